"""Mixing (2) against a plain version."""

import hashlib
import re
from collections import defaultdict

from corvane.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def plain_mix(rows):
    """doc_id to copies."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in rows}
    of = defaultdict(list)
    for d, s, _ in rows:
        of[s].append(d)
    total = {s: sum(size[d] for d in ds) for s, ds in of.items()}
    target = plain_targets(total)
    out = {}
    for s, ds in of.items():
        ratio = target[s] / total[s] if total[s] else 0
        more, below = target[s] - int(ratio) * total[s], 0
        for d in sorted(ds, key=lambda d: hashlib.md5(f"7:{d}".encode()).hexdigest()):
            out[d] = int(ratio) + (below + size[d] / 2 < more)
            below += size[d]
    return out


def test_against_plain(spark):
    rows = [(i, None if i % 7 == 0 else ("hot" if i % 3 else f"s{i % 5}"), None if i == 4 else "w " * (i * i % 97) + "x y") for i in range(200)]
    rows += [(500, "tiny", "one"), (501, "empty", ""), (502, "empty", "  \n")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, text string, target string").repartition(3)
    got = {r.doc_id: r for r in mixing.plan(docs).collect()}
    want = plain_mix(rows)
    assert {d: r.copies for d, r in got.items()} == want
    taken, goal = defaultdict(int), {}
    for r in got.values():
        taken[r.source] += r.copies * r.size
        goal[r.source] = r.target
        assert r.target <= 2 * r.source_size and r.copies <= 2
    assert abs(sum(goal.values()) - 1.5 * sum(r.size for r in got.values())) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(want.values())


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z")], "doc_id long, source string, text string")
    assert mixing.plan(docs).count() == 3
    assert mixing.plan(docs.limit(0)).collect() == []
    assert mixing.mix(docs.limit(0)).collect() == []
