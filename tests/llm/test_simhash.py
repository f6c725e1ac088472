"""SimHash near-dedup (8) against all pairs."""

import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from corvane.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_against_all_pairs(spark):
    r = random.Random(5)
    words = [f"{'Wx'[i % 2]}ord{i}" for i in range(50)]
    rows = []
    for i in range(300):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split(" ")
            if r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 80, 200])))))
    rows += [(900, None), (901, ""), (902, " \n"), (5, "another text under one id"), (None, rows[3][1]), (None, "alone " * 3), (None, "alone " * 3), (7, rows[7][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, root int").repartition(3)
    got = sorted(map(tuple, simhash.groups(docs).collect()), key=repr)
    assert got == sorted(plain_groups(rows), key=repr)
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert sorted(d for d in kept if d is not None) == sorted({d for d, _, c in plain_groups(rows) if d is not None and d == c})
    assert kept.count(None) == 1  # the text that no row with an id is near


def test_dense_balls_lose_no_link(spark):
    """Many fingerprints about few centres, so that buckets are divided."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(1500):
            x = c
            for b in rng.choice(12, rng.integers(0, 7), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps |= set(rng.integers(0, 1 << 63, 300).tolist())
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    from corvane.llm.components import components

    root = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    x = np.array(fps, np.uint64)
    label = np.arange(len(x))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    got = {}
    for f, i in zip(fps, label.tolist(), strict=True):
        got.setdefault(i, set()).add(root.get(f, f))
    assert all(len(s) == 1 for s in got.values()) and len({s for x in got.values() for s in x}) == len(got)


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain(spark):
    from corvane.llm.components import components

    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_names_that_clash_and_rows_that_share_an_id(spark):
    rows = [(1, "a b c d", "x", 1), (1, "a b c e f g", "y", 2), (None, "q r s t", "z", 3), (None, "q r s t", "w", 4), (5, "a b c d", "v", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _root string, _fp int").withColumn("_doc", F.lit(1)).withColumn("_n", F.lit(2)).withColumn("_row", F.lit(3))
    got = [sorted(map(repr, simhash.deduplicated(docs.repartition(n)).collect())) for n in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 2


def test_the_largest_id_is_an_id(spark):
    docs = spark.createDataFrame([((1 << 63) - 1, "a b c"), (None, "a b c"), (None, "d e f g")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.groups(docs).collect()), key=repr)
    assert got == sorted([((1 << 63) - 1, (1 << 63) - 1), (None, (1 << 63) - 1), (None, None)], key=repr)
