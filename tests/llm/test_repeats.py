"""Suffix-array dedup (4) and substring dedup (9) against brute force."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from corvane.llm import substring, suffix, windows


def brute_bytes(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, length):
    first = {}
    last = 1 << 62
    split = [(last if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d0, _), (d, w) in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (d, i):
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d0, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(k))
    passages = [text(r.randint(15, 90)) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.3:
            t = text(r.randint(0, 120)) + r.choice(passages) + text(r.randint(0, 60))
        elif kind < 0.5 and rows:
            t = r.choice(rows)[1] or ""
            w = t.split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif kind < 0.6:
            t = (r.choice(words) + " ") * r.randint(5, 150)
        elif kind < 0.7:
            t = (text(r.randint(3, 9))) * r.randint(5, 20)
        else:
            t = text(r.randint(0, 200))
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (3, rows[3][1]), (3, "x" + text(80)), (None, rows[5][1]), (n + 2, "z" * 3000), (n + 3, "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, tag string").repartition(3)
    got = suffix.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_bytes(rows, 200))


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_words(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, spans int").repartition(3)
    got = substring.drop_repeats(docs).collect()
    assert Counter(map(tuple, got)) == Counter(brute_words(rows, 20))


def test_pieces_and_hot_anchors(spark, monkeypatch):
    """In-process: texts cut into small pieces give the anchors that whole ones give."""
    import numpy as np

    r = np.random.default_rng(3)
    data = r.integers(97, 101, 5000).astype(np.uint8)
    at = np.array([0, 3000, 3000, 3100, 5000])
    spec = windows.Spec(200, 64, words=False, ordered=False)
    whole = windows.batch_anchors(data, at, spec)
    monkeypatch.setattr(windows, "PIECE", 450)
    cut = windows.batch_anchors(data, at, spec)
    for a, b in zip(whole, cut, strict=True):
        assert (a == b).all()


def test_with_text_keeps_characters(spark):
    shared = "é" * 150
    rows = [(1, "aé" + shared), (2, "bb" + shared + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix.drop_repeats(docs, with_text=True).collect()}
    assert got[1].startswith("a") and got[2] == "bbtail"


@pytest.mark.parametrize("op", [suffix, substring])
def test_empty_table(spark, op):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.drop_repeats(docs).collect() == []


def test_hot_extents(spark):
    """One passage in very many texts, each with other neighbours, in more than one batch."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefg ") for _ in range(400))
    rows = [(i, f"{r.random()} {r.random()} " + passage + f" {r.random()} {r.random()}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffix.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_bytes(rows, 200))
    got = substring.drop_repeats(docs).collect()
    assert Counter(map(tuple, got)) == Counter(brute_words(rows, 20))


def test_offset_ranges():
    for side in (1, 2, 3, 15, 136):
        flat = [o for a, b in windows.offset_ranges(side) for o in range(a, b + 1)]
        assert sorted(flat) == list(range(side + 1))
    assert len(windows.offset_ranges(136)) < 20


@pytest.mark.parametrize("ordered", [False, True])
def test_hot_contexts_give_what_plain_ones_give(ordered):
    """The rows of a hot anchor, dealt by ranges of offsets, flag the windows that a plain comparison flags."""
    import numpy as np

    spec = windows.Spec(20, 5, words=True, ordered=ordered)
    r = np.random.default_rng(8)
    n, side = 400, spec.side
    words = r.integers(1, 3, (n, 2 * side)).astype(np.uint64)
    words[:, side : side + 9] = 7
    words[::3, side - 6 : side] = 7
    doc, pos = np.sort(r.integers(0, 150, n)), r.integers(20, 60, n)
    _, first = np.unique((doc << 32) | pos, return_index=True)
    words, doc, pos = words[first], doc[first], pos[first]
    n = len(first)
    rows = {"ah": np.full(n, 5, np.int64), "nul": np.zeros(n, bool), "doc": doc, "key": doc * 3, "rank": doc, "pos": pos, "from": side - r.integers(8, side + 1, n), "to": r.integers(8, side + 1, n), "context": words.view(np.uint8).reshape(n, -1)}
    wanted = set()
    for o in range(side + 1):
        ok = [i for i in range(n) if rows["from"][i] <= o <= rows["to"][i]]
        seen = {}
        for i in ok:
            seen.setdefault(words[i, side - o : 2 * side - o].tobytes(), []).append(i)
        for same in seen.values():
            wanted |= {(int(doc[i]), int(pos[i]) - o) for i in (same[1:] if ordered else same * (len(same) > 1))}

    class Frame:
        """compared() without Spark."""

        def __init__(self, batches):
            self.batches = batches

        def repartition(self, *_):
            t = pa.Table.from_batches(self.batches).combine_chunks()
            order = np.lexsort((t["at"].to_numpy(), t["key"].to_numpy(), t["doc"].to_numpy(), t["route"].to_numpy()))
            return Frame(t.take(pa.array(order)).combine_chunks().to_batches())

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter(self.batches)))

    def flagged(hot, monkeypatch=None):
        made = list(windows.dealt_contexts(rows | {"hot": np.full(n, hot)}, spec))
        repeated = substring.extended if ordered else suffix_like
        out = set()
        for b in windows.compared(Frame(made), repeated, spec):
            for d, lo, hi in zip(*(b.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                out |= {(d, x) for x in range(lo, hi + 1)}
        return out

    def suffix_like(route, place, ok, context):
        w = np.ascontiguousarray(context).view(np.uint64).reshape(len(route), -1)
        width = w.shape[1] // 2
        flags = np.zeros_like(ok)
        for o in range(width + 1):
            name = lambda i, o=o: (route[i], w[i, width - o : 2 * width - o].tobytes())
            seen = Counter(map(name, np.flatnonzero(ok[:, o])))
            for i in np.flatnonzero(ok[:, o]):
                flags[i, o] = seen[name(i)] > 1
        return flags

    import pyspark.sql.functions as F

    original = F.shiftright
    F.shiftright = lambda *_: None
    try:
        assert flagged(False) == wanted and flagged(True) == wanted
    finally:
        F.shiftright = original


def test_radix_passes():
    """Groups of windows against a plain comparison, and rows in the order of their bytes."""
    import numpy as np

    r = np.random.default_rng(5)
    for w in (0, 1, 7, 8, 9, 30):
        n = 120
        context = r.integers(97, 99, (n, 2 * w)).astype(np.uint8)
        context[::4] = context[0] if w else context[::4]
        route = r.integers(0, 4, n)
        ok = r.random((n, w + 1)) < 0.8
        flags = suffix.radix_groups(route, np.arange(n), ok, context)
        for o in range(w + 1):
            name = lambda i, o=o: (route[i], context[i, w - o : 2 * w - o].tobytes())
            seen = Counter(map(name, np.flatnonzero(ok[:, o])))
            assert all(flags[i, o] == (ok[i, o] and seen[name(i)] > 1) for i in range(n))
        order, parts = suffix.radix_order(route, context)
        rows = [(route[i], context[i].tobytes()) for i in order]
        assert rows == sorted(rows)
        for (a, x), (b, y), p in zip(rows, rows[1:], parts[1:].tolist(), strict=False):
            same = next((k for k in range(2 * w) if x[k] != y[k]), suffix.NEVER)
            assert p == (same if a == b else -1)


@pytest.mark.parametrize("op,brute,length", [(suffix, brute_bytes, 200), (substring, None, 20)])
def test_rows_without_ids_and_shared_ids(spark, op, brute, length):
    """Many rows without doc_id, or with the same one, are judged each by its own text."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(50)) for _ in range(40)]
    texts = [t + " " + passage + " " + word() if i % 4 == 0 else t for i, t in enumerate(texts)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)] + [((1 << 63) - 1, texts[3]), (None, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op.drop_repeats(docs, with_text=True).collect()
    assert len(got) == len(rows) and sum(x.doc_id == (1 << 63) - 1 for x in got) == 1
    if brute:
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert Counter(tuple(x[c] for c in names) for x in got) == Counter(brute(rows, length))
        return
    # By words, of the rows with the passage exactly one keeps it, and copies without an id are the later ones.
    assert sum(passage in x.kept for x in got) == 1
    untouched = Counter(t for t in texts if passage not in t)
    kept = Counter(x.kept for x in got)
    assert all(kept[t] >= 1 for t in untouched) and kept[texts[3]] == 1


def test_one_passage_in_tasks_of_many_batches(spark, monkeypatch):
    """Groups that come in parts, and hot anchors that a task has told of before."""
    monkeypatch.setattr(windows, "MOST_ROWS", 40)
    r = random.Random(10)
    passage = "".join(r.choice("abcdefg ") for _ in range(400))
    rows = [(i if i % 3 else None, f"{r.random()} " * (i % 2) + passage + f" {r.random()} {r.random()}" * (i % 4)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 90)
    try:
        got = suffix.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert Counter(map(tuple, got)) == Counter(brute_bytes(rows, 200))
        named = [x for x in rows if x[0] is not None]
        got = substring.drop_repeats(spark.createDataFrame(named, "doc_id long, text string").repartition(2)).collect()
        assert Counter(map(tuple, got)) == Counter(brute_words(named, 20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parts_of_groups():
    import numpy as np

    key, eh = np.array([1, 1, 2, 2, 2, 2, 2, 2, 2, 3]), np.array([0, 1, 0, 0, 0, 1, 1, 2, 2, 0])
    t = pa.table({"key": key, "eh": eh}).to_batches(max_chunksize=2)
    for most in (None, 2, 3, 4):
        got = list(windows.groups(iter(t), 0, 2, most, 1))
        assert np.concatenate([r[0] for r, _ in got]).tolist() == key.tolist() and np.concatenate([r[1] for r, _ in got]).tolist() == eh.tolist()
        for (a, partly), (b, _) in zip(got, got[1:], strict=False):
            assert (a[0][-1] == b[0][0]) == partly


@pytest.mark.parametrize("seed", [11, 12])
def test_all_anchors_hot(spark, seed, monkeypatch):
    """With every anchor dealt as a hot one, results stay the same."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    settle = windows.settle
    monkeypatch.setattr(windows, "settle", lambda found, spec: hot_kind(settle(found, spec)))
    got = suffix.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_bytes(rows, 200))
    got = substring.drop_repeats(docs).collect()
    assert Counter(map(tuple, got)) == Counter(brute_words(rows, 20))


def hot_kind(settled):
    from pyspark.sql import functions as F

    return settled.withColumn("at", F.col("at").bitwiseOR(windows.HOT))
