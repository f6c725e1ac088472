"""Near copies by Jaccard similarity, against all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corvane.llm import near

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS).repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == plain_kept(rows)


def test_stage_against_all_pairs(spark):
    """Chains of edits about the threshold, a common passage, copies, texts of few words and none."""
    r = random.Random(8)
    word = lambda: f"Wörd{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = ["", None, " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(120):
        w = [word() for _ in range(r.choice([6, 30, 120]))] + (passage if r.random() < 0.5 else [])
        texts.append(" ".join(w))
        for _ in range(r.choice([0, 1, 3])):
            for _ in range(r.choice([0, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    check(spark, list(enumerate(texts)))


def test_large_group_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "DIRECT", 2)
    monkeypatch.setattr(near, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        w = list(base)
        for i in r.sample(range(100), r.choice([1, 2, 3, 6])):
            w[i] = f"x{r.randrange(1000)}"
        texts.append(" ".join(w[: r.choice([100, 90, 80])]))
    check(spark, list(enumerate(texts)))


def test_blocks_of_a_bucket_meet_all_that_sizes_allow():
    for sizes in ([5], [4, 5, 5, 6, 7, 9, 30], list(range(1, 41)), [7] * 16):
        n = np.sort(np.array(sizes))
        rows = near.blocked(np.arange(len(n)), np.zeros(len(n), np.int64), n, 4).to_pylist()
        for x in rows:
            for y in rows:
                if near.DENOMINATOR * min(x["size"], y["size"]) >= near.NUMERATOR * max(x["size"], y["size"]):
                    assert x["low"] <= y["block"] <= x["high"]
                assert (x["low"] <= y["block"] <= x["high"]) == (y["low"] <= x["block"] <= y["high"])


def test_near_copies_beyond_three_bits(spark):
    """Documents 145 and 6, 177 and 1 of the smallest tables have similarity 0.83 and lie further apart than three bits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id in (1, 6, 145, 177)")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == [1, 6]


def test_simhash_meets_first_and_the_rest_completes(spark, monkeypatch):
    """Pairs within three bits come from the fingerprints, and what those connect is not compared again."""
    r = random.Random(11)
    base = [[f"w{r.randrange(5000)}" for _ in range(400)] for _ in range(30)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for n in (1, 2, 12):
            v = list(w)
            for i in r.sample(range(400), n):
                v[i] = f"x{r.randrange(5000)}"
            texts.append(" ".join(v))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    keyed = near.keys(docs)
    prints = {x.fp: x.print % 2**64 for x in keyed.collect()}
    close = {frozenset(p) for p in combinations(prints, 2) if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 3}
    met = {frozenset((x.a, x.b)) for x in near.close_prints(keyed.select("fp", "print").distinct()).collect()}
    assert met and near_groups(met) == near_groups(close) and len(near_groups(close)) <= 30
    seen = []
    whole = near.likely
    monkeypatch.setattr(near, "likely", lambda pairs, sketches: (seen.append({frozenset((x.a, x.b)) for x in pairs.collect()}), whole(pairs, sketches))[1])
    linked = {frozenset((x.a, x.b)) for x in near.edges(docs, keyed).collect()}
    assert seen[0] == met and seen[1] and not any(p <= g for p in seen[1] for g in near_groups(met & linked))
    check(spark, list(enumerate(texts)))


def near_groups(pairs):
    groups = []
    for p in pairs:
        hit = [g for g in groups if g & p]
        groups = [g for g in groups if not g & p] + [frozenset(p).union(*hit)]
    return set(groups)


def long_rows():
    rng = random.Random(5)
    return [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(60)) if i % 3 else "the same words in every third of all texts, again and again and again") for i in range(90)]


def test_few_rows_go_into_few_files(spark, tmp_path):
    """Each file of a checkpoint costs a task, and on a local disk a process of the executor."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(spark, long_rows())
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        if before:
            spark.sparkContext.setCheckpointDir(before.rsplit("/", 1)[0])
    most = {}
    for f in tmp_path.rglob("part-*"):
        most[f.parent] = most.get(f.parent, 0) + 1
    assert most and max(most.values()) <= 2 * spark.sparkContext.defaultParallelism


def test_a_batch_is_taken_up_in_parts(monkeypatch):
    """The steps over texts give the same rows whatever the size of the parts, and hold the shingles of one part."""
    steps = []

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            steps.append(run)
            return self

        def __getattr__(self, name):
            return lambda *a, **b: [] if name == "collect" else self

    for of in (near.keys, near.common_shingles, lambda d: near.first_shingles(d, np.zeros(0, near.U), np.zeros(0, np.int64)), lambda d: near.keyed_texts(d, d)):
        of(Docs())
    text = pa.array([t for _, t in long_rows()])
    wide = pa.RecordBatch.from_arrays([pa.array(range(len(text))), text], names=["doc_id", "text"])
    held, whole = [], near.shingles
    monkeypatch.setattr(near, "shingles", lambda data, at: (held.append(int(at[-1] - at[0])), whole(data, at))[1])
    found = []
    for size in (1 << 21, 1000):
        held.clear()
        monkeypatch.setattr(near, "TEXT", size)
        found.append([pa.Table.from_batches(run(iter([wide if run is steps[0] else wide.select(["text"])]))).to_pylist() for run in steps])
        assert max(held) <= size
    assert found[0] == found[1] and all(found[0])
