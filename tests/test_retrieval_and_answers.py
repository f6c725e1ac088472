"""Search, rerank, answers, evaluation: golden cases."""

from pyspark.sql import functions as F

from corvane.operators import answer as A
from corvane.operators import evaluate, rerank, search


def test_rerank(spark):
    rows = [("q", f"p{i}", i + 1, s) for i, s in enumerate([0.4, 0.05, 0.9, 0.5, 0.4])]
    df = spark.createDataFrame(rows, "qid string, page_id string, rank int, score double")
    names = lambda **k: [r.page_id for r in rerank.rerank(df, None, **k).orderBy("rank").collect()]
    assert names(score_min=0.3) == ["p2", "p3", "p0", "p4"]
    assert names(score_min=0.4) == ["p2", "p3", "p0", "p4"]  # the bound itself stays
    assert names(score_min=0.3, top_n=2) == ["p2", "p3"] and names(top_n=0, score_min=0.0) == ["p2", "p3", "p0", "p4", "p1"]
    assert names(score_min=0.95) == [] and names(score_min=None) == ["p2", "p3", "p0", "p4"]
    assert rerank.rerank(df.limit(0), None).collect() == []


def sources(spark):
    rows = [("q", i, f"p{min(i, 3)}", f"T{i}", f"u{i}", "d", f"text {i}") for i in range(1, 5)]
    return spark.createDataFrame(rows, "qid string, rank int, page_id string, title string, url string, last_modified string, text string")


def cited(spark, text):
    got = A.citations(spark.createDataFrame([("q", text)], "qid string, answer string"), sources(spark))
    return [(r.page_id, r.title) for r in got.orderBy("place").collect()]


def test_citations(spark):
    assert cited(spark, "See [1] and [3], [1].") == [("p1", "T1"), ("p3", "T3")]
    assert cited(spark, "[4] then [3]") == [("p3", "T4")]
    assert cited(spark, "none") == [("p1", "T1"), ("p2", "T2"), ("p3", "T3")]
    assert cited(spark, "[9] [99999999999]") == []


def test_answers(spark):
    asked = spark.createDataFrame([("q", "Was?"), ("bare", "Wie?"), ("blank", " ")], "qid string, question string")

    def run(reply):
        return {r.qid: r for r in A.answer(asked, sources(spark), lambda q, c: F.lit(reply).cast("string")).collect()}

    got = run("Die Antwort steht hier [2]. ")
    assert set(got) == {"q", "bare"}
    assert (got["q"].answer, got["q"].used_context, [c.page_id for c in got["q"].citations]) == ("Die Antwort steht hier [2].", True, ["p2"])
    assert (got["bare"].answer, got["bare"].used_context, got["bare"].citations) == (A.NO_CONTEXT, False, [])
    for reply in (None, " ", A.NO_CONTEXT + " Und mehr [1]."):
        r = run(reply)["q"]
        assert (r.answer, r.used_context, r.citations) == (A.NO_CONTEXT, False, [])


def test_the_generator_runs_once_a_question(spark):
    """And never for questions without sources."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    seen = spark.sparkContext.accumulator(0)

    def generate(question, context):
        @pandas_udf("string")
        def say(q: pd.Series, c: pd.Series) -> pd.Series:
            seen.add(len(q))
            assert c.notna().all()
            return q + " [1]"

        return say(question, context)

    asked = spark.createDataFrame([(f"q{i}", f"Was {i}?") for i in range(20)] + [("bare", "Wie?")], "qid string, question string")
    many = asked.where("qid <> 'bare'").crossJoin(sources(spark).drop("qid"))
    got = A.answer(asked, many, generate).collect()
    assert len(got) == 21 and sum(r.used_context for r in got) == 20 and all(len(r.citations) == r.used_context for r in got)
    assert seen.value == 20


def test_bm25_against_plain_sums(spark):
    """Texts of all lengths, repeated and empty ones, questions without a known term, from texts and from stored terms."""
    import math
    import random
    import re
    from collections import Counter

    from corvane.operators.index import with_sparse

    r = random.Random(3)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "Gamma", "delta,", "épsilon", "x1"]) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(90, None), (91, "...")]
    asked = [(0, "alpha beta"), (1, "Épsilon X1 x1"), (2, "nothing here"), (3, ""), (4, None)]
    df = spark.createDataFrame(texts, "key long, text string").repartition(3)
    words = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in texts}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, text in asked:
        for t in dict.fromkeys(re.findall(r"[^\W_]+", (text or "").lower())):
            n = sum(t in w for w in words.values())
            for k, w in words.items():
                if tf := Counter(w)[t]:
                    want[q, k] = want.get((q, k), 0) + math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    questions = spark.createDataFrame(asked, "qid int, question string")
    for frame in (df, with_sparse(df)):
        got = {(x.qid, x.key): x.score for x in search.bm25(questions, frame, 1000, key="key").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
        top = search.bm25(questions, frame, 3, key="key").collect()
        assert {(x.qid, x.key) for x in top} == {(q, k) for q in range(5) for _, k in sorted((-s, k) for (p, k), s in want.items() if p == q)[:3]}
    stored = {x.key: dict(zip(x.terms, x.tfs, strict=True)) for x in with_sparse(df).collect()}
    assert stored == {k: dict(Counter(w)) for k, w in words.items()}


def test_dense_leaves_out_what_has_no_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [1.0, 1.0, 1.0]), (6, [-1e200, 1e-200]), (7, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "key long, vec array<double>")
    asked = spark.createDataFrame([(0, [3.0, 0.0]), (1, None), (2, [0.0, 0.0])], "qid int, qvec array<double>")
    got = [(r.qid, r.key, r.score, r["rank"]) for r in search.dense(asked, df, 2, key="key", vector="vec").orderBy("rank").collect()]
    assert got == [(0, 1, 1.0, 1), (0, 7, 1.0, 2)]


def test_source_block(spark):
    [r] = A.source_blocks(sources(spark)).collect()
    assert r.context.startswith("[1] Titel: T1 | URL: u1\ntext 1\n\n---\n\n[2] Titel: T2") and r.n == 4


def test_metrics(spark):
    results = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "z", 1), ("c", "w", 1)], "qid string, page_id string, rank int")
    asked = spark.createDataFrame([("a", ["y", "none"]), ("b", ["z"]), ("c", ["no"]), ("d", ["no"])], "qid string, gold_page_ids array<string>")
    firsts = evaluate.first_gold(evaluate.page_ranks(results), asked)
    assert {r.qid: r["first"] for r in firsts.collect()} == {"a": 2, "b": 1, "c": 0, "d": 0}
    assert tuple(evaluate.metrics(firsts, 1).first()) == (0.25, 0.375)
    assert {r.qid for r in evaluate.misses(firsts, 1).collect()} == {"a", "c", "d"}


def test_hybrid_filters_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(f"c{i}", "s1" if i % 2 else "s2", f"alpha word{i} {'beta' if i < 4 else ''}", [float(i), 1.0]) for i in range(12)], "chunk_id string, space_key string, text string, dense array<double>")
    asked = spark.createDataFrame([(q, "beta alpha", [3.0, 1.0]) for q in range(5)], "qid int, question string, qvec array<double>")
    whole = sorted(map(tuple, search.hybrid(asked, docs, 4).collect()))
    monkeypatch.setattr(search, "QUESTION_BLOCK", 2)
    assert sorted(map(tuple, search.hybrid(asked, docs, 4).collect())) == whole and len(whole) == 20
    only = search.hybrid(asked, docs, 4, ["s1"]).join(docs, "chunk_id")
    assert {r.space_key for r in only.collect()} == {"s1"}
    assert search.hybrid(asked, docs, 4, []).count() == 20


def test_searches_in_small_tiles_find_the_same(spark, monkeypatch):
    """Tiles of few pairs, common terms by product and others by pairs, copies beyond what is held back: all as in one piece; texts are cut into terms once."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, range(60, 0, -1), k=r.randint(0, 40))) for _ in range(150)]
    rows = [(i, "s", texts[i % 100] if i < 200 else texts[i - 200], [r.gauss(0, 1) for _ in range(4)]) for i in range(350)]
    docs = spark.createDataFrame(rows, "key long, space_key string, text string, dense array<double>").repartition(2).cache()
    asked = docs.where("key % 5 = 0").selectExpr("key AS qid", "text AS question", "dense AS qvec")
    legs = lambda: [sorted(map(tuple, f.collect())) for f in (search.bm25(asked, docs, 5, "key", digits=6), search.dense(asked, docs, 5, "key", digits=6))]
    monkeypatch.setattr(search, "COMMON", 0)
    whole = legs()
    for name, value in (("TILE", 300), ("HELD", 0), ("ADDED", 50), ("COMMON", 7), ("QUESTION_BLOCK", 30)):
        monkeypatch.setattr(search, name, value)
    cut = []
    pack = search.packed
    monkeypatch.setattr(search, "packed", lambda *a: (cut.append(1), pack(*a))[1])
    assert legs() == whole and len(whole[1]) == 350 and cut == [1]
    best = search.Best(2, 0.0, search.pa.array([0, 1]), ["qid", "key", "score"], 0.0)
    out = [b for lo in range(0, 4000, 10) for b in best.add(search.pa.array(range(lo, lo + 10)), search.np.ones((10, 2)))]
    assert best.n <= best.most and sum(b.num_rows for b in [*out, *best.rest()]) == 8000  # ties are never lost, nor all held


def test_a_task_scores_in_bounded_memory():
    """A full block of questions against a batch: no array of all their pairs, which were 64 MB for 2,048 rows, is ever made."""
    import tracemalloc

    np, pa = search.np, search.pa
    n, r = search.QUESTION_BLOCK, np.random.default_rng(1)
    best = search.Best(20, 1e-6, pa.array(range(n)), ["qid", "key", "score"], np.nextafter(0.0, 1.0))
    key = pa.array(range(search.SCORED))
    asking, at = np.tile(np.arange(n), 4), np.arange(5) * n
    tracemalloc.start()
    rows = []
    for a, b in search.tiles(pa.RecordBatch.from_arrays([key], names=["key"]), n):
        rows.append(b - a)
        scores = np.zeros((b - a, n))
        search.add_pairs(scores, np.repeat(np.arange(b - a), 4), np.tile(np.arange(4), b - a), r.random(4 * (b - a)), asking, at, np.diff(at))
        for _ in best.add(key.slice(a, b - a), scores):
            pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == search.SCORED and max(rows) * n <= search.TILE and peak < 64 << 20, peak
