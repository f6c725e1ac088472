"""Nearest neighbours (1) against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import ann


def plain(vectors, k=5, every=50):
    out = []
    for q, v in vectors.items():
        if q % every:
            continue
        scored = sorted((-float(np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w))), i) for i, w in vectors.items() if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BASE_BLOCK", 700)
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 24))
    vectors = {i: (centres[i % 12] + 0.5 * r.standard_normal(24)).astype(np.float32).astype(float) for i in range(2000)}
    docs = spark.createDataFrame([(i, v.tolist(), 1, b"x") for i, v in vectors.items()], "vec_id long, embedding array<float>, dim int, code binary").repartition(3)
    got = {(x.query_id, x.rank): x for x in ann.nearest(docs, F.col("vec_id") % 50 == 0).collect()}
    want = plain(vectors)
    assert len(got) == len(want)
    hits = sum(got[q, n].vec_id == i for q, n, i, _ in want)
    assert hits >= 0.995 * len(want)
    for x in got.values():
        a, b = vectors[x.query_id], vectors[x.vec_id]
        assert abs(x.score - np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))) < 1e-12


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [4.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (0, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, []), (100, [float("inf"), 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.nearest(docs, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 8, -1.0)]
    assert ann.nearest(docs.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_large_and_small_components(spark):
    """Squares that overflow or vanish change nothing."""
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [2.0, 1.0]), (3, [-1e300, 1e300]), (4, [5e-324, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(docs, F.col("vec_id") == 0).collect()))
    assert [x[2] for x in got] == [1, 2, 4, 3]
    for (_, _, _, score), want in zip(got, (1.0, 0.8, 1 / math.sqrt(5), 1 / math.sqrt(10)), strict=True):
        assert abs(score - want) < 1e-12


def test_few_pairs_are_reranked_and_none_is_lost(spark):
    """On the fixture's vectors: all neighbours by the bounds, with less than a tenth of the pairs reranked, in blocks of any size."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    asked = ids % 50 == 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit[asked] @ unit.T
    cosine[np.arange(asked.sum()), np.flatnonzero(asked)] = -2
    want = {q: set(ids[np.argsort(-c)[:5]].tolist()) for q, c in zip(ids[asked].tolist(), cosine, strict=True)}
    for size in (len(ids), 300):
        found, reranked = {q: [] for q in want}, 0
        for lo in range(0, len(ids), size):
            part = slice(lo, lo + size)
            block = ann.Block(ids[part], x[part], *ann.encoded(x[part]))
            for q, i, s in zip(*block.search(ids[asked], x[asked], 5), strict=True):
                found[q].append((-s, i))
            reranked += block.reranked
        hits = sum(len(want[q] & {i for _, i in sorted(found[q])[:5]}) for q in want)
        assert hits == 5 * len(want)
        if size == len(ids):
            assert reranked < 0.1 * asked.sum() * len(ids)


def test_bounds_hold():
    """The exact cosine lies within the error bound of its estimate."""
    r = np.random.default_rng(4)
    d = 64
    x, q = r.standard_normal((3000, d)), r.standard_normal((40, d))
    x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    code, scale = ann.encoded(x)
    block = ann.Block(np.arange(3000), x, code, scale)
    turned = (q @ ann.rotation(d).T).T.astype(np.float32) / np.float32(math.sqrt(d * ann.EXPAND))
    estimate = np.concatenate([e for _, e in block.estimates(turned)])
    assert (np.abs(estimate - x @ q.T) <= block.bound[:, None]).mean() > 0.9999
