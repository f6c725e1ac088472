"""Quality classifier (5): held-out accuracy, and the parts."""

import zlib

import numpy as np

from pyspark.sql import functions as F

from corvane.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [d for d in known if got[d].held_out]
    assert np.mean([got[d].predicted == known[d] for d in held]) > 0.95
    good, bad = ([got[d].score for d in held if known[d] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, ("good text of words " * 9) if i % 2 else ("BAD### " * 30)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(80)], "doc_id long, quality int")
    a, b = (sorted(map(tuple, quality.classify(docs, label(f)).collect())) for f in (False, True))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "text"), (1, None), (4, "x" * 200_000), (5, "a b. " * 20)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(5, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    model = quality.fit(docs, labels)
    assert quality.kept(docs, model, 0.0).count() == len(rows)


def test_isotonic():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.ones(5)).round(9).tolist() == [0.1, *[round(1 / 3, 9)] * 3, 0.9]


def test_fit_against_a_plain_solve(spark):
    """Statistics' moments, equations of folds and the calibration, without partitions."""
    import math

    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs.repartition(5), labels)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("fold")
    rows = docs.join(labels.where(~quality.held_out(F.col("doc_id"))), "doc_id").where("quality is not null").select("text", "quality", fold).collect()
    x = np.array([quality.statistics(np.frombuffer(r.text.encode(), np.uint8)) for r in rows])
    y, folds = np.array([float(r.quality) for r in rows]), np.array([r.fold for r in rows])
    deviation = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, deviation)
    z = np.clip((x - x.mean(0)) / deviation, -8, 8)
    f = np.array([[1.0, *(math.sqrt(2 / quality.FEATURES) * math.cos(v) for v in row)] for row in z @ model.weight + model.phase])

    def solve(of):
        ridge = np.eye(f.shape[1]) * quality.RIDGE * of.sum()
        ridge[0, 0] = 1e-9 * of.sum()
        return np.linalg.solve(f[of].T @ f[of] + ridge, f[of].T @ y[of])

    beta = solve(np.ones(len(y), bool))
    assert np.allclose(f @ model.beta, f @ beta, atol=1e-6)
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        raw[folds == k] = f[folds == k] @ solve(folds != k)
    bins = np.clip(np.floor((raw + 0.5) / 2 * quality.BINS), 0, quality.BINS - 1)
    means = [(raw[bins == b].mean(), y[bins == b].mean(), (bins == b).sum()) for b in np.unique(bins)]
    knots, values, n = map(np.array, zip(*means, strict=True))
    fitted = values.astype(float)
    for i in range(len(fitted)):  # the min-max formula of isotonic regression
        fitted[i] = max(min(np.average(values[a : b + 1], weights=n[a : b + 1]) for b in range(i, len(values))) for a in range(i + 1))
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.values, fitted, atol=1e-6)
