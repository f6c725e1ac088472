"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics are few and cheap. Scaled by the labelled rows' mean and deviation, they go through random Fourier
features, whose inner products approximate a Gaussian kernel. Each partition of labelled rows adds up its part of the
normal equations, fold by fold; the sums are small and of fixed size. Ridge scores are calibrated by isotonic regression
over a fixed number of bins, on scores that each row gets from the equations of the other folds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, text_or_empty

#: Random features, kernel width in deviations, ridge penalty a row, bins of the calibration, score from which a text is kept.
FEATURES, WIDTH, RIDGE, BINS, KEEP = 256, 4.0, 1e-4, 512, 0.3
#: At most about so many labelled rows are fitted; beyond, those of smallest hashed id, which is the documented bound.
#: So the labels that are learnt from can be broadcast, and no text moves to meet its label.
MOST_ROWS = 200_000
#: The bounded rows are summed in so many parts, and the parts added up in so many groups of rows of the matrix.
SLICES, STRIPES = 32, 16
#: Parts of the labelled rows, by hashed id, of which each is scored by the others for the calibration.
FOLDS = 3
_SEED = 5

#: Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence punctuation, 6 symbol, 7 part of a character beyond ASCII.
CLASS = np.zeros(256, np.uint8)
CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
CLASS[[ord(c) for c in "0123456789"]] = 3
CLASS[[32, *range(9, 14)]] = 4
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
CLASS[128:] = 7

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_deviation", "lower", "upper", "digit", "sentence_marks", "symbols", "beyond_ascii", "white",
    "lines_a_word", "ends_in_mark", "distinct_words", "top_word", "repeats_next", "symbol_words", "upper_words", "short_words", "pair_variety", "worst_part_symbols", "worst_part_upper", "worst_part_repeats",
)
PARTS = 8


def statistics(text: np.ndarray) -> np.ndarray:
    """The statistics of a whole text; zeros for an empty one."""
    out = np.zeros(len(STATISTICS))
    n = len(text)
    if not n:
        return out
    kind = CLASS[text]
    share = np.bincount(kind, minlength=8) / n
    raw = text.tobytes()
    words = raw.split()
    m = len(words)
    out[0], out[1] = math.log1p(n), math.log1p(m)
    out[4:11] = share[[1, 2, 3, 5, 6, 7, 4]]
    if not m:
        return out
    size = np.fromiter(map(len, words), np.int64, m)
    out[2], out[3] = size.mean(), size.std()
    out[11] = raw.count(b"\n") / m
    out[12] = float(raw.rstrip()[-1:] in b".!?")
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, m)
    out[13] = len(number) / m**0.8
    out[14] = np.bincount(ids).max() / m
    again = np.zeros(m, bool)
    again[1:] = ids[1:] == ids[:-1]
    out[15] = again.mean()
    white = kind == 4
    at = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    symbols = np.add.reduceat(kind == 6, at, dtype=np.int64) > 0
    upper = (np.add.reduceat(kind == 2, at, dtype=np.int64) >= 2) & (np.add.reduceat(kind == 1, at, dtype=np.int64) == 0)
    out[16], out[17], out[18] = symbols.mean(), upper.mean(), (size <= 2).mean()
    pairs = ids[:-1] * m + ids[1:]
    out[19] = len(np.unique(pairs)) / max(1, m - 1)
    edges = np.linspace(0, m, min(PARTS, -(-m // 16)) + 1).astype(np.int64)[:-1]
    width = np.diff(np.append(edges, m))
    for k, flags in ((20, symbols), (21, upper), (22, again)):
        out[k] = (np.add.reduceat(flags, edges, dtype=np.int64) / width).max()
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # random directions, a column each
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray  # raw scores and what they are calibrated to
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.ones((len(x), 1)), math.sqrt(2 / len(self.phase)) * np.cos(z @ self.weight + self.phase)), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing values."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, v) for v, _, n in pools]) if pools else value


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from: crc32 of the id as text, modulo 5, is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def measured(docs: DataFrame, label: str) -> DataFrame:
    """(label, fold, x array of statistics) of rows with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            rows = np.stack([statistics(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)]) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["label", "fold", "x"])

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return docs.select(F.col(label).cast("double").alias("label"), text_or_empty().alias("text"), fold).mapInArrow(run, "label double, fold int, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from the labelled rows that are not held out. What comes to the driver has a fixed size: means, one matrix, BINS bins."""
    from .common import checkpointed

    known = labels.select(F.col("doc_id"), F.col(label).alias("_label")).where("_label is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    n = known.count()
    if n > MOST_ROWS:  # a bounded sample, by hash, so that reruns agree
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(MOST_ROWS / n * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    data = checkpointed(measured(rows, "_label")).coalesce(SLICES)
    k = len(STATISTICS)
    at = [F.element_at("x", i + 1) for i in range(k)]
    got = data.agg(F.count("*"), F.avg("label"), *(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    rng = np.random.default_rng(_SEED)
    weight = rng.standard_normal((k, FEATURES)) / WIDTH
    phase = rng.uniform(0, 2 * math.pi, FEATURES)
    none = np.zeros(FEATURES + 1)
    if not got[0]:  # nothing to learn from: all texts are as likely good as not
        return Model(np.zeros(k), np.ones(k), weight, phase, none, np.zeros(1), np.full(1, 0.5))
    mean = np.array(got[2 : 2 + k])
    scale = np.array(got[2 + k :])
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = Model(mean, scale, weight, phase, none, np.zeros(1), np.full(1, 0.5))
    width = FEATURES + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 1, width))
        for batch in batches:
            fold, label_, f = batch.column(1).to_numpy(), batch.column(0).to_numpy(), model.features(matrix(batch.column(2)))
            for k in range(FOLDS):
                g = f[fold == k]
                total[k] += g.T @ np.concatenate((g, label_[fold == k, None]), axis=1)
        stripes = np.array_split(np.arange(FEATURES + 1), STRIPES)
        parts = [(k * STRIPES + i, total[k, s].tobytes()) for k in range(FOLDS) for i, s in enumerate(stripes)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["stripe", "part"])

    def add(parts: pa.Table) -> pa.Table:
        total = None
        for p in parts.column("part"):
            x = np.frombuffer(p.as_py())
            total = x.copy() if total is None else total + x
        return pa.table({"stripe": parts.column("stripe").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    sums = data.mapInArrow(partial, "stripe int, part binary").groupBy("stripe").applyInArrow(add, "stripe int, part binary").collect()
    each = np.concatenate([np.frombuffer(r["part"]).reshape(-1, width) for r in sorted(sums, key=lambda r: r["stripe"])]).reshape(FOLDS, FEATURES + 1, width)

    def solved(equations: np.ndarray) -> np.ndarray:
        n = max(equations[0, 0], 1.0)  # the constant feature counts the rows
        penalty = np.full(FEATURES + 1, RIDGE * n)
        penalty[0] = 1e-9 * n
        return np.linalg.solve(equations[:, :-1] + np.diag(penalty), equations[:, -1])

    whole = each.sum(0)
    beta = solved(whole)
    others = np.stack([solved(whole - e) for e in each])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (model.features(matrix(batch.column(2))) * others[batch.column(1).to_numpy()]).sum(1)
            bin_ = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(raw), batch.column(0)], names=["bin", "raw", "label"])

    bins = data.mapInArrow(binned, "bin int, raw double, label double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("label").alias("label")).orderBy("bin").collect()
    raw, label_mean, n_bin = (np.array([r[c] for r in bins], float) for c in ("raw", "label", "n"))
    return Model(mean, scale, weight, phase, beta, raw, isotonic(label_mean, n_bin))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            x = np.stack([statistics(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)]) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    The score is the calibrated probability of label 1; predicted is 1 from KEEP on. Null texts count as empty, and
    empty ones are scored like others; null doc_ids stay null; repeated rows score alike; without labelled rows all
    scores are 0.5. Of several labels of a document the largest counts. An empty table gives an empty result.
    """
    out = scored(docs, fit(docs, labels, label))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``least``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            data, offsets = buffers(texts.fill_null("") if texts.null_count else texts)
            x = np.stack([statistics(data[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
