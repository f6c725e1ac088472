"""Hybrid retrieval for batches of questions: BM25 and vectors, fused by reciprocal rank.

Both legs leave the corpus where it is; texts are cut into terms once. A block of questions, whose size is bounded, goes to all
tasks; a task scores its rows against the block with numpy, a tile of bounded size at a time, and passes on the best of each
question, so that what is shuffled is k rows a question and task, however common a term is and however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import materialised, stored

TOP_K = 20
#: Published defaults: Okapi BM25 and reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Questions that meet the corpus at a time, and characters or vector components that they hold at most, unless one question alone holds more.
QUESTION_BLOCK, QUESTION_SIZE = 4096, 1 << 24
#: Rows of the corpus that a task takes up at a time, and pairs of a row and a question that it scores at a time.
SCORED, TILE = 2048, 1 << 20
#: Terms that rows and questions share in so many of all pairs are added up by a matrix product, the COMMON most shared at most; the others pair by pair, so many at a time, which a processor's cache holds.
OFTEN, COMMON, ADDED = 0.003, 512, 1 << 15
#: Rows that a task holds back beyond the k of each question before it sorts them.
HELD = 1 << 18


def in_spaces(rows: DataFrame, spaces: list[str] | None) -> DataFrame:
    """No list and an empty list filter nothing."""
    return rows.where(F.col("space_key").isin(spaces)) if spaces else rows


def ranked(scored: DataFrame, k: int, key: str, by: str = "qid") -> DataFrame:
    """The k best of each question, ties by key. Spark keeps k rows a question and task before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def question_blocks(questions: DataFrame, size: str) -> Iterator[list[Row]]:
    """The questions in blocks of QUESTION_BLOCK rows, and of QUESTION_SIZE by the column ``size``, one block at a time on the driver."""
    block: list[Row] = []
    held = 0
    for row in questions.toLocalIterator():
        if block and (len(block) >= QUESTION_BLOCK or held + row[size] > QUESTION_SIZE):
            yield block
            block, held = [], 0
        block.append(row)
        held += row[size]
    if block:
        yield block


class Best:
    """The k best rows of each question among the tiles of a task, and all that come within the margin of the k-th. Only a bounded number is held back."""

    def __init__(self, k: int, margin: float, qids: pa.Array, names: list[str], above: float) -> None:
        self.k, self.margin, self.qids, self.names = k, margin, qids, names
        #: What a score must reach: more than so many rows of the question have it already.
        self.least = np.full(len(qids), above)
        self.most = HELD + 2 * k * len(qids)
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, key: pa.Array, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        """scores: a row for each key, a column for each question; NaN for a pair that is none."""
        if len(scores) > 4 * self.k and self.n == 0:  # else all of a first tile were held
            with np.errstate(invalid="ignore"):
                kth = np.partition(np.nan_to_num(scores, nan=-np.inf), len(scores) - self.k, axis=0)[len(scores) - self.k] - self.margin
            self.least = np.maximum(self.least, kth)
        i, j = np.nonzero(scores >= self.least)
        if len(i):
            self.held.append((key.take(pa.array(i)), j, scores[i, j]))
            self.n += len(i)
        if self.n > self.most:
            self.cut()
            if 2 * self.n > self.most:  # ties
                yield from self.rest()

    def cut(self) -> None:
        key = pa.concat_arrays([h[0] for h in self.held])
        j, score = (np.concatenate([h[i] for h in self.held]) for i in (1, 2))
        order = np.lexsort((-score, j))
        j, score = j[order], score[order]
        first = np.searchsorted(j, np.arange(len(self.least)))
        full = np.flatnonzero(np.diff(np.append(first, len(j))) >= self.k)
        self.least[full] = np.maximum(self.least[full], score[first[full] + self.k - 1] - self.margin)
        good = score >= self.least[j]
        self.held, self.n = [(key.take(pa.array(order[good])), j[good], score[good])], int(good.sum())

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.cut()
            for key, j, score in self.held:
                yield pa.RecordBatch.from_arrays([self.qids.take(pa.array(j)), key, pa.array(score)], names=self.names)
        self.held, self.n = [], 0


def tiles(batch: pa.RecordBatch, n_questions: int) -> Iterator[tuple[int, int]]:
    step = max(1, TILE // n_questions)
    return ((lo, min(lo + step, batch.num_rows)) for lo in range(0, batch.num_rows, step))


def types_of(questions: DataFrame, rows: DataFrame, key: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    qid = questions.schema["qid"].dataType
    return f"qid {qid.simpleString()}, `{key}` {rows.schema[key].dataType.simpleString()}, score double", to_arrow_type(qid)


def rounded(score: F.Column, digits: int | None) -> F.Column:
    return F.round(score, digits) if digits else score


def packed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_terms, terms, tfs) as ``with_sparse`` gives them, but in one string of terms between spaces and one binary of counts a row, which are read much faster than arrays. A text without terms has one empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SCORED):
                batch = whole.slice(lo, SCORED)
                words = pc.split_pattern(batch.column(1), " ")
                coded = words.flatten().dictionary_encode()
                size = max(1, len(coded.dictionary))
                row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
                of, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
                row, code = np.divmod(of, size)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(code))), " ")
                tfs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(4 * ends), pa.py_buffer(n.astype(np.int32))])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), terms, tfs], names=[key, "n_terms", "terms", "tfs"])

    words = texts.select(key, T.terms(F.col(text)).alias("_t")).select(key, F.array_join("_t", " ").alias("words"), F.size("_t").alias("n_terms"))
    return words.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, n_terms int, terms string, tfs binary")


def entries(batch: pa.RecordBatch) -> tuple[pa.ListArray, np.ndarray]:
    """The terms of each row of a batch of sparse vectors, and all counts in turn."""
    terms, tfs = batch.column(2), batch.column(3)
    if pa.types.is_list(terms.type):
        return terms, tfs.flatten().to_numpy()
    data, at = tfs.buffers()[2], np.frombuffer(tfs.buffers()[1], np.int32)[tfs.offset : tfs.offset + len(tfs) + 1]
    return pc.split_pattern(terms, " "), np.frombuffer(data, np.int32)[at[0] // 4 : at[-1] // 4]


def bm25(questions: DataFrame, texts: DataFrame, k: int | None = TOP_K, key: str = "chunk_id", text: str = "text", digits: int | None = None) -> DataFrame:
    """questions (qid, question), texts (key, text): (qid, key, score, rank) of those that share a term.

    texts may hold the sparse vectors of the index (n_terms, terms, tfs); else they are made here and written once. The corpus is
    read twice a block of questions: once for its size and how many texts hold each asked term, sums of a size that the block
    bounds, and once to score. Scores have ``digits`` decimals, or 10, so that equal texts have equal scores.
    """
    k = k or TOP_K
    columns = (key, "n_terms", "terms", "tfs")
    sparse = texts.select(*columns) if set(columns) <= set(texts.columns) else stored(packed(texts, key, text))
    digits = digits or 10
    asked = questions.select("qid", F.array_distinct(T.terms(F.col("question"))).alias("terms"), F.coalesce(F.char_length("question"), F.lit(0)).alias("size"))
    schema, qid_type = types_of(questions, texts, key)
    margin = 10.0**-digits
    parts = []
    for block in question_blocks(asked, "size"):
        vocabulary = pa.array(sorted({t for q in block for t in q.terms}), pa.string())
        qids = pa.array([q.qid for q in block], qid_type)
        n_questions, n_terms = len(block), len(vocabulary)
        in_question = pc.index_in(pa.array([t for q in block for t in q.terms], pa.string()), vocabulary).to_numpy(zero_copy_only=False)
        of_question = np.repeat(np.arange(n_questions), [len(q.terms) for q in block])
        by_term = np.argsort(in_question, kind="stable")
        asking, at = of_question[by_term], np.searchsorted(in_question[by_term], np.arange(n_terms + 1))

        def known(batch: pa.RecordBatch, vocabulary=vocabulary) -> tuple[np.ndarray, ...]:
            """(text, term, tf) of the asked terms in a batch."""
            terms, tfs = entries(batch)
            term = pc.index_in(terms.flatten(), vocabulary).fill_null(-1).to_numpy()
            which = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
            hit = term >= 0
            return which[hit], term[hit], tfs[hit]

        def count(batches: Iterator[pa.RecordBatch], known=known, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            held = np.zeros(n_terms + 2, np.int64)
            for whole in batches:
                for lo in range(0, whole.num_rows, SCORED):
                    batch = whole.slice(lo, SCORED)
                    held[:n_terms] += np.bincount(known(batch)[1], minlength=n_terms)
                    held[n_terms] += batch.num_rows
                    held[n_terms + 1] += batch.column(1).to_numpy().sum()
            i = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(held[i])], names=["i", "n"])

        df = np.zeros(n_terms + 2, np.int64)
        for r in sparse.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            df[r.i] = r.n
        n_texts, mean = int(df[n_terms]), df[n_terms + 1] / max(1, df[n_terms])
        idf = np.log1p((n_texts - df[:n_terms] + 0.5) / (df[:n_terms] + 0.5))

        shared = df[:n_terms] * np.diff(at) / max(1, n_texts * n_questions)
        common = np.argsort(-shared, kind="stable")[: min(COMMON, int((shared > OFTEN).sum()))]

        def score(batches: Iterator[pa.RecordBatch], known=known, asking=asking, at=at, idf=idf, mean=mean, common=common, qids=qids) -> Iterator[pa.RecordBatch]:
            place = np.full(len(idf), -1)
            place[common] = np.arange(len(common))
            holds = np.zeros((len(common), len(qids)))
            for c, t in enumerate(common.tolist()):
                holds[c, asking[at[t] : at[t + 1]]] = 1.0
            many = np.diff(at)
            best = Best(k, margin, qids, ["qid", key, "score"], np.nextafter(0.0, 1.0))  # a pair that shares no term has 0
            for whole in batches:
                for lo in range(0, whole.num_rows, SCORED):
                    batch = whole.slice(lo, SCORED)
                    which, term, tf = known(batch)
                    length = batch.column(1).to_numpy()[which]
                    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))
                    for a, b in tiles(batch, len(qids)):
                        some = slice(*np.searchsorted(which, [a, b]))
                        row, t, w = which[some] - a, term[some], weight[some]
                        often = place[t] >= 0
                        held = np.zeros((b - a, len(common)))
                        held[row[often], place[t[often]]] = w[often]
                        scores = held @ holds
                        add_pairs(scores, row[~often], t[~often], w[~often], asking, at, many)
                        yield from best.add(batch.column(0).slice(a, b - a), scores)
            yield from best.rest()

        found = sparse.mapInArrow(score, schema)
        parts.append(found.select("qid", key, rounded(F.col("score"), digits).alias("score")))
    if not parts:
        return ranked(texts.sparkSession.createDataFrame([], schema), k, key)
    return ranked(reduce(DataFrame.unionByName, parts), k, key)


def add_pairs(scores: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, asking: np.ndarray, at: np.ndarray, many: np.ndarray) -> None:
    """Add each weight of (row, term), rows ascending, to the questions that ask the term."""
    n, width = many[term], scores.shape[1]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        before = ends[lo] - n[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + ADDED, "right")))
        m, first = n[lo:hi], row[lo]
        rows = int(row[hi - 1] - first) + 1
        # From where an entry's questions stand in asking to where its pairs stand here.
        shift = at[term[lo:hi]] - (ends[lo:hi] - m - before)
        cell = asking[np.repeat(shift, m) + np.arange(ends[hi - 1] - before)] + np.repeat((row[lo:hi] - first) * width, m)
        scores[first : first + rows] += np.bincount(cell, np.repeat(weight[lo:hi], m), rows * width).reshape(rows, width)
        lo = hi


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that no square overflows; NaN for a zero row."""
    with np.errstate(invalid="ignore", divide="ignore"):
        rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def dense(questions: DataFrame, vectors: DataFrame, k: int | None = TOP_K, key: str = "chunk_id", vector: str = "dense", digits: int | None = None) -> DataFrame:
    """questions (qid, qvec), vectors (key, vector): (qid, key, score, rank) by exact cosine, one matrix product a batch and block of questions.

    Vectors that are null, zero or hold nulls, and vectors of another length than the question's, are not found.
    """
    k = k or TOP_K
    asked = questions.select("qid", F.col("qvec").cast("array<double>").alias("v"), F.greatest(F.size("qvec"), F.lit(0)).alias("size")).where("qvec is not null")
    schema, qid_type = types_of(questions, vectors, key)
    margin = 10.0**-digits if digits else 0.0
    parts = []
    for block in question_blocks(asked, "size"):
        for dim in sorted({q.size for q in block} - {0}):
            some = [q for q in block if q.size == dim and None not in q.v]
            if not some:
                continue
            matrix = unit(np.array([q.v for q in some], float)).T
            qids = pa.array([q.qid for q in some], qid_type)

            def score(batches: Iterator[pa.RecordBatch], matrix=matrix, qids=qids, dim=dim) -> Iterator[pa.RecordBatch]:
                best = Best(k, margin, qids, ["qid", key, "score"], np.finfo(float).min)
                for whole in batches:
                    for lo in range(0, whole.num_rows, SCORED):
                        batch = whole.slice(lo, SCORED)
                        flat = batch.column(1).flatten()
                        x = unit(flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))
                        for a, b in tiles(batch, len(qids)):
                            yield from best.add(batch.column(0).slice(a, b - a), x[a:b] @ matrix)
                yield from best.rest()

            found = vectors.select(key, F.col(vector).cast("array<double>").alias("_v")).where(F.size("_v") == dim).where(F.forall("_v", lambda c: c.isNotNull())).mapInArrow(score, schema)
            parts.append(found.select("qid", key, rounded(F.col("score"), digits).alias("score")))
    if not parts:
        return ranked(vectors.sparkSession.createDataFrame([], schema), k, key)
    return ranked(reduce(DataFrame.unionByName, parts), k, key)


def fused(legs: list[DataFrame], k: int | None = TOP_K, key: str = "chunk_id", constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of legs (qid, key, rank): a union and one sum, in place of an outer join."""
    rows = reduce(DataFrame.unionByName, [leg.select("qid", key, "rank") for leg in legs])
    scored = rows.groupBy("qid", key).agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"))
    return ranked(scored, k or TOP_K, key)


def hybrid(questions: DataFrame, points: DataFrame, k: int | None = TOP_K, spaces: list[str] | None = None, key: str = "chunk_id", digits: int | None = None) -> DataFrame:
    """questions (qid, question, qvec), points (key, space_key, text, dense): candidates (qid, key, score, rank). The space filter applies before each leg."""
    here = in_spaces(points, spaces)
    legs = [bm25(questions, here, k, key, digits=digits), dense(questions, here.where("dense is not null"), k, key, digits=digits)]
    return fused(legs, k, key)


def candidates(found: DataFrame, points: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Join the payload to what was found, which is written once; the vectors stay out."""
    return materialised(found).join(points.drop("dense", "n_terms", "terms", "tfs"), key)
