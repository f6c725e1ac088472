"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length 1, filled up with zeros to EXPAND times its length, rotated by a seeded random orthogonal
matrix and kept as the signs of its coordinates, with one correction scalar: its inner product with its own code. A
query's inner product with a code, divided by that scalar, estimates the cosine without bias, and lies within ``epsilon``
deviations of it; the longer the code, the smaller a deviation. Only vectors whose upper bound reaches the query's k-th best
exact cosine so far are reranked on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fixed_binary

#: Rows of a block of candidates, which a task holds, and queries that meet it at a time.
BASE_BLOCK, QUERY_BATCH = 32_768, 1_024
#: Bits of a code for each dimension.
EXPAND = 16
#: Deviations of the estimate that the error bound allows for. A neighbour is missed if the error of its own estimate is larger; at 4.5 that is about one in 150,000. Infinity reranks everything.
EPSILON = 4.5
#: Candidates whose codes are compared with a batch of queries at a time.
STEP = 2_048
_SEED = 11
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int, expand: int = EXPAND) -> np.ndarray:
    """The columns of a random orthogonal matrix of expand * dim that meet a vector filled up with zeros."""
    if dim * expand not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(_SEED + dim).standard_normal((dim * expand, dim)))
        _rotations[dim * expand] = q * np.sign(np.diag(r))
    return _rotations[dim * expand]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim): rows with an id and a non-null, non-zero vector of finite components. Of rows that share an id, the one of smallest vector."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(fine)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: no square overflows or vanishes, and no bit of a cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and their inner products with them."""
    x = scaled(x)
    turned = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ rotation(x.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


CODE = "vec_id long, v array<double>, dim int, code binary, scale double"


def encode(rows: DataFrame) -> DataFrame:
    """Add code and scale to (vec_id, v, dim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                of = whole.filter(pa.array(dims == d))
                for lo in range(0, of.num_rows, STEP):
                    batch = of.slice(lo, STEP)
                    code, scale = encoded(batch.column(1).flatten().to_numpy().reshape(-1, d))
                    yield pa.RecordBatch.from_arrays([*batch.columns, fixed_binary(code), pa.array(scale)], names=["vec_id", "v", "dim", "code", "scale"])

    return rows.mapInArrow(run, CODE)


def exact(q: np.ndarray, x: np.ndarray, qq: np.ndarray, xx: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision, added up in order of the components. q and x have a vector a column."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        dot = np.zeros(len(a))
        for row in range(len(q)):
            dot += q[row, a] * x[row, b]
        out[lo : lo + (1 << 16)] = dot / np.sqrt(qq[a] * xx[b])
    return out


def squares(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for row in x:
        out += row * row
    return out


class Block:
    """Candidates of one length of vectors: ids, vectors, codes and scalars."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, scale: np.ndarray, epsilon: float = EPSILON) -> None:
        self.ids, self.codes, self.dim = ids, codes, x.shape[1]
        self.xt = np.ascontiguousarray(scaled(x).T)
        self.xx = squares(self.xt)
        self.scale = scale.astype(np.float32)
        self.bound = (epsilon * np.sqrt(np.maximum(0, 1 - scale**2)) / scale / math.sqrt(max(self.dim * EXPAND - 1, 1)) + 1e-5).astype(np.float32)
        self.reranked = 0

    def estimates(self, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first candidate, estimated cosines of STEP candidates by all queries)."""
        bits = self.dim * EXPAND
        for lo in range(0, len(self.ids), STEP):
            signs = np.unpackbits(self.codes[lo : lo + STEP], axis=1, count=bits).astype(np.float32)
            signs *= 2
            signs -= 1
            yield lo, (signs @ turned) / self.scale[lo : lo + STEP, None]

    def search(self, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, cosine) of the k best for each query, itself left out.

        The best by estimate are reranked first; their exact cosines set the mark that the others' upper bounds must reach.
        """
        q = scaled(q)
        unit = q / np.sqrt((q * q).sum(1, keepdims=True))
        turned = np.ascontiguousarray((unit @ rotation(self.dim).T).T.astype(np.float32)) / np.float32(math.sqrt(self.dim * EXPAND))
        qt = np.ascontiguousarray(q.T)
        qq = squares(qt)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, candidate, cosine
        mark = np.full(len(qid), -np.inf)

        def merge(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal best
            other = qid[i] != self.ids[j]
            i, j = i[other], j[other]
            self.reranked += len(i)
            i, j, s = np.concatenate((best[0], i)), np.concatenate((best[1], j)), np.concatenate((best[2], exact(qt, self.xt, qq, self.xx, i, j)))
            order = np.lexsort((self.ids[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            new = np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(i) else np.zeros(0, bool)
            i, j, s = i[new], j[new], s[new]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            best = (i[rank < k], j[rank < k], s[rank < k])
            mark[i[rank == k - 1]] = s[rank == k - 1]

        firsts: list[tuple[np.ndarray, np.ndarray]] = []  # the k + 1 best estimates so far, and their candidates
        for lo, estimate in self.estimates(turned):
            top = np.argpartition(-estimate, min(k, len(estimate) - 1), axis=0)[: k + 1]
            firsts.append((np.take_along_axis(estimate, top, 0), top + lo))
            if len(firsts) == 8:
                firsts = [self._first(firsts, k)]
        value, which = self._first(firsts, k)
        merge(np.repeat(np.arange(len(qid))[None, :], len(which), 0).ravel(), which.ravel())
        for lo, estimate in self.estimates(turned):
            j, i = np.nonzero(estimate + self.bound[lo : lo + STEP, None] >= mark[None, :])
            merge(i, j + lo)
        return qid[best[0]], self.ids[best[1]], best[2]

    @staticmethod
    def _first(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
        value, which = (np.concatenate(x) for x in zip(*parts, strict=True))
        top = np.argpartition(-value, min(k, len(value) - 1), axis=0)[: k + 1]
        return np.take_along_axis(value, top, 0), np.take_along_axis(which, top, 0)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """The k nearest other vectors of each query, by cosine: (query_id, rank, vec_id, score).

    is_query: which rows are queries too, a condition on vec_id. Candidates are cut into blocks of bounded size, each
    of which one task holds once; the queries, a small part of the rows, go to all blocks and stream past them in batches,
    of which each gives k rows a query. So no side is held as a whole, and no candidate is sent twice. Vectors are compared
    with those of their own length. Rows without id or with a vector that is null, zero, or holds null or non-finite
    components take no part; rows that share an id count as one; equal scores go by the smaller id; a query with fewer than
    k candidates gets them all; components may be as large or small as doubles are. An empty table gives an empty result.
    Other columns are ignored.
    """
    coded = checkpointed(encode(usable(vectors, id_col, vector_col)))
    blocks = max(1, -(-coded.count() // BASE_BLOCK))
    blocks = max(blocks, vectors.sparkSession.sparkContext.defaultParallelism)  # at least one for each core
    base = coded.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(0))
    asked = coded.where(is_query).withColumn("code", F.lit(None).cast("binary")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(1))

    def matrix(column: pa.Array, dim: int) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None  # the block at hand, as it comes and as it is searched
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("b", "dim", "asks")], 1)
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if lo == hi:
                    continue
                b, dim, asks = keys[lo].tolist()
                rows = whole.slice(lo, hi - lo)
                if at != (b, dim):
                    at, held, block = (b, dim), [], None
                if not asks:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if block is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
                    block = Block(t["vec_id"].to_numpy(), matrix(t["v"].combine_chunks(), dim), codes, t["scale"].to_numpy(), epsilon)
                for first in range(0, rows.num_rows, QUERY_BATCH):
                    some = rows.slice(first, QUERY_BATCH)
                    found = block.search(some.column("vec_id").to_numpy(), matrix(some.column("v"), dim), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    names = ["b", "dim", "asks", "vec_id", "v", "code", "scale"]
    met = base.select(*names).unionByName(asked.select(*names)).repartition("b").sortWithinPartitions("b", "dim", "asks").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
