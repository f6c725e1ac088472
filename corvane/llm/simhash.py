"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits lie on a ring of 16 segments. If two differ in 3 bits at most, some segment starts a chain
in which, for every length l, the first l segments differ in 3 l / 16 bits at most: five segments not at all, ten in
one bit. So one of the two halves of segments six to ten is equal too, and the 5 + 2.5 segments, with where the
chain starts, are the key on which candidates meet. They are pruned by the whole chain, then by the full distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, checkpointed, tasks_for, text_or_empty
from .components import EDGES_A_TASK, components, join_hot
from .windows import U, whole_groups

SEGMENTS, DISTANCE, SHINGLE, SEED = 16, 3, 3, 42
#: Fingerprints of a bucket that are compared with each other directly; larger buckets are divided further.
DIRECT = 256


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    m = min(shingle, len(words))
    first, last = start[: len(words) - m + 1].tolist(), (start + size)[m - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(first, last, strict=True)), U, len(first))
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            raw = data.tobytes()
            fps = np.fromiter((fingerprint(raw[at[i] : at[i + 1]], shingle) for i in range(batch.num_rows)), U, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text")).mapInArrow(run, "doc long, fp long")


def rotated(fp: np.ndarray, start: int) -> np.ndarray:
    s = 4 * start
    return (fp << U(s)) | (fp >> U(64 - s)) if s else fp


def distance(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_holds(x: np.ndarray) -> np.ndarray:
    """Whether the differences x of rotated fingerprints stay within the budget of every chain length."""
    ok = np.ones(len(x), bool)
    for length in range(1, SEGMENTS + 1):
        ok &= np.bitwise_count(x >> U(64 - 4 * length)) <= DISTANCE * length // SEGMENTS
    return ok


def close_pairs(fp: np.ndarray, group: np.ndarray, free: tuple[int, ...], check) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups (sorted ids) at DISTANCE at most. Groups over DIRECT are divided by blocks of their free bits, of which one must be equal."""
    size = np.bincount(group)[group] if len(group) else group
    large = size > DIRECT
    i = np.flatnonzero(~large)
    g, f = group[i], fp[i]
    for d in range(1, int(size[~large].max(initial=1))):
        same = np.flatnonzero(g[d:] == g[:-d])
        if not len(same):
            break
        x = f[same] ^ f[same + d]
        hit = same[(distance(x) <= DISTANCE) & check(x)]
        if len(hit):
            yield i[hit], i[hit + d]
    i = np.flatnonzero(large)
    if not len(i):
        return
    blocks = [b for b in np.array_split(np.array(free), min(DISTANCE + 1, len(free))) if len(b)]
    for block in blocks:
        mask = U(sum(1 << int(b) for b in block))
        key = fp[i] & mask
        order = np.lexsort((key, group[i]))
        j = i[order]
        new = np.concatenate(([True], (group[j][1:] != group[j][:-1]) | ((fp[j] & mask)[1:] != (fp[j] & mask)[:-1])))
        rest = tuple(b for b in free if b not in set(block.tolist()))
        for a, b in close_pairs(fp[j], np.cumsum(new) - 1, rest, check):
            yield j[a], j[b]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each index's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == was).all() and (root[a] == root[b]).all():
            break
    return root


def links(nodes: DataFrame) -> DataFrame:
    """nodes (fp), distinct: edges (a, b) that connect all fingerprints at DISTANCE at most. A bucket gives a spanning forest, not its pairs."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for start in range(SEGMENTS):
                r = rotated(fp, start)
                for half in (0, 1):
                    key = (U(2 * start + half) << U(30)) | ((r >> U(44)) << U(10)) | ((r >> U(34 - 10 * half)) & U(1023))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in whole_groups(batches, 0):
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(new) - 1
            i = np.flatnonzero(np.bincount(group)[group] > 1)
            a = fp[i]
            start = (key[i] >> 31).astype(np.int64)
            _, group = np.unique(group[i], return_inverse=True)
            turned = a.view(U).copy()
            for s in np.unique(start).tolist():
                at = start == s
                turned[at] = rotated(a.view(U)[at], s)
            # Of the rotated bits, 44 to 63 are equal within a group; which ten of 34 to 43 and 24 to 33 are, differs.
            values, rank = np.unique(a, return_inverse=True)
            n_values = len(values)
            root = np.arange(n_values)
            held_a, held_b, n = [], [], 0
            for x, y in close_pairs(turned, group, tuple(range(44)), chain_holds):
                held_a.append(rank[x])
                held_b.append(rank[y])
                n += len(x)
                if n > 1 << 20:
                    root = spanning(np.concatenate([*held_a, np.arange(n_values)]), np.concatenate([*held_b, root]), n_values)
                    held_a, held_b, n = [], [], 0
            if held_a:
                root = spanning(np.concatenate([*held_a, np.arange(n_values)]), np.concatenate([*held_b, root]), n_values)
            moved = np.flatnonzero(root != np.arange(n_values))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[root[moved]])], names=["a", "b"])

    dealt = nodes.select("fp").mapInArrow(keys, "key long, fp long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def rooted(fps: DataFrame, linked: DataFrame) -> tuple[DataFrame, int]:
    """Of each fingerprint of fps (doc, fp), (fp, root, least, n): its component over the edges ``linked`` and shared docs, the least doc in it, and how many rows have the fingerprint; and the number of all rows."""
    rows = fps.count()
    tasks = tasks_for(fps.sparkSession, rows, EDGES_A_TASK)
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc").alias("doc"), F.count("*").alias("n")), tasks)
    several = fps.where("doc is not null").groupBy("doc").agg(F.min("fp").alias("b"), F.max("fp").alias("x"), F.count("*").alias("n")).where("b <> x").select("doc", "b", "n")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = join_hot(fps, several, "doc", "n", total[0]).select(F.col("fp").alias("a"), "b").where("a <> b")
    found = components(linked.unionByName(shared), rows)
    of_fp = checkpointed(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "doc", "n", F.coalesce("root", "fp").alias("root")), tasks)
    least = of_fp.groupBy("root").agg(F.min("doc").alias("least"), F.count("*").alias("m"))
    return join_hot(of_fp, least, "root", "m", total[1]).select("fp", "root", "least", "n"), total[0]


def _components(docs: DataFrame, shingle: int) -> tuple[DataFrame, tuple[DataFrame, int]]:
    """(doc, fp) of each row, and ``rooted`` over the links of the fingerprints."""
    fps = checkpointed(fingerprints(docs, shingle))
    return fps, rooted(fps, links(fps.select("fp").distinct()))


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    Fingerprints at DISTANCE at most are linked; component_id is the smallest doc_id that links reach, the row's
    own included. Copies meet as one fingerprint before anything is compared. Null and empty texts have
    fingerprint zero, which is linked like any other; fewer than ``shingle`` words are one shingle. A doc_id that
    stands by several texts links them. A row without doc_id is linked by its text; where no id is in reach, its
    component is null. An empty table gives an empty result; other columns are ignored.
    """
    fps, (of_fp, total) = _components(docs, shingle)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_hot(fps, of_fp, "fp", "n", total).select(F.col("doc").alias("doc_id"), shown.alias("fingerprint"), F.col("least").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stand for their group, as ``kept`` chooses them."""
    fps, of_fp = _components(docs, shingle)
    return kept(docs, fps, of_fp, lambda text: int(np.array([fingerprint(text, shingle)], U).view(np.int64)[0]))


def kept(docs: DataFrame, fps: DataFrame, of_fp: tuple[DataFrame, int], key: Callable[[bytes], int]) -> DataFrame:
    """The row of each group's smallest doc_id; of rows that share it, the first by a hash of its text and then of all its columns. fps, of_fp: see ``rooted``; key: the fp of a text.

    A group without any doc_id keeps one of its rows, chosen in the same way. Columns of ``docs`` may have any names.
    """
    rooted_, total = of_fp
    columns = docs.columns
    free = lambda name: next(n for n in (name + "_" * i for i in range(len(columns) + 1)) if n not in columns)
    doc, n, fp, root, row = map(free, ("_doc", "_n", "_fp", "_root", "_row"))
    first = checkpointed(join_hot(fps, rooted_, "fp", "n", total).where(F.col("doc") == F.col("least")).groupBy(F.col("doc").alias(doc)).agg(F.count("*").alias(n)), tasks_for(docs.sparkSession, total, EDGES_A_TASK))
    named = docs.withColumn(doc, F.col("doc_id").cast("long")).join(first.hint("shuffle_hash"), doc)
    out = named.where(F.col(n) == 1).select(*docs.columns)
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    one_of = F.min_by(whole, F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(whole)))).alias(row)
    back = [F.col(row)[c].alias(c) for c in columns]
    if not first.where(F.col(n) > 1).isEmpty():
        out = out.unionByName(named.where(F.col(n) > 1).groupBy(doc).agg(one_of).select(*back))
    if fps.where("doc is null").isEmpty():
        return out
    # Rows without id are known by their text alone.
    alone = rooted_.where("least is null").select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("n").alias(n))
    nameless = docs.where("doc_id is null")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in nameless.dtypes), f"{fp} long"])
    at = columns.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [key((t.as_py() or "").encode()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*columns, fp])

    one = join_hot(nameless.mapInArrow(add, schema), alone, fp, n, total).groupBy(root).agg(one_of)
    return out.unionByName(one.select(*back))
