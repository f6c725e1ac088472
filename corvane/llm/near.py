"""Near copies by SimHash, checked and completed by the Jaccard similarity of word shingles, without a loss.

A text is the set of its shingles of five words; equal sets meet as one *key*. First the SimHash fingerprints of the sets meet
by pigeonring filtering, as in op8, and the pairs of a spanning forest of those within DISTANCE bits are compared exactly.
Sets of the similarity can lie further apart than any number of bits that a filter could bound, so a second step looks for
what the first has not connected. If two sets have similarity t, each
holds at least t of the other, so in any one order of all shingles their first |S| - ceil(t |S|) + 1 share one (prefix
filtering). The order puts shingles that batches see often last, the most frequent at the very end; which these are bears
on time only. Pairs that meet are
thinned by parity sketches, whose differing bits are never more than the shingles that only one set holds, and what is
left is compared exactly. Of a large bucket each set first meets one other of its size; then all that are not connected yet
compare their sketches, the bucket being cut by sizes into blocks that meet in pairs: in a first round each pair of blocks passes on a forest of the pairs that may be similar, and in
a second, when what is similar is nearly all connected, all such pairs that are still apart. So nothing is lost, and copies of one
text give few pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, checkpointed, in_parts, tasks_for, text_or_empty
from .components import EDGES_A_TASK, components, join_hot
from .simhash import kept, links, majority, rooted
from .windows import PIECE, UNBASE, U, mix, part, powers, prefix, starts_of, whole_groups, word_tokens

SHINGLE = 5
#: Sets are near copies from NUMERATOR / DENOMINATOR on.
NUMERATOR, DENOMINATOR = 4, 5
#: Sets of a bucket that all meet each other at once.
DIRECT = 16
#: Rows of a block of a large bucket; its blocks meet in pairs, each of which is a group of its own.
BLOCK = 1024
#: Bytes of the sketches that go into large buckets, to which longer ones are folded.
SHORT = 256
#: Shingles go last in the order if batches that hold them OFTEN times sum up to COMMON; at most MOST_COMMON do.
OFTEN, COMMON, MOST_COMMON = 8, 64, 1 << 16
#: Bytes of texts of an Arrow batch that are taken up at a time, and shingles of all documents for each task of a step over texts.
TEXT, SHINGLES_A_TASK = 1 << 21, 1 << 18


def shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its shingles. Fewer words are one shingle, none are the shingle 0."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1)
        tokens, begins = word_tokens(data, at[lo:hi], at[lo + 1 : hi + 1])
        p, n = prefix(tokens), len(tokens)
        grams = mix((p[SHINGLE:] - p[:-SHINGLE]) * powers(UNBASE, n - SHINGLE + 1)) if n >= SHINGLE else np.zeros(0, U)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            else:
                out.append(mix(part(p, np.array([a]), np.array([b])) + U(b - a)) if b > a else np.zeros(1, U))
        lo = hi
    return out


def key_of(s: np.ndarray) -> int:
    """One number for a set, as a signed one."""
    return int(mix((mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))).reshape(1)).view(np.int64)[0])


def key_of_text(text: bytes) -> int:
    return key_of(shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles by their low bits, in a power of two of bits that is twice the shingles at least."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def short(x: bytes) -> bytes:
    a = np.frombuffer(x, np.uint8)
    return np.bitwise_xor.reduce(a.reshape(-1, SHORT)).tobytes() if len(a) > SHORT else x


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the shingles that only one of two sets holds; the longer sketch is folded to the shorter."""
    a, b = (np.frombuffer(z, np.uint8) for z in (x, y))
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, n)) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def keys(docs: DataFrame) -> DataFrame:
    """(doc, fp, size, sketch, short, print) of each row, fp being the key of its set, short its sketch as large buckets hold it, print its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in in_parts(batch.column(1), TEXT):
                sets = shingles(*buffers(batch.column(1)[lo:hi]))
                sketches = list(map(sketch, sets))
                columns = [pa.array(map(key_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(sketches, pa.binary()), pa.array(map(short, sketches), pa.binary())]
                prints = np.fromiter(map(majority, sets), U, len(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *columns, pa.array(prints)], names=["doc", "fp", "size", "sketch", "short", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text")).mapInArrow(run, "doc long, fp long, size long, sketch binary, short binary, print long")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that go last, in order of their hashes, and the place of each, the most frequent having the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.concatenate(shingles(*buffers(batch.column(0)[lo:hi]))) for lo, hi in in_parts(batch.column(0), TEXT)]
            if held:
                sh = np.concatenate(held)
                del held
                sh.sort()
                often = np.unique(sh[OFTEN - 1 :][sh[OFTEN - 1 :] == sh[: len(sh) - OFTEN + 1]]) if len(sh) >= OFTEN else sh[:0]
                n = np.searchsorted(sh, often, "right") - np.searchsorted(sh, often)
                yield pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(n.astype(np.int64))], names=["sh", "n"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(run, "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "sh").limit(MOST_COMMON).collect()
    common = np.array([r.sh for r in reversed(rows)], np.int64).view(U)
    place = np.argsort(common)
    return common[place], place


def first_shingles(docs: DataFrame, common: np.ndarray, place: np.ndarray) -> DataFrame:
    """(sh, fp, size) of the shingles by which a set meets others; equal sets of a batch give them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for lo, hi in in_parts(batch.column(0), TEXT):
                sets = {k: s for s in shingles(*buffers(batch.column(0)[lo:hi])) if (k := key_of(s)) not in seen}
                if not sets:
                    continue
                seen |= sets.keys()
                first = []
                for s in sets.values():
                    n = len(s)
                    if len(common):
                        i = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        s = s[np.argsort(np.where(common[i] == s, place[i], -1), kind="stable")]
                    first.append(s[: n + (-NUMERATOR * n // DENOMINATOR) + 1])
                many = np.array([len(f) for f in first])
                fp, size = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(fp, many)), pa.array(np.repeat(size, many))], names=["sh", "fp", "size"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "sh long, fp long, size long")


def pairs_of(fp: np.ndarray, size: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups (rows sorted by group and size) whose sizes allow the similarity."""
    for d in range(1, len(fp)):
        i = np.flatnonzero((group[d:] == group[:-d]) & (DENOMINATOR * size[:-d] >= NUMERATOR * size[d:]))
        if not len(i):  # sizes ascend, so that wider steps hold no pair either
            break
        yield i, i + d


CANDIDATE = "a long, b long, sh long, size long, block int, low int, high int"


def candidates(first: DataFrame) -> DataFrame:
    """Pairs (a, b) to compare, and rows of large buckets, whose b is null, each with its block and the blocks it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sh, fp, size in whole_groups(batches, 0):
            order = np.lexsort((fp, size, sh))
            sh, fp, size = sh[order], fp[order], size[order]
            one = starts_of(sh, size, fp)
            sh, fp, size = sh[one], fp[one], size[one]
            group = np.cumsum(starts_of(sh)) - 1
            many = np.bincount(group)[group]
            i = np.flatnonzero((many > 1) & (many <= DIRECT))
            for x, y in pairs_of(fp[i], size[i], group[i]):
                yield pair(fp[i[x]], fp[i[y]])
            i = np.flatnonzero(many > DIRECT)
            if len(i):
                at = np.flatnonzero(starts_of(sh[i]))
                for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(i)], strict=True):
                    yield blocked(fp[i[lo:hi]], sh[i[lo:hi]], size[i[lo:hi]], BLOCK)
                    while lo < hi:  # sets of one range of sizes meet one of them
                        end = lo + int(np.searchsorted(size[i[lo:hi]], DENOMINATOR * size[i[lo]] // NUMERATOR, "right"))
                        star = fp[i[lo + int(sh[i[lo]]) % (end - lo)]]
                        rest = fp[i[lo:end]]
                        rest = rest[rest != star]
                        if len(rest):
                            yield pair(np.full(len(rest), star), rest)
                        lo = end

    return first.repartition("sh").sortWithinPartitions("sh").mapInArrow(run, CANDIDATE)


CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sh", pa.int64()), ("size", pa.int64()), ("block", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])


def pair(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), *(pa.nulls(len(x), f.type) for f in list(CANDIDATES)[2:])], schema=CANDIDATES)


def blocked(fp: np.ndarray, sh: np.ndarray, size: np.ndarray, rows: int) -> pa.RecordBatch:
    """One large bucket, in order of size, with each row's block of that many rows and the first and last block whose sizes allow the similarity."""
    block = np.arange(len(fp)) // rows
    least, most = size[::rows], np.append(size[rows - 1 : -1 : rows], size[-1])
    low = np.searchsorted(DENOMINATOR * most, NUMERATOR * least, "left")
    high = np.searchsorted(NUMERATOR * least, DENOMINATOR * most, "right") - 1
    columns = [pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(sh), pa.array(size), *(pa.array(x.astype(np.int32)) for x in (block, low[block], high[block]))]
    return pa.RecordBatch.from_arrays(columns, schema=CANDIDATES)


class Sketches:
    """Sketches of several lengths, to compare many pairs at once."""

    def __init__(self, column: pa.Array) -> None:
        data, at = buffers(column)
        self.size = np.diff(at)
        self.where = np.zeros(len(self.size), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.size).tolist():
            i = np.flatnonzero(self.size == n)
            self.where[i] = np.arange(len(i))
            self.rows[n] = np.ascontiguousarray(data[at[i][:, None] + np.arange(n)]).view(U)

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lower bounds of the shingles that only one set of each pair holds; longer sketches are folded to the shorter."""
        out = np.zeros(len(x), np.int64)
        both = self.size[x] * (1 << 20) + self.size[y]
        for kind in np.unique(both).tolist():
            m, n = divmod(kind, 1 << 20)
            words = min(m, n) // 8
            for at in np.array_split(np.flatnonzero(both == kind), max(1, len(x) >> 14)):
                a, b = (np.bitwise_xor.reduce(self.rows[k][self.where[z[at]]].reshape(len(at), -1, words), axis=1) for k, z in ((m, x), (n, y)))
                out[at] = np.bitwise_count(a ^ b).sum(1)
        return out


def joining(x: np.ndarray, y: np.ndarray, above: list[int]) -> np.ndarray:
    """Which of the pairs of roots (x, y), taken in turn, join what is not joined yet; above is the forest so far."""

    def find(r: int) -> int:
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    out = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            above[b] = a
            out.append(k)
    return np.array(out, np.int64)


def unconnected(large: DataFrame, forest: bool) -> DataFrame:
    """large (sh, fp, size, block, low, high, root, short): pairs (a, b) of a bucket with different roots whose sketches allow the similarity; with ``forest``, of two blocks only as many as connect the same roots, if all are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fp, size, block, within, root, sketches in whole_groups(batches, 0, 4 * BLOCK):
            _, root = np.unique(root, return_inverse=True)
            above = list(range(len(root)))
            order = np.lexsort((fp, size, group))
            group, fp, size, block, within, root = (c[order] for c in (group, fp, size, block, within, root))
            held = Sketches(sketches.take(pa.array(order)))
            for x, y in pairs_of(fp, size, group):
                apart = (root[x] != root[y]) & ((within[x] > 0) | (block[x] != block[y]))
                x, y = x[apart], y[apart]
                may = (NUMERATOR + DENOMINATOR) * held.differing(x, y) <= (DENOMINATOR - NUMERATOR) * (size[x] + size[y])
                x, y = x[may], y[may]
                if forest:
                    few = joining(root[x], root[y], above)
                    x, y = x[few], y[few]
                if len(x):
                    yield pair(fp[x], fp[y])

    one, two = F.least("block", "other"), F.greatest("block", "other")
    dealt = large.withColumn("other", F.explode(F.sequence("low", "high"))).select(F.xxhash64("sh", one, two).alias("group"), "fp", "size", "block", (one == two).cast("int").alias("within"), "root", "short")
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, CANDIDATE).select("a", "b").distinct()


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys without those whose sketches rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            good = [(NUMERATOR + DENOMINATOR) * differing(s, t) <= (DENOMINATOR - NUMERATOR) * (m + n) for m, s, n, t in rows]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sketches.select(F.col("fp").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("s"))
    y = sketches.select(F.col("fp").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("t"))
    both = pairs.join(x.hint("shuffle_hash"), "a").join(y.hint("shuffle_hash"), "b")
    return both.select("a", "b", "m", "s", "n", "t").mapInArrow(run, "a long, b long")


def near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of keys, those whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for s, t in zip(shingles(*buffers(some.column(2))), shingles(*buffers(some.column(3))), strict=True):
                    shared = len(s) + len(t) - len(np.union1d(s, t))
                    good.append(DENOMINATOR * shared >= NUMERATOR * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = texts.select(F.col("fp").alias("a"), F.col("text").alias("s"))
    y = texts.select(F.col("fp").alias("b"), F.col("text").alias("t"))
    both = pairs.join(x.hint("shuffle_hash"), "a").join(y.hint("shuffle_hash"), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def keyed_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(fp, text) of the keys in members (fp), one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [key_of(s) for lo, hi in in_parts(batch.column(0), TEXT) for s in shingles(*buffers(batch.column(0)[lo:hi]))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0)], names=["fp", "text"])

    made = docs.select(text_or_empty().alias("text")).mapInArrow(run, "fp long, text string")
    return made.join(members.hint("shuffle_hash"), "fp", "left_semi").dropDuplicates(["fp"])


def close_prints(sets: DataFrame, tasks: int | None = None) -> DataFrame:
    """sets (fp, print), distinct: pairs (a, b) of keys that connect all sets whose SimHashes are equal or at DISTANCE at most, as a forest; what a chain connects may be further apart."""
    one = checkpointed(sets.groupBy("print").agg(F.min("fp").alias("set"), F.count("*").alias("n")), tasks)
    total = one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = join_hot(sets, one, "print", "n", total).where("fp <> set").select(F.col("set").alias("a"), F.col("fp").alias("b"))
    close = checkpointed(links(one.select(F.col("print").alias("fp"))).distinct(), tasks)
    total = close.count()
    if not total:
        return same
    for end in ("a", "b"):  # from prints to the one set that stands for each
        many = close.groupBy(end).agg(F.count("*").alias("n")).join(one.select(F.col("print").alias(end), "set"), end)
        close = join_hot(close, many, end, "n", total).drop(end).withColumnRenamed("set", end)
    return same.unionByName(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def apart(pairs: DataFrame, linked: DataFrame, sets: int) -> DataFrame:
    """The pairs (a, b) of keys, of which there are so many, that the edges ``linked`` do not connect."""
    found = checkpointed(components(linked, sets), tasks_for(pairs.sparkSession, sets, EDGES_A_TASK))
    x, y = (found.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")) for end in ("a", "b"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def edges(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Edges (a, b) of keys that connect all sets of the similarity. keyed: ``keys`` of docs."""
    sketches = keyed.select("fp", "size", "sketch").dropDuplicates(["fp"])
    shorts = keyed.select("fp", "short").dropDuplicates(["fp"])
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    few, many = tasks_for(docs.sparkSession, rows, EDGES_A_TASK), tasks_for(docs.sparkSession, total, SHINGLES_A_TASK)

    def linking(pairs: DataFrame) -> DataFrame:
        good = checkpointed(likely(pairs, sketches), many)
        members = good.select(F.col("a").alias("fp")).union(good.select("b")).distinct()
        return checkpointed(near(good, checkpointed(keyed_texts(docs, members), many)), many)

    linked = linking(close_prints(keyed.select("fp", "print").distinct(), few))
    met = checkpointed(candidates(first_shingles(docs, *common_shingles(docs))).distinct(), many)
    linked = linked.unionByName(linking(apart(met.where("b is not null").select("a", "b"), linked, rows)))
    large = met.where("b is null").select("sh", F.col("a").alias("fp"), "size", "block", "low", "high").join(shorts, "fp")
    if large.isEmpty():
        return linked
    large = checkpointed(large, many)
    # First as many pairs as could connect what is apart; then all that are still apart, which are few by then.
    for forest in (True, False):
        labelled = large.join(components(linked, rows), F.col("fp") == F.col("node"), "left").select("sh", "fp", "size", "block", "low", "high", F.coalesce("root", "fp").alias("root"), "short")
        linked = linked.unionByName(linking(unconnected(labelled, forest)))
    return linked


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group, as ``simhash.kept`` chooses them."""
    keyed = checkpointed(keys(docs))
    fps = keyed.select("doc", "fp")
    return kept(docs, fps, rooted(fps, edges(docs, keyed)), key_of_text)
