"""Where windows of a fixed number of tokens may repeat in a whole corpus: content-chosen samples, and what stands about them.

A token is a byte (suffix.py) or a word, as a 64-bit hash (substring.py). A window is L consecutive tokens of one text.
Every window holds the k-gram of smallest hash among its L-k+1 k-grams (leftmost on ties), its *anchor*; equal windows
have equal anchors at equal offsets. So a table of all windows is never made:

1. ``anchors`` scans the texts once and yields one row for each distinct anchor: its hash ``ah``, the hash ``eh`` of its
   *extent* (all tokens that any window with this anchor can hold), the text and the position. Within an Arrow batch,
   rows of one extent are settled there and then (the map-side combine); an anchor that a batch holds with many extents
   is *hot*: it repeats for sure, and of each task two of its rows alone go to the task of its hash.
2. ``settle`` meets the anchors of one hash, in order, a bounded number of rows at a time. One that stands alone is
   dropped. Where both hashes are equal, all windows repeat. What is left goes on to be compared.
3. ``contexts`` fetches the tokens about these anchors, and deals them by anchor. A hot anchor's are dealt by ranges of
   offsets, each by the tokens that all windows of the range share, which stay behind; the few tokens at the range's
   ends go along, after equal rows of a batch are settled. So what surrounds a very common passage differs and spreads,
   and what is equal meets as a few short rows.
4. ``compared`` lets suffix.py and substring.py compare contexts in their own way.

A text is known by (nul, doc, key): its doc_id and 64 bits of its hash or, where it has no id, 128 bits of its hash. Rows
that share an id but not a text stay apart. In this order texts come: ids first, and then those without, by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, fixed_binary, text_or_empty

U = np.uint64
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
LOW = U((1 << 20) - 1)
#: Tokens that are hashed at a time.
PIECE = 1 << 18
#: An anchor with so many extents in one batch is hot.
HOT_IN_BATCH = 64
#: And one with so many in the task of its hash.
HOT_IN_TASK = 4096
#: Rows of one route that a task holds at most.
MOST_ROWS = 1 << 15
#: HOT goes with COMPARE: the contexts of a hot anchor are dealt by more of their tokens (``contexts``).
UNDECIDED, FULL, COMPARE, HOT = 0, 1, 2, 4
BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPREAD = np.int64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Spec:
    """length: tokens of a window; gram: of an anchor; words: whether tokens are words; ordered: whether only what is not the first occurrence repeats."""

    length: int
    gram: int
    words: bool
    ordered: bool

    @property
    def side(self) -> int:
        return self.length - self.gram


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """Powers of a base; those of a piece's length are kept, longer ones are made anew."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, PIECE + (1 << 12)), base, U)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if len(out) > 4 * PIECE:
            return out[:n]
        _powers[base] = out
    return _powers[base][:n]


def prefix(v: np.ndarray) -> np.ndarray:
    """p such that (p[j] - p[i]) * powers(UNBASE)[i] hashes v[i:j]."""
    out = np.zeros(len(v) + 1, U)
    np.cumsum(v * powers(BASE, len(v)), out=out[1:])
    return out


def part(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (p[j] - p[i]) * powers(UNBASE, len(p))[i]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block-wise running minima from both ends."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(U).max, U)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def word_tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts data[starts[i]:ends[i]], and where each text's words begin, with the end last."""
    size = int((ends - starts).sum()) + len(starts)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    flat = np.full(size, 32, np.uint8)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        flat[at[i] : at[i] + b - a] = data[a:b]
    black = (flat != 32) & ((flat < 9) | (flat > 13))
    edge = np.diff(black.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = [mix(word_hashes(flat, first[lo : lo + PIECE], last[lo : lo + PIECE])) for lo in range(0, len(first), PIECE)]
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.searchsorted(first, at)


def word_hashes(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of flat[first[i]:last[i]], which stand in order."""
    lo, out = 0, []
    while lo < len(first):  # some bytes at a time
        hi = max(lo + 1, int(np.searchsorted(last, first[lo] + 4 * PIECE, "right")))
        p = prefix(BYTE[flat[first[lo] : last[hi - 1]]])
        out.append(part(p, first[lo:hi] - first[lo], last[lo:hi] - first[lo]))
        lo = hi
    return np.concatenate(out)


def pieces(lengths: np.ndarray, spec: Spec, most: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Groups of (text, begin, end, first and last+1 owned window) of at most about ``most`` tokens; long texts are cut, with margins."""
    group, size, margin = [], 0, 2 * spec.length
    for i in np.flatnonzero(lengths >= spec.length).tolist():
        n = int(lengths[i])
        for lo in range(0, n - spec.length + 1, most):
            begin, end = max(0, lo - margin), min(n, lo + most + margin)
            if group and size + end - begin > most:
                yield group
                group, size = [], 0
            group.append((i, begin, end, lo, min(lo + most, n - spec.length + 1)))
            size += end - begin
    if group:
        yield group


def find_anchors(tokens: list[np.ndarray], group: list[tuple[int, int, int, int, int]], spec: Spec) -> tuple[np.ndarray, ...]:
    """(text, position, ah, eh) of the anchors of the owned windows of one group of pieces."""
    length, k = spec.length, spec.gram
    v = np.concatenate(tokens)
    text, begin, end, own, stop = (np.array(x, np.int64) for x in zip(*group, strict=True))
    at = np.zeros(len(group) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    p = prefix(v)
    n = len(v)
    grams = mix((p[k:] - p[:-k]) * powers(UNBASE, n - k + 1))
    least = sliding_min((grams & ~LOW) | np.arange(len(grams), dtype=U), length - k + 1)
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, at[:-1] + own - begin, 1)
    np.add.at(mark, at[:-1] + stop - begin, -1)
    pos = (least[np.cumsum(mark[: len(least)]) > 0] & LOW).astype(np.int64)
    pos = pos[np.concatenate(([True], pos[1:] != pos[:-1]))] if len(pos) else pos
    which = np.searchsorted(at, pos, "right") - 1
    left = np.minimum(spec.side, pos - at[which])
    right = np.minimum(length, at[which + 1] - pos)
    extent = mix(part(p, pos - left, pos + right) + left.astype(U) * U(0x632BE59BD9B4E019) + right.astype(U) * U(0xA0761D6478BD642F))
    return text[which], pos - at[which] + begin[which], grams[pos], extent


def batch_anchors(data: np.ndarray, at: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """(text, position, ah, eh) over all texts of a batch."""
    found: list[tuple[np.ndarray, ...]] = []
    if spec.words:
        lo = 0
        while lo < len(at) - 1:  # word hashes for some texts at a time
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4 * PIECE, "right")) - 1)
            tokens, begins = word_tokens(data, at[lo:hi], at[lo + 1 : hi + 1])
            for group in pieces(np.diff(begins), spec, PIECE):
                got = find_anchors([tokens[begins[i] + a : begins[i] + b] for i, a, b, _, _ in group], group, spec)
                found.append((got[0] + lo, *got[1:]))
            lo = hi
    else:
        for group in pieces(np.diff(at), spec, PIECE):
            found.append(find_anchors([BYTE[data[at[i] + a : at[i] + b]] for i, a, b, _, _ in group], group, spec))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))
    text, pos, ah, eh = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])))  # the pieces of a text share margins
    return text[new], pos[new], ah[new], eh[new]


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one above."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


# Where a row stands: its text's flag nul, the position, and the row's kind, in one number.


def packed(nul: np.ndarray, pos: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (nul.astype(np.int64) << 62) | (pos.astype(np.int64) << 8) | kind


def nul_of(at: np.ndarray) -> np.ndarray:
    return at >> 62


def pos_of(at: np.ndarray) -> np.ndarray:
    return (at >> 8) & np.int64(0xFFFFFFFF)


def kind_of(at: np.ndarray) -> np.ndarray:
    return at & np.int64(255)


def text_ranks(nul: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each text in the order of texts; equal ones share it."""
    order = np.lexsort((key, doc, nul))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(starts_of(nul[order], doc[order], key[order]))
    return rank


def judge(ah: np.ndarray, eh: np.ndarray, place: np.ndarray, ordered: bool) -> tuple[np.ndarray, ...]:
    """Order by (ah, eh, place). Returns that order without rows that stand at one place twice and, for the rows in it: the group of ah, the group of (ah, eh), whether it stands for its extent, whether all its windows repeat."""
    order = np.lexsort((place, eh, ah))
    a, e, p = ah[order], eh[order], place[order]
    many = np.bincount(np.cumsum(starts_of(a, e)) - 1)
    once = starts_of(a, e, p)
    order, a, e, p = order[once], a[once], e[once], p[once]
    new_e = starts_of(a, e)
    of_a, of_e = np.cumsum(starts_of(a)) - 1, np.cumsum(new_e) - 1
    full = ~new_e if ordered else many[of_e] > 1
    return order, of_a, of_e, new_e, full


ANCHOR = "ah long, eh long, doc long, key long, at long, route long"
_ANCHOR = ["ah", "eh", "doc", "key", "at", "route"]


def anchors(docs: DataFrame, spec: Spec) -> DataFrame:
    """docs: (nul, doc, key, text). route is the hash whose task gets the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, np.int64)  # hot anchors that this task has sent two rows of
        for batch in batches:
            nul, doc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            data, at = buffers(batch.column(3))
            text, pos, ah, eh = batch_anchors(data, at, spec)
            if not len(text):
                continue
            order, of_a, of_e, head, full = judge(ah, eh, (text_ranks(nul, doc, key)[text] << 32) | pos, spec.ordered)
            text, pos, ah, eh = text[order], pos[order], ah[order].view(np.int64), eh[order].view(np.int64)
            first = np.flatnonzero(starts_of(of_a))
            extents = np.bincount(of_a, weights=head).astype(np.int64)
            known = np.isin(ah[first], told)
            told = np.concatenate((told, ah[first][(extents >= HOT_IN_BATCH) & ~known]))
            is_hot = ((extents >= HOT_IN_BATCH) | known)[of_a]
            hot = is_hot & (known[of_a] | (of_e - of_e[first][of_a] >= 2))
            kind = np.where(full, FULL, UNDECIDED) | np.where(hot & head, COMPARE, 0) | np.where(is_hot, HOT, 0)
            # Settled rows go anywhere. Of an extent that repeats here, the first goes on.
            settled = hot | (full if spec.ordered else full & ~head)
            route = np.where(settled, (key[text] + pos) * _SPREAD, ah)
            columns = (ah, eh, doc[text], key[text], packed(nul[text], pos, kind), route)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_ANCHOR)

    return docs.select("nul", "doc", "key", "text").mapInArrow(run, ANCHOR)


def joined(columns: list) -> np.ndarray | pa.Array:
    return np.concatenate(columns) if isinstance(columns[0], np.ndarray) else pa.concat_arrays(columns)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int, at_least: int = 1 << 16) -> Iterator[list]:
    """Columns of batches that are sorted by column ``key``, cut only where the key changes: numbers as numpy arrays, binary ones as they are."""
    for rows, _ in groups(batches, key, at_least):
        yield rows


def groups(batches: Iterator[pa.RecordBatch], key: int, at_least: int, most: int | None = None, within: int = 0) -> Iterator[tuple[list, bool]]:
    """Columns of batches that are sorted by column ``key``, and whether the last group in them goes on after them.

    They are cut where the key changes, unless a group has ``most`` rows; such a group comes in parts, each on its own and
    cut where the column ``within`` changes, if it does.
    """
    held: list[list] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c if pa.types.is_binary(c.type) else c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n < at_least or (held[-1][key][-1] == held[0][key][0] and (most is None or n < most)):
            continue
        rows = [joined(list(x)) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(rows[key], rows[key][-1], "left"))
        if cut:
            yield [x[:cut] for x in rows], False
            rows = [x[cut:] for x in rows]
        if most is not None and len(rows[key]) >= most:
            cut = int(np.flatnonzero(rows[within] != rows[within][-1])[-1]) + 1 if (rows[within] != rows[within][-1]).any() else len(rows[key])
            yield [x[:cut] for x in rows], True
            rows = [x[cut:] for x in rows]
        n = len(rows[key])
        held = [rows] if n else []
    if held:
        yield [joined(list(x)) for x in zip(*held, strict=True)], False


SETTLED = "doc long, key long, at long, ah long"


def settle(found: DataFrame, spec: Spec) -> DataFrame:
    """Rows (doc, key, at, ah) of all anchors that repeat, of kind FULL, COMPARE or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going_on = None  # the route that came in part, the extent it ended in, and the first row of that
        for (ah, eh, doc, key, at, route), partly in groups(batches, 5, 1 << 16, MOST_ROWS, 1):
            done = route != ah
            i = np.flatnonzero(~done)
            out = np.zeros(0, np.int64)
            if len(i):
                a, e, kind = ah[i], eh[i], kind_of(at[i])
                # Rows come in order of (route, eh, text, position).
                once = starts_of(a, e, nul_of(at[i]), doc[i], key[i], pos_of(at[i]))
                head, first = starts_of(a, e), starts_of(a)
                of_a, of_e = np.cumsum(first) - 1, np.cumsum(head) - 1
                rows = np.bincount(of_e)
                full = ((kind & FULL) > 0) | (~head if spec.ordered else (rows > 1)[of_e])
                extents = np.bincount(of_a, weights=head)[of_a]
                hot = (np.bincount(of_a, weights=(kind & HOT) > 0)[of_a] > 0) | (extents >= HOT_IN_TASK)
                several = extents > 1
                large = np.zeros(len(i), bool)
                if partly:  # what else the last route has is not known yet
                    large |= a == a[-1]
                if going_on is not None and going_on[0] == a[0]:
                    large |= a == a[0]
                    if going_on[1] == e[0]:
                        same = of_e == 0
                        full |= same
                        head &= ~same
                        if spec.ordered:  # rows that stand where the first one does
                            j = i[0]
                            if going_on[2] == (nul_of(at[j]), doc[j], key[j], pos_of(at[j])):
                                once[0] = False
                alone = ~(several | full | large)
                kind = np.where(full, FULL, 0) | np.where(head & (several | large), COMPARE, 0) | np.where(hot | large, HOT, 0)
                keep = once & ~alone & ((kind & (FULL | COMPARE)) > 0)
                if partly:
                    j = i[np.flatnonzero(of_e == of_e[-1])[0]]
                    first_row = (nul_of(at[j]), doc[j], key[j], pos_of(at[j]))
                    if going_on is not None and going_on[:2] == (a[-1], e[-1]):
                        first_row = going_on[2]
                    going_on = (a[-1], e[-1], first_row)
                else:
                    going_on = None
                out = kind[keep]
                i = i[keep]
            j = np.flatnonzero(done)
            places = np.concatenate((at[j], (at[i] & ~np.int64(255)) | out))
            keep = (kind_of(places) & (FULL | COMPARE)) > 0
            if keep.any():
                columns = [np.concatenate((c[j], c[i]))[keep] for c in (doc, key)] + [places[keep], np.concatenate((ah[j], ah[i]))[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "key", "at", "ah"])

    nul = F.shiftright("at", 62)
    return found.repartition("route").sortWithinPartitions("route", "eh", nul, "doc", "key", "at").mapInArrow(run, SETTLED)


#: Windows that a row is about, by their offset, which is how many tokens they start before the anchor: first is the least
#: offset of the row's range, and from and to, 16 bits each, are what the text has of the range. context has the tokens at
#: the range's ends: as many to the left and to the right as the range is wide.
CONTEXT = "route long, ah long, doc long, key long, at long, reach long, context binary"
_CONTEXT = [c.split()[0] for c in CONTEXT.split(", ")]


def reach_of(first: np.ndarray | int, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    return (np.int64(first) << 32) | (from_ << 16) | to


def offsets_of(reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, from, to) of each row."""
    low = np.int64(0xFFFF)
    return reach >> 32, (reach >> 16) & low, reach & low


def offset_ranges(side: int) -> list[tuple[int, int]]:
    """0..side in ranges that double in width from both ends to the middle."""
    out, lo, width = [], 0, 1
    half = side // 2
    while lo <= half:
        hi = min(half, max(lo, lo + width - 1))
        out.append((lo, hi))
        width = max(1, lo + width) if lo else 1
        lo = hi + 1
    mirrored = [(side - b, side - a) for a, b in out]
    return out + [(max(a, half + 1), b) for a, b in mirrored if b > half]


def dealt_contexts(rows: dict[str, np.ndarray], spec: Spec) -> Iterator[pa.RecordBatch]:
    """Rows of CONTEXT from rows (ah, nul, doc, key, rank, pos, from, to, hot, context): a plain anchor's one row, and a hot one's for each range of offsets.

    A hot row's route is a hash of the tokens that all windows of the range share. Where all tokens of the range are equal,
    rows are settled here: but for the first, they go anywhere, if they repeat.
    """
    side, width = spec.side, 8 if spec.words else 1

    def made(row: np.ndarray, route: np.ndarray, reach: np.ndarray, full: np.ndarray, context: np.ndarray) -> pa.RecordBatch:
        at = packed(rows["nul"][row], rows["pos"][row], np.where(full, FULL, 0))
        columns = (route, rows["ah"][row], rows["doc"][row], rows["key"][row], at, reach)
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), fixed_binary(context)], names=_CONTEXT)

    cold = np.flatnonzero(~rows["hot"])
    if len(cold):
        yield made(cold, rows["ah"][cold], reach_of(0, rows["from"][cold], rows["to"][cold]), np.zeros(len(cold), bool), rows["context"][cold])
    i = np.flatnonzero(rows["hot"])
    if not len(i):
        return
    ah, place, context = rows["ah"][i], (rows["rank"][i] << 32) | rows["pos"][i], np.ascontiguousarray(rows["context"][i])
    tokens = context.view(U) if spec.words else BYTE[context]
    p = prefix(tokens.ravel())
    base = np.arange(len(i), dtype=np.int64) * (2 * side)
    for a, b in offset_ranges(side):
        from_, to = np.maximum(a, rows["from"][i]), np.minimum(b, rows["to"][i])
        r = np.flatnonzero(from_ <= to)
        if not len(r):
            continue
        at, from_, to = base[r], from_[r], to[r]
        core = part(p, at + side - a, at + 2 * side - b)
        route = mix(core + mix(ah[r].view(U) + U((a + 1) * BASE % (1 << 64))))
        whole = mix(part(p, at + side - to, at + 2 * side - from_) + ((from_ << 32) | to).astype(U))
        order, _, _, head, full = judge(route, whole, place[r], spec.ordered)
        route, from_, to, r = route[order].view(np.int64), from_[order], to[order], r[order]
        away = full if spec.ordered else full & ~head
        route = np.where(away, (place[r] + a) * _SPREAD, route)
        ends = np.concatenate((context[r, (side - b) * width : (side - a) * width], context[r, (2 * side - b) * width : (2 * side - a) * width]), axis=1)
        yield made(i[r], route, reach_of(a, from_, to), full, ends)


#: Anchors whose contexts are made at a time.
ANCHORS_AT_ONCE = 1 << 13


def contexts(docs: DataFrame, settled: DataFrame, spec: Spec) -> DataFrame:
    """CONTEXT: for each anchor to compare, side tokens before it and side tokens after it."""
    width = 8 if spec.words else 1
    side, k = spec.side, spec.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nul, doc, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            data, at = buffers(batch.column(3))
            wanted = batch.column(4)
            each = np.diff(wanted.offsets.to_numpy())
            flat = wanted.flatten()
            all_pos, all_ah, all_hot = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2).to_numpy(zero_copy_only=False)
            rank = text_ranks(nul, doc, key)
            first, size = 0, 0
            made: list[tuple[np.ndarray, ...]] = []

            def flushed(made: list[tuple[np.ndarray, ...]], nul=nul, doc=doc, key=key, rank=rank) -> Iterator[pa.RecordBatch]:
                text, ah, pos, from_, to, hot, context = (np.concatenate(x) for x in zip(*made, strict=True))
                return dealt_contexts({"ah": ah, "nul": nul[text], "doc": doc[text], "key": key[text], "rank": rank[text], "pos": pos, "from": from_, "to": to, "hot": hot, "context": context}, spec)

            for i in range(batch.num_rows):
                if spec.words:
                    tokens = word_tokens(data, at[i : i + 1], at[i + 1 : i + 2])[0]
                else:
                    tokens = data[at[i] : at[i + 1]]
                n = len(tokens)
                filled = np.concatenate((np.zeros(side, tokens.dtype), tokens, np.zeros(side, tokens.dtype)))
                stretch = np.lib.stride_tricks.sliding_window_view(filled, side)
                for lo in range(first, first + each[i], ANCHORS_AT_ONCE):
                    of = slice(lo, min(lo + ANCHORS_AT_ONCE, first + each[i]))
                    pos, ah, hot = all_pos[of].astype(np.int64), all_ah[of], all_hot[of]
                    about = np.concatenate((stretch[pos], stretch[pos + side + k]), axis=1)
                    from_, to = np.maximum(0, side - (n - k - pos)), np.minimum(side, pos)
                    made.append((np.full(len(pos), i), ah, pos, from_, to, hot, about.view(np.uint8).reshape(len(pos), 2 * side * width)))
                    size += len(pos)
                    if size >= ANCHORS_AT_ONCE:
                        yield from flushed(made)
                        made, size = [], 0
                first += each[i]
            if made:
                yield from flushed(made)

    one = F.struct(F.shiftright("at", 8).bitwiseAND(0xFFFFFFFF).alias("pos"), "ah", (F.col("at").bitwiseAND(HOT) > 0).alias("hot"))
    by_text = (
        settled.where(F.col("at").bitwiseAND(COMPARE) > 0)
        .select((F.shiftright("at", 62) > 0).alias("nul"), "doc", "key", one.alias("x"))
        .groupBy("nul", "doc", "key")
        .agg(F.collect_list("x").alias("wanted"))
    )
    # All columns of docs are taken, so that the exchange of the texts is the one that the last step reads.
    return docs.join(by_text.hint("shuffle_hash"), ["nul", "doc", "key"]).select("nul", "doc", "key", "text", "wanted", *(c for c in docs.columns if c == "rest")).mapInArrow(run, CONTEXT)


SPAN = "doc long, key long, at long, lo int, hi int"


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last - 1


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(nul, doc, key, text), nulls replaced, and the columns to carry along as a struct, rest."""
    text = text_or_empty()
    rest = [F.struct(*carry).alias("rest")] if carry else []
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.isNull().alias("nul"), F.coalesce(doc_id, F.xxhash64(F.lit("without an id"), text)).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"), *rest)


def id_of_key() -> F.Column:
    return F.when(~F.col("nul"), F.col("doc")).alias("doc_id")


Repeated = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def compared(rows: DataFrame, repeated: Repeated, spec: Spec) -> DataFrame:
    """SPAN of the contexts of each route.

    ``repeated(route, place, ok, context)`` is given rows of one width w with 2 w tokens each: flags, of the windows ok (per
    row and offset 0..w), those that repeat. A window at offset o has the last o tokens of the left half and the first w - o
    of the right one. Rows are held whole until their route ends; those of hot anchors, which alone can be very many, have
    no more than the ends of a range.
    """
    width = 8 if spec.words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, _, doc, key, at, reach, context in whole_groups(batches, 0, 1 << 14):
            data, offsets = buffers(context)
            first, from_, to = offsets_of(reach)
            place = np.cumsum(starts_of(nul_of(at), doc, key, pos_of(at)))  # rows of a route come in order
            size = np.diff(offsets)
            for n_bytes in np.unique(size).tolist():
                i = np.flatnonzero(size == n_bytes)
                w = n_bytes // (2 * width)
                o = np.arange(w + 1)
                lo, hi = from_[i] - first[i], to[i] - first[i]
                ok = (o >= lo[:, None]) & (o <= hi[:, None])
                about = data[offsets[i][:, None] + np.arange(n_bytes)]
                flags = repeated(route[i], place[i], ok, about) | (ok & ((kind_of(at[i]) & FULL) > 0)[:, None])
                row, begin, end = runs(flags)
                if len(row):  # the window at offset o starts o tokens before its anchor
                    j = i[row]
                    anchor = pos_of(at[j]) - first[j]
                    columns = [doc[j], key[j], at[j], (anchor - end).astype(np.int32), (anchor - begin).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "key", "at", "lo", "hi"])

    return rows.repartition("route").sortWithinPartitions("route", F.shiftright("at", 62), "doc", "key", "at").mapInArrow(run, SPAN)


def repeated_windows(docs: DataFrame, repeated: Repeated, spec: Spec, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The keyed texts, dealt by text, and per text with repeated windows: (nul, doc, key, spans array of (lo, hi)). hi may exceed the last window of the text."""
    keys = keyed(docs, carry)
    texts = keys.repartition("nul", "doc", "key")
    settled = settle(anchors(keys, spec), spec)
    found = compared(contexts(texts, settled, spec), repeated, spec)
    pos = F.shiftright("at", 8).bitwiseAND(0xFFFFFFFF).cast("int")
    full = settled.where(F.col("at").bitwiseAND(FULL) > 0).select("doc", "key", "at", F.greatest(pos - spec.side, F.lit(0)).alias("lo"), pos.alias("hi"))
    nul = (F.shiftright("at", 62) > 0).alias("nul")
    return texts, full.unionByName(found).groupBy(nul, "doc", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def covered(lo: np.ndarray, hi: np.ndarray, n: int, length: int) -> np.ndarray:
    """Flags of the n tokens that windows starting from lo to hi cover."""
    mark = np.zeros(n + 1, np.int64)
    if n >= length and len(lo):
        lo, hi = np.maximum(lo, 0), np.minimum(hi, n - length)
        good = lo <= hi
        np.add.at(mark, lo[good], 1)
        np.add.at(mark, hi[good] + length, -1)
    return np.cumsum(mark[:-1]) > 0
