"""Suffix-array dedup by depth-limited radix sort.

Suffixes are ordered only through their first ``length`` bytes, by most-significant-digit passes: a pass splits each
group by the next digit, a suffix alone in its group retires, and the groups left at the end are exactly the windows of
``length`` bytes that start in more than one place.

A row for each suffix would be many times the corpus, so the passes run over a sparse sample of it (windows.py): the
positions that windows are anchored at, one in about 70. The first pass deals the sample by its first digit, ``gram`` bytes;
most of it retires there. What is left is sorted by what stands about it, digit by digit of eight bytes, to the right and,
for the suffixes that begin up to length - gram bytes further left, to the left. A suffix's group at full depth is
its group on the left at its distance from the anchor together with its group on the right at the depth that is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers
from .windows import U, Spec, covered, id_of_key, repeated_windows

LENGTH, GRAM = 200, 64
#: Bytes of a digit after the first pass.
DIGIT = 8
#: Where rows that agree all the way would part.
NEVER = 1 << 30


def radix_order(group: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over rows of bytes, within groups: the order of the rows, and how many bytes each shares with the one before it (-1: another group; NEVER: all)."""
    n, depth = tokens.shape
    order = np.argsort(group, kind="stable")
    parts = np.full(n, NEVER)
    parts[:1] = -1
    parts[1:][group[order][1:] != group[order][:-1]] = -1
    for d in range(0, depth, DIGIT):
        bucket = np.cumsum(parts != NEVER) - 1
        live = np.flatnonzero(np.bincount(bucket)[bucket] > 1)  # the others have retired
        if not len(live):
            break
        digit = np.zeros((len(live), DIGIT), np.uint8)
        some = tokens[order[live], d : d + DIGIT]
        digit[:, : some.shape[1]] = some
        x, b = digit.view(">u8").ravel().astype(U), bucket[live]
        by = np.lexsort((x, b))
        order[live], x = order[live][by], x[by]
        at = np.flatnonzero((b[1:] == b[:-1]) & (x[1:] != x[:-1]))
        differs = x[at] ^ x[at + 1]
        parts[live[at + 1]] = d + sum((differs >> U(8 * (DIGIT - j)) == 0).astype(np.int64) for j in range(1, DIGIT))
    return order, parts


def radix_groups(route: np.ndarray, place: np.ndarray, ok: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Flags, of the suffixes ok (per row and offset), those that share all their bytes with another row's. Offsets never meet: equal windows have their anchor at one offset."""
    n, w = len(route), context.shape[1] // 2
    flags = np.zeros((n, w + 1), bool)
    left_order, left = radix_order(route, context[:, :w][:, ::-1])
    right_order, right = radix_order(route, context[:, w:])
    left_group, right_group = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(w + 1):
        i = np.flatnonzero(ok[:, o])
        if len(i) < 2:
            continue
        left_group[left_order] = np.cumsum(left < o)
        right_group[right_order] = np.cumsum(right < w - o)
        group = left_group[i] * (n + 1) + right_group[i]
        by = np.argsort(group)
        same = group[by][1:] == group[by][:-1]
        flags[i[by[1:][same]], o] = True
        flags[i[by[:-1][same]], o] = True
    return flags


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Texts dealt by key, and per text the starts of windows of ``length`` bytes that also start elsewhere."""
    spec = Spec(length, gram, words=False, ordered=False)
    return repeated_windows(docs, radix_groups, spec, carry)


OUT = "nul boolean, doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte that a repeated window covers.

    One row per row of ``docs`` (doc_id long, text string; other columns are ignored): doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes left and, with ``with_text``, kept, a
    string: characters of which a part was removed go as a whole; the columns in ``carry`` come along. A null text is an empty one; empty texts
    and those under ``length`` bytes keep all they have. Repeated rows remove each other. A null doc_id is kept
    as null; rows without one, or with the same one, are told apart by their texts. An empty table gives an empty result.
    """
    dealt, spans = repeated_spans(docs, length, gram, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(2))
            rows = batch.column(3)
            each = np.where(rows.is_valid().to_numpy(zero_copy_only=False), np.diff(rows.offsets.to_numpy()), 0)
            flat = rows.flatten()
            los, his = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            first, out = 0, []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]]
                n = len(text)
                lo, hi = los[first : first + each[i]], his[first : first + each[i]]
                first += each[i]
                gone = covered(lo.astype(np.int64), hi.astype(np.int64), n, length) if each[i] else None
                if gone is None or not gone.any():
                    kept = text.tobytes()
                    out.append((n, 0, 0, hashlib.sha256(kept).hexdigest(), kept))
                else:
                    kept = text[~gone].tobytes()
                    n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    out.append((n, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), whole_characters(text, gone) if with_text else b""))
            n, removed, n_spans, sha, kept = zip(*out, strict=True) if out else ((),) * 5
            made = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["nul", "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                made.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
                names.append("kept")
            if carry:
                made.append(batch.column(4))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(made, names=names)

    rest = ["rest"] if carry else []
    joined = dealt.join(spans.hint("shuffle_hash"), ["nul", "doc", "key"], "left").select("nul", "doc", "text", "spans", *rest)
    schema = OUT + (", kept string" if with_text else "") + "".join(f", rest {dict(dealt.dtypes)['rest']}" for _ in rest)
    extra = [*(["kept"] if with_text else []), *(F.col("rest")[c].alias(c) for c in carry)]
    return joined.mapInArrow(run, schema).select(id_of_key(), "n_bytes", "n_removed", "n_spans", "kept_sha256", *extra)


def whole_characters(text: np.ndarray, gone: np.ndarray) -> bytes:
    """What is left when characters that lost a byte go as a whole."""
    character = np.cumsum((text & 0xC0) != 0x80)
    hurt = np.zeros(int(character[-1]) + 1, bool)
    hurt[character[gone]] = True
    return text[~hurt[character]].tobytes()
