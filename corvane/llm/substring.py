"""Substring dedup by seed and extend.

Documents meet on winnowed anchors (windows.py: the gram of smallest hash in every window, so no repeat of
threshold length is without one). From its seed, each occurrence is extended word by word both ways; occurrences
stay in one class as long as their words agree. A window repeats if its class has an earlier occurrence; the union
of such windows is made of the maximal repeats of at least the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers
from .windows import U, Spec, covered, id_of_key, repeated_windows, starts_of

LENGTH, GRAM = 20, 5


def classes(of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes of occurrences that agree so far, split by their next word."""
    order = np.lexsort((word, of))
    out = np.empty(len(of), np.int64)
    out[order] = np.cumsum(starts_of(of[order], word[order]))
    return out


def extended(route: np.ndarray, place: np.ndarray, ok: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Flags, of the windows ok (per row and offset), those whose words also start earlier, by place.

    From their seed, occurrences are extended word by word to both sides; a class falls apart where words differ.
    """
    n = len(route)
    words = np.ascontiguousarray(context).view(U).reshape(n, -1)
    w = words.shape[1] // 2
    flags = np.zeros((n, w + 1), bool)
    seed = classes(route, np.zeros(n, U))
    ahead = [seed]  # extended by so many words to the right
    for r in range(w):
        ahead.append(classes(ahead[-1], words[:, w + r]))
    back = seed  # and by o words to the left
    for o in range(w + 1):
        if o:
            back = classes(back, words[:, w - o])
        i = np.flatnonzero(ok[:, o])
        if len(i) < 2:
            continue
        window = back[i] * (n + 1) + ahead[w - o][i]
        order = np.lexsort((place[i], window))
        j = i[order]
        new = starts_of(window[order])
        head = j[np.flatnonzero(new)[np.cumsum(new) - 1]]
        flags[j, o] = place[j] != place[head]
    return flags


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Texts dealt by key, and per text the starts of windows of ``length`` words that also start earlier."""
    spec = Spec(length, gram, words=True, ordered=True)
    return repeated_windows(docs, extended, spec)


OUT = "nul boolean, doc long, n_words long, n_removed long, kept_sha256 string"


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Remove each word that a window covers whose words also start earlier (smaller doc_id, or the same document further up).

    One row per row of ``docs`` (doc_id long, text string; other columns are ignored): doc_id, n_words,
    n_removed, kept_sha256 of the words left, joined by one space, and, with ``with_text``, that string as kept.
    A null text has no words; empty texts and those under ``length`` words keep all. Rows that share doc_id and
    text are one document and get equal results; rows that share doc_id alone are in order of a hash of their
    texts. Rows without doc_id come after all others, in that order too. An empty table gives an empty result.
    """
    dealt, spans = repeated_spans(docs, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(2))
            rows = batch.column(3)
            each = np.where(rows.is_valid().to_numpy(zero_copy_only=False), np.diff(rows.offsets.to_numpy()), 0)
            flat = rows.flatten()
            los, his = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            first, out = 0, []
            for i in range(batch.num_rows):
                words = data[at[i] : at[i + 1]].tobytes().split()
                n, removed = len(words), 0
                if each[i]:
                    lo, hi = los[first : first + each[i]], his[first : first + each[i]]
                    gone = covered(lo.astype(np.int64), hi.astype(np.int64), n, length)
                    removed = int(gone.sum())
                    if removed:
                        words = [words[x] for x in np.flatnonzero(~gone).tolist()]
                first += each[i]
                kept = b" ".join(words)
                out.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            n, removed, sha, kept = zip(*out, strict=True) if out else ((),) * 4
            made = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["nul", "doc", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                made.append(pa.array(kept, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(made, names=names)

    joined = dealt.join(spans.hint("shuffle_hash"), ["nul", "doc", "key"], "left").select("nul", "doc", "text", "spans")
    done = joined.mapInArrow(run, OUT + (", kept string" if with_text else ""))
    return done.select(id_of_key(), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))
