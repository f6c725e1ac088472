"""BPE encoding and decoding with forced-boundary splitting.

Two bytes that never stand side by side inside any token of the vocabulary mark a certain cut: no merge can
cross it. A pre-token is cut there, and its fragments are encoded on their own and concatenated. Fragments are
few and short, so almost all of them come from a bounded table of fragments already encoded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_or_empty

#: Entries of a worker's tables of pre-tokens and of fragments. A full table is put aside and serves until the next one
#: is full, so that what is frequent stays.
TABLE = 100_000
#: The split pattern of this family of byte-level tokenizers; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def check(spec: dict) -> None:
    """Refuse a vocabulary file that asks for anything that this codec doesn't do."""
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    asked = {
        "a normalizer": spec.get("normalizer") is not None,
        "another pre-tokenizer than byte-level": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
        "another model than BPE": model.get("type", "BPE") != "BPE",
        "options of the model": any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added tokens that strip, need whole words or are normalized": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if found := [what for what, wanted in asked.items() if wanted]:
        raise ValueError(f"the vocabulary has {', '.join(found)}")


class Codec:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s.encode() not in self.special}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: b for b, i in self.special.items()}
        # A pair of ids as one number to its rank, and each rank to the id that the pair becomes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(s) for s in (m if isinstance(m, list) else m.split(" ")))
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.single = [vocab[bytes([b])] for b in range(256)]
        inside = {(t[i], t[i + 1]) for t in vocab for i in range(len(t) - 1)}
        self.cut = [bytearray((a, b) not in inside for b in range(256)) for a in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(regex.escape(s.decode()) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.old_tokens: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}
        self.old_fragments: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a pre-token between its certain cuts."""
        cut, out, at = self.cut, [], 0
        for i in range(1, len(word)):
            if cut[word[i - 1]][word[i]]:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.single[b] for b in fragment]
        if len(ids) > 128:
            return self.merge_long(ids)
        none = len(self.made)
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] << 32 | ids[i + 1], none)
        return tuple(ids)

    def merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap and links, for fragments where searching the list would take quadratic time."""
        n, rank_of = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank_of(ids[x] << 32 | ids[y])) is not None:
                    heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(x for x in ids if x >= 0)

    def fragment(self, f: bytes) -> tuple[int, ...]:
        """A fragment that is not in the table."""
        got = self.old_fragments.get(f) or self.merge(f)
        if len(f) <= 64:
            if len(self.fragments) >= TABLE:
                self.old_fragments, self.fragments = self.fragments, {}
            self.fragments[f] = got
        return got

    def word(self, token: str) -> tuple[int, ...]:
        """A pre-token that is not in the table."""
        out = self.tokens.get(token) or self.old_tokens.get(token)
        if out is None:
            known = self.fragments
            parts = [known.get(f) or self.fragment(f) for f in self.cuts(token.encode())]
            out = parts[0] if len(parts) == 1 else tuple(chain.from_iterable(parts))
        if len(token) <= 64:
            if len(self.tokens) >= TABLE:
                self.old_tokens, self.tokens = self.tokens, {}
            self.tokens[token] = out
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a text; strings of special tokens are those tokens."""
        parts = self.special_split.split(text) if self.special_split else [text]
        word, out = self.word, []
        for k, p in enumerate(parts):
            if k % 2:
                out.append(self.special[p.encode()])
            elif p:
                known = self.tokens.get  # the table of this moment; what is missing in it is looked for again
                out.extend(chain.from_iterable([known(t) or word(t) for t in self.split(p)]))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, special ones included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def public_vocabulary() -> str:
    """The place of the public 50k vocabulary, by default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def codec(path: str | None) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(path or public_vocabulary())


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded again.

    path: the vocabulary, a file that is on every machine; None finds the public one there. One row per row. Null
    and empty texts have no tokens; null doc_ids stay null; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(repr(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ids (array of int), n_tokens, and round_trip: whether decoding gives the text again. Columns of these names are replaced. Null texts count as empty."""
    new = ("ids", "n_tokens", "round_trip")
    rest = [c for c in docs.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes), "ids array<int>, n_tokens long, round_trip boolean"])
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                texts = [t.as_py() or "" for t in b.column(at)]
                ids = [c.encode(t) for t in texts]
                same = [c.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=[*rest, *new])

    return docs.select(*rest).mapInArrow(run, schema)
