"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, text_or_empty

#: Samples of a row of the images that hold payloads.
WIDTH = 64


def encode_pgm(gray: np.ndarray) -> bytes:
    height, width = gray.shape
    return b"P5\n%d %d\n255\n" % (width, height) + gray.astype(np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with up to 16 bits a sample: (height, width) or (height, width, 3)."""
    if (head := re.match(rb"P([1-6])", data)) is None:
        raise ValueError("not Netpbm")
    kind, at, fields = int(head[1]), 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        if (m := re.compile(rb"(?:\s|#[^\n\r]*[\n\r])+(\d+)").match(data, at)) is None:
            raise ValueError("bad Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    most = fields[2] if len(fields) == 3 else 1
    planes = 3 if kind in (3, 6) else 1
    n = width * height * planes
    if kind == 1:
        body = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])
        out = 1 - (np.frombuffer(body, np.uint8)[:n] - 48)
    elif kind <= 3:
        out = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64).astype(np.uint8 if most < 256 else np.uint16)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        out = 1 - np.unpackbits(rows, axis=1)[:, :width]
    else:
        out = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if out.size != n:
        raise ValueError("Netpbm data is short")
    return out.reshape((height, width) if planes == 1 else (height, width, 3))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit BMP: (height, width, 3)."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, size, width, height, _, depth, packing = struct.unpack_from("<I I i i H H I", data, 10)
    if packing not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        palette = np.frombuffer(data[14 + size : start], np.uint8).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def knots(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of equal parts of n samples: the whole number below each, and the rest."""
    edges = np.arange(parts + 1) * n / parts
    below = np.minimum(edges.astype(np.int64), n - 1)
    return below, edges - below


def integral(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``at`` of the image's integral along its first axis: sums of all rows above. Sums of whole numbers are whole, and no other row of the integral is held."""
    rows = np.unique(at)
    kind = np.int64 if image.dtype.kind in "uib" else np.float64
    out = np.zeros((len(rows), *image.shape[1:]), kind)
    inside = rows[rows < len(image)]
    if len(inside):
        starts = np.unique(np.concatenate(([0], inside)))
        sums = np.add.reduceat(image, starts, axis=0, dtype=kind).cumsum(0)  # up to the next start
        ends = np.append(starts[1:], len(image))
        where = np.searchsorted(ends, rows)
        out[rows > 0] = sums[where[rows > 0]]
    else:
        out[rows > 0] = image.sum(0, dtype=kind)
    return out[np.searchsorted(rows, at)]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact (fractional) box of each target pixel, from the integral image at the boxes' edges, linear between its knots.

    What is held grows with the edges and one side of the image, not with the image.
    """
    h, w = image.shape[:2]
    total: np.ndarray = image
    for axis, (n, parts) in enumerate(((h, height), (w, width))):
        below, rest = knots(n, parts)
        turned = np.swapaxes(total, 0, axis)
        if axis == 0:
            low, high = integral(turned, below), integral(turned, below + 1)
        else:
            summed = np.concatenate((np.zeros((1, *turned.shape[1:])), turned.cumsum(0)))
            low, high = summed[below], summed[below + 1]
        rest = rest.reshape(-1, *([1] * (low.ndim - 1)))
        total = np.swapaxes(np.diff(low * (1 - rest) + high * rest, axis=0), 0, axis)
    return total * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 area means is below its right neighbour; 16 hex digits. Colours count alike."""
    small = area_resize(image, 8, 9)
    small = small.mean(2) if image.ndim == 3 else small
    bits = np.round(small[:, 1:], 9) > np.round(small[:, :-1], 9)
    return np.packbits(bits.ravel()).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


TILE = "tile_row int, tile_col int, npy binary, dhash string"
TILES = f"array<struct<{', '.join(':'.join(f.split()) for f in TILE.split(', '))}>>"


def cut(image: np.ndarray, tile: tuple[int, int]) -> list[dict]:
    """An image as NPY tiles, each with its place and its difference hash."""
    height, width = tile
    parts = ((r, c, image[r : r + height, c : c + width]) for r in range(0, image.shape[0], height) for c in range(0, image.shape[1], width))
    return [{"tile_row": r // height, "tile_col": c // width, "npy": npy(part), "dhash": difference_hash(part)} for r, c, part in parts]


def assembled(parts: list[dict]) -> np.ndarray:
    """The image that tiles hold."""
    rows: dict[int, list[np.ndarray]] = {}
    for t in sorted(parts, key=lambda t: (t["tile_row"], t["tile_col"])):
        rows.setdefault(t["tile_row"], []).append(read_npy(t["npy"]))
    return np.concatenate([r[0] if len(r) == 1 else np.concatenate(r, axis=1) for r in rows.values()])


def tiled(media: DataFrame, column: str = "media", size: int | None = 256, tile: tuple[int, int] = (128, 128)) -> DataFrame:
    """Decode a binary column, resize so that the longer side is at most ``size`` (None: leave it), and cut into NPY tiles with hashes.

    The other columns, with ``tiles``, an array of TILE in place of the media, which stays with its row. It is null for null
    and unreadable media and for images without a pixel. A column of that name is replaced.
    """
    rest = [c for c in media.columns if c not in ("tiles", column)]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in media.select(*rest).dtypes), f"tiles {TILES}"])

    def one(data: bytes | None) -> list[dict] | None:
        try:
            image = decode(data or b"")
        except (ValueError, IndexError, struct.error):
            return None
        h, w = image.shape[:2]
        if not h or not w:
            return None
        if size is not None and max(h, w) > size:
            small = area_resize(image, max(1, h * size // max(h, w)), max(1, w * size // max(h, w)))
            image = np.clip(np.round(small), 0, np.iinfo(image.dtype).max).astype(image.dtype)
        return cut(image, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tile_row", pa.int32()), ("tile_col", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                made = [one(m.as_py()) for m in batch.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(made, kind)], names=[*rest, "tiles"])

    return media.select(*rest, column).mapInArrow(run, schema)


def tiles(media: DataFrame, column: str = "media", size: int | None = 256, tile: int = 128) -> DataFrame:
    """``tiled`` with one row per tile: the other columns with (tile_row, tile_col, npy, dhash). Columns of ``media`` named like the new ones are dropped."""
    new = {"tile_row", "tile_col", "npy", "dhash", "tiles", column}
    rest = [c for c in media.columns if c not in new]
    found = tiled(media.select(*rest, column), column, size, (tile, tile)).select(*rest, F.explode("tiles").alias("_tile"))
    return found.select(*rest, *(F.col("_tile")[c].alias(c) for c in ("tile_row", "tile_col", "npy", "dhash")))


STORED = "doc_id long, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a grey PGM of 64 samples a row: (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            n = np.diff(at)
            for lo in range(0, len(n), 256):
                made = []
                for i in range(lo, min(lo + 256, len(n))):
                    padded = np.zeros(max(1, -(-int(n[i]) // WIDTH)) * WIDTH, np.uint8)
                    padded[: n[i]] = data[at[i] : at[i + 1]]
                    made.append(encode_pgm(padded.reshape(-1, WIDTH)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(made)), pa.array(n[lo : lo + 256]), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, STORED)


#: Rows of a stored tile: 64 KB of a payload.
TILE_ROWS = 1024


def digests(media: DataFrame) -> DataFrame:
    """Store media as NPY tiles, read the tiles back, put the image together again and digest it.

    One row per row of ``media`` (doc_id, n_bytes, media): media_bytes and media_sha256 are of the tiles, one after the other,
    feature is the difference hash of what was read back. Null doc_ids stay null; empty and null texts have a payload of 64
    zeros; equal texts have equal values; a text of any length has tiles of at most TILE_ROWS rows, and no more than a few
    copies of it are held. An empty table gives an empty result.
    """
    stored = tiled(media.select("doc_id", "n_bytes", "media"), size=None, tile=(TILE_ROWS, WIDTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(2):
                parts = row.as_py()
                image = assembled(parts)
                payload = image.tobytes()
                digest, size = hashlib.sha256(), 0
                for t in parts:
                    digest.update(t["npy"])
                    size += len(t["npy"])
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest.hexdigest(), difference_hash(image)))
            x = list(zip(*out, strict=True)) if out else [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(x, types, strict=True))], names=[f.strip().split()[0] for f in DIGEST.split(",")])

    return stored.mapInArrow(run, DIGEST)
