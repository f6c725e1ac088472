"""Media columns (10): formats, resizing, tiles, and the payload round trip."""

import hashlib
import io
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm import media


def bmp(image, depth=24, flip=False):
    h, w = image.shape[:2]
    rows = image if flip else image[::-1]
    palette = b""
    if depth == 8:
        palette = bytes(x for i in range(256) for x in (i, i, i, 0))
        body = rows[:, :, 0]
    else:
        body = rows[:, :, ::-1]
        if depth == 32:
            body = np.concatenate((body, np.zeros((h, w, 1), np.uint8)), axis=2)
    lines = [r.astype(np.uint8).tobytes() for r in body]
    lines = [x + b"\0" * (-len(x) % 4) for x in lines]
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + sum(map(len, lines)), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, -h if flip else h, 1, depth, 0, 0, 0, 0, 0, 0) + palette + b"".join(lines)


def test_formats():
    r = np.random.default_rng(1)
    gray, rgb = r.integers(0, 256, (5, 7), np.uint8), r.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(gray)) == gray).all()
    assert (media.decode(b"P6 # note\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, gray.ravel())).encode()) == gray).all()
    assert (media.decode(b"P3\n7 5 255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    bits = gray & 1
    assert (media.decode(b"P1\n7 5\n" + " ".join(map(str, 1 - bits.ravel())).encode()) == bits).all()
    assert (media.decode(b"P4\n7 5\n" + np.packbits(1 - bits, axis=1).tobytes()) == bits).all()
    wide = r.integers(0, 60000, (5, 7)).astype(">u2")
    assert (media.decode(b"P5\n7 5\n65535\n" + wide.tobytes()) == wide).all()
    for depth in (24, 32):
        for flip in (False, True):
            assert (media.decode(bmp(rgb, depth, flip)) == rgb).all()
    same = np.repeat(gray[:, :, None], 3, 2)
    assert (media.decode(bmp(same, 8)) == same).all()
    for bad in (b"", b"P5\n7 5\n255\nshort", b"P9\n", b"GIF"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean_over_boxes():
    r = np.random.default_rng(2)
    x = r.integers(0, 256, (12, 10)).astype(float)
    assert np.allclose(media.area_resize(x, 4, 5), x.reshape(4, 3, 5, 2).mean((1, 3)))
    fine = np.kron(x, np.ones((7, 9)))  # each pixel as a box of equal ones
    assert np.allclose(media.area_resize(x, 7, 9), fine.reshape(7, 12, 9, 10).mean((1, 3)))
    assert np.allclose(media.area_resize(x, 24, 10), np.repeat(x, 2, 0))


def saved(tile):
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def plain_hash(image):
    """The difference hash from exact means over fractional boxes."""
    h, w = len(image), len(image[0])
    share = lambda n, parts, i: [max(0, min(Fraction(n * (i + 1), parts), k + 1) - max(Fraction(n * i, parts), k)) for k in range(n)]
    columns = [share(w, 9, j) for j in range(9)]
    bits = ""
    for i in range(8):
        row = [sum(int(x) * f for x, f in zip(column, share(h, 8, i), strict=True) if f) for column in zip(*image.tolist(), strict=True)]
        means = [sum(x * f for x, f in zip(row, c, strict=True) if f) for c in columns]
        bits += "".join("01"[b > a] for a, b in zip(means, means[1:], strict=False))
    return f"{int(bits, 2):016x}"


def test_difference_hash_against_exact_means():
    r = np.random.default_rng(6)
    for shape in ((1, 64), (3, 64), (8, 9), (40, 64), (5, 3)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        assert media.difference_hash(image) == plain_hash(image)


def test_payloads(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (None, "é" * 64), (4, "x" * 64), (5, "xy" * 40_000), (6, "abc")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in media.digests(media.text_media(docs)).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\0" * ((-len(raw) % 64) or (0 if raw else 64))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        stored = b"".join(saved(image[i : i + 1024]) for i in range(0, len(image), 1024))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(padded), len(stored))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.feature == plain_hash(image)
    assert got[1].feature == got[6].feature
    assert media.digests(media.text_media(docs.limit(0))).collect() == []


def test_tiles(spark):
    r = np.random.default_rng(3)
    image = r.integers(0, 256, (300, 200), np.uint8)
    rows = [(1, bytearray(media.encode_pgm(image)), "t"), (2, None, "t"), (3, bytearray(b"junk"), "t"), (4, bytearray(bmp(np.zeros((4, 4, 3), np.uint8))), "t")]
    got = media.tiles(spark.createDataFrame(rows, "id long, media binary, dhash string"), size=150, tile=64).collect()
    assert sorted((x.id, x.tile_row, x.tile_col) for x in got) == [(1, a, b) for a in range(3) for b in range(2)] + [(4, 0, 0)]
    small = np.clip(np.round(media.area_resize(image, 150, 100)), 0, 255).astype(np.uint8)
    for x in got:
        if x.id == 1:
            tile = np.load(io.BytesIO(x.npy))
            want = small[x.tile_row * 64 : x.tile_row * 64 + 64, x.tile_col * 64 : x.tile_col * 64 + 64]
            assert (tile == want).all() and x.dhash == media.difference_hash(want)
