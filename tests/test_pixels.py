"""Image files to pixels: every filter, colour type and depth, and files that can't be read."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import pixels


def png(raw_rows, width, height, depth, colour, palette=b"", woven=0):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(b"".join(raw_rows))
    return pixels.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, woven)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


def filtered(rows, step, kinds):
    """Rows of bytes with the given filters applied, by the format's own definition."""
    out, before = [], bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = bytearray([kind])
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(bytes(line))
        before = row
    return out


def test_every_filter_and_colour():
    rng = np.random.default_rng(1)
    for colour, n in pixels.SAMPLES.items():
        if colour == 3:
            continue
        image = rng.integers(0, 256, (10, 7, n)).astype(np.uint8)
        file = png(filtered([r.tobytes() for r in image], n, [0, 1, 2, 3, 4] * 2), 7, 10, 8, colour)
        wanted = np.repeat(image[:, :, :1], 3, axis=2) if n < 3 else image[:, :, :3]
        assert (pixels.pixels(file) == wanted).all()
    palette = rng.integers(0, 256, (4, 3)).astype(np.uint8)
    index = rng.integers(0, 4, (3, 5))
    packed = [bytes([0, *np.packbits(np.array([[x >> 1 & 1, x & 1] for x in row]).ravel())]) for row in index]
    assert (pixels.pixels(png(packed, 5, 3, 2, 3, palette.tobytes())) == palette[index]).all()
    bits = rng.integers(0, 2, (3, 9))
    assert (pixels.pixels(png([bytes([0, *np.packbits(row)]) for row in bits], 9, 3, 1, 0))[:, :, 1] == bits * 255).all()
    wide = rng.integers(0, 65536, (2, 3, 3)).astype(">u2")
    assert (pixels.pixels(png([b"\0" + r.tobytes() for r in wide], 3, 2, 16, 2)) == (wide >> 8)).all()


def test_files_as_columns(spark):
    ppm = b"P6 # a note\n2 1\n255\n" + bytes(range(6))
    good = png([b"\0" + bytes([9, 8, 7])], 1, 1, 8, 2)
    bad = [b"GIF89a", good[:20], good[:-20], png([b"\7abc"], 1, 1, 8, 2), png([b"\0abc"], 1, 1, 8, 2, woven=1), b"P6 2 2 255\nab", b"P6 1 1 65535\nabcdef", png([b"\0abc"], 1 << 20, 1 << 20, 8, 2), png([b"\0a"], 1, 1, 8, 3)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([ppm, good, None, b"", *bad])], "id long, content binary")
    got = [r.p for r in rows.select("id", pixels.rgb(F.col("content")).alias("p")).orderBy("id").collect()]
    assert [(p.width, p.height, p.pixels and bytes(p.pixels), p.error) for p in got[:4]] == [(2, 1, bytes(range(6)), None), (1, 1, bytes([9, 8, 7]), None), (None,) * 4, (None,) * 4]
    assert all(p.width is None and "can't be read" in p.error for p in got[4:]) and len(got) == 4 + len(bad)
    with pytest.raises(ValueError):
        pixels.pixels(b"")
