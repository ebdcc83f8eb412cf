"""Image files to RGB pixels: PNG without interlacing and binary PPM, in Arrow batches."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

# Fixed values of the PNG format: the signature, and samples a pixel by colour type.
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of an image at most; larger ones are an error, as they would not fit a task.
MOST = 1 << 26
_PPM = re.compile(rb"P6(?:\s+(?:#[^\n]*\n\s*)*)(\d+)(?:\s+(?:#[^\n]*\n\s*)*)(\d+)(?:\s+(?:#[^\n]*\n\s*)*)(\d+)\s")


def _size(width: int, height: int) -> None:
    if not 0 < width * height <= MOST:
        raise ValueError(f"{width} x {height} pixels")


def _rows(raw: np.ndarray, step: int) -> np.ndarray:
    """Undoes the filter of each row (its first byte), ``step`` bytes a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    before = np.zeros(rows.shape[1], np.uint8)
    for k, kind in enumerate(kinds.tolist()):
        row = rows[k]
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row += before
        elif kind in (3, 4):
            for i in range(len(row)):
                a, b = int(row[i - step]) if i >= step else 0, int(before[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = int(before[i - step]) if i >= step else 0
                    near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                    guess = (a, b, c)[near.index(min(near))]
                row[i] = (int(row[i]) + guess) & 255
        elif kind:
            raise ValueError(f"filter {kind}")
        before = row
    return rows


def _png(content: bytes) -> np.ndarray:
    at, body, palette, header = len(SIGNATURE), [], None, None
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, woven = header
    if woven or colour not in SAMPLES:
        raise ValueError("interlaced" if woven else f"colour type {colour}")
    _size(width, height)
    bits = depth * SAMPLES[colour]
    line = (width * bits + 7) // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: height * (line + 1)].reshape(height, line + 1)
    rows = _rows(raw, max(1, bits // 8))
    if depth < 8:
        each = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
        value = (each * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)
        rows = (value if colour == 3 else value * 255 // ((1 << depth) - 1)).astype(np.uint8)
    elif depth == 16:
        rows = rows[:, ::2]
    pixels = rows.reshape(height, width, -1)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if colour in (0, 4) else pixels[:, :, :3]


def pixels(content: bytes) -> np.ndarray:
    """(height, width, 3) bytes; transparency is left out. What can't be read is a ValueError."""
    try:
        if content.startswith(SIGNATURE):
            return _png(content)
        if found := _PPM.match(content):
            width, height, top = map(int, found.groups())
            _size(width, height)
            if top != 255:
                raise ValueError(f"{top} shades")
            return np.frombuffer(content, np.uint8, width * height * 3, found.end()).reshape(height, width, 3)
    except (ValueError, zlib.error, struct.error, IndexError, TypeError) as e:
        raise ValueError(f"the image can't be read: {e}") from e
    raise ValueError("the image can't be read: neither PNG nor PPM")


_RGB = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("pixels", BinaryType()), StructField("error", StringType())])


def rgb(content: Column) -> Column:
    """(width, height, pixels, error) of an image file: three bytes a pixel, row by row. A file that can't be read has an error and nulls;
    null or empty content has nulls alone."""

    @F.pandas_udf(_RGB)
    def run(files: pd.Series) -> pd.DataFrame:
        out = []
        for file in files:
            try:
                p = pixels(file) if file else None
                out.append((None, None, None, None) if p is None else (p.shape[1], p.shape[0], p.tobytes(), None))
            except ValueError as e:
                out.append((None, None, None, str(e)))
        df = pd.DataFrame(out, columns=_RGB.names, dtype=object)
        return df.astype({"width": "Int32", "height": "Int32"})

    return run(content)
