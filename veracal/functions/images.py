"""Image sizes from file headers; no pixel is decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

# Bytes of a file that are looked at first; headers that reach further are walked in the whole file.
HEADER_BYTES = 1 << 16

SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("cut", BooleanType())])
CUT = (None, None, True)
NONE = (None, None, False)


def _jpeg(data: bytes) -> tuple:
    """Walk the segments to the frame header."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return NONE
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0x01, *range(0xD0, 0xD8)):
            at += 2
        elif marker in (0xD9, 0xDA):
            return NONE
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                return CUT
            height, width = struct.unpack(">HH", data[at + 5:at + 9])
            return width, height, False
        else:
            at += 2 + struct.unpack(">H", data[at + 2:at + 4])[0]
    return CUT


def _webp(data: bytes) -> tuple:
    if len(data) < 30:
        return CUT
    kind = data[12:16]
    if kind == b"VP8X":
        width, height = (int.from_bytes(data[k:k + 3], "little") + 1 for k in (24, 27))
    elif kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        width, height = (x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    elif kind == b"VP8L" and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        width, height = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    else:
        return NONE
    return width, height, False


def header_size(data: bytes | None) -> tuple:
    """(width, height, cut) of PNG, JPEG, GIF, WebP or BMP data; cut: the size may stand behind the end of the data."""
    if not data:
        return NONE
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out = (*struct.unpack(">II", data[16:24]), False) if len(data) >= 24 and data[12:16] == b"IHDR" else CUT if len(data) < 24 else NONE
    elif data[:2] == b"\xff\xd8":
        out = _jpeg(data)
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        out = (*struct.unpack("<HH", data[6:10]), False) if len(data) >= 10 else CUT
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        out = _webp(data)
    elif data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        out = (width, abs(height), False)
    else:
        return NONE
    return out if out[2] or (out[0] or 0) > 0 and out[1] > 0 and max(out[:2]) < 1 << 31 else NONE


@pandas_udf(SIZE)
def _sizes(data: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([header_size(x) for x in data], columns=["width", "height", "cut"])
    return found.astype({"width": "Int32", "height": "Int32", "cut": "bool"})


def image_size(content: Column, header_bytes: int = HEADER_BYTES) -> Column:
    """struct(width, height, cut) of a binary column; null sizes where no header is found or the column is null.

    Tasks get the first bytes, and whole contents only for headers that reach further.
    """
    first = _sizes(F.substring(content, 1, header_bytes))
    rest = _sizes(F.when(first["cut"] & (F.length(content) > header_bytes), content))
    return F.when(first["cut"], rest).otherwise(first)
