"""What image files are made of: PNG chunks, JPEG segments, RIFF chunks, walked by their own lengths.

A name that stands somewhere in the bytes proves nothing; a part counts only where the file's
structure has one. A length that reaches past the end, or a checksum that does not hold, is reported
and ends the walk or marks the part; no file makes it fail.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signatures, and the parts of each format that carry text, Exif, XMP and credentials.
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
CARRIERS = {"tEXt": "text", "zTXt": "text", "iTXt": "text", "eXIf": "exif", "caBX": "credentials", "EXIF": "exif", "XMP ": "xmp", "C2PA": "credentials", "COM": "text"}
EXIF, XMP, JUMBF = b"Exif\x00\x00", b"http://ns.adobe.com/xap/1.0/\x00", b"JP"
STANDALONE = {0x01, *range(0xD0, 0xD8)}
NAMES = {0xC4: "DHT", 0xDA: "SOS", 0xDB: "DQT", 0xDD: "DRI", 0xFE: "COM", 0xD9: "EOI"}

#: name, offset, length of its content, status (ok, bad_crc, truncated), what it carries.
Part = tuple[str, int, int, str, str | None]


def png_parts(data: bytes) -> Iterator[Part]:
    at = len(PNG)
    while at < len(data):
        name = data[at + 4 : at + 8].decode("latin-1")
        size = int.from_bytes(data[at : at + 4])
        end = at + 12 + size
        carries = CARRIERS.get(name)
        if len(data) - at < 12 or end > len(data):
            yield name, at, max(0, min(size, len(data) - at - 8)), "truncated", carries
            return
        holds = zlib.crc32(memoryview(data)[at + 4 : end - 4]) == int.from_bytes(data[end - 4 : end])
        yield name, at, size, "ok" if holds else "bad_crc", carries
        if name == "IEND":
            if end < len(data):
                yield "trailing", end, len(data) - end, "ok", None
            return
        at = end


def jpeg_parts(data: bytes) -> Iterator[Part]:
    at = len(JPEG)
    while at < len(data):
        if data[at] != 0xFF:  # entropy-coded data, up to a marker that is no stuffed byte and no restart
            start = at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    yield "scan", start, len(data) - start, "truncated", None
                    return
                if data[at + 1] != 0 and data[at + 1] not in STANDALONE:
                    break
                at += 2
            yield "scan", start, at - start, "ok", None
            continue
        marker = data[at + 1] if at + 1 < len(data) else 0xFF
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        name = NAMES.get(marker, f"APP{marker - 0xE0}" if 0xE0 <= marker <= 0xEF else f"{marker:02X}")
        if marker == 0xD9:
            yield name, at, 0, "ok", None
            if at + 2 < len(data):
                yield "trailing", at + 2, len(data) - at - 2, "ok", None
            return
        if marker in STANDALONE:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4]) if at + 4 <= len(data) else 0
        own = data[at + 4 : at + 2 + size]
        carries = CARRIERS.get(name)
        if name == "APP1":
            carries = "exif" if own.startswith(EXIF) else "xmp" if own.startswith(XMP) else None
        elif name == "APP11" and own.startswith(JUMBF) and b"c2pa" in own:
            carries = "credentials"
        if size < 2 or at + 2 + size > len(data):
            yield name, at, max(0, len(data) - at - 4), "truncated", carries
            return
        yield name, at, size - 2, "ok", carries
        at += 2 + size


def riff_parts(data: bytes) -> Iterator[Part]:
    at = 12
    while at < len(data):
        name = data[at : at + 4].decode("latin-1")
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        carries = CARRIERS.get(name.upper())
        if len(data) - at < 8 or at + 8 + size > len(data):
            yield name, at, max(0, len(data) - at - 8), "truncated", carries
            return
        yield name, at, size, "ok", carries
        at += 8 + size + size % 2


def parts(data: bytes | None) -> list[Part]:
    """The parts of a file of a known format, in order; none for others."""
    if not data:
        return []
    if data.startswith(PNG):
        return list(png_parts(data))
    if data.startswith(JPEG) and data[2:3] == b"\xff":
        return list(jpeg_parts(data))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return list(riff_parts(data))
    return []


PARTS = "array<struct<name:string,offset:long,length:long,status:string,carries:string>>"
_ARROW = pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("status", pa.string()), ("carries", pa.string())]))


def with_parts(files: DataFrame, content: str = "content") -> DataFrame:
    """The files with ``parts``, their structure."""

    @F.arrow_udf(PARTS)
    def walked(column: pa.Array) -> pa.Array:
        fields = ("name", "offset", "length", "status", "carries")
        return pa.array([[dict(zip(fields, part)) for part in parts(data.as_py())] for data in column], _ARROW)

    return files.withColumn("parts", walked(F.col(content)))
