"""Reading and writing fixed places of BINARY columns with built-in functions, bounds checked: out of range gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def part(b: Column, offset: Column | int, length: Column | int) -> Column:
    """length bytes from offset (0-based); NULL where they are not all there."""
    offset, length = _c(offset), _c(length)
    inside = (offset >= 0) & (length >= 0) & (offset <= F.length(b) - length)
    return F.when(inside, F.substring(b, (offset + 1).cast("int"), length.cast("int")))


def u8(b: Column, offset: Column | int) -> Column:
    return be(b, offset, 1)


def be(b: Column, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned number; NULL out of range and above the largest BIGINT."""
    return F.conv(F.hex(part(b, offset, size)), 16, 10).try_cast("bigint")


def flipped(b: Column) -> Column:
    """The bytes in the other order. (reverse() takes BINARY for text here, so it goes by pairs of hex digits.)"""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(b), F.lit("(..)"), 1)), ""))


def le(b: Column, offset: Column | int, size: int) -> Column:
    return F.conv(F.hex(flipped(part(b, offset, size))), 16, 10).try_cast("bigint")


def put_be(v: Column | int, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(_c(v).cast("bigint")), 2 * size, "0"))


def put_le(v: Column | int, size: int) -> Column:
    return flipped(put_be(v, size))


def raw(data: bytes | str) -> Column:
    """A BINARY literal."""
    data = data.encode("latin-1") if isinstance(data, str) else data
    return F.unhex(F.lit(data.hex()))


def starts(b: Column, offset: int, prefix: bytes) -> Column:
    return F.coalesce(part(b, offset, len(prefix)) == raw(prefix), F.lit(False))


def holds(b: Column, needle: bytes) -> Column:
    return F.contains(b, raw(needle))


def is_padding(b: Column) -> Column:
    """Nothing but 0x00 and 0xFF."""
    return F.hex(b).rlike("^(00|FF)*$")


def is_critical(kind: Column) -> Column:
    """Whether a PNG chunk of this type must be understood: bit 5 of the first letter is clear."""
    return F.ascii(kind).bitwiseAND(F.lit(32)) == 0


# Writers of the container formats, as byte strings.


def png_chunk(kind: str, data: Column) -> Column:
    body = F.concat(raw(kind), data)
    return F.concat(put_be(F.length(data), 4), body, put_be(F.crc32(body), 4))


PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_header(width: Column | int, height: Column | int, depth: int = 8, colour: int = 0) -> Column:
    return png_chunk("IHDR", F.concat(put_be(width, 4), put_be(height, 4), raw(bytes([depth, colour, 0, 0, 0]))))


def png(*chunks: Column) -> Column:
    return F.concat(raw(PNG_SIGNATURE), *chunks, png_chunk("IEND", raw(b"")))


def riff_chunk(kind: str, data: Column) -> Column:
    return F.concat(raw(kind), put_le(F.length(data), 4), data, F.when(F.length(data) % 2 == 1, raw(b"\0")).otherwise(raw(b"")))


def webp(*chunks: Column) -> Column:
    body = F.concat(raw("WEBP"), *chunks)
    return F.concat(raw("RIFF"), put_le(F.length(body), 4), body)


def jpeg_segment(marker: int, payload: Column) -> Column:
    return F.concat(raw(bytes([0xFF, marker])), put_be(F.length(payload) + 2, 2), payload)


def box(kind: str, payload: Column, wide: Column | None = None) -> Column:
    """An ISO box; with a 64-bit size where wide is true."""
    small = F.concat(put_be(F.length(payload) + 8, 4), raw(kind), payload)
    if wide is None:
        return small
    large = F.concat(put_be(1, 4), raw(kind), put_be(F.length(payload) + 16, 8), payload)
    return F.when(wide, large).otherwise(small)


def iim_dataset(record: int, dataset: int, data: Column) -> Column:
    """An IIM dataset; over 32,767 bytes with an extended length."""
    head = raw(bytes([0x1C, record, dataset]))
    long = F.concat(head, raw(b"\x80\x04"), put_be(F.length(data), 4), data)
    return F.when(F.length(data) > 32767, long).otherwise(F.concat(head, put_be(F.length(data), 2), data))
