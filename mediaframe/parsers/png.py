"""PNG chunks, texts and structure."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

from ..functions.scalars import INFLATE_LIMIT, PNG_CHANNELS, PNG_DEPTHS, inflate_exact, png_bytes_of_rows
from . import Malformed

SIGNATURE = b"\x89PNG\r\n\x1a\n"


class Chunk(NamedTuple):
    ordinal: int
    kind: str
    offset: int
    size: int
    crc_ok: bool
    data: bytes


def chunks(data: bytes, strict: bool = False) -> list[Chunk]:
    """Chunks up to IEND. Strict: letters as types, right checksums, IEND there and last."""
    out: list[Chunk] = []
    if not data.startswith(SIGNATURE):
        if strict:
            raise Malformed("no PNG signature")
        return out
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            break
        if not kind.isalpha():
            if strict:
                raise Malformed("chunk type is not letters")
            break
        body = data[at + 8 : at + 8 + size]
        ok = zlib.crc32(kind + body) == struct.unpack_from(">I", data, at + 8 + size)[0]
        if strict and not ok:
            raise Malformed(f"{kind.decode()}: wrong checksum")
        out.append(Chunk(len(out), kind.decode("latin-1"), at, size, ok, body))
        at += 12 + size
        if kind == b"IEND":
            if strict and at != len(data):
                raise Malformed("data after IEND")
            return out
    if strict:
        raise Malformed("truncated chunk" if at != len(data) else "no IEND")
    return out


def write(parts: list[tuple[str, bytes]]) -> bytes:
    out = [SIGNATURE]
    for kind, body in parts:
        k = kind.encode("latin-1")
        out.append(struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body)))
    return b"".join(out)


def text_of(kind: str, body: bytes) -> tuple[str, bytes | None] | None:
    """Keyword and value of tEXt, zTXt, iTXt and iCCP chunks; the value is None if it cannot be inflated."""
    if kind not in ("tEXt", "zTXt", "iTXt", "iCCP"):
        return None
    keyword, zero, rest = body.partition(b"\0")
    if not zero or not 1 <= len(keyword) <= 79:
        return None
    name = keyword.decode("latin-1")
    if kind == "tEXt":
        return name, rest
    if kind in ("zTXt", "iCCP"):
        return name, inflate_exact(rest[1:]) if rest[:1] == b"\0" else None
    if len(rest) < 2:
        return None
    packed, method, tail = rest[0], rest[1], rest[2:].split(b"\0", 2)
    if len(tail) < 3:
        return None
    value = tail[2]
    return name, value if not packed else inflate_exact(value) if method == 0 else None


#: The ancillary chunks that must stand before PLTE, and those before IDAT.
BEFORE_PLTE = {"cHRM", "gAMA", "iCCP", "sBIT", "sRGB", "cICP", "mDCV", "cLLI"}
BEFORE_IDAT = BEFORE_PLTE | {"bKGD", "hIST", "tRNS", "pHYs", "sPLT", "PLTE", "acTL"}
ONCE = BEFORE_PLTE | {"IHDR", "PLTE", "IEND", "tRNS", "bKGD", "hIST", "pHYs", "tIME", "eXIf", "acTL"}


def header(body: bytes) -> tuple[int, int, int, int, int]:
    """width, height, depth, colour type, interlace."""
    if len(body) != 13:
        raise Malformed("IHDR: wrong length")
    w, h, depth, colour, compression, filters, interlace = struct.unpack(">2I5B", body)
    if not 0 < w < 2**31 or not 0 < h < 2**31 or depth not in PNG_DEPTHS.get(colour, ()) or compression or filters or interlace > 1:
        raise Malformed("IHDR: illegal values")
    return w, h, depth, colour, interlace


def violations(data: bytes, original: bytes | None = None) -> list[tuple[str, int]]:
    """Rules that a result breaks, with the ordinal of the chunk: order, counts, image data, and, given the original, foreign chunks."""
    try:
        parts = chunks(data, strict=True)
    except Malformed as e:
        return [(str(e), -1)]
    out: list[tuple[str, int]] = []
    if not parts or parts[0].kind != "IHDR":
        return [("IHDR is not first", 0)]
    try:
        w, h, depth, colour, interlace = header(parts[0].data)
    except Malformed as e:
        return [(str(e), 0)]
    seen: set[str] = set()
    ended_data = False
    for c in parts:
        if c.kind in ONCE and c.kind in seen:
            out.append((f"second {c.kind}", c.ordinal))
        if c.kind in BEFORE_PLTE and "PLTE" in seen or c.kind in BEFORE_IDAT and "IDAT" in seen:
            out.append((f"{c.kind} too late", c.ordinal))
        if c.kind == "IDAT" and ended_data:
            out.append(("IDAT not contiguous", c.ordinal))
        ended_data = ended_data or "IDAT" in seen and c.kind != "IDAT"
        if c.kind[0].isupper() and c.kind not in ("IHDR", "PLTE", "IDAT", "IEND"):
            out.append((f"unknown critical {c.kind}", c.ordinal))
        if c.kind == "PLTE":
            if c.size % 3 or not 0 < c.size // 3 <= (2**depth if colour == 3 else 256):
                out.append(("PLTE: wrong length", c.ordinal))
            if colour in (0, 4):
                out.append(("PLTE in a grey image", c.ordinal))
            entries = c.size // 3
        if c.kind == "tRNS":
            fits = {0: c.size == 2, 2: c.size == 6, 3: "PLTE" in seen and c.size <= entries}.get(colour, False)
            if not fits:
                out.append(("tRNS does not fit", c.ordinal))
        seen.add(c.kind)
    if colour == 3 and "PLTE" not in seen:
        out.append(("no PLTE", -1))
    if {"sRGB", "iCCP"} <= seen:
        out.append(("sRGB and iCCP", -1))
    numbers = [struct.unpack(">I", c.data[:4])[0] for c in parts if c.kind in ("fcTL", "fdAT") and c.size >= 4]
    if numbers != list(range(len(numbers))):
        out.append(("frames not in sequence", -1))
    body = b"".join(c.data for c in parts if c.kind == "IDAT")
    expected = png_bytes_of_rows(w, h, PNG_CHANNELS[colour] * depth, bool(interlace))
    pixels = inflate_exact(body, min(INFLATE_LIMIT, expected + 1)) if expected <= INFLATE_LIMIT else None
    if pixels is None or len(pixels) != expected:
        out.append(("image data has another size", -1))
    if original is not None:
        own = {(c.kind, c.data) for c in chunks(original)}
        for c in parts:
            if c.kind[0].islower() and (c.kind, c.data) not in own and c.kind not in ("sRGB", "tRNS"):
                out.append((f"foreign {c.kind}", c.ordinal))
    return out
