"""RIFF and WebP chunks."""

from __future__ import annotations

import struct
from typing import NamedTuple

from . import Malformed


class Chunk(NamedTuple):
    ordinal: int
    kind: str
    offset: int
    size: int
    data: bytes


def chunks(data: bytes, start: int = 12, strict: bool = False) -> list[Chunk]:
    """Chunks from start on, padded to even lengths. Lenient: what is there before the first misfit; strict: all must fit."""
    out: list[Chunk] = []
    at = start
    while len(data) - at >= 8:
        kind, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > len(data):
            if strict:
                raise Malformed("truncated chunk")
            return out
        out.append(Chunk(len(out), kind.decode("latin-1"), at, size, data[at + 8 : at + 8 + size]))
        at += 8 + size
        if size % 2:
            if strict and data[at : at + 1] != b"\0":
                raise Malformed("bad padding")
            at += 1
    if strict and at != len(data):
        raise Malformed("stray bytes")
    return out


def webp(data: bytes, strict: bool = False) -> list[Chunk]:
    """Chunks of a WebP file, up to the size that its head gives."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Malformed("no WebP header")
    size = struct.unpack_from("<I", data, 4)[0] + 8
    if strict and size != len(data):
        raise Malformed("RIFF size differs from the file's")
    return chunks(data[:size], strict=strict)


def write(parts: list[tuple[str, bytes]]) -> bytes:
    body = b"WEBP" + b"".join(k.encode("latin-1") + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


#: The order of chunks in an extended file; flags of VP8X.
ORDER = {"VP8X": 0, "ICCP": 1, "ANIM": 2, "ANMF": 3, "ALPH": 3, "VP8 ": 4, "VP8L": 4, "EXIF": 5, "XMP ": 6}
FLAGS = {"ICCP": 0x20, "ALPH": 0x10, "EXIF": 0x08, "XMP ": 0x04, "ANIM": 0x02}


def rank(kind: str) -> int:
    return ORDER.get(kind, 7)


def dimensions(kind: str, body: bytes) -> tuple[int, int]:
    """Width and height in a VP8, VP8L or VP8X head."""
    if kind == "VP8 ":
        if len(body) < 10 or body[3:6] != b"\x9d\x01\x2a":
            raise Malformed("VP8: no key frame")
        w, h = struct.unpack_from("<2H", body, 6)
        return w & 0x3FFF, h & 0x3FFF
    if kind == "VP8L":
        if len(body) < 5 or body[0] != 0x2F:
            raise Malformed("VP8L: no signature")
        bits = struct.unpack_from("<I", body, 1)[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == "VP8X":
        if len(body) < 10:
            raise Malformed("VP8X: truncated")
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    raise Malformed(f"{kind}: no dimensions")


def violations(data: bytes, original: bytes | None = None) -> list[tuple[str, int]]:
    try:
        parts = webp(data, strict=True)
    except Malformed as e:
        return [(str(e), -1)]
    out: list[tuple[str, int]] = []
    kinds = [c.kind for c in parts]
    for a, b in zip(parts, parts[1:]):
        if rank(b.kind) < rank(a.kind):
            out.append((f"{b.kind.strip()} out of order", b.ordinal))
    try:
        if "VP8X" in kinds:
            head = parts[kinds.index("VP8X")]
            canvas = dimensions("VP8X", head.data)
            for kind, bit in FLAGS.items():
                has = kind in kinds
                if kind != "ALPH" and has != bool(head.data[0] & bit):
                    out.append((f"flag of {kind.strip()} is wrong", head.ordinal))
            for c in parts:
                if c.kind in ("VP8 ", "VP8L") and dimensions(c.kind, c.data) != canvas:
                    out.append(("image and canvas differ in size", c.ordinal))
                if c.kind == "ANMF":
                    if c.size < 16:
                        raise Malformed("ANMF: truncated")
                    x, y, w, h = (int.from_bytes(c.data[k : k + 3], "little") for k in (0, 3, 6, 9))
                    if 2 * x + w + 1 > canvas[0] or 2 * y + h + 1 > canvas[1]:
                        out.append(("frame outside the canvas", c.ordinal))
                if c.kind == "ALPH" and (not c.data or c.data[0] & 3 > 1):
                    out.append(("ALPH: bad header", c.ordinal))
        elif len(parts) != 1 or kinds[0] not in ("VP8 ", "VP8L"):
            out.append(("simple file with other chunks", -1))
        else:
            dimensions(kinds[0], parts[0].data)
    except Malformed as e:
        out.append((str(e), -1))
    if original is not None:
        own = {(c.kind, c.data) for c in webp(original)}
        out += [(f"foreign {c.kind.strip()}", c.ordinal) for c in parts if c.kind in ("ICCP", "EXIF", "XMP ") and (c.kind, c.data) not in own]
    return out
