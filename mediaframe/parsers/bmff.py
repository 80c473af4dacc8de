"""ISO base media boxes, HEIF items, MP4 metadata, JPEG XL containers."""

from __future__ import annotations

import struct
from typing import NamedTuple

from . import Malformed, need


class Box(NamedTuple):
    ordinal: int
    parent: int
    kind: str
    offset: int
    size: int
    header: int


def boxes(data: bytes, start: int = 0, end: int | None = None, top: bool = True, parent: int = -1, first: int = 0) -> list[Box]:
    """Boxes that fill [start, end) exactly. Size 1: a 64-bit size follows; size 0: up to the end, at the top only; uuid: 16 bytes more."""
    out: list[Box] = []
    at, end = start, len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise Malformed("stray bytes after a box")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", need(data, at + 8, 8, "box"))[0], 16
        elif size == 0:
            if not top:
                raise Malformed("open box inside another")
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise Malformed(f"{kind.decode('latin-1')}: bad size")
        out.append(Box(first + len(out), parent, kind.decode("latin-1"), at, size, head))
        at += size
    return out


def only(found: list[Box], kind: str) -> Box:
    own = [b for b in found if b.kind == kind]
    if len(own) != 1:
        raise Malformed(f"{len(own)} {kind} boxes")
    return own[0]


def payload(data: bytes, b: Box) -> bytes:
    return data[b.offset + b.header : b.offset + b.size]


#: Boxes of a movie that hold boxes, and those that hold metadata.
MOVIE_CONTAINERS = {"moov", "trak", "mdia", "minf", "edts"}
MOVIE_METADATA = {"udta", "meta", "uuid", "XMP_"}


def movie_holds_metadata(data: bytes, start: int = 0, end: int | None = None, top: bool = True) -> bool | None:
    """True, False, or None of data that is no sound sequence of boxes."""
    try:
        for b in boxes(data, start, end, top):
            if b.kind in MOVIE_METADATA:
                return True
            if b.kind in MOVIE_CONTAINERS:
                inner = movie_holds_metadata(data, b.offset + b.header, b.offset + b.size, False)
                if inner is None or inner:
                    return inner
    except Malformed:
        return None
    return False


class Item(NamedTuple):
    item_id: int
    kind: str
    name: str
    content_type: str


class Reference(NamedTuple):
    kind: str
    from_id: int
    to_id: int


class Extent(NamedTuple):
    item_id: int
    method: int
    offset: int
    length: int


class Heif(NamedTuple):
    primary: int | None
    items: list[Item]
    references: list[Reference]
    extents: list[Extent]
    groups: list[int]
    boxes: list[Box]


def _uint(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(need(data, at, size), "big")


def heif(data: bytes) -> Heif:
    """The item tables of a HEIF file: rows of items, references, extents and entity groups."""
    tops = boxes(data)
    meta = only(tops, "meta")
    inner = boxes(data, meta.offset + meta.header + 4, meta.offset + meta.size, False, meta.ordinal, len(tops))
    by = lambda kind: [payload(data, b) for b in inner if b.kind == kind]
    primary = None
    for p in by("pitm"):
        primary = _uint(p, 4, 2 if p[0] == 0 else 4)
    items = []
    for p in by("iinf"):
        wide = p[0] != 0
        for b in boxes(p, 4 + (4 if wide else 2), None, False):
            q = payload(p, b)
            if b.kind != "infe" or q[0] < 2:
                raise Malformed("infe: old version")
            at = 6 if q[0] == 2 else 8
            number, kind = _uint(q, 4, at - 4), need(q, at + 2, 4).decode("latin-1")
            strings = q[at + 6 :].split(b"\0")
            items.append(Item(number, kind, strings[0].decode("utf-8", "replace"), strings[1].decode("latin-1") if kind == "mime" and len(strings) > 1 else ""))
    references = []
    for p in by("iref"):
        size = 2 if p[0] == 0 else 4
        for b in boxes(p, 4, None, False):
            q = payload(p, b)
            source, n = _uint(q, 0, size), _uint(q, size, 2)
            references += [Reference(b.kind, source, _uint(q, size + 2 + k * size, size)) for k in range(n)]
    extents = []
    for p in by("iloc"):
        version, sizes = p[0], _uint(p, 4, 2)
        o, n, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
        at = 6
        count = _uint(p, at, 2 if version < 2 else 4)
        at += 2 if version < 2 else 4
        for _ in range(count):
            number = _uint(p, at, 2 if version < 2 else 4)
            at += 2 if version < 2 else 4
            method = 0
            if version:
                method = _uint(p, at, 2) & 15
                at += 2
            at += 2
            start = _uint(p, at, base)
            at += base
            m = _uint(p, at, 2)
            at += 2
            for _ in range(m):
                at += index
                extents.append(Extent(number, method, start + _uint(p, at, o), _uint(p, at + o, n)))
                at += o + n
    groups = []
    for p in by("grpl"):
        groups += [_uint(payload(p, b), 4, 4) for b in boxes(p, 0, None, False)]
    return Heif(primary, items, references, extents, groups, [*tops, *inner])


def heif_violations(data: bytes) -> list[tuple[str, int]]:
    """References of ids that are not there, groups with items' ids, data outside of what holds data."""
    try:
        h = heif(data)
    except Malformed as e:
        return [(str(e), -1)]
    out: list[tuple[str, int]] = []
    ids = [i.item_id for i in h.items]
    known = set(ids)
    if len(known) != len(ids):
        out.append(("item id twice", -1))
    if h.primary not in known:
        out.append(("primary item missing", h.primary or -1))
    out += [("reference from a missing item", r.from_id) for r in h.references if r.from_id not in known]
    out += [("reference to a missing item", r.to_id) for r in h.references if r.to_id not in known]
    out += [("location of a missing item", e.item_id) for e in h.extents if e.item_id not in known]
    out += [("group has an item's id", g) for g in h.groups if g in known]
    spaces = [(b.offset + b.header, b.offset + b.size) for b in h.boxes if b.kind in ("mdat", "idat")]
    for e in h.extents:
        if e.method == 0 and not any(lo <= e.offset and e.offset + e.length <= hi for lo, hi in spaces):
            out.append(("data outside mdat", e.item_id))
    taken = sorted((e.offset, e.offset + e.length, e.item_id) for e in h.extents if e.method == 0)
    out += [("extents overlap", b[2]) for a, b in zip(taken, taken[1:]) if b[0] < a[1] and a[2] != b[2]]
    return out


JXL_SIGNATURE = bytes.fromhex("0000000C4A584C200D0A870A")


class Jxl(NamedTuple):
    boxes: list[Box]
    from_jpeg: bool
    exif: list[bytes]
    xmp: list[bytes]
    jumbf: list[bytes]
    needs_brotli: int


def jxl(data: bytes) -> Jxl:
    """A JPEG XL container: boxes, whether a JPEG can be rebuilt, metadata payloads; compressed boxes are counted, not read."""
    if not data.startswith(JXL_SIGNATURE):
        if data[:2] == b"\xff\x0a":
            return Jxl([], False, [], [], [], 0)
        raise Malformed("no JPEG XL signature")
    found = boxes(data)
    numbers = [struct.unpack(">I", need(payload(data, b), 0, 4))[0] for b in found if b.kind == "jxlp"]
    if numbers and (any(n & 0x7FFFFFFF != k for k, n in enumerate(numbers)) or any(n >> 31 for n in numbers[:-1]) or not numbers[-1] >> 31):
        raise Malformed("jxlp boxes out of order")
    if any(b.kind == "jxlc" for b in found) == bool(numbers):
        raise Malformed("no codestream, or two")
    packed = [payload(data, b)[:4] for b in found if b.kind == "brob"]
    own = lambda kind: [payload(data, b) for b in found if b.kind == kind]
    return Jxl(found, any(b.kind == "jbrd" for b in found), own("Exif"), own("xml "), own("jumb"), len(packed))
