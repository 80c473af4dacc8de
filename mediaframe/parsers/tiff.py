"""TIFF and EXIF directories."""

from __future__ import annotations

import struct
from typing import NamedTuple

from . import Malformed, need

#: Bytes of a value by type 1 to 13.
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
#: Fixed value: the tag of a maker note.
MAKER_NOTE = 0x927C
#: Tags that point to further directories, and their names.
POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}


class Entry(NamedTuple):
    ifd: str
    tag: int
    kind: int
    count: int
    value: bytes
    value_offset: int


class Tiff:
    def __init__(self, data: bytes) -> None:
        self.data = data
        mark = need(data, 0, 8, "TIFF header")
        if mark[:2] not in (b"II", b"MM"):
            raise Malformed("no byte order")
        self.big = mark[:2] == b"MM"
        self.order = ">" if self.big else "<"
        if struct.unpack(self.order + "H", mark[2:4])[0] != 42:
            raise Malformed("no TIFF mark")
        self.first = struct.unpack(self.order + "I", mark[4:8])[0]

    def ifd(self, at: int, name: str = "ifd0", lenient: bool = False) -> list[Entry]:
        """Entries of a directory; one whose value is not there is malformed, or left out if lenient."""
        n = struct.unpack(self.order + "H", need(self.data, at, 2, "directory"))[0]
        out = []
        for k in range(n):
            raw = need(self.data, at + 2 + 12 * k, 12, "entry")
            tag, kind, count = struct.unpack(self.order + "2HI", raw[:8])
            size = WIDTHS.get(kind, 0) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(self.order + "I", raw[8:])[0]
            if not lenient or (size and place + size <= len(self.data)):
                out.append(Entry(name, tag, kind, count, need(self.data, place, size, "value"), place))
        return out

    def next_ifd(self, at: int) -> int:
        n = struct.unpack(self.order + "H", need(self.data, at, 2, "directory"))[0]
        return struct.unpack(self.order + "I", need(self.data, at + 2 + 12 * n, 4, "directory"))[0]

    def number(self, e: Entry, index: int = 0) -> int:
        width = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}.get(e.kind)
        if width is None or index >= e.count:
            raise Malformed("no whole number")
        return struct.unpack_from(self.order + width, e.value, index * WIDTHS[e.kind])[0]


def entries(data: bytes) -> list[Entry]:
    """All entries of IFD0, IFD1, EXIF, GPS and interoperability directories. A directory that comes up twice is malformed."""
    t = Tiff(data)
    out, seen, todo = [], set(), [("ifd0", t.first)]
    while todo:
        name, at = todo.pop(0)
        if at in seen:
            raise Malformed("directories form a ring")
        seen.add(at)
        own = t.ifd(at, name)
        out += own
        todo += [(POINTERS[e.tag], t.number(e)) for e in own if e.tag in POINTERS]
        if name == "ifd0" and (nxt := t.next_ifd(at)):
            todo.append(("ifd1", nxt))
    return out


def write(fields: list[tuple[int, int, int, bytes]], big: bool = False) -> bytes:
    """A TIFF block of one directory: (tag, type, count, value) by tag, long values behind it at even offsets."""
    o = ">" if big else "<"
    fields = sorted(fields)
    base = 8 + 2 + 12 * len(fields) + 4
    head, tail = [], b""
    for tag, kind, count, value in fields:
        if len(value) <= 4:
            spot = value.ljust(4, b"\0")
        else:
            tail += b"\0" * (len(tail) % 2)
            spot = struct.pack(o + "I", base + len(tail))
            tail += value
        head.append(struct.pack(o + "2HI", tag, kind, count) + spot)
    return (b"MM" if big else b"II") + struct.pack(o + "HIH", 42, 8, len(fields)) + b"".join(head) + struct.pack(o + "I", 0) + tail


def _directory(fields: list[tuple[int, int, int, bytes]], at: int, o: str) -> bytes:
    """A directory that lies at offset `at`, with its values behind it."""
    base, head, tail = at + 2 + 12 * len(fields) + 4, [], b""
    for tag, kind, count, value in sorted(fields):
        if len(value) <= 4:
            spot = value.ljust(4, b"\0")
        else:
            tail += b"\0" * (len(tail) % 2)
            spot = struct.pack(o + "I", base + len(tail))
            tail += value
        head.append(struct.pack(o + "2HI", tag, kind, count) + spot)
    return struct.pack(o + "H", len(fields)) + b"".join(head) + struct.pack(o + "I", 0) + tail + b"\0" * (len(tail) % 2)


class _Note(Tiff):
    """Apple's maker note, a directory at byte 14 whose offsets count from the note's start."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"Apple iOS\0") or data[12:14] not in (b"II", b"MM"):
            raise Malformed("no note of Apple's")
        self.data, self.big = data, data[12:14] == b"MM"
        self.order = ">" if self.big else "<"


def maker_note(data: bytes, keep) -> bytes:
    """Apple's maker note with the tags that keep(tag) allows; empty if it is another maker's, cannot be read, or none is left."""
    try:
        note = _Note(data)
        kept = [(e.tag, e.kind, e.count, e.value) for e in note.ifd(14, "note", lenient=True) if keep(e.tag)]
    except Malformed:
        return b""
    return data[:14] + _directory(kept, 14, note.order) if kept else b""


def _says_something(main: list, exif: list, o: str) -> bool:
    """Whether EXIF entries say more than their version, sRGB, which is the default, and a pixel size beside 72 dots per inch."""

    def number(e) -> int | None:
        return struct.unpack_from(o + {3: "H", 4: "I"}[e[1]], e[3].ljust(4, b"\0"))[0] if e[1] in (3, 4) else None

    def usual(e) -> bool:
        if e[0] in (0x011A, 0x011B):
            return e[1] == 5 and len(e[3]) == 8 and (r := struct.unpack(o + "2I", e[3]))[0] == 72 * r[1]
        return number(e) == 2 if e[0] == 0x0128 else True

    scaled = not all(map(usual, main))
    told = {0x9000: lambda e: False, 0xA001: lambda e: number(e) != 1, 0xA002: lambda e: scaled, 0xA003: lambda e: scaled}
    return any(told.get(e[0], lambda _: True)(e) for e in exif)


def filtered(data: bytes, keep, keep_note=lambda tag: False) -> bytes:
    """The block with the entries that keep(ifd, tag) allows, of the first, the EXIF and the Interop directory; GPS and IFD1 never; empty if nothing is left that says anything.

    Of a maker note that is Apple's the tags stay that keep_note(tag) allows.
    """
    t = Tiff(data)
    o = ">" if t.big else "<"
    own = {k: [(e.tag, e.kind, e.count, e.value) for e in entries(data) if e.ifd == k and e.tag not in POINTERS and keep(k, e.tag)] for k in ("ifd0", "exif", "interop")}
    main, exif, interop = own["ifd0"], own["exif"], own["interop"]
    for e in entries(data):
        note = maker_note(e.value, keep_note) if e.ifd == "exif" and e.tag == MAKER_NOTE and not keep(e.ifd, e.tag) else b""
        if note:
            exif.append((e.tag, 7, len(note), note))
    if not interop and not _says_something(main, exif, o):
        exif = []
    if not exif and not interop:
        upright = len(main) == 1 and main[0][0] == 0x0112 and main[0][1] == 3 and struct.unpack_from(o + "H", main[0][3])[0] == 1
        return b"" if not main or upright else write(main, t.big)
    pointer = lambda tag, at: (tag, 4, 1, struct.pack(o + "I", at))
    exif_at = 8 + len(_directory([*main, pointer(0x8769, 0)], 8, o))
    inner = lambda at: [*exif, pointer(0xA005, at)] if interop else exif
    interop_at = exif_at + len(_directory(inner(0), exif_at, o))
    out = (b"MM" if t.big else b"II") + struct.pack(o + "HI", 42, 8) + _directory([*main, pointer(0x8769, exif_at)], 8, o) + _directory(inner(interop_at), exif_at, o)
    return out + (_directory(interop, interop_at, o) if interop else b"")
