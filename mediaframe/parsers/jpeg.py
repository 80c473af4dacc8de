"""JPEG segments, entropy-coded data, tables, layout of files with several images."""

from __future__ import annotations

import struct
from typing import NamedTuple

from . import Malformed, need
from .tiff import Tiff

SOI, EOI, SOS, DQT, DHT, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE
#: Frame markers; those of lossless and arithmetic coding.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
ARITHMETIC = {0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
LOSSLESS = {0xC3, 0xC7, 0xCB, 0xCF}

# Signatures of application segments.
SIGNATURES = (
    ("jfif", 0xE0, b"JFIF\0"), ("jfxx", 0xE0, b"JFXX\0"), ("exif", 0xE1, b"Exif\0\0"), ("xmp", 0xE1, b"http://ns.adobe.com/xap/1.0/\0"),
    ("extendedXMP", 0xE1, b"http://ns.adobe.com/xmp/extension/\0"), ("iccProfile", 0xE2, b"ICC_PROFILE\0"), ("multiPicture", 0xE2, b"MPF\0"),
    ("isoGainMap", 0xE2, b"urn:iso:std:iso:ts:21496:-1\0"), ("photoshop", 0xED, b"Photoshop 3.0\0"), ("adobe", 0xEE, b"Adobe"),
)


class Segment(NamedTuple):
    ordinal: int
    marker: int
    offset: int
    size: int
    kind: str
    payload: bytes


def part(marker: int, payload: bytes) -> str:
    """The kind of a segment, by marker and signature."""
    if marker == COM:
        return "comment"
    for name, m, sign in SIGNATURES:
        if m == marker and payload.startswith(sign):
            return name
    return "other" if 0xE0 <= marker <= 0xEF else "image"


def headers(data: bytes, start: int = 0) -> tuple[list[Segment], int]:
    """Segments up to and with the first SOS, and the offset after it. Fill bytes before a marker are skipped."""
    if data[start : start + 2] != b"\xff\xd8":
        raise Malformed("no SOI")
    out: list[Segment] = []
    at = start + 2
    while True:
        if need(data, at, 2, "marker")[0] != 0xFF:
            raise Malformed("no marker where one belongs")
        while need(data, at + 1, 1, "marker")[0] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == EOI or marker == SOI or 0xD0 <= marker <= 0xD7 or marker in (0x00, 0x01):
            raise Malformed("no image data")
        size = struct.unpack(">H", need(data, at + 2, 2, "segment"))[0]
        if size < 2:
            raise Malformed("segment too short")
        body = need(data, at + 4, size - 2, "segment")
        out.append(Segment(len(out), marker, at, size + 2, part(marker, body), body))
        at += 2 + size
        if marker == SOS:
            return out, at


def entropy_end(data: bytes, at: int, strict: bool = False, expected: int | None = None) -> int:
    """Offset of the marker that ends entropy-coded data. Strict: restart markers count 0 to 7 in turn, and as many as expected."""
    restarts = 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise Malformed("truncated image data")
        m = data[at + 1]
        if m == 0xFF and strict is False:
            at += 1
            continue
        if m == 0:
            at += 2
        elif 0xD0 <= m <= 0xD7:
            if strict and m - 0xD0 != restarts % 8:
                raise Malformed("restart markers out of turn")
            restarts += 1
            at += 2
        else:
            if strict and expected is not None and restarts != expected:
                raise Malformed("wrong number of restart markers")
            return at


def image_end(data: bytes, start: int = 0) -> int:
    """Offset after the EOI of the image at start."""
    _, at = headers(data, start)
    while True:
        at = entropy_end(data, at)
        m = data[at + 1]
        if m == EOI:
            return at + 2
        at += 2 + struct.unpack(">H", need(data, at + 2, 2, "segment"))[0]


def quant_tables(payload: bytes) -> dict[int, list[int]]:
    """Tables of a DQT payload in zigzag order, 8 or 16 bits."""
    out, at = {}, 0
    while at < len(payload):
        wide, number = payload[at] >> 4, payload[at] & 15
        if wide > 1 or number > 3:
            raise Malformed("DQT: bad table")
        raw = need(payload, at + 1, 128 if wide else 64, "DQT")
        out[number] = list(struct.unpack(">64H", raw)) if wide else list(raw)
        at += 1 + len(raw)
    return out


def huffman_tables(payload: bytes) -> dict[tuple[int, int], tuple[list[int], bytes]]:
    """Tables of a DHT payload by (class, number): counts of code lengths and symbols; a code must fit and leave the all-ones code free."""
    out, at = {}, 0
    while at < len(payload):
        kind, number = payload[at] >> 4, payload[at] & 15
        counts = list(need(payload, at + 1, 16, "DHT"))
        code = 0
        for k, n in enumerate(counts):
            code = (code << 1) + n
            if code > (1 << (k + 1)) - (n > 0):
                raise Malformed("DHT: codes do not fit")
        symbols = need(payload, at + 17, sum(counts), "DHT")
        if kind > 1 or number > 3 or len(set(symbols)) != len(symbols):
            raise Malformed("DHT: bad table")
        out[kind, number] = counts, symbols
        at += 17 + len(symbols)
    return out


class Frame(NamedTuple):
    marker: int
    precision: int
    height: int
    width: int
    components: list[tuple[int, int, int, int]]


def frame(marker: int, payload: bytes) -> Frame:
    precision, h, w, n = struct.unpack(">B2HB", need(payload, 0, 6, "frame"))
    if len(payload) != 6 + 3 * n or not n:
        raise Malformed("frame: wrong length")
    return Frame(marker, precision, h, w, [(payload[6 + 3 * k], payload[7 + 3 * k] >> 4, payload[7 + 3 * k] & 15, payload[8 + 3 * k]) for k in range(n)])


class Scan(NamedTuple):
    components: list[int]
    ss: int
    se: int
    ah: int
    al: int


def scan(payload: bytes) -> Scan:
    n = need(payload, 0, 1, "scan")[0]
    if len(payload) != 4 + 2 * n:
        raise Malformed("scan: wrong length")
    ss, se, approx = payload[1 + 2 * n :]
    return Scan([payload[1 + 2 * k] for k in range(n)], ss, se, approx >> 4, approx & 15)


def violations(data: bytes, original: bytes | None = None) -> list[tuple[str, int]]:
    """A strict reading of one JPEG image: tables before use, scans that refine what was sent, EOI last; foreign metadata segments."""
    out: list[tuple[str, int]] = []
    try:
        own, at = headers(data)
        tables: set[int] = set()
        codes: set[tuple[int, int]] = set()
        sof: Frame | None = None
        interval = 0
        sent: dict[tuple[int, int], int] = {}
        segments = list(own)
        k = 0
        while True:
            while k < len(segments):
                s = segments[k]
                k += 1
                if s.marker == DQT:
                    tables |= set(quant_tables(s.payload))
                elif s.marker == DHT:
                    codes |= set(huffman_tables(s.payload))
                elif s.marker == DRI:
                    interval = struct.unpack(">H", need(s.payload, 0, 2))[0]
                elif s.marker in FRAMES:
                    if sof:
                        out.append(("second frame", s.ordinal))
                    sof = frame(s.marker, s.payload)
                    if not sof.width or not sof.height:
                        out.append(("empty frame", s.ordinal))
                elif s.marker == SOS:
                    if not sof:
                        raise Malformed("scan before frame")
                    sc = scan(s.payload)
                    ids = {c[0]: c for c in sof.components}
                    for c in sc.components:
                        if c not in ids:
                            raise Malformed("scan of an unknown component")
                        if ids[c][3] not in tables:
                            out.append(("no quantisation table", s.ordinal))
                    if sof.marker in (0xC2, 0xCA):
                        if sc.ss > sc.se or sc.se > 63 or sc.ss == 0 and sc.se or sc.ss and len(sc.components) > 1:
                            out.append(("bad spectral band", s.ordinal))
                        for c in sc.components:
                            for q in range(sc.ss, sc.se + 1):
                                if sent.get((c, q), 0) != sc.ah if (c, q) in sent else sc.ah:
                                    out.append(("refines what was not sent", s.ordinal))
                                    break
                            sent.update({(c, q): sc.al for q in range(sc.ss, sc.se + 1)})
                    elif (sc.ss, sc.se, sc.ah, sc.al) != (0, 63, 0, 0) and sof.marker not in LOSSLESS:
                        out.append(("bad sequential scan", s.ordinal))
                    at = entropy_end(data, s.offset + s.size, strict=True)
            m = data[at + 1]
            if m == EOI:
                if at + 2 != len(data):
                    out.append(("data after EOI", -1))
                break
            size = struct.unpack(">H", need(data, at + 2, 2, "segment"))[0]
            body = need(data, at + 4, size - 2, "segment")
            segments.append(Segment(len(segments), m, at, size + 2, part(m, body), body))
            at += 2 + size
            if m != SOS:
                if data[at : at + 1] != b"\xff":
                    raise Malformed("no marker where one belongs")
        if original is not None:
            known = {(s.marker, s.payload) for s in headers(original)[0]}
            out += [(f"foreign {s.kind}", s.ordinal) for s in segments if s.kind not in ("image", "jfif", "adobe") and (s.marker, s.payload) not in known]
    except Malformed as e:
        out.append((str(e), -1))
    return out


class Picture(NamedTuple):
    start: int
    size: int


def multi_picture(payload: bytes, base: int = 0) -> list[Picture]:
    """Entries of an MPF index; starts count from the index's own TIFF header, which stands at base in the file; the first image starts at 0."""
    t = Tiff(payload.removeprefix(b"MPF\0"))
    entries = {e.tag: e for e in t.ifd(t.first)}
    if 0xB002 not in entries:
        raise Malformed("MPF: no entries")
    raw = entries[0xB002].value
    if len(raw) % 16:
        raise Malformed("MPF: entry of another length")
    order = ">" if t.big else "<"
    out = []
    for k in range(0, len(raw), 16):
        _, size, start, _, _ = struct.unpack_from(order + "3I2H", raw, k)
        out.append(Picture(start + base if start else 0, size))
    return out


class Layout(NamedTuple):
    images: list[tuple[int, int]]
    gaps: list[int]
    problem: str


def holds_video(data: bytes) -> bool:
    """Whether data after a photo is a video: a box `ftyp` of a likely size, or one of the marks that cameras write."""
    if data.endswith(b"SEFT") or b"MotionPhoto_Data" in data:
        return True
    at = data.find(b"ftyp")
    while at >= 4:
        size = int.from_bytes(data[at - 4 : at], "big")
        if 16 <= size <= 256 and size % 4 == 0:
            return True
        at = data.find(b"ftyp", at + 1)
    return False


def layout(data: bytes) -> Layout:
    """Images that lie one after the other, bytes between them, and what keeps the file from being split: video, index, unlisted."""
    images, gaps, at, problem = [], [], 0, ""
    while True:
        end = image_end(data, at)
        images.append((at, end))
        nxt = data.find(b"\xff\xd8\xff", end)
        gaps.append((nxt if nxt >= 0 else len(data)) - end)
        if nxt < 0:
            break
        at = nxt
    tail = data[images[0][1] :]
    if tail.strip(b"\0\xff"):
        listed = None
        for s in headers(data)[0]:
            if s.kind == "multiPicture":
                try:
                    listed = multi_picture(s.payload, s.offset + 8)
                except Malformed:
                    problem = "index"
        if holds_video(tail if len(images) == 1 else data[images[-1][1] :]):
            problem = "video"
        elif not problem and len(images) > 1:
            starts = {p.start for p in listed or []}
            if any(a not in starts for a, _ in images[1:]):
                problem = "unlisted"
    return Layout(images, gaps, problem)


def extended_xmp(pieces: list[tuple[str, int, int, bytes]]) -> bytes:
    """Extended XMP of (guid, total, offset, data): one guid, the whole covered once."""
    if len({(g, t) for g, t, _, _ in pieces}) != 1:
        raise Malformed("extended XMP: several")
    at, out = 0, []
    for _, _, offset, data in sorted(pieces, key=lambda p: p[2]):
        if offset != at:
            raise Malformed("extended XMP: gap or overlap")
        out.append(data)
        at += len(data)
    if at != pieces[0][1]:
        raise Malformed("extended XMP: not whole")
    return b"".join(out)


# Fixed values of the JPEG standard, annex K: luminance quantisation, in rows.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def scaled_table(quality: int) -> list[int]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (v * scale + 50) // 100)) for v in LUMINANCE]


def estimate_quality(table: list[int]) -> int:
    """The quality whose scaled standard table has the nearest mean; of equals the lowest."""
    mean = sum(table) / 64
    return min(range(1, 101), key=lambda q: (abs(sum(scaled_table(q)) / 64 - mean), q))


def rewritten_index(payload: bytes, pictures: list[Picture], base: int) -> bytes:
    """The MPF index with the places and sizes of `pictures`; as many as it lists."""
    body = payload.removeprefix(b"MPF\0")
    t = Tiff(body)
    entry = next((e for e in t.ifd(t.first) if e.tag == 0xB002), None)
    if entry is None or len(entry.value) != 16 * len(pictures):
        raise Malformed("MPF: another number of entries")
    order = ">" if t.big else "<"
    raw = bytearray(entry.value)
    for k, p in enumerate(pictures):
        struct.pack_into(order + "2I", raw, 16 * k + 4, p.size, p.start - base if p.start else 0)
    return payload[: len(payload) - len(body)] + body[: entry.value_offset] + bytes(raw) + body[entry.value_offset + len(raw) :]


def assembled(images: list[bytes], gaps: list[bytes] | None = None) -> bytes:
    """A file of several images: the index of the first, if it has one, says where they are now."""
    gaps = gaps or [b""] * len(images)
    places, at = [], 0
    for k, (image, gap) in enumerate(zip(images, gaps)):
        places.append(Picture(at if k else 0, len(image)))
        at += len(image) + len(gap)
    first = images[0]
    for s in headers(first)[0]:
        if s.kind == "multiPicture":
            new = rewritten_index(s.payload, places, s.offset + 8)
            first = first[: s.offset + 4] + new + first[s.offset + s.size :]
            break
    return b"".join(x for pair in zip([first, *images[1:]], gaps) for x in pair)


def index_violations(data: bytes) -> list[tuple[str, int]]:
    """Entries of the index that differ from where the images are."""
    found = layout(data)
    for s in headers(data)[0]:
        if s.kind == "multiPicture":
            listed = multi_picture(s.payload, s.offset + 8)
            if len(listed) != len(found.images):
                return [("index lists another number of images", -1)]
            return [("index differs from the image", k) for k, (p, (a, b)) in enumerate(zip(listed, found.images)) if (p.start, p.size) != (a, b - a)]
    return []
