"""Where files keep their metadata: the only places in which text of it is looked for, as short texts turn up by chance in image data."""

from __future__ import annotations

from . import Malformed, bmff, jpeg, png, riff

# Chunks and boxes of image data.
PNG_IMAGE = {"IDAT", "fdAT"}
WEBP_IMAGE = {"VP8 ", "VP8L", "ALPH", "ANMF"}


def regions(data: bytes) -> list[tuple[str, bytes]]:
    """(kind, bytes) of each region: application segments and comments of all images of a JPEG, chunks of PNG and WebP and boxes of HEIF but the image data. A file that cannot be taken apart is one region."""
    try:
        if data.startswith(b"\xff\xd8\xff"):
            out = []
            for start, _ in jpeg.layout(data).images:
                out += [(f"{s.marker:02X}", s.payload) for s in jpeg.headers(data, start)[0] if 0xE0 <= s.marker <= 0xEF or s.marker == jpeg.COM]
            return out
        if data.startswith(png.SIGNATURE):
            return [(c.kind, c.data) for c in png.chunks(data) if c.kind not in PNG_IMAGE]
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return [(c.kind, c.data) for c in riff.webp(data, strict=True) if c.kind not in WEBP_IMAGE]
        if data[4:8] == b"ftyp" or data[4:8] == b"JXL ":
            return [(b.kind, bmff.payload(data, b)) for b in bmff.boxes(data) if b.parent < 0 and b.kind != "mdat"]
    except Malformed:
        pass
    return [("", data)]


def holds_manifest(data: bytes, fmt: str) -> bool:
    """Whether a region holds content credentials: a box `jumb` labelled c2pa, in a JPEG only in an APP11 segment."""
    own = regions(data)
    if fmt == "jpeg" and own != [("", data)]:
        own = [x for x in own if x[0] == "EB"]
    if fmt == "jxl":
        return any(b"c2pa" in x for kind, x in own if kind == "jumb")
    return any(b"jumb" in x and b"c2pa" in x for _, x in own)
