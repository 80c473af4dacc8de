"""Metadata fields of files, whatever block they stand in, with the group that the policy gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..parsers import Malformed, iptc, jpeg, png, riff, tiff, xmp
from ..plans import policy
from .tables import table_function

_XMP_KEYWORD = "XML:com.adobe.xmp"


def _exif(data: bytes):
    for e in tiff.entries(data):
        if e.tag not in tiff.POINTERS:
            text = e.value.rstrip(b"\0").decode("latin-1") if e.kind == 2 else e.value.hex()
            yield "exif", e.ifd, f"0x{e.tag:04X}", text, policy.exif_group(e.ifd, e.tag), False


def _xmp(data: bytes):
    for f in xmp.fields(data):
        yield "xmp", f.ns, f.name, f.text, policy.xmp_group(f.ns, f.name), policy.derivable(f.ns, f.name)


def _photoshop(data: bytes):
    for r in iptc.resources(data):
        if r.number == iptc.IIM:
            for d in iptc.datasets(r.data, strict=False):
                yield "iim", str(d.record), str(d.dataset), d.data.decode("utf-8", "replace"), policy.iim_group(d.record, d.dataset), False
        else:
            yield "photoshop", "", f"0x{r.number:04X}", r.data.hex(), policy.resource_group(r.number), False


def _guarded(read, data: bytes):
    """A block that cannot be read is one field without a group: it goes whole below keep."""
    try:
        return list(read(data))
    except Malformed:
        return [(read.__name__.strip("_"), "", "unreadable", "", policy.REMOVED, False)]


def of_png(data: bytes) -> list[tuple]:
    out = []
    for c in png.chunks(data):
        if c.kind == "eXIf":
            out += _guarded(_exif, c.data)
        elif c.kind in ("tEXt", "zTXt", "iTXt") and (t := png.text_of(c.kind, c.data)):
            if t[0] == _XMP_KEYWORD:
                out += _guarded(_xmp, t[1] or b"")
            else:
                out.append(("png_text", "", t[0], (t[1] or b"").decode("utf-8", "replace"), policy.png_text_group(t[0]), False))
    return out


def of_jpeg(data: bytes) -> list[tuple]:
    out = []
    for s in jpeg.headers(data)[0]:
        mark = next((m for k, _, m in jpeg.SIGNATURES if k == s.kind), b"")
        body = s.payload[len(mark) :]
        if s.kind == "exif":
            out += _guarded(_exif, body)
        elif s.kind == "xmp":
            out += _guarded(_xmp, body)
        elif s.kind == "photoshop":
            out += _guarded(_photoshop, body)
        elif s.kind == "comment":
            out.append(("comment", "", "COM", s.payload.decode("utf-8", "replace"), policy.REMOVED, False))
    return out


def of_webp(data: bytes) -> list[tuple]:
    out = []
    for c in riff.webp(data):
        if c.kind == "EXIF":
            out += _guarded(_exif, c.data.removeprefix(b"Exif\0\0"))
        elif c.kind == "XMP ":
            out += _guarded(_xmp, c.data)
    return out


READERS = {"png": of_png, "jpeg": of_jpeg, "webp": of_webp}


def fields(df: DataFrame, keys: list[str], fmt: str, column: str = "content") -> DataFrame:
    """(keys…, source, ns, name, text, rank, derivable, error) of each metadata field."""
    return table_function(df, keys, column, READERS[fmt], "source string, ns string, name string, text string, rank int, derivable boolean")


def private(found: DataFrame, level: Column | str) -> DataFrame:
    """The fields that a level removes."""
    level = F.lit(level) if isinstance(level, str) else level
    return found.where("error IS NULL").where(policy.removed_at(F.col("rank"), F.col("derivable"), level))


def holds_private(found: DataFrame, keys: list[str], level: str) -> DataFrame:
    """(keys…, privateData) of files with any field: null at keep, where nothing is private."""
    gone = policy.removed_at(F.col("rank"), F.col("derivable"), F.lit(level))
    return found.groupBy(*keys).agg((F.max(F.coalesce(gone, F.lit(False))) if level != "keep" else F.lit(None).cast("boolean")).alias("privateData"))
