"""Format detection, facts, and the ladder of reasons that keep a file as it is. All of it on bytes at fixed places, with built-in functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bytesx import PNG_SIGNATURE, be, holds, le, part, raw, starts, u8
from ..parsers import Malformed, jpeg, xmp
from ..parsers.bmff import JXL_SIGNATURE
from ..parsers.jpeg import scaled_table
from ..parsers.regions import holds_manifest
from .tables import prepare

#: Bytes of a file's head that detection reads, and those that it needs.
HEAD, LEAST = 4096, 12
# Brands of HEIF files.
HEIF_BRANDS = ("heic", "heix", "heim", "heis", "hevc", "hevx")


def is_heif(head: Column) -> Column:
    """ftyp box with one of the brands and without avif; the minor version at offset 12 is no brand."""
    size = F.least(be(head, 0, 4), F.length(head).cast("bigint"))
    count = F.greatest(F.floor((size - 16) / 4), F.lit(0)).cast("int")
    later = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(head, 17 + 4 * k, 4))).otherwise(F.array().cast("array<binary>"))
    brands = F.concat(F.array(F.substring(head, 9, 4)), later)
    known = F.array(*[raw(b) for b in HEIF_BRANDS])
    return starts(head, 4, b"ftyp") & F.arrays_overlap(brands, known) & ~F.array_contains(brands, raw("avif"))


def looks_like_svg(head: Column) -> Column:
    """`<svg` in any case, in UTF-8 or in UTF-16 of either byte order, at whole bytes."""
    text = F.hex(head)
    plain = F.lower(F.decode(head, "ISO-8859-1")).contains("<svg")
    return plain | text.rlike("^(?:..)*?3C00[57]300[57]600[46]700") | text.rlike("^(?:..)*?003C00[57]300[57]600[46]7")


def detect(content: Column, ext: Column) -> Column:
    """png, jpeg, gif, webp, jxl, heic or svg by the first bytes, never by the name; only svg needs both. NULL of anything else."""
    head = F.substring(content, 1, HEAD)
    return F.when(
        F.length(head) >= LEAST,
        F.when(starts(head, 0, PNG_SIGNATURE), "png")
        .when(starts(head, 0, b"\xff\xd8\xff"), "jpeg")
        .when(starts(head, 0, b"GIF87a") | starts(head, 0, b"GIF89a"), "gif")
        .when(starts(head, 0, b"RIFF") & starts(head, 8, b"WEBP"), "webp")
        .when(starts(head, 0, JXL_SIGNATURE) | starts(head, 0, b"\xff\x0a"), "jxl")
        .when(is_heif(head), "heic")
        .when((F.lower(ext) == "svg") & looks_like_svg(head), "svg"),
    )


def has_end_marker(content: Column, fmt: Column) -> Column:
    """Whether a file's end is there: IEND near the end of a PNG, FFD9 anywhere in a JPEG, 3B in a GIF's tail, all of a WebP's bytes."""
    tail = F.substring(content, -64, 64)
    return (
        F.when(fmt == "png", holds(tail, b"IEND"))
        .when(fmt == "jpeg", holds(content, b"\xff\xd9"))
        .when(fmt == "gif", holds(tail, b"\x3b"))
        .when(fmt == "webp", F.coalesce(F.length(content) >= le(content, 4, 4) + 8, F.lit(False)))
        .otherwise(F.lit(True))
    )


@F.pandas_udf(T.BooleanType())
def _manifest(content: pd.Series, fmt: pd.Series) -> pd.Series:
    return pd.Series([c is not None and holds_manifest(c, f) for c, f in zip(content, fmt)], dtype="bool")


@F.pandas_udf(T.StringType())
def _structure(content: pd.Series, fmt: pd.Series) -> pd.Series:
    """What the structure of a JPEG or SVG says against changing it."""

    def one(data, f):
        if data is None:
            return None
        try:
            if f == "svg":
                return "uncheckable" if xmp.uncheckable(data) else None
            return {"": None, "video": "motionPhotoVideo"}.get(jpeg.layout(data).problem, "unreadableImages")
        except Malformed:
            return "damaged" if f == "jpeg" else None

    return pd.Series([one(c, f) for c, f in zip(content, fmt)], dtype="object")


def has_credentials(content: Column, fmt: Column) -> Column:
    """Content credentials where a format keeps its metadata, never in image data: in APP11 segments, chunks, boxes, and as an element of SVG.

    A search of the whole file, without Python, says which files can have them; only those are taken apart.
    """
    may = (fmt != "svg") & holds(content, b"c2pa")
    return F.when(fmt == "svg", F.contains(F.decode(content, "ISO-8859-1"), F.lit("c2pa:manifest"))).otherwise(may & _manifest(F.when(may, content), fmt))


def is_apple_png(content: Column) -> Column:
    """PNG of Apple's own kind, with CgBI as first chunk."""
    return F.coalesce(part(content, 12, 4) == raw("CgBI"), F.lit(False))


def reason(files: DataFrame, disabled: list[str] | None = None, replacing: bool = False) -> DataFrame:
    """files (content, ext, and if replacing writable) with format and reason: the first of the ladder that holds, or NULL of an admitted file.

    Places of fixed bytes are looked at without Python. Parsers run on JPEG and SVG files, for layouts that must stay and for
    what a rendering cannot check, and on files in which the words of content credentials occur.
    """
    prepare(files.sparkSession)
    one = files.withColumn("format", detect(F.col("content"), F.col("ext")))
    one = one.withColumn("__s", _structure(F.when(F.col("format").isin("jpeg", "svg"), F.col("content")), F.col("format")))
    c, fmt = F.col("content"), F.col("format")
    ladder = F.when(F.length(c) == 0, "empty").when(fmt.isNull(), "notAnImage")
    if replacing:
        ladder = ladder.when(~F.col("writable"), "readOnly")
    if disabled:
        ladder = ladder.when(fmt.isin(*disabled), "turnedOff")
    return one.withColumn(
        "reason",
        ladder.when((fmt != "svg") & ~has_end_marker(c, fmt), "damaged").when(has_credentials(c, fmt), "contentCredentials").when((fmt == "png") & is_apple_png(c), "appleCgBI").when(F.col("__s").isNotNull(), F.col("__s")).when(fmt == "gif", "notSupported"),
    ).drop("__s")


def orientation(value: Column) -> Column:
    return F.when(value.between(1, 8), value).otherwise(1)


def jpeg_quality(steps: Column) -> Column:
    """Quality of a luminance table, by the nearest mean among the hundred scaled standard tables; of equals the lowest."""
    mean = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x) / 64.0
    table = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(sum(scaled_table(q)) / 64.0).alias("m")) for q in range(1, 101)])
    return F.array_min(F.transform(table, lambda t: F.struct(F.abs(t["m"] - mean).alias("d"), t["q"].alias("q"))))["q"]


def facts(files: DataFrame) -> DataFrame:
    """files (content, format) with byte_size, bits, width and height as far as fixed places tell, and the flags of WebP."""
    c, fmt = F.col("content"), F.col("format")
    webp = fmt == "webp"
    return files.withColumns({
        "byte_size": F.length(c).cast("bigint"),
        "width": F.when(fmt == "png", be(c, 16, 4)).when(fmt == "gif", le(c, 6, 2)).when(webp & starts(c, 12, b"VP8X"), le(c, 24, 3) + 1),
        "height": F.when(fmt == "png", be(c, 20, 4)).when(fmt == "gif", le(c, 8, 2)).when(webp & starts(c, 12, b"VP8X"), le(c, 27, 3) + 1),
        "bits": F.when(fmt == "png", u8(c, 24)).otherwise(8).cast("int"),
        "is_lossless_webp": webp & holds(c, b"VP8L") & ~holds(c, b"VP8 "),
        "has_webp_metadata": webp & (holds(c, b"EXIF") | holds(c, b"XMP ")),
        "is_animated": F.when(webp, holds(c, b"ANIM")).when(fmt == "png", holds(c, b"acTL")).otherwise(F.lit(False)),
        "from_jpeg": (fmt == "jxl") & holds(c, b"jbrd"),
    })
