"""Scalar functions on text, paths and numbers."""

from __future__ import annotations

import base64
import math
import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def svg_encoding(head: Column) -> Column:
    """UTF-8, UTF-16LE or UTF-16BE, by byte order mark or the zero bytes of `<` and what follows it."""
    h = F.hex(F.substring(head, 1, 4))
    return (
        F.when(h.startswith("FFFE") | (h == "3C003F00") | (h == "3C007300"), "UTF-16LE")
        .when(h.startswith("FEFF") | (h == "003C003F") | (h == "003C0073"), "UTF-16BE")
        .otherwise("UTF-8")
    )


def utf16_to_utf8(b: Column, encoding: Column) -> Column:
    """Text of UTF-16 bytes without their mark, with the XML declaration naming UTF-8; NULL if encoding it again gives other bytes."""
    body = F.when(F.hex(F.substring(b, 1, 2)).isin("FFFE", "FEFF"), F.substring(b, 3, 2**31 - 1)).otherwise(b)
    text = F.when(encoding == "UTF-16LE", F.decode(body, "UTF-16LE")).when(encoding == "UTF-16BE", F.decode(body, "UTF-16BE"))
    again = F.when(encoding == "UTF-16LE", F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-16BE"))
    return F.when(again == body, F.regexp_replace(text, r"""^(<\?xml[^>]*encoding=["'])[^"']*""", "$1UTF-8"))


def base64_lenient(text: Column) -> Column:
    """Bytes of Base64 with everything else in it ignored; unreadable text gives no bytes."""
    kept = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    return F.coalesce(F.try_to_binary(kept, F.lit("base64")), F.unhex(F.lit("")))


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1_$2"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_number(100.0 * part / whole, 1)).otherwise("0.0")


def bytes_text(n: Column) -> Column:
    """1,234,567 bytes as 1.2 MB, in steps of 1000."""
    k = F.least(F.floor(F.log10(F.greatest(F.abs(n), F.lit(1))) / 3), F.lit(4)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("bytes", "KB", "MB", "GB", "TB"))), k + 1)
    return F.concat(F.when(k == 0, F.format_number(n, 0)).otherwise(F.format_number(n / F.pow(F.lit(1000.0), k), 1)), F.lit(" "), unit)


def least_size(best: Column, gain: Column) -> Column:
    """The limit that a candidate must stay under: best * (1 - gain), cut off, not rounded."""
    return (best * (1 - gain)).cast("bigint")


def bit_length(n: Column) -> Column:
    """Bits of a number's magnitude; 0 of zero."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(F.abs(n)))).cast("int")


def natural_key(text: Column) -> Column:
    """A key whose order is that of names with numbers read as numbers: digits get their count before them."""
    padded = F.regexp_replace(F.lower(text), r"(\d+)", "0000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("d", T.LongType())]))
def reduced(n: pd.Series, d: pd.Series) -> pd.DataFrame:
    """A rational in lowest terms; over zero it stays as it is."""
    g = [math.gcd(a, b) or 1 for a, b in zip(n, d)]
    return pd.DataFrame({"n": [a // k for a, k in zip(n, g)], "d": [b // k for b, k in zip(d, g)]})


#: Bytes that any inflated stream may have at most.
INFLATE_LIMIT = 64 << 20


def inflate_exact(data: bytes, limit: int = INFLATE_LIMIT) -> bytes | None:
    """Inflated zlib stream; None if it is broken, too large, or does not end with the last byte."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, limit)
        if d.unconsumed_tail and (d.decompress(d.unconsumed_tail, 1) or not d.eof):
            return None
    except zlib.error:
        return None
    return out if d.eof and not d.unused_data else None


@F.pandas_udf(T.BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(inflate_exact, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    """zlib stream at the best level."""
    return data.map(lambda x: zlib.compress(x, 9), na_action="ignore")


def xmp_unpadded(text: Column) -> Column:
    """An XMP packet without its padding: of the white space before the closing instruction one line end stays."""
    return F.regexp_replace(text, r"\s+(<\?xpacket end=)", "\n$1")


def flatten_value(value) -> str:
    """Nested values as text: arrays as [a,], maps by key as {k=v,}."""
    if isinstance(value, dict):
        return "{" + "".join(f"{k}={flatten_value(value[k])}," for k in sorted(value)) + "}"
    if isinstance(value, list | tuple):
        return "[" + "".join(f"{flatten_value(x)}," for x in value) + "]"
    return str(value)


def base64_text(data: bytes) -> str:
    return base64.b64encode(data).decode()


# Image geometry. Fixed values of PNG: channels by colour type, legal depths, and the seven passes (x0, y0, dx, dy).
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_bits(colour: Column, depth: Column) -> Column:
    """Bits per pixel; NULL of an illegal combination."""
    table = F.create_map(*[F.lit(x) for c, n in PNG_CHANNELS.items() for x in (c, n)])
    legal = F.create_map(*[y for c, d in PNG_DEPTHS.items() for y in (F.lit(c), F.array(*map(F.lit, d)))])
    return F.when(F.array_contains(F.try_element_at(legal, colour), depth), F.try_element_at(table, colour) * depth)


def png_inflated_size(width: Column, height: Column, bits: Column, interlaced: Column) -> Column:
    """Bytes that the image data must inflate to: each row of each pass has a filter byte."""
    row = lambda w: 1 + F.ceil(w * bits / 8)
    total = F.lit(0)
    for x0, y0, dx, dy in PNG_PASSES:
        w, h = F.ceil((width - x0) / dx), F.ceil((height - y0) / dy)
        total = total + F.when((w > 0) & (h > 0), h * row(w)).otherwise(0)
    return F.when(interlaced, total).otherwise(height * row(width)).cast("bigint")


def png_bytes_of_rows(width: int, height: int, bits: int, interlaced: bool) -> int:
    """The same for a single image, counted pass by pass."""
    if not interlaced:
        return height * (1 + -(-width * bits // 8))
    return sum(h * (1 + -(-w * bits // 8)) for x0, y0, dx, dy in PNG_PASSES if (w := -(-(width - x0) // dx)) > 0 and (h := -(-(height - y0) // dy)) > 0)


def mcu_count(width: Column, height: Column, h: Column, v: Column) -> Column:
    return (F.ceil(width / (8 * h)) * F.ceil(height / (8 * v))).cast("bigint")


def restart_count(mcus: Column, interval: Column) -> Column:
    return F.when(interval > 0, F.ceil(mcus / interval) - 1).otherwise(0).cast("bigint")


def kraft_complete(counts: Column) -> Column:
    """Whether code lengths 1 to 16, given by their counts, fit a prefix code that leaves the all-ones code free."""
    used = F.aggregate(counts, F.struct(F.lit(0).cast("bigint").alias("code"), F.lit(True).alias("ok")), lambda a, n: F.struct(((a["code"] + n) * 2).alias("code"), (a["ok"] & (a["code"] + n >= 0)).alias("ok")))
    fits = F.aggregate(
        F.zip_with(counts, F.sequence(F.lit(1), F.lit(16)), lambda n, k: F.struct(n.cast("bigint").alias("n"), F.pow(F.lit(2.0), 16 - k).cast("bigint").alias("w"))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x["n"] * x["w"],
    )
    return used["ok"] & (fits < 65536)


def icc_id(profile: Column) -> Column:
    """MD5 of an ICC profile with its flags, rendering intent and id bytes as zeros."""
    zero = lambda n: F.unhex(F.lit("00" * n))
    s = lambda a, n: F.substring(profile, a + 1, n)
    return F.md5(F.concat(s(0, 44), zero(4), s(48, 16), zero(4), s(68, 16), zero(16), s(100, 2**31 - 101)))


def oriented(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> Column:
    """Where a stored pixel is shown, for EXIF orientations 1 to 8."""
    r, b = width - 1 - x, height - 1 - y
    table = {1: (x, y), 2: (r, y), 3: (r, b), 4: (x, b), 5: (y, x), 6: (b, x), 7: (b, r), 8: (y, r)}
    out = F.struct(x.alias("x"), y.alias("y"))
    for k, (u, v) in table.items():
        out = F.when(orientation == k, F.struct(u.alias("x"), v.alias("y"))).otherwise(out)
    return out


# Element names that editors number, and the patterns of ids that editors make by themselves.
NUMBERED_ELEMENTS = (
    "svg g defs symbol use path rect circle ellipse line polyline polygon text tspan textPath image linearGradient radialGradient stop clipPath mask pattern filter fe[A-Z][A-Za-z]* marker "
    "switch style title desc metadata layer namedview guide grid swatch path-effect perspective flowRoot flowRegion flowPara flowSpan"
).split()
GENERATED_ID_PATTERNS = (
    "(?:" + "|".join(NUMBERED_ELEMENTS) + ")-?[0-9]+(?:-[0-9]+)*",
    "SVGID_[0-9]+_(?:[0-9]+_)?",
    "XMLID_[0-9]+_",
    "Layer_[0-9]+",
    "_(?:Radial|Linear|Image|clip|Effect)[0-9]+",
    "(?:clip|paint|filter|mask|pattern|image)[0-9]+(?:_[a-z]+)*(?:_[0-9]+)+",
    "svg_[0-9]+",
)
GENERATED_ID = re.compile("^(?:" + "|".join(GENERATED_ID_PATTERNS) + ")$")


def is_generated_id(c: Column) -> Column:
    """Whether an id looks like one that an editor numbered by itself, and so may be changed."""
    return c.rlike(GENERATED_ID.pattern)


def ids_to_preserve(ids: Column) -> Column:
    """Named ids in order; NULL if none is generated."""
    named = F.array_sort(F.array_distinct(F.filter(ids, lambda x: ~is_generated_id(x))))
    return F.when(F.exists(ids, is_generated_id), named)
