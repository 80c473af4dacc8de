"""Rewriters: bytes to bytes. Metadata filters of each format, reassembly, re-deflation, code lengths."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..parsers import Malformed, iptc, jpeg, png, riff, tiff, xmp
from ..plans import policy
from ..plans.codecs import redeflate_png
from .tables import prepare

# Ids of the standard sRGB profiles, and checksum and length of those without an id.
SRGB_IDS = {"29f83ddeaff255ae7842fae4ca83390d", "c95bd637e95d8a3b0df38f99c1320389", "fc66337837e2886bfd72e9838228f1b8", "34562abf994ccd066d2c5721d0d68c5d"}
SRGB_WITHOUT_ID = {(0x5D5129CE, 3024), (0x182EA552, 3144), (0xF29E526D, 3144)}


def srgb_intent(profile: bytes) -> int | None:
    """The rendering intent of a standard sRGB profile, which an sRGB chunk says as well; None of any other, whatever its name."""
    if len(profile) < 128 or not int.from_bytes(profile[64:68], "big") <= 3:
        return None
    own, zero = profile[84:100], lambda n: b"\0" * n
    if own.hex() in SRGB_IDS:
        plain = profile[:44] + zero(4) + profile[48:64] + zero(4) + profile[68:84] + zero(16) + profile[100:]
        return profile[67] if hashlib.md5(plain).digest() == own else None
    return profile[67] if not any(own) and (zlib.crc32(profile), len(profile)) in SRGB_WITHOUT_ID else None
#: Segments hold at most this many bytes.
SEGMENT_BYTES = 65533


def exif_keep(level: str):
    return lambda ifd, tag: level == "keep" or policy.keeps(policy.exif_group(ifd, tag), level)


def xmp_keep(level: str):
    return lambda ns, name: level == "keep" or policy.keeps(policy.xmp_group(ns, name), level) and not policy.derivable(ns, name)


def filter_exif(data: bytes, level: str) -> bytes:
    """What a level keeps of a TIFF block; a block that cannot be read goes whole below keep."""
    if level == "keep":
        return data
    try:
        return tiff.filtered(data, exif_keep(level), lambda tag: tag in policy.MAKER_NOTE_KEPT and policy.keeps(policy.DISPLAY, level))
    except Malformed:
        return b""


def minimal_exif(orientation: int) -> bytes:
    return tiff.write([(0x0112, 3, 1, struct.pack(">H", orientation))], big=True)


def orientation_of(data: bytes) -> int:
    try:
        t = tiff.Tiff(data)
        found = next((t.number(e) for e in t.ifd(t.first) if e.tag == 0x0112), 1)
    except Malformed:
        return 1
    return found if 1 <= found <= 8 else 1


def filter_png(data: bytes, level: str) -> bytes:
    """Chunks that a level keeps, each in its place. Only the first eXIf stays; an orientation that would be lost gets a minimal one after IHDR; standard sRGB profiles become sRGB chunks."""
    out: list[tuple[str, bytes]] = []
    seen_exif, turned, kept_exif = False, 1, False
    for c in png.chunks(data):
        if c.kind == "eXIf":
            if not seen_exif:
                seen_exif, turned = True, orientation_of(c.data)
                body = filter_exif(c.data, level)
                if body:
                    out.append((c.kind, body))
                    kept_exif = True
        elif c.kind == "iCCP" and (t := png.text_of("iCCP", c.data)) and t[1] and (intent := srgb_intent(t[1])) is not None:
            if all(k != "sRGB" for k, _ in out):
                out.append(("sRGB", bytes([intent])))
        elif c.kind in ("tEXt", "zTXt", "iTXt"):
            t = png.text_of(c.kind, c.data)
            if level == "keep":
                out.append((c.kind, c.data))
            elif t and t[0] == "XML:com.adobe.xmp" and t[1]:
                body = xmp.filtered(t[1], xmp_keep(level))
                if body:
                    out.append(("iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + body))
            elif t and policy.keeps(policy.png_text_group(t[0]), level):
                out.append((c.kind, c.data))
        elif c.kind[0].isupper() or c.kind in policy.PNG_KEPT or level == "keep":
            out.append((c.kind, c.data))
    if turned != 1 and not kept_exif and level != "keep":
        out.insert(1, ("eXIf", minimal_exif(turned)))
    return png.write(out)


def segment(marker: int, payload: bytes) -> bytes:
    if len(payload) > SEGMENT_BYTES:
        raise Malformed("segment too long")
    return struct.pack(">2BH", 0xFF, marker, len(payload) + 2) + payload


def filter_jpeg(data: bytes, level: str) -> bytes:
    """Segments that a level keeps; EXIF right after JFIF, minimal where an orientation would be lost; image data as it is."""
    segments, at = jpeg.headers(data)
    head, rest, exif, turned = [], [], b"", 1
    for s in segments[:-1]:
        whole = data[s.offset : s.offset + s.size]
        if s.kind == "image" or s.kind in policy.JPEG_KEPT or level == "keep":
            (head if s.kind in ("jfif", "jfxx") else rest).append(whole)
        elif s.kind == "exif":
            turned = orientation_of(s.payload[6:])
            body = filter_exif(s.payload[6:], level)
            exif = exif or (segment(0xE1, b"Exif\0\0" + body) if body else b"")
        elif s.kind == "xmp":
            mark = jpeg.SIGNATURES[3][2]
            body = xmp.filtered(s.payload[len(mark) :], xmp_keep(level))
            if body:
                rest.append(segment(0xE1, mark + body))
        elif s.kind == "photoshop":
            mark = jpeg.SIGNATURES[8][2]
            body = iptc.filtered(s.payload[len(mark) :], lambda n: policy.keeps(policy.resource_group(n), level), lambda r, k: policy.keeps(policy.iim_group(r, k), level))
            if body:
                rest.append(segment(0xED, mark + body))
    if not exif and turned != 1 and level != "keep":
        exif = segment(0xE1, b"Exif\0\0" + minimal_exif(turned))
    last = segments[-1]
    return b"\xff\xd8" + b"".join(head) + exif + b"".join(rest) + data[last.offset :]


def transplant(result: bytes, original: bytes) -> bytes:
    """The image of result with the metadata segments of original, but the result's own colour mark."""
    own = [s for s in jpeg.headers(original)[0][:-1] if s.kind not in ("image", "jfif", "jfxx", "adobe")]
    parts = jpeg.headers(result)[0]
    keep = [s for s in parts if s.kind in ("image", "jfif", "jfxx", "adobe")]
    first = [s for s in keep[:-1] if s.kind in ("jfif", "jfxx")]
    rest = [s for s in keep[:-1] if s.kind not in ("jfif", "jfxx")]
    cut = lambda src, s: src[s.offset : s.offset + s.size]
    return b"\xff\xd8" + b"".join(cut(result, s) for s in first) + b"".join(cut(original, s) for s in own) + b"".join(cut(result, s) for s in rest) + result[parts[-1].offset :]


def filter_webp(data: bytes, level: str) -> bytes:
    """Chunks that a level keeps, in the order that the format asks for, with flags to match."""
    out = []
    for c in riff.webp(data):
        body = c.data
        if c.kind == "EXIF":
            body = filter_exif(body.removeprefix(b"Exif\0\0"), level)
        elif c.kind == "XMP " and level != "keep":
            body = xmp.filtered(body, xmp_keep(level))
        elif riff.rank(c.kind) == 7 and level != "keep":
            continue
        if body or c.kind not in ("EXIF", "XMP "):
            out.append((c.kind, body))
    out.sort(key=lambda x: riff.rank(x[0]))
    kinds = {k for k, _ in out}
    fixed = []
    for kind, body in out:
        if kind == "VP8X" and body:
            flags = body[0] & ~(riff.FLAGS["EXIF"] | riff.FLAGS["XMP "])
            flags |= sum(riff.FLAGS[k] for k in ("EXIF", "XMP ") if k in kinds)
            body = bytes([flags]) + body[1:]
        fixed.append((kind, body))
    return riff.write(fixed)


FILTERS = {"png": filter_png, "jpeg": filter_jpeg, "webp": filter_webp}


def filter_metadata(df: DataFrame, keys: list[str], fmt: str, level: str, column: str = "content") -> DataFrame:
    """(keys…, content, error): each file of a format without what a level removes. A narrow map; a file that cannot be read has a null content and the error."""
    prepare(df.sparkSession)
    rewrite = FILTERS[fmt]

    def run(batches):
        for b in batches:
            out, errors = [], []
            for v in b.column(len(keys)):
                try:
                    out.append(None if v.as_py() is None else rewrite(v.as_py(), level))
                    errors.append(None)
                except Malformed as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [*keys, "content", "error"])

    own = df.select(*keys, column)
    return own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", content binary, error string")


def reassemble(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, parts, data) of parts (keys…, total, offset, data) that cover the total exactly, once and without overlap."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "data")))
    got = parts.groupBy(*keys).agg(rows.alias("p"), F.min("total").alias("lo"), F.max("total").alias("hi"), F.sum(F.length("data")).alias("sum"))
    empty = F.unhex(F.lit(""))
    joined = F.aggregate("p", F.struct(empty.alias("d"), F.lit(True).alias("ok")), lambda a, x: F.struct(F.concat(a["d"], x["data"]).alias("d"), (a["ok"] & (x["offset"] == F.length(a["d"]))).alias("ok")))
    return got.withColumn("j", joined).where("j.ok AND lo = hi AND sum = lo").select(*keys, F.size("p").cast("bigint").alias("parts"), F.col("j.d").alias("data"))


def extended_segments(packet: bytes, size: int = 65400) -> list[bytes]:
    """Segments of an extended XMP packet: each with the packet's digest, its length and the offset."""
    guid = hashlib.md5(packet).hexdigest().upper().encode()
    return [segment(0xE1, jpeg.SIGNATURES[4][2] + guid + struct.pack(">2I", len(packet), at) + packet[at : at + size]) for at in range(0, len(packet), size)]


def code_lengths(counts: list[int], limit: int = 16) -> list[int]:
    """Lengths of the best prefix code of at most `limit` bits, by package-merge."""
    used = sorted((n, k) for k, n in enumerate(counts) if n > 0)
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0][1]] = 1
        return lengths
    row = [(n, (k,)) for n, k in used]
    now = row
    for _ in range(limit - 1):
        pairs = [(now[i][0] + now[i + 1][0], now[i][1] + now[i + 1][1]) for i in range(0, len(now) - 1, 2)]
        now = sorted(row + pairs, key=lambda x: x[0])
    for _, symbols in now[: 2 * len(used) - 2]:
        for k in symbols:
            lengths[k] += 1
    return lengths


def huffman_bits(histogram: DataFrame, by: str, symbol: str, count: str, limit: int = 16) -> DataFrame:
    """(by, symbols, bits): what each group's symbols cost under their best code. A group has at most as many rows as there are symbols."""
    prepare(histogram.sparkSession)

    def cost(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf.sort_values(symbol)[count].tolist()
        bits = int(np.dot(counts, code_lengths(counts, limit)))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "symbols": [len(counts)], "bits": [bits]})

    kind = histogram.schema[by].dataType.simpleString()
    return histogram.groupBy(by).applyInPandas(cost, f"`{by}` {kind}, symbols long, bits long")


def redeflate_rows(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """(key, sound, pixels_sha256, not_larger): images of one row of grey pixels, written with stored data and deflated again; read back strictly."""
    prepare(df.sparkSession)

    def run(batches):
        for b in batches:
            sound, digest, smaller = [], [], []
            for v in b.column(1):
                row = v.as_py()
                first = png.write([("IHDR", struct.pack(">2I5B", len(row), 1, 8, 0, 0, 0, 0)), ("IDAT", zlib.compress(b"\0" + row, 0)), ("IEND", b"")])
                again = redeflate_png(first) or first
                sound.append(not png.violations(again, first))
                body = b"".join(c.data for c in png.chunks(again, strict=True) if c.kind == "IDAT")
                digest.append(hashlib.sha256(zlib.decompress(body)[1:]).hexdigest())
                smaller.append(len(again) <= len(first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sound), pa.array(digest), pa.array(smaller)], [key, "sound", "pixels_sha256", "not_larger"])

    return df.select(key, pixels).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, sound boolean, pixels_sha256 string, not_larger boolean")
