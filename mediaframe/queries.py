"""The registered queries over the driver's tables, and their DuckDB SQL.

The tables hold no image bytes. Round-trip queries build files from a table's columns, take them apart again, and SQL
gives the answer from the columns alone; the others apply an operator's relational meaning to a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bytesx as bx
from .functions import scalars as sc
from .operators import admission, compare, entropy, fields, naming, report, rewrite, selection, tables, verify
from .parsers import jpeg
from .plans import planner, policy
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql:
            SQL[f"q_{f.__name__}"] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(name: str = "text"):
    return F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")


#: A total order of the lines of an order, whose numbers repeat.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _sample_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers chosen by doc_id: (doc_id, ext, content)."""
    docs = _t(spark, d, "documents").select("doc_id", _text().alias("t"), (F.col("doc_id") % 8).alias("k"))
    ftyp = lambda brand: F.concat(bx.put_be(20, 4), bx.raw("ftyp"), bx.raw(brand), bx.put_be(0, 4), bx.raw("mif1"), F.col("t"))
    content = (
        F.when(F.col("k") == 0, bx.png(bx.png_header(1, 1), bx.png_chunk("tEXt", F.concat(bx.raw(b"Title\0"), F.col("t")))))
        .when(F.col("k") == 1, F.concat(bx.raw(b"\xff\xd8\xff\xe0"), F.col("t"), bx.raw(b"            \xff\xd9")))
        .when(F.col("k") == 2, F.concat(bx.raw("GIF89a      "), F.col("t"), bx.raw(";")))
        .when(F.col("k") == 3, bx.webp(bx.riff_chunk("VP8L", F.col("t"))))
        .when(F.col("k") == 4, F.concat(bx.raw(bytes.fromhex("0000000C4A584C200D0A870A")), F.col("t")))
        .when(F.col("k") == 5, ftyp("heic"))
        .when(F.col("k") == 6, ftyp("avif"))
        .otherwise(F.concat(bx.raw('<?xml version="1.0"?><SVG xmlns="http://www.w3.org/2000/svg">'), F.col("t")))
    )
    return docs.select("doc_id", "k", F.when(F.col("k") == 7, "svg").otherwise("png").alias("ext"), content.alias("content"))


_FORMATS = "CASE doc_id % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'jxl' WHEN 5 THEN 'heic' WHEN 7 THEN 'svg' END"


@query(f"SELECT doc_id, {_FORMATS} AS format FROM documents")
def detect_format(spark, d):
    return _sample_files(spark, d).select("doc_id", admission.detect(F.col("content"), F.col("ext")).alias("format"))


@query(f"SELECT coalesce({_FORMATS}, 'none') AS format, count(*) AS files FROM documents GROUP BY 1")
def format_counts(spark, d):
    f = _sample_files(spark, d).select(F.coalesce(admission.detect(F.col("content"), F.col("ext")), F.lit("none")).alias("format"))
    return f.groupBy("format").agg(F.count("*").alias("files"))


@query("""SELECT doc_id, CASE doc_id % 18 WHEN 0 THEN 'empty' WHEN 1 THEN 'notAnImage' WHEN 2 THEN 'turnedOff' WHEN 3 THEN 'damaged' WHEN 4 THEN 'contentCredentials' WHEN 5 THEN 'appleCgBI' WHEN 6 THEN 'damaged'
  WHEN 10 THEN 'contentCredentials' WHEN 12 THEN 'motionPhotoVideo' WHEN 13 THEN 'uncheckable' WHEN 15 THEN 'notSupported' WHEN 16 THEN 'damaged' END AS reason FROM documents""")
def admission_ladder(spark, d):
    """One file of each rung. Words of content credentials count where metadata is (4, 10), not in image data (9) nor in a comment (11); a video after a photo keeps it (12), and so do scripts an SVG (13); 16 has no segments."""
    docs = _t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 18).alias("k"), F.md5(_text()).cast("binary").alias("t"))
    soi, words = bx.raw(b"\xff\xd8"), bx.raw("jumb c2pa ")
    scan = F.concat(bx.jpeg_segment(0xDA, bx.raw(b"\x01\x01\x00\x00\x3f\x00")), bx.raw(b"\xff\xd9"))
    svg = lambda body: F.concat(bx.raw("<svg xmlns='http://www.w3.org/2000/svg'><desc>"), F.col("t"), bx.raw(f"</desc>{body}</svg>"))
    text = bx.png_chunk("tEXt", F.concat(bx.raw(b"Comment\0"), F.col("t")))
    whole = bx.png(bx.png_header(1, 1), text)
    content = (
        F.when(F.col("k") == 0, bx.raw(b""))
        .when(F.col("k") == 1, F.concat(bx.raw("no image at all "), F.col("t")))
        .when(F.col("k") == 2, bx.webp(bx.riff_chunk("VP8L", F.col("t"))))
        .when(F.col("k") == 3, F.substring(whole, F.lit(1), F.length(whole) - 12))
        .when(F.col("k") == 4, bx.png(bx.png_header(1, 1), bx.png_chunk("caBX", F.concat(bx.raw("jumb c2pa "), F.col("t")))))
        .when(F.col("k") == 5, bx.png(bx.png_chunk("CgBI", bx.raw(b"\0\0\0\0")), bx.png_header(1, 1), text))
        .when(F.col("k") == 6, F.concat(bx.raw(b"\xff\xd8\xff\xe0"), F.col("t")))
        .when(F.col("k") == 7, F.concat(soi, bx.jpeg_segment(0xFE, F.col("t")), scan))
        .when(F.col("k") == 9, bx.png(bx.png_header(1, 1), bx.png_chunk("IDAT", F.concat(words, F.col("t")))))
        .when(F.col("k") == 10, F.concat(soi, bx.jpeg_segment(0xEB, F.concat(words, F.col("t"))), scan))
        .when(F.col("k") == 11, F.concat(soi, bx.jpeg_segment(0xFE, F.concat(words, F.col("t"))), scan))
        .when(F.col("k") == 12, F.concat(soi, bx.jpeg_segment(0xFE, F.col("t")), scan, F.col("t"), bx.raw("MotionPhoto_Data")))
        .when(F.col("k") == 13, svg("<script>1</script>"))
        .when(F.col("k") == 14, svg("<path d='M0 0'/>"))
        .when(F.col("k") == 15, F.concat(bx.raw("GIF89a      "), F.col("t"), bx.raw(";")))
        .when(F.col("k") == 16, F.concat(bx.raw(b"\xff\xd8\xff\xe0"), F.col("t"), bx.raw(b"\xff\xd9")))
        .when(F.col("k") == 17, F.concat(soi, bx.jpeg_segment(0xFE, F.col("t")), scan, F.col("t"), bx.raw("SEFT of old")))
        .otherwise(whole)
    )
    files = docs.select("doc_id", F.when(F.col("k").isin(13, 14), "svg").otherwise("png").alias("ext"), content.alias("content"))
    return admission.reason(files, disabled=["webp"]).select("doc_id", "reason")


@query("SELECT doc_id, 'Description' AS keyword, coalesce(text, '') AS text, true AS crc_ok FROM documents")
def png_text_roundtrip(spark, d):
    files = _t(spark, d, "documents").select("doc_id", bx.png(bx.png_header(1, 1), bx.png_chunk("tEXt", F.concat(bx.raw(b"Description\0"), _text()))).alias("content"))
    return tables.png_texts(files, ["doc_id"]).select("doc_id", "keyword", F.decode("value", "UTF-8").alias("text"), "crc_ok")


@query("""SELECT doc_id, CAST(0 AS INTEGER) AS ordinal, 'EXIF' AS kind, CAST(octet_length(encode(lang)) AS INTEGER) AS size, lang AS value FROM documents
  UNION ALL SELECT doc_id, 1, 'XMP ', octet_length(encode(coalesce(text, ''))), coalesce(text, '') FROM documents""")
def riff_roundtrip(spark, d):
    files = _t(spark, d, "documents").select("doc_id", bx.webp(bx.riff_chunk("EXIF", _text("lang")), bx.riff_chunk("XMP ", _text())).alias("content"))
    return tables.webp_chunks(files, ["doc_id"], strict=True).select("doc_id", "ordinal", "kind", "size", F.decode("data", "UTF-8").alias("value"))


_PIECE = 4096


@query(f"""SELECT doc_id, CAST(greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / {_PIECE}.0)) AS BIGINT) AS segments,
  CAST(least({_PIECE}, octet_length(encode(coalesce(text, '')))) AS BIGINT) AS largest, sha256(coalesce(text, '')) AS text_sha256 FROM documents""")
def jpeg_segments(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", _text().alias("t"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("t") / _PIECE).cast("int") - 1, F.lit(0))), lambda k: F.substring(F.col("t"), k * _PIECE + 1, F.lit(_PIECE)))
    segs = F.transform(pieces, lambda p: bx.jpeg_segment(0xFE, p))
    body = F.aggregate(segs, bx.raw(b""), lambda a, x: F.concat(a, x))
    files = docs.select("doc_id", F.concat(bx.raw(b"\xff\xd8"), body, bx.jpeg_segment(0xDA, bx.raw(b"\x01\x01\x00\x00\x3f\x00")), bx.raw(b"\xff\xd9")).alias("content"))
    got = tables.jpeg_segments(files, ["doc_id"]).where("kind = 'comment'")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "payload")))
    return got.groupBy("doc_id").agg(F.count("*").alias("segments"), F.max(F.length("payload")).cast("bigint").alias("largest"), F.sha2(F.aggregate(parts, bx.raw(b""), lambda a, x: F.concat(a, x["payload"])), 256).alias("text_sha256"))


@query("""SELECT o_orderkey, CAST(0 AS INTEGER) AS ordinal, 'stat' AS kind, CAST(CASE WHEN o_orderkey % 2 = 1 THEN 16 ELSE 8 END AS INTEGER) AS header, o_orderstatus AS value FROM orders
  UNION ALL SELECT o_orderkey, 1, 'prio', 8, o_orderpriority FROM orders""")
def bmff_boxes(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.concat(bx.box("stat", _text("o_orderstatus"), F.col("o_orderkey") % 2 == 1), bx.box("prio", _text("o_orderpriority"))).alias("content"))
    return tables.iso_boxes(o, ["o_orderkey"]).select("o_orderkey", "ordinal", "kind", "header", F.decode("payload", "UTF-8").alias("value"))


@query("""SELECT c_custkey, 'ifd0' AS ifd, CAST(271 AS INTEGER) AS tag, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'ifd0', 274, CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'ifd0', 256, CAST(c_custkey AS VARCHAR) FROM customer""")
def tiff_fields(spark, d):
    """A directory with a text behind it, a SHORT and a LONG in place, in both byte orders."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey", _text("c_name").alias("t"), (F.col("c_custkey") % 2 == 0).alias("big"))
    num = lambda v, n: F.when(F.col("big"), bx.put_be(v, n)).otherwise(bx.put_le(v, n))
    entry = lambda tag, kind, count, spot: F.concat(num(F.lit(tag), 2), num(F.lit(kind), 2), num(count, 4), spot)
    size = F.length("t")
    spot = F.when(size <= 4, F.rpad("t", 4, bx.raw(b"\0"))).otherwise(num(F.lit(8 + 2 + 36 + 4), 4))
    content = F.concat(
        F.when(F.col("big"), bx.raw("MM")).otherwise(bx.raw("II")), num(F.lit(42), 2), num(F.lit(8), 4), num(F.lit(3), 2),
        entry(256, 4, F.lit(1), num(F.col("c_custkey"), 4)), entry(271, 2, size, spot), entry(274, 3, F.lit(1), F.concat(num(F.col("c_nationkey"), 2), bx.raw(b"\0\0"))), num(F.lit(0), 4), F.col("t"),
    )
    got = tables.tiff_entries(c.select("c_custkey", "big", content.alias("content")), ["c_custkey", "big"])
    number = F.when(F.col("big"), F.conv(F.hex("value"), 16, 10)).otherwise(F.conv(F.hex(bx.flipped(F.col("value"))), 16, 10))
    return got.select("c_custkey", "ifd", "tag", F.when(F.col("kind") == 2, F.decode("value", "UTF-8")).otherwise(number).alias("value"))


@query("""SELECT conv_id, turn, CAST(0 AS INTEGER) AS ordinal, CAST(5 AS INTEGER) AS dataset, coalesce(role, '') AS value FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 120, coalesce(text, '') FROM conversations""")
def iim_datasets(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(bx.iim_dataset(2, 5, _text("role")), bx.iim_dataset(2, 120, _text())).alias("content"))
    return tables.iim_datasets(c, ["conv_id", "turn"]).select("conv_id", "turn", "ordinal", "dataset", F.decode("data", "UTF-8").alias("value"))


_PART = 1000


@query(f"SELECT doc_id, CAST(greatest(1, ceil(octet_length(encode(coalesce(text, ''))) / {_PART}.0)) AS BIGINT) AS parts, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def extended_parts(spark, d):
    """A text split into parts that lie in any order, put together by guid: whole, once, without gap."""
    docs = _t(spark, d, "documents").select("doc_id", _text().alias("t"))
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("t") / _PART).cast("int") - 1, F.lit(0))), lambda k: k * _PART)
    parts = docs.select("doc_id", F.md5("t").alias("guid"), F.length("t").alias("total"), "t", F.explode(starts).alias("offset"))
    parts = parts.select("doc_id", "guid", "total", "offset", F.substring("t", F.col("offset") + 1, F.lit(_PART)).alias("data"))
    return rewrite.reassemble(parts, ["doc_id", "guid"]).select("doc_id", "parts", F.sha2("data", 256).alias("text_sha256"))


_FIELDS = (
    ("dc", "creator"), ("dc", "format"), ("dc", "title"), ("dc", "coverage"), ("exif", "GPSLatitude"), ("exif", "ColorSpace"), ("exif", "UserComment"), ("tiff", "Artist"), ("tiff", "ImageWidth"),
    ("tiff", "Make"), ("tiff", "Software"), ("GCamera", "MotionPhotoVersion"), ("GCamera", "Other"), ("xmp", "CreatorTool"), ("xmp", "Rating"), ("pdf", "Author"), ("pdf", "Producer"), ("plus", "Anything"),
)
# What SQL expects, by field: rank and derivable, from the policy's prose.
_EXPECTED = ((2, 0), (3, 1), (3, 0), (8, 0), (8, 0), (1, 0), (8, 0), (2, 0), (1, 1), (3, 0), (8, 0), (1, 0), (8, 0), (8, 0), (3, 0), (2, 0), (8, 0), (2, 0))


@query(f"""SELECT level, count(*) AS removed FROM (SELECT [{", ".join(str(list(x)) for x in _EXPECTED)}][doc_id % {len(_FIELDS)} + 1] AS e FROM documents),
  (VALUES ('private', 3), ('copyright', 2), ('none', 1)) AS l(level, r) WHERE e[1] > r OR e[2] = 1 GROUP BY level""")
def policy_removed(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.element_at(F.array(*[F.struct(F.lit(policy.NS[n]).alias("ns"), F.lit(v).alias("name")) for n, v in _FIELDS]), (F.col("doc_id") % len(_FIELDS) + 1).cast("int")).alias("f"))
    grouped = policy.with_group(docs.select("doc_id", "f.*"))
    levels = grouped.withColumn("level", F.explode(F.array(*map(F.lit, ("keep", "private", "copyright", "none")))))
    return levels.where(policy.removed_at(F.col("rank"), F.col("derivable"), F.col("level"))).groupBy("level").agg(F.count("*").alias("removed"))


@query("""SELECT doc_id, level, CAST(8 + 25 + 12 + CASE WHEN keep THEN 12 + 7 + octet_length(encode(coalesce(text, ''))) ELSE 0 END AS BIGINT) AS size FROM (SELECT doc_id, text, level,
  CASE doc_id % 3 WHEN 0 THEN level = 'private' WHEN 1 THEN level IN ('private', 'copyright') ELSE false END AS keep FROM documents, (VALUES ('private'), ('copyright'), ('none')) AS l(level))""")
def png_filtered_size(spark, d):
    """Texts under keywords of six letters: of image information, of rights, and of neither."""
    keyword = F.element_at(F.array(*[bx.raw(k) for k in (b"Source", b"Author", b"Xxxxxx")]), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = _t(spark, d, "documents").select("doc_id", bx.png(bx.png_header(1, 1), bx.png_chunk("tEXt", F.concat(keyword, bx.raw(b"\0"), _text()))).alias("content"))
    out = None
    for level in ("private", "copyright", "none"):
        one = rewrite.filter_metadata(docs, ["doc_id"], "png", level).select("doc_id", F.lit(level).alias("level"), F.length("content").cast("bigint").alias("size"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT c_custkey, CASE WHEN n = 1 THEN t ELSE regexp_replace(t, '\\.jpg$', '') || ' ' || n || '.jpg' END AS claimed FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(t) ORDER BY c_custkey) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '.jpg' AS t FROM customer))""")
def output_names(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit(".jpg")).alias("t"))
    return naming.claim(c, "t", "c_custkey").select("c_custkey", "claimed")


@query(r"""SELECT page_id, regexp_replace(p, '(\.[^./]*)?$', '') || '-small' || regexp_extract(regexp_extract(p, '([^/]*)$', 1), '(\.[^.]*)$', 1) AS suffixed,
  '/out' || p AS mirrored FROM (SELECT page_id, '/' || regexp_extract(url, '://([^?#]*)', 1) || '/image.' || CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS p FROM pages)""")
def plan_paths(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/image."), F.when(F.col("page_id") % 2 == 0, "png").otherwise("jpg")).alias("p"))
    root = F.regexp_extract("p", "^(/[^/]*)/", 1)
    return p.select("page_id", naming.destination(F.col("p"), root, "suffix").alias("suffixed"), naming.destination(F.col("p"), root, "folder", folder="/out").alias("mirrored"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def dedup_exact(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("""SELECT doc_id, source, lang, bits FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, bits ORDER BY doc_id) AS rn FROM (
  SELECT doc_id, source, lang, CAST(CASE WHEN n_chars = 0 THEN 0 ELSE length(bin(n_chars)) END AS INTEGER) AS bits FROM documents)) WHERE rn <= 3""")
def keep_three_of_a_kind(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", sc.bit_length(F.col("n_chars")).alias("bits"))
    return naming.keep_first(docs, [F.col("source"), F.col("lang"), F.col("bits")], [F.col("doc_id")], 3)


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS rn
  FROM lineitem WHERE l_returnflag <> 'R') WHERE rn = 1""")
def verified_smallest(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return selection.smallest_by(li, ["l_orderkey"], "l_quantity", "l_linenumber", F.col("l_returnflag") != "R", []).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(trunc(CAST(trunc(l_extendedprice) AS BIGINT) * (1 - l_discount)) AS BIGINT) AS bound,
  CAST(trunc(l_extendedprice * 0.97) AS BIGINT) < CAST(trunc(CAST(trunc(l_extendedprice) AS BIGINT) * (1 - l_discount)) AS BIGINT) AS passes FROM lineitem""")
def minimum_gain(spark, d):
    li = _t(spark, d, "lineitem")
    best = F.col("l_extendedprice").cast("bigint")
    return li.select("l_orderkey", "l_linenumber", sc.least_size(best, F.col("l_discount")).alias("bound"), selection.under_limit((F.col("l_extendedprice") * 0.97).cast("bigint"), best, F.col("l_discount")).alias("passes"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT) + 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lineitem""")
def running_offsets(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", *_LINE)
    return compare.running_offsets(li, ["l_orderkey"], _LINE, F.col("l_quantity").cast("bigint"), 4).select("l_orderkey", "l_linenumber", "start")


@query("""SELECT event_id, user_id, CAST(expected AS INTEGER) AS expected FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 8 AS expected FROM events)
  WHERE expected <> event_id % 8""")
def restart_sequence(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts")
    return compare.out_of_turn(e, ["user_id"], ["ts", "event_id"], F.col("event_id") % 8, 8).select("event_id", "user_id", "expected")


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS r FROM events)
SELECT event_id, 'late' AS rule FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
  WHERE event_type = 'signup' AND seen = 1
UNION ALL SELECT event_id, 'falling' FROM (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e) WHERE r < p""")
def chunk_order(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    rank = F.when(kind == "signup", 0).when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).otherwise(4)
    late = compare.too_late(e, ["user_id"], ["ts", "event_id"], kind == "signup", kind == "purchase").select("event_id", F.lit("late").alias("rule"))
    return late.unionByName(compare.falling(e, ["user_id"], ["ts", "event_id"], rank).select("event_id", F.lit("falling").alias("rule")))


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM (SELECT *, lag(al) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS p FROM (
  SELECT *, CAST(l_quantity AS BIGINT) % 3 AS ah, CAST(l_quantity AS BIGINT) % 2 AS al FROM lineitem)) WHERE ah <> coalesce(p, 0)""")
def scan_progression(spark, d):
    q = F.col("l_quantity").cast("bigint")
    li = _t(spark, d, "lineitem").select("l_orderkey", *_LINE, (q % 3).alias("ah"), (q % 2).alias("al"))
    return compare.progression(li, ["l_orderkey"], _LINE, "ah", "al").select("l_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) % 7 + 1 AS ms FROM conversations), g AS (SELECT conv_id, sum(ms) AS total, count(DISTINCT role) > 1 AS varied FROM f GROUP BY conv_id)
SELECT conv_id, conv_id % 2 = 0 AS same FROM g""")
def timeline_compare(spark, d):
    """Turns as frames: against themselves with equal neighbours merged, and, for odd conversations, with the last frame a moment longer."""
    f = _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), (F.length(F.coalesce("text", F.lit(""))) % 7 + 1).alias("ms"))
    merged = compare.merge_frames(f, ["conv_id"], "turn", "role", "ms").withColumnRenamed("frame", "turn")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    merged = merged.withColumn("l", last).withColumn("ms", F.col("ms") + F.when((F.col("conv_id") % 2 == 1) & (F.col("turn") == F.col("l")), 1).otherwise(0)).drop("l")
    return compare.compare_timelines(f, merged, ["conv_id"], "turn", "role", "ms")


@query("""SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'lost' WHEN a.doc_id IS NULL THEN 'invented' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'kept' ELSE 'changed' END AS status
FROM (SELECT doc_id + 3 AS doc_id, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS v FROM documents) a FULL JOIN (SELECT doc_id, CAST(quality AS INTEGER) AS v FROM labels) b USING (doc_id)""")
def metadata_diff(spark, d):
    """Whole tables; ids are moved by three on one side, so that each side has some that the other has not."""
    a = _t(spark, d, "documents").withColumn("doc_id", F.col("doc_id") + 3).select("doc_id", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("v"))
    b = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("v"))
    return compare.diff(a, b, ["doc_id"], "v").select("doc_id", "status")


@query("SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def foreign_parts(spark, d):
    kept = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return compare.foreign_parts(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), kept, ["l_orderkey"])


@query("""SELECT 'supplier' AS source, count(*) AS missing FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
  UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")
def dangling_refs(spark, d):
    n = _t(spark, d, "nation").where("n_regionkey < 3")
    one = lambda t, c: compare.dangling(_t(spark, d, t), c, n, "n_nationkey").agg(F.lit(t).alias("source"), F.count("*").alias("missing"))
    return one("supplier", "s_nationkey").unionByName(one("customer", "c_nationkey"))


@query("""SELECT e.event_id, p.p_partkey FROM (SELECT event_id, CAST(event_id % 2000 AS BIGINT) AS at FROM events) e JOIN (SELECT p_partkey, CAST(p_retailprice AS BIGINT) AS lo, CAST(p_retailprice AS BIGINT) + p_size % 3 AS hi FROM
  (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part)) p ON e.at >= p.lo AND e.at < p.hi""")
def range_containment(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 2000).alias("at"))
    lo = F.floor("p_retailprice").cast("bigint")
    p = _t(spark, d, "part").select("p_partkey", lo.alias("lo"), (lo + F.col("p_size") % 3).alias("hi"))
    return compare.contained(e, "at", p, "lo", "hi").select("event_id", "p_partkey")


@query("""SELECT p_partkey FROM (SELECT *, max(hi) OVER (PARTITION BY p_brand ORDER BY lo, hi, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (
  SELECT p_partkey, p_brand, CAST(floor(p_retailprice * 100) AS BIGINT) * 100000 + p_partkey AS lo, CAST(floor(p_retailprice * 100) AS BIGINT) * 100000 + p_partkey + p_size * 100000 AS hi FROM part)) WHERE lo < e""")
def overlapping_ranges(spark, d):
    lo = F.floor(F.col("p_retailprice") * 100).cast("bigint") * 100000 + F.col("p_partkey")
    p = _t(spark, d, "part").select("p_partkey", "p_brand", lo.alias("lo"), (lo + F.col("p_size") * 100000).alias("hi"))
    return compare.overlaps(p, ["p_brand"], "lo", "hi").select("p_partkey")


@query("""WITH s AS (SELECT vec_id, i, CASE WHEN (i + vec_id) % 7 = 0 THEN NULL WHEN vec_id % 10 = 3 THEN 2.0 ELSE CAST(embedding[i] AS DOUBLE) END AS a,
  CASE WHEN (i + vec_id) % 5 = 0 THEN NULL ELSE CAST(embedding[len(embedding) + 1 - i] AS DOUBLE) END AS b FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
SELECT vec_id, round((sum(abs(a - b)) / CASE WHEN max(a) FILTER (b IS NOT NULL) > min(a) FILTER (b IS NOT NULL) THEN max(a) FILTER (b IS NOT NULL) - min(a) FILTER (b IS NOT NULL) ELSE 255 END
  + count(*) FILTER ((a IS NULL) <> (b IS NULL))) / count(*), 4) AS mean_diff FROM s GROUP BY vec_id""")
def mean_difference(spark, d):
    """Samples against themselves in reverse; some have no value on one side or on both, and some images are flat. In the SQL NULL stands for NaN."""
    v = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nan = F.lit(float("nan"))
    a = F.transform("a", lambda x, i: F.when((i + 1 + F.col("vec_id")) % 7 == 0, nan).when(F.col("vec_id") % 10 == 3, 2.0).otherwise(x))
    b = F.transform(F.reverse("a"), lambda x, i: F.when((i + 1 + F.col("vec_id")) % 5 == 0, nan).otherwise(x))
    return v.select("vec_id", F.round(compare.mean_difference(a, b, 255.0), 4).alias("mean_diff"))


@query("""WITH s AS (SELECT vec_id, (i - 1) % 10 AS x, (i - 1) // 10 AS y, abs(CAST(embedding[i] AS DOUBLE) - CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)) AS e
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), b AS (SELECT vec_id, avg(e) AS m FROM s GROUP BY vec_id, x // 8, y // 8)
SELECT vec_id, round(t.mean, 4) AS mean, round(w.block, 4) AS block, round(t.largest, 4) AS largest FROM (SELECT vec_id, avg(e) AS mean, max(e) AS largest FROM s GROUP BY vec_id) t JOIN (SELECT vec_id, max(m) AS block FROM b GROUP BY vec_id) w USING (vec_id)""")
def block_worst_mean(spark, d):
    """Images of ten columns, so that blocks of 8 x 8 are cut at the right and at the bottom."""
    v = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    s = v.select("vec_id", F.posexplode(F.arrays_zip(F.col("a"), F.reverse("a").alias("b"))).alias("i", "p")).select("vec_id", (F.col("i") % 10).alias("x"), F.floor(F.col("i") / 10).alias("y"), "p.a", "p.b")
    got = compare.block_difference(s, ["vec_id"], "x", "y", "a", "b")
    return got.select("vec_id", *[F.round(c, 4).alias(c) for c in ("mean", "block", "largest")])


@query("""WITH i AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS length, l_linenumber % 3 AS padding, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
t AS (SELECT *, 20 + 15 * (l_orderkey % 17) AS total, l_orderkey % 2 = 0 AS ahead FROM i),
p AS (SELECT *, CASE WHEN ahead THEN coalesce(sum(CASE WHEN n = 1 THEN padding ELSE length + padding END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  ELSE total - sum(length + padding) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS s FROM t)
SELECT l_orderkey, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS first, CAST(s + length AS BIGINT) AS last FROM p WHERE n > 1
  AND l_orderkey NOT IN (SELECT l_orderkey FROM p WHERE length > total OR padding > total OR n > 1 AND (s < 0 OR s + length > total))""")
def container_items(spark, d):
    """Lines as the items of a container behind a photo: counted from the end, or one after the other; those of a container that does not fit have no place."""
    li = _t(spark, d, "lineitem").select("l_orderkey", *_LINE)
    own = li.select("l_orderkey", F.col("l_quantity").cast("bigint").alias("length"), (F.col("l_linenumber") % 3).alias("padding"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)).cast("bigint").alias("n"))
    got = compare.placed_items(own, ["l_orderkey"], "n", "length", "padding", 20 + 15 * (F.col("l_orderkey") % 17), F.col("l_orderkey") % 2 == 0)
    return got.select("l_orderkey", "n", F.col("start").cast("bigint").alias("first"), F.col("end").cast("bigint").alias("last"))


_QUANT = "list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 6) AS INTEGER))"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as blocks of 64 coefficients, by label as the component."""
    return _t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.round(v.cast("double") * 6).cast("int")).alias("c"))


@query(f"""SELECT vec_id, CAST(dc - p AS INTEGER) AS difference, CAST(CASE WHEN dc = p THEN 0 ELSE length(bin(abs(dc - p))) END AS INTEGER) AS symbol FROM (
  SELECT vec_id, dc, coalesce(lag(dc) OVER (PARTITION BY label ORDER BY vec_id), 0) AS p FROM (SELECT vec_id, label, {_QUANT}[1] AS dc FROM embeddings))""")
def dc_differences(spark, d):
    b = _blocks(spark, d).select("vec_id", "label", F.col("c")[0].alias("dc"))
    return entropy.dc_differences(b, ["label"], ["vec_id"], "dc").select("vec_id", "difference", "symbol")


@query(f"""WITH c AS (SELECT vec_id, label, k, v FROM (SELECT vec_id, label, unnest(range(5, 21)) AS k, unnest({_QUANT}[6:21]) AS v FROM embeddings) WHERE v <> 0),
z AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY vec_id ORDER BY k), 4) - 1 AS zeros FROM c),
e AS (SELECT m.vec_id, m.label, max(c.k) AS last FROM embeddings m LEFT JOIN c ON m.vec_id = c.vec_id GROUP BY 1, 2),
i AS (SELECT label, sum(CASE WHEN last IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS island, CASE WHEN last = 20 THEN 0 ELSE 1 END AS open FROM e),
r AS (SELECT label, CAST(sum(open) AS BIGINT) AS run FROM i GROUP BY label, island HAVING sum(open) > 0),
s AS (SELECT label, (zeros % 16) * 16 + length(bin(abs(v))) AS symbol FROM z UNION ALL SELECT label, 240 FROM z WHERE zeros >= 16 UNION ALL SELECT label, (length(bin(run)) - 1) * 16 FROM r)
SELECT label, CAST(symbol AS INTEGER) AS symbol, count(*) AS n FROM s GROUP BY ALL""")
def ac_symbols(spark, d):
    """Symbols of the band 5 to 20 in a first pass, with runs of empty ends over blocks."""
    return entropy.ac_symbols(_blocks(spark, d), ["label"], ["vec_id"], "c", 5, 20)


@query("""WITH RECURSIVE s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS k, CAST(l_quantity AS BIGINT) * 1200 AS b FROM lineitem),
w AS (SELECT l_orderkey, n, k, b AS held, 1 AS g FROM s WHERE n = 1 UNION ALL
  SELECT s.l_orderkey, s.n, s.k, CASE WHEN coalesce(s.k = w.k, false) AND w.held + s.b + 2 <= 65535 THEN w.held + s.b ELSE s.b END, CASE WHEN coalesce(s.k = w.k, false) AND w.held + s.b + 2 <= 65535 THEN g ELSE g + 1 END
  FROM w JOIN s ON s.l_orderkey = w.l_orderkey AND s.n = w.n + 1)
SELECT l_orderkey, CAST(n AS BIGINT) AS n, CAST(g AS INTEGER) AS grp FROM w""")
def merged_segments(spark, d):
    """Lines as table segments: neighbours of a flag go into one segment while it holds them; those that were returned stay alone."""
    li = _t(spark, d, "lineitem").select("l_orderkey", *_LINE, "l_returnflag")
    own = li.select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)).cast("bigint").alias("n"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("k"), (F.col("l_quantity").cast("bigint") * 1200).alias("b"))
    return entropy.merged_segments(own, ["l_orderkey"], "n", "k", "b").withColumnRenamed("group", "grp")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as outcomes of files."""
    o = _t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "optimized").when(F.col("o_orderkey") % 50 == 0, "failed").otherwise("unchanged")
    reason = F.when(F.col("o_orderkey") % 3 == 0, "alreadyOptimal").otherwise("damaged")
    size = F.floor("o_totalprice").cast("bigint")
    return o.select(
        F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".png")).alias("file"), status.alias("status"), F.when(status == "unchanged", reason).alias("reason"), size.alias("originalSize"),
        (size - F.col("o_custkey") % 100).alias("size"), F.lower(F.substring("o_orderpriority", 1, 1)).alias("ext"),
    )


_OUTCOMES = """o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'optimized' WHEN o_orderkey % 50 = 0 THEN 'failed' ELSE 'unchanged' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'alreadyOptimal' ELSE 'damaged' END AS r0, CAST(floor(o_totalprice) AS BIGINT) AS original, CAST(floor(o_totalprice) AS BIGINT) - o_custkey % 100 AS size,
  lower(substr(o_orderpriority, 1, 1)) AS ext FROM orders), p AS (SELECT *, CASE WHEN status = 'unchanged' THEN r0 END AS reason FROM o)"""


@query(f"""WITH {_OUTCOMES}, s AS (SELECT count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unchanged' AND reason <> 'alreadyOptimal') AS skipped,
  CAST(coalesce(sum(original - size) FILTER (status = 'optimized'), 0) AS BIGINT) AS saved, CAST(coalesce(sum(original) FILTER (status = 'optimized' OR reason = 'alreadyOptimal'), 0) AS BIGINT) AS total FROM p)
SELECT *, CASE WHEN failed > 0 THEN 2 WHEN skipped > 0 THEN 1 ELSE 0 END AS exit_status FROM s""")
def run_summary(spark, d):
    return report.summary(_outcomes(spark, d))


@query(f"""WITH {_OUTCOMES} SELECT ext, count(*) AS files, count(*) FILTER (status = 'optimized') AS changed, CAST(sum(original) AS BIGINT) AS before,
  CAST(sum(CASE WHEN status = 'optimized' THEN size ELSE original END) AS BIGINT) AS after FROM p GROUP BY ROLLUP (ext)""")
def by_extension(spark, d):
    return report.by_extension(_outcomes(spark, d))


@query(f"WITH {_OUTCOMES} SELECT reason, count(*) AS files FROM p WHERE reason IS NOT NULL GROUP BY reason")
def reasons(spark, d):
    return report.by_reason(_outcomes(spark, d))


@query("""SELECT o_custkey, bytes, bytes - coalesce(b, bytes) AS delta, bytes > coalesce(b, bytes) AS regressed FROM (SELECT o_custkey, CAST(floor(max(o_totalprice)) AS BIGINT) AS bytes FROM orders GROUP BY 1)
  LEFT JOIN (SELECT c_custkey + 5 AS c_custkey, CAST(floor(c_acctbal) AS BIGINT) * 50 AS b FROM customer) ON o_custkey = c_custkey""")
def baseline_regressions(spark, d):
    now = _t(spark, d, "orders").groupBy("o_custkey").agg(F.floor(F.max("o_totalprice")).cast("bigint").alias("bytes"))
    base = _t(spark, d, "customer").select((F.col("c_custkey") + 5).alias("o_custkey"), (F.floor("c_acctbal").cast("bigint") * 50).alias("bytes"))
    return report.regressions(now, base, "o_custkey").select("o_custkey", "bytes", "delta", "regressed")


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'script' WHEN 1 THEN 'animation' WHEN 2 THEN 'html' WHEN 3 THEN 'css' WHEN 4 THEN 'script' END AS reason FROM pages")
def uncheckable_reason(spark, d):
    parts = ("<set attributeName='x'/><script>1</script>", "<animate/><foreignObject/>", "<foreignObject/>", "<style>@import 'a';</style>", "<rect onclick='a()'/>", "<rect style='fill:red'/>")
    p = _t(spark, d, "pages").select("page_id", F.encode(F.concat(F.lit("<svg xmlns='http://www.w3.org/2000/svg'><desc>"), F.md5("html"), F.lit("</desc>"), F.element_at(F.array(*map(F.lit, parts)), (F.col("page_id") % 6 + 1).cast("int")), F.lit("</svg>")), "UTF-8").alias("content"))
    return tables.svg_reasons(p, ["page_id"]).select("page_id", "reason")


@query("SELECT p_partkey, p_partkey % 4 < 2 AS is_generated FROM part")
def generated_ids(spark, d):
    k = F.col("p_partkey")
    own = F.when(k % 4 == 0, F.concat(F.lit("path"), k)).when(k % 4 == 1, F.concat(F.lit("SVGID_"), k, F.lit("_"))).when(k % 4 == 2, F.concat(F.lit("logo"), k)).otherwise(F.concat(F.lit("path"), k, F.lit("x")))
    return _t(spark, d, "part").select("p_partkey", sc.is_generated_id(own).alias("is_generated"))


@query("""WITH s(i, v) AS (SELECT unnest(range(1, 65)), unnest([16,11,10,16,24,40,51,61,12,12,14,19,26,58,60,55,14,13,16,24,40,57,69,56,14,17,22,29,51,87,80,62,18,22,37,56,68,109,103,77,24,35,55,64,81,104,113,92,49,64,78,87,103,121,120,101,72,92,95,98,112,100,103,99])),
m AS (SELECT q, sum(least(255, greatest(1, (v * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END + 50) // 100))) AS total FROM s, (SELECT unnest(range(1, 101)) AS q) GROUP BY q)
SELECT q AS written, CAST(min(q) OVER (PARTITION BY total) AS INTEGER) AS estimated FROM m""")
def jpeg_quality(spark, d):
    """Files with the scaled standard table of each quality; equal means give the lowest quality."""
    rows = [(q, bytes(jpeg.scaled_table(q))) for q in range(1, 101)]
    t = spark.createDataFrame(rows, "written long, steps binary")
    dqt = bx.jpeg_segment(0xDB, F.concat(bx.raw(b"\0"), F.col("steps")))
    files = t.select("written", F.concat(bx.raw(b"\xff\xd8"), dqt, bx.jpeg_segment(0xDA, bx.raw(b"\x01\x01\x00\x00\x3f\x00")), bx.raw(b"\xff\xd9")).alias("content"))
    return tables.quant_tables(files, ["written"]).select("written", admission.jpeg_quality(F.col("steps")).alias("estimated"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UTF-8' WHEN doc_id % 3 = 1 THEN 'UTF-16LE' ELSE 'UTF-16BE' END AS encoding, CASE WHEN doc_id % 3 > 0 THEN '<?xml version="1.0" encoding="UTF-8"?>' || coalesce(text, '') END AS text FROM documents""")
def utf16_roundtrip(spark, d):
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-16"?>'), F.coalesce("text", F.lit("")))
    content = F.when(F.col("doc_id") % 3 == 0, F.encode(text, "UTF-8")).when(F.col("doc_id") % 3 == 1, F.concat(bx.raw(b"\xff\xfe"), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-16BE"))
    files = _t(spark, d, "documents").select("doc_id", content.alias("content"))
    files = files.withColumn("encoding", sc.svg_encoding(F.col("content")))
    return files.select("doc_id", "encoding", sc.utf16_to_utf8(F.when(F.col("encoding") != "UTF-8", F.col("content")), F.col("encoding")).alias("text"))


@query("""SELECT lang, b AS symbol, count(*) AS n FROM (SELECT lang, unnest(string_split(hex(encode(coalesce(text, ''))), '')) AS b FROM documents) WHERE b <> '' GROUP BY lang, b""")
def symbol_histogram(spark, d):
    """Half-bytes by language; rows are counted per text first, so only counts are shuffled."""
    docs = _t(spark, d, "documents").select("lang", F.hex(_text()).alias("h"))
    one = docs.select("lang", F.explode(F.transform(F.array(*map(F.lit, "0123456789ABCDEF")), lambda s: F.struct(s.alias("symbol"), (F.length("h") - F.length(F.replace("h", s, F.lit("")))).alias("n")))).alias("x"))
    return one.groupBy("lang", "x.symbol").agg(F.sum("x.n").alias("n")).where("n > 0")


@query()
def huffman_cost(spark, d):
    """Bits of a length-limited code (package-merge, at most 16) for the half-bytes of each language."""
    return rewrite.huffman_bits(symbol_histogram(spark, d), "lang", "symbol", "n")


@query("SELECT doc_id, true AS sound, sha256(coalesce(text, '')) AS pixels_sha256, true AS not_larger FROM documents WHERE octet_length(encode(coalesce(text, ''))) > 0")
def idat_redeflate(spark, d):
    """Grey images of one row whose pixels are a text, deflated without effort and then again: the pixels stay, the size does not grow."""
    docs = _t(spark, d, "documents").select("doc_id", _text().alias("t")).where("length(t) > 0")
    return rewrite.redeflate_rows(docs, "doc_id", "t")


@query("""SELECT 'f' || o_orderkey || '.png' AS file, CASE WHEN o_orderstatus = 'F' THEN 'optimized' WHEN o_orderkey % 50 = 0 THEN 'failed' ELSE 'unchanged' END AS status,
  o_orderstatus <> 'F' AND o_orderkey % 50 <> 0 AS has_reason FROM orders""")
def report_json(spark, d):
    """Records as JSON, read again: a reason is there only where the file is unchanged."""
    r = report.records(_outcomes(spark, d).drop("ext"))
    return r.select(F.get_json_object("json", "$.file").alias("file"), F.get_json_object("json", "$.status").alias("status"), F.contains(F.col("json"), F.lit('"reason"')).alias("has_reason"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_returnflag <> 'R'), o AS (SELECT o_orderkey, CAST(40 AS BIGINT) AS original FROM orders)
SELECT o_orderkey, CASE WHEN min(size) < 40 THEN min(size) ELSE 40 END AS size, coalesce(min(size) < 40, false) AS smaller FROM o LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def fold_stages(spark, d):
    """All lines as candidates in four stages, verified unless returned: the end is the smallest under the original."""
    li = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), ((F.col("l_linenumber") - 1) % 4).cast("int").alias("stage"), F.col("l_linenumber").cast("int").alias("cand"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("name"), F.col("l_quantity").cast("bigint").alias("size"),
        (F.col("l_returnflag") != "R").alias("verified"), F.lit(False).alias("lossy"), F.lit(0.0).alias("minimum_gain"), F.lit(False).alias("required"), F.lit(False).alias("judged_finished"), F.lit(False).alias("promised"), F.lit(False).alias("has_private"),
    )
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit(40).alias("size"))
    got = selection.fold_stages(li, o)
    return got.select(F.col("file_id").alias("o_orderkey"), "size", (F.size("steps") > 0).alias("smaller"))


@query("""WITH e(effort, png, webp) AS (VALUES ('fast', 1, 1), ('standard', 1, 2), ('high', 1, 2), ('max', 2, 2)), f AS (SELECT doc_id % 9 AS k FROM documents)
SELECT effort, lossy, k AS variant, count(*) AS files, CAST(sum(CASE k WHEN 0 THEN 1 + png + CASE WHEN lossy THEN 1 + png ELSE 0 END WHEN 1 THEN CASE WHEN lossy THEN 3 ELSE 2 END WHEN 3 THEN webp WHEN 4 THEN 2
  WHEN 5 THEN CASE WHEN lossy THEN 2 ELSE 1 END WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 1 END) AS BIGINT) AS candidates,
  count(*) * CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 5 THEN CASE WHEN lossy THEN 0 ELSE 1 END WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 8 THEN 1 ELSE 0 END AS required
FROM f, e, (VALUES (true), (false)) AS l(lossy) WHERE k <> 2 GROUP BY effort, lossy, k""")
def stage_plans(spark, d):
    """Candidates of files by effort, loss, format and facts, from the rule tables: still PNG, JPEG above the target, GIF, lossless WebP, SVG, HEIC, JPEG XL from a JPEG, animated PNG at its one run, HEIC of 10 bits."""
    k = F.col("doc_id") % 9
    own = ("png", "jpeg", "gif", "webp", "svg", "heic", "jxl", "png", "heic")
    facts = _t(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), k.alias("k"), F.element_at(F.array(*map(F.lit, own)), (k + 1).cast("int")).alias("format"), (k == 7).alias("is_animated"),
        F.lit(90).alias("jpeg_quality"), (k == 3).alias("is_lossless_webp"), F.lit(False).alias("has_webp_metadata"), F.lit(False).alias("is_utf16"), F.lit(False).alias("is_uncheckable"), F.when(k == 8, 10).otherwise(8).alias("bits"), (k == 6).alias("from_jpeg"),
    )
    out = None
    for effort in planner.EFFORTS:
        for lossy in (True, False):
            c = planner.candidates(facts, planner.Settings(effort=effort, lossy=lossy))
            one = c.groupBy(F.lit(effort).alias("effort"), F.lit(lossy).alias("lossy"), F.col("k").alias("variant")).agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("candidates"), F.count_if("required").alias("required"))
            out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'flag of EXIF is wrong' WHEN doc_id % 4 = 1 THEN 'XMP out of order' WHEN doc_id % 4 = 2 THEN 'stray bytes' END AS rule FROM documents WHERE doc_id % 4 < 3")
def webp_violations(spark, d):
    """Extended WebP files: a flag missing, chunks out of order, stray bytes, and sound ones."""
    k = F.col("doc_id") % 4
    t = F.md5(_text()).cast("binary")
    vp8x = lambda flags: bx.riff_chunk("VP8X", bx.raw(bytes([flags, 0, 0, 0, 0, 0, 0, 0, 0, 0])))
    pixel = bx.riff_chunk("VP8L", bx.raw(b"\x2f\0\0\0\0\0\0\0"))
    exif, xmp = bx.riff_chunk("EXIF", t), bx.riff_chunk("XMP ", t)
    content = F.when(k == 0, bx.webp(vp8x(0), pixel, exif)).when(k == 1, bx.webp(vp8x(4), xmp, pixel)).when(k == 2, bx.webp(vp8x(8), pixel, exif, bx.raw("abc"))).otherwise(bx.webp(vp8x(12), pixel, exif, xmp))
    files = _t(spark, d, "documents").select("doc_id", content.alias("content"))
    got = tables.violations(files, ["doc_id"], "webp").select("doc_id", "rule")
    return got.withColumn("rule", F.when(F.col("rule") == "VP8L out of order", "XMP out of order").otherwise(F.col("rule")))


@query("SELECT doc_id, doc_id % 3 <> 1 AS \"privateData\" FROM documents")
def private_data(spark, d):
    """Files with one text each, of image information, of rights, of neither: what is private where only rights are kept."""
    keyword = F.element_at(F.array(*[bx.raw(k) for k in (b"Source", b"Author", b"Xxxxxx")]), (F.col("doc_id") % 3 + 1).cast("int"))
    files = _t(spark, d, "documents").select("doc_id", bx.png(bx.png_header(1, 1), bx.png_chunk("tEXt", F.concat(keyword, bx.raw(b"\0"), _text()))).alias("content"))
    return fields.holds_private(fields.fields(files, ["doc_id"], "png"), ["doc_id"], "copyright")


@query("""SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 1 AND 8 THEN c_nationkey ELSE 1 END AS orientation FROM customer""")
def orientation(spark, d):
    return _t(spark, d, "customer").select("c_custkey", admission.orientation(F.col("c_nationkey")).alias("orientation"))


_OWN_PATH = "'/in/' || CASE WHEN page_id % 5 = 4 THEN 'done/' ELSE '' END || 'page' || page_id || CASE page_id % 5 WHEN 0 THEN '-small' WHEN 1 THEN ' (original)' WHEN 2 THEN ' (original 3)' ELSE '' END || '.png'"


@query(f"""SELECT page_id, page_id % 5 <> 3 AS own, regexp_replace(p, 'png$', 'jxl') AS converted, regexp_extract(p, '^(.*)/', 1) AS folder FROM (SELECT page_id, {_OWN_PATH} AS p FROM pages)""")
def own_outputs(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.expr(_OWN_PATH).alias("p"))
    return p.select("page_id", naming.is_own_output(F.col("p"), folder="/in/done").alias("own"), naming.converted(F.col("p"), "jxl").alias("converted"), naming.folder_needed(F.col("p")).alias("folder"))


@query("""SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY lower(split_part(url, '?', 1)) ORDER BY page_id) AS n FROM pages WHERE url IS NOT NULL) WHERE n = 1""")
def inputs_once(spark, d):
    p = _t(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("path"))
    return naming.once(p, "path", "page_id").select("page_id")


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) WHERE n % 7 = 0")
def every_nth(spark, d):
    return files.every_nth(_t(spark, d, "part").select("p_partkey"), 7, "p_partkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey % 1000, o_orderkey) AS BIGINT) AS place FROM orders")
def natural_order(spark, d):
    """Names with numbers, in the order of the numbers."""
    o = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("F"), F.col("o_orderkey") % 1000, F.lit(" b"), F.col("o_orderkey"), F.lit(".png")).alias("name"))
    return o.select("o_orderkey", F.row_number().over(Window.orderBy(sc.natural_key(F.col("name")))).cast("bigint").alias("place"))


@query("""SELECT p_partkey, CAST(depth * chans AS INTEGER) AS bits, CAST(CASE WHEN p_partkey % 2 = 0 THEN h * (1 + ceil(w * depth * chans / 8.0)) ELSE (SELECT sum(CASE WHEN ceil((w - x0) / CAST(dx AS DOUBLE)) > 0 AND ceil((h - y0) / CAST(dy AS DOUBLE)) > 0
    THEN ceil((h - y0) / CAST(dy AS DOUBLE)) * (1 + ceil(ceil((w - x0) / CAST(dx AS DOUBLE)) * depth * chans / 8.0)) ELSE 0 END)
  FROM (VALUES (0,0,8,8),(4,0,8,8),(0,4,4,8),(2,0,4,4),(0,2,2,4),(1,0,2,2),(0,1,1,2)) AS a(x0, y0, dx, dy)) END AS BIGINT) AS inflated
FROM (SELECT p_partkey, p_size AS w, p_partkey % 23 + 1 AS h, CASE WHEN p_partkey % 3 = 0 THEN 16 ELSE 8 END AS depth, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 4 END AS chans FROM part)""")
def png_geometry(spark, d):
    """Bits of a pixel and inflated bytes, whole and in the seven passes."""
    k = F.col("p_partkey")
    colour = F.element_at(F.array(*map(F.lit, (0, 2, 4, 6))), (k % 4 + 1).cast("int"))
    p = _t(spark, d, "part").select("p_partkey", F.col("p_size").alias("w"), (k % 23 + 1).alias("h"), sc.png_bits(colour, F.when(k % 3 == 0, 16).otherwise(8)).alias("bits"))
    return p.select("p_partkey", "bits", sc.png_inflated_size(F.col("w"), F.col("h"), F.col("bits"), k % 2 == 1).alias("inflated"))


@query("""SELECT p_partkey, CAST(m AS BIGINT) AS mcus, CAST(CASE WHEN i > 0 THEN ceil(m / i) - 1 ELSE 0 END AS BIGINT) AS restarts FROM (SELECT p_partkey, p_partkey % 6 AS i,
  ceil(p_size * 40 / (8.0 * (1 + p_partkey % 2))) * ceil((p_partkey % 900 + 1) / (8.0 * (1 + p_partkey % 3 // 2))) AS m FROM part)""")
def mcu_restarts(spark, d):
    k = F.col("p_partkey")
    mcus = sc.mcu_count(F.col("p_size") * 40, k % 900 + 1, 1 + k % 2, 1 + F.floor(k % 3 / 2))
    return _t(spark, d, "part").select("p_partkey", mcus.alias("mcus"), sc.restart_count(mcus, k % 6).alias("restarts"))


@query("""SELECT p_partkey, CASE o WHEN 1 THEN x WHEN 2 THEN w - 1 - x WHEN 3 THEN w - 1 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN h - 1 - y WHEN 7 THEN h - 1 - y ELSE y END AS sx,
  CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN h - 1 - y WHEN 4 THEN h - 1 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN w - 1 - x ELSE w - 1 - x END AS sy
FROM (SELECT p_partkey, p_partkey % 8 + 1 AS o, p_partkey % 40 AS x, p_partkey % 30 AS y, CAST(40 AS BIGINT) AS w, CAST(30 AS BIGINT) AS h FROM part)""")
def oriented(spark, d):
    k = F.col("p_partkey")
    at = sc.oriented(k % 40, k % 30, F.lit(40).cast("bigint"), F.lit(30).cast("bigint"), k % 8 + 1)
    return _t(spark, d, "part").select("p_partkey", at["x"].alias("sx"), at["y"].alias("sy"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS inflated, sha256(coalesce(text, '')) AS from_base64, lower(regexp_replace('keep' || upper(lang[1]) || lang[2:], '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake FROM documents""")
def codec_roundtrip(spark, d):
    """Texts deflated and inflated, and as Base64 with line ends and marks in it; a name in snake case."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", _text().alias("t"))
    dirty = F.concat(F.lit("\n "), F.regexp_replace(F.base64("t"), "(.{50})", "$1\n* "))
    name = F.concat(F.lit("keep"), F.initcap("lang"))
    return docs.select("doc_id", F.sha2(sc.inflate(sc.deflate(F.col("t"))), 256).alias("inflated"), F.sha2(sc.base64_lenient(dirty), 256).alias("from_base64"), sc.snake_case(name).alias("snake"))


@query("""SELECT p_partkey, lead(lo) OVER (PARTITION BY p_brand ORDER BY lo) - (lo + p_size % 17) AS gap FROM (SELECT p_partkey, p_brand, p_size, p_partkey * 10 AS lo FROM part)""")
def gaps(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + F.col("p_size") % 17).alias("hi"))
    return compare.gaps(p, ["p_brand"], "lo", "hi").select("p_partkey", "gap")


@query("""SELECT p_partkey, n > floor(size / 1000.0) OR s > 10 AS strict, n > floor(size / 100.0) OR s > 100 AS loose FROM (SELECT p_partkey, p_size * 900 AS size, p_partkey % 300 AS n, p_partkey % 120 AS s FROM part)""")
def rendering_differs(spark, d):
    k = F.col("p_partkey")
    args = (F.col("p_size") * 900, k % 300, k % 120)
    return _t(spark, d, "part").select("p_partkey", compare.rendering_differs(*args, True).alias("strict"), compare.rendering_differs(*args, False).alias("loose"))


@query("""SELECT o_orderkey, CASE k % 4 WHEN 0 THEN 'lossy' WHEN 1 THEN 'visiblyIdentical' WHEN 2 THEN 'lossless' ELSE 'pixelIdentical' END AS fidelity,
  CASE k % 5 WHEN 0 THEN 'damaged' WHEN 1 THEN 'metadataNotFilterable' WHEN 2 THEN 'resultRejected' ELSE 'alreadyOptimal' END AS reason,
  CASE WHEN o_orderstatus = 'F' THEN k % 700 - k % 300 ELSE 0 END AS saved, k % 3 = 2 AS belongs FROM (SELECT *, o_orderkey AS k FROM orders)""")
def outcome_rules(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(
        "o_orderkey", report.fidelity(k % 4 == 0, k % 4 == 1, report.compares_exactly(F.when(k % 4 == 2, "svg").otherwise("png"))).alias("fidelity"),
        report.final_reason(k % 5 == 0, k % 5 == 1, F.when(k % 5 == 2, 3).otherwise(0)).alias("reason"),
        report.saved(F.when(F.col("o_orderstatus") == "F", "optimized").otherwise("unchanged"), k % 700, k % 300).alias("saved"),
        report.belongs_in_folder(F.element_at(F.array(F.lit("empty"), F.lit("changedMeanwhile"), F.lit("damaged")), (k % 3 + 1).cast("int"))).alias("belongs"),
    )


@query("""SELECT doc_id, CASE k WHEN 0 THEN 'animatedWebP' WHEN 1 THEN 'lossyWebP' WHEN 2 THEN 'gif' WHEN 3 THEN 'heicWithoutLoss' WHEN 4 THEN 'jxlNotFromJPEG' ELSE 'nothingToOptimize' END AS lossless,
  CASE k WHEN 0 THEN 'animatedWebP' WHEN 1 THEN 'lossyWebP' WHEN 2 THEN 'gif' WHEN 3 THEN 'hdrHEIC' WHEN 4 THEN 'jxlNotFromJPEG' ELSE 'nothingToOptimize' END AS lossy,
  CASE k WHEN 0 THEN 'video' WHEN 1 THEN 'moreImages' WHEN 2 THEN 'otherData' END AS obstacle FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)""")
def unsupported_kinds(spark, d):
    k = F.col("doc_id") % 6
    fmt = F.element_at(F.array(*map(F.lit, ("webp", "webp", "gif", "heic", "jxl", "png"))), (k + 1).cast("int"))
    both = [planner.reason_for_no_stages(fmt, k == 0, lossy).alias(n) for n, lossy in (("lossless", False), ("lossy", True))]
    return _t(spark, d, "documents").select("doc_id", *both, planner.jxl_obstacle(k == 0, F.when(k == 1, 2).otherwise(1), F.when(k == 2, 9).otherwise(0)).alias("obstacle"))


@query("""SELECT doc_id, kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT doc_id, 'FE' AS kind, 32 AS size FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'E1', 32 FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'IHDR', 13 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'tEXt', 40 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 'IEND', 0 FROM documents WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 'EXIF', 32 FROM documents WHERE doc_id % 3 = 2) GROUP BY doc_id, kind""")
def metadata_regions(spark, d):
    """Regions of JPEG, PNG and WebP files: image data and tables are none."""
    k = F.col("doc_id") % 3
    t = F.md5(_text()).cast("binary")
    scan = F.concat(bx.jpeg_segment(0xDA, bx.raw(b"\x01\x01\x00\x00\x3f\x00")), bx.raw(b"\xff\xd9"))
    jpg = F.concat(bx.raw(b"\xff\xd8"), bx.jpeg_segment(0xFE, t), bx.jpeg_segment(0xDB, t), bx.jpeg_segment(0xE1, t), scan)
    content = F.when(k == 0, jpg).when(k == 1, bx.png(bx.png_header(1, 1), bx.png_chunk("tEXt", F.concat(bx.raw(b"Comment\0"), t)), bx.png_chunk("IDAT", t))).otherwise(bx.webp(bx.riff_chunk("VP8L", t), bx.riff_chunk("EXIF", t)))
    got = tables.metadata_regions(_t(spark, d, "documents").select("doc_id", content.alias("content")), ["doc_id"])
    return got.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("data")).cast("bigint").alias("bytes"))


_PAIR = "SELECT doc_id, doc_id % 12 AS r, doc_id // 12 % 2 AS v, doc_id // 24 % 3 > 0 AS exact, ['jpeg', 'heic', 'png', 'gif', 'webp', 'svg', 'jxl'][doc_id % 7 + 1] AS format FROM documents"


@query(f"""WITH f AS ({_PAIR}), m AS (SELECT *, format IN ('jpeg', 'heic') AS paired, format IN ('png', 'webp', 'heic') AS colour, CASE WHEN r = 0 THEN 'chunk order' WHEN format = 'jxl' THEN CASE WHEN r < 6 THEN 'rebuilt file differs' END
  WHEN format = 'svg' THEN CASE WHEN r < 6 AND v = 0 THEN 'looks different' WHEN r < 6 THEN 'text changed' END WHEN r = 1 THEN 'unreadable' WHEN r = 2 THEN 'different dimensions' WHEN r = 3 THEN 'orientation lost'
  WHEN r = 4 THEN 'resolution changed' WHEN r = 5 AND (v = 0 OR format IN ('jpeg', 'heic')) THEN 'animation or second image lost' WHEN r <= 6 AND format IN ('jpeg', 'heic') THEN 'color profile lost'
  WHEN r <= 7 AND format IN ('jpeg', 'heic') THEN 'animation or second image lost' WHEN r <= 8 AND format IN ('jpeg', 'heic') THEN 'HDR brightness changed' WHEN r <= 9 THEN 'unreadable' WHEN NOT exact THEN NULL
  WHEN r = 10 AND format = 'jpeg' THEN 'pixels changed' WHEN r = 10 THEN 'animation timing changed' WHEN format IN ('png', 'webp', 'heic') AND v = 1 THEN 'pixels changed' END AS rejected FROM f)
SELECT doc_id, rejected, NOT (rejected IS NULL AND colour AND exact) AS hidden_kept FROM m""")
def verdict(spark, d):
    """Pairs that break a rule and all that come after it, in seven formats: the first that counts for the format names the reason."""
    k = F.col("doc_id")
    docs = _t(spark, d, "documents").select("doc_id", (k % 12).alias("r"), (F.floor(k / 12) % 2).alias("v"), (F.floor(k / 24) % 3 > 0).alias("exact"))
    fmt = F.element_at(F.array(*map(F.lit, ("jpeg", "heic", "png", "gif", "webp", "svg", "jxl"))), (k % 7 + 1).cast("int"))
    r, v = F.col("r"), F.col("v")
    broken = lambda n, good, bad: F.when(r <= n, F.lit(bad)).otherwise(F.lit(good))
    facts = {
        "format": fmt, "structure": F.when(r == 0, "chunk order"), "readable": r > 1, "complete": r > 9, "decodes": r > 9, "a_width": F.lit(640), "b_width": broken(2, 640, 641),
        "a_height": F.lit(480), "b_height": F.lit(480), "a_orientation": F.lit(6), "b_orientation": broken(3, 6, 1), "a_resolution": verify.resolution(F.lit(None), F.lit(72.0)),
        "b_resolution": verify.resolution(broken(4, 72.0, 96.0), F.lit(72.0)), "a_browser": F.lit(None).cast("array<int>"), "b_browser": F.lit(None).cast("array<int>"), "a_frames": F.lit(3),
        "b_frames": F.when(r <= 5, F.when(v == 0, 1).otherwise(2)).otherwise(3), "a_icc": F.lit("p3"), "b_icc": broken(6, "p3", "srgb"), "auxiliary_same": r > 7, "auxiliary": F.lit(1),
        "a_headroom": F.lit(4.9), "b_headroom": broken(8, 4.9, 1.0), "same_bytes": F.lit(False), "coefficients": broken(10, 0, 1), "a_duration": F.lit(90), "b_duration": broken(10, 90, 80),
        "pixels": broken(10, "hidden", "changed"), "hidden_may_change": v == 0, "converted": F.when(r < 6, "rebuilt file differs"), "text_same": F.when(v == 1, r >= 6), "looks_different": r < 6,
    }
    return verify.verdict(docs.withColumns(facts)).select("doc_id", "rejected", "hidden_kept")


@query("""SELECT p_partkey, CAST(coalesce(x, 72.0) AS DOUBLE) AS dpi, CASE WHEN x = 144 AND unit <> 3 AND told THEN p_size * 20 ELSE p_size * 40 END AS shown FROM (
  SELECT p_partkey, p_size, [0.0, 72.0, 144.0, NULL][p_partkey % 4 + 1] AS x, coalesce([2, 3, NULL][p_partkey // 4 % 3 + 1], 2) AS unit, p_partkey // 12 % 2 = 0 AS told FROM part)""")
def image_properties(spark, d):
    """Resolutions of nothing, 72, 144 and none, in inches, centimetres and no unit; half of the files tell half of their size."""
    k, w = F.col("p_partkey"), F.col("p_size") * 40
    x = F.element_at(F.array(F.lit(0.0), F.lit(72.0), F.lit(144.0), F.lit(None)), (k % 4 + 1).cast("int"))
    unit = F.element_at(F.array(F.lit(2), F.lit(3), F.lit(None)), (F.floor(k / 4) % 3 + 1).cast("int"))
    told = F.when(F.floor(k / 12) % 2 == 0, F.col("p_size") * 20).otherwise(w)
    return _t(spark, d, "part").select("p_partkey", verify.resolution(x, x)[0].alias("dpi"), verify.browser_size(w, w, x, x, unit, told, told)[0].alias("shown"))


@query("""SELECT p_partkey, CASE WHEN k % 7 > 0 AND k % 3 = k % 5 AND k % 2 = k // 2 % 2 THEN 'same' WHEN k % 7 > 0 AND k % 4 = 0 THEN 'hidden' ELSE 'changed' END AS pixels FROM (SELECT p_partkey, p_partkey AS k FROM part)""")
def under_alpha(spark, d):
    """Frames of two pixels: the first transparent or not in each, the second opaque and sometimes another."""
    k, n = F.col("p_partkey"), lambda *xs: F.array(*[(x if not isinstance(x, int) else F.lit(x)).cast("bigint") for x in xs])
    a = n(k % 3, 1, 2, k % 2, 5, 6, 7, 255)
    b = n(k % 5, 1, 2, F.floor(k / 2) % 2, 5, 6, 7, F.when(k % 7 == 0, 254).otherwise(255))
    return _t(spark, d, "part").select("p_partkey", verify.under_alpha(a, b).alias("pixels"))


@query("""SELECT o_orderkey, CAST(s AS INTEGER) AS status, CASE s WHEN 3 THEN 'the decoder reports damaged data' WHEN 1 THEN 'pixels changed' END AS damage FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 3 = 1 THEN 1 WHEN o_orderkey % 7 < 2 AND o_orderkey % 7 > 0 THEN 3 ELSE 0 END AS s FROM orders)""")
def comparer_status(spark, d):
    k = F.col("o_orderkey")
    status = verify.comparer_status(F.when(k % 5 > 0, True), k % 7 * (k % 7 < 2).cast("int"), F.when(k % 3 < 2, k % 3 == 1))
    return _t(spark, d, "orders").select("o_orderkey", status.alias("status"), verify.damage(status).alias("damage"))


@query("""SELECT file, exact, count(*) FILTER (bad) = 0 AS auxiliary_same, count(*) AS auxiliary FROM (
  SELECT l_orderkey AS file, exact, l_partkey, CASE WHEN exact THEN l_partkey % 11 = 0 ELSE l_partkey % 7 = 0 OR l_partkey % 5 = 0 END AS bad
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), (VALUES (true), (false)) AS e(exact)) GROUP BY file, exact""")
def auxiliary_images(spark, d):
    """Parts of an order as auxiliary images: other data, another size, samples that are far or near."""
    k = F.col("l_partkey")
    own = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), "l_partkey").distinct()
    flat = F.lit(None).cast("array<double>")
    arr = lambda *xs: F.array(*map(F.lit, xs))
    a = own.select("file", k.alias("kind"), k.alias("data"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.when(k % 5 == 0, arr(1.0, 2.0, 3.0)).when(k % 9 == 0, arr(0.0, 100.0)).otherwise(flat).alias("samples"))
    b = own.select("file", k.alias("kind"), F.when(k % 11 == 0, -1 - k).otherwise(k).alias("data"), F.when(k % 7 == 0, 9).otherwise(8).alias("width"), F.lit(8).alias("height"),
                   F.when(k % 5 == 0, arr(1.0, 2.0, 4.0)).when(k % 9 == 0, arr(0.5, 100.0)).otherwise(flat).alias("samples"))
    return verify.auxiliary_same(a, b, ["file"], True).withColumn("exact", F.lit(True)).unionByName(verify.auxiliary_same(a, b, ["file"], False).withColumn("exact", F.lit(False)))


@query("""SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 3 > 0 AND (l_returnflag <> 'A' OR l_linenumber % 4 = 3)""")
def maker_notes_left(spark, d):
    """Lines as tags: of Apple's and of another maker, of a tag for display and of one that is not; an order's level is keep, none or private."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    tags = _t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "Apple").otherwise("Canon").alias("maker"), pick((17, 33, 48, 8), F.col("l_linenumber") % 4).alias("tag"),
                                           pick(("keep", "none", "private"), F.col("l_orderkey") % 3).alias("level"))
    return verify.maker_notes_left(tags, ["l_orderkey"], F.col("level"))


@query("""SELECT p_partkey, m IN (192, 193, 194, 195) AND p = 8 AND c IN (1, 3) AS reads, CASE WHEN k % 2 = 0 THEN k % 3 = 0 AND k % 4 = 0 AND m IN (192, 193, 194, 195) AND p = 8 AND c IN (1, 3) ELSE k % 4 = 0 OR k % 5 > 0 OR (k % 7 = 1 AND k % 3 = 0) END AS may FROM (
  SELECT p_partkey, p_partkey AS k, 192 + p_partkey % 6 AS m, 8 + p_partkey % 5 // 4 * 4 AS p, p_partkey % 4 + 1 AS c FROM part)""")
def encoding_rules(spark, d):
    k = F.col("p_partkey")
    reads = verify.reads_for_encoding(k % 6 + 192, F.when(k % 5 == 4, 12).otherwise(8), k % 4 + 1)
    may = verify.may_change(k % 4, k % 2 == 0, k % 3 == 0, reads, k % 5 == 0, F.when(k % 7 == 1, "container").when(k % 7 == 2, "multiPicture"), k % 3 == 0)
    return _t(spark, d, "part").select("p_partkey", reads.alias("reads"), may.alias("may"))


_NTH = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1"


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the images of a file, numbered from 0."""
    return _t(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE)) - 1)


@query(f"""WITH i AS (SELECT *, {_NTH} AS n FROM lineitem), c AS (SELECT l_orderkey, min(n) FILTER (n > 0 AND l_returnflag <> 'N' AND l_partkey % 9 = 0) AS bad, count(*) FILTER (l_suppkey % 8 = 0 AND l_linestatus <> 'F') AS g FROM i GROUP BY 1)
SELECT l_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'images lost or added' WHEN bad IS NOT NULL THEN 'image ' || (bad + 1) || ' changed' ELSE 'data between or after the images changed' END AS violation
FROM c LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' OR bad IS NOT NULL OR g > 0
UNION ALL SELECT o_orderkey, 'images lost or added' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def image_pairs(spark, d):
    """Lines as images: some changed that may not, some with other data behind them, orders of one status with one image more."""
    i = _images(spark, d)
    gap = F.col("l_linestatus")
    a = i.select("l_orderkey", "n", F.col("l_partkey").alias("digest"), gap.alias("gap"), (gap == "F").alias("gap_stays"), ((F.col("n") == 0) | (F.col("l_returnflag") == "N")).alias("may_change"))
    kept = F.when(gap == "F", gap).when(F.col("l_suppkey") % 8 == 0, gap).otherwise("")
    b = i.select("l_orderkey", "n", F.when(F.col("l_partkey") % 9 == 0, -1).otherwise(F.col("l_partkey")).alias("digest"), kept.alias("gap"))
    more = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(99).alias("n"), F.lit(1).cast("bigint").alias("digest"), F.lit("").alias("gap"))
    return verify.images_violation(a, b.unionByName(more), ["l_orderkey"])


@query(f"""SELECT l_orderkey, string_agg(l_partkey || coalesce(CASE WHEN l_linestatus = 'F' THEN l_linestatus END, ''), '' ORDER BY n) AS content FROM (SELECT *, {_NTH} AS n FROM lineitem) GROUP BY 1""")
def joined_images(spark, d):
    i = _images(spark, d).withColumns({"content": F.encode(F.col("l_partkey").cast("string"), "UTF-8"), "gap": F.encode(F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")), "UTF-8")})
    return verify.joined_images(i, ["l_orderkey"], "n", "content", "gap").select("l_orderkey", F.decode("content", "UTF-8").alias("content"))


@query("""SELECT p.l_orderkey, CAST(p.l_linenumber AS INTEGER) AS l_linenumber, p.l_partkey, CAST(p.l_partkey + coalesce(sum(c.delta), 0) AS BIGINT) AS moved
FROM (SELECT *, row_number() OVER () AS id FROM lineitem) p LEFT JOIN (SELECT l_orderkey, l_suppkey * 15 AS e, CAST(l_quantity AS BIGINT) - 25 AS delta FROM lineitem) c ON c.l_orderkey = p.l_orderkey AND c.e <= p.l_partkey
GROUP BY p.id, p.l_orderkey, p.l_linenumber, p.l_partkey""")
def moved_places(spark, d):
    """Lines as places in a file, and as changes of its length that end somewhere."""
    t = _t(spark, d, "lineitem")
    changes = t.select("l_orderkey", (F.col("l_suppkey") * 15).alias("e"), (F.col("l_quantity").cast("bigint") - 25).alias("delta"))
    points = t.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey")
    return verify.moved(points, "l_partkey", changes, "e", "delta", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "moved")


@query("""SELECT o_orderkey, CAST(CASE WHEN refused THEN 100 ELSE size END AS BIGINT) AS final_size, lossy AND NOT back AND NOT refused AS final_lossy,
  CASE WHEN refused THEN 'metadataNotFilterable' WHEN size = 100 AND back THEN 'resultRejected' WHEN size = 100 THEN 'alreadyOptimal' END AS final_reason FROM (
  SELECT *, size <> 100 AND fmt NOT IN ('svg', 'gif') AND k % 7 = 0 AS refused FROM (SELECT *, CASE WHEN back THEN 90 + k % 11 ELSE CASE WHEN lossy THEN 50 ELSE 90 + k % 11 END END AS size FROM (
  SELECT o_orderkey, o_orderkey AS k, o_orderkey % 2 = 0 AS lossy, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS back, ['jpeg', 'svg', 'gif', 'png'][o_orderkey % 4 + 1] AS fmt FROM orders)))""")
def settled(spark, d):
    k = F.col("o_orderkey")
    lossless = (k % 11 + 90).cast("bigint")
    ends = _t(spark, d, "orders").select(
        "o_orderkey", F.element_at(F.array(*map(F.lit, ("jpeg", "svg", "gif", "png"))), (k % 4 + 1).cast("int")).alias("format"), F.lit(100).cast("bigint").alias("original"),
        F.when(k % 2 == 0, 50).otherwise(lossless).alias("size"), (k % 2 == 0).alias("lossy"), lossless.alias("lossless_size"), (k % 3 == 0).alias("chosen_fails"), (k % 7 == 0).alias("metadata_fails"),
    )
    return verify.settled(ends).select("o_orderkey", "final_size", "final_lossy", "final_reason")


@query("""SELECT k, CASE WHEN r THEN 'extra' ELSE 'missing' END AS side FROM (SELECT coalesce(o_custkey, c_custkey) AS k, o_custkey IS NOT NULL AS r, c_custkey IS NOT NULL AS e
  FROM (SELECT DISTINCT o_custkey FROM orders) FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey) WHERE r <> e""")
def unexpected(spark, d):
    """Customers that ordered, against those that are in credit."""
    reported = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return verify.unexpected(reported, _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("""SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(coalesce(text, '')), doc_id) - 1 AS i, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
WHERE i = n // 2 OR i = n * 3 // 4""")
def middle_and_upper(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return verify.middle_and_upper(docs, ["source", "lang"], "size", "doc_id").drop("size")


@query(f"""SELECT doc_id, CASE WHEN reason = 'damaged' AND lang IS NULL THEN '{verify.DAMAGED_SOMEHOW}' ELSE replace(said, '%s', coalesce(lang, '')) END AS message FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS lang, doc_id % {len(verify.MESSAGES)} AS i FROM documents) JOIN (VALUES {", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(verify.MESSAGES.items()))}) m(i, reason, said) USING (i)""")
def messages(spark, d):
    names = F.array(*map(F.lit, verify.MESSAGES))
    reason = F.element_at(names, (F.col("doc_id") % len(verify.MESSAGES) + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", verify.message(reason, F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).alias("message"))


@query("SELECT DISTINCT conv_id, conv_id % 2 = 0 AS same FROM conversations")
def timeline_least(spark, d):
    """Turns as frames, some without duration: against themselves at one unit at least, and, in odd conversations, with frames that last longer."""
    ms = F.length(F.coalesce("text", F.lit(""))) % 3
    t = _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), ms.alias("ms"))
    b = t.withColumn("ms", F.greatest("ms", F.lit(1)) + F.col("conv_id") % 2)
    return compare.compare_timelines(t, b, ["conv_id"], "turn", "role", "ms", least=1)
