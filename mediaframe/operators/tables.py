"""Table functions: a parser applied to each row's bytes, one row per part. Bytes stay in their task; only the parts leave it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..parsers import Malformed, bmff, iptc, jpeg, png, regions, riff, tiff, xmp


def prepare(spark) -> None:
    """Python workers import this package also when only the driver's sys.path has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table_function(df: DataFrame, keys: list[str], column: str, parse: Callable[[bytes], list[tuple]], schema: str, rows: int = 5000) -> DataFrame:
    """Rows (keys…, fields of schema…, error string): parse(content) per row of df. A null content gives no rows.

    What parse raises as Malformed becomes one row with nulls and the error. keys and the parsed fields must differ in name.
    """
    prepare(df.sparkSession)
    own = df.select(*keys, column)
    out = StructType([*own.schema.fields[:-1], *_parse_datatype_string(schema).fields, *_parse_datatype_string("error string").fields])
    arrow = to_arrow_schema(out)
    width = len(out) - len(keys) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[list] = [[] for _ in out]
            ids = [b.column(k).to_pylist() for k in range(len(keys))]
            for i, content in enumerate(b.column(len(keys))):
                data = content.as_py()
                if data is None:
                    continue
                try:
                    found = [(*r, None) for r in parse(data)]
                except Malformed as e:
                    found = [(*[None] * width, str(e))]
                for r in found:
                    for c, v in zip(held, (*(k[i] for k in ids), *r)):
                        c.append(v)
                if len(held[0]) >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow)], schema=arrow)
                    held = [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow)], schema=arrow)

    return own.mapInArrow(run, out)


def png_chunks(df: DataFrame, keys: list[str], column: str = "content", strict: bool = False) -> DataFrame:
    return table_function(df, keys, column, lambda d: png.chunks(d, strict), "ordinal int, kind string, offset int, size int, crc_ok boolean, data binary")


def png_texts(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    def parse(d: bytes):
        return [(c.ordinal, c.kind, *t, c.crc_ok) for c in png.chunks(d) if (t := png.text_of(c.kind, c.data))]

    return table_function(df, keys, column, parse, "ordinal int, kind string, keyword string, value binary, crc_ok boolean")


def webp_chunks(df: DataFrame, keys: list[str], column: str = "content", strict: bool = False) -> DataFrame:
    return table_function(df, keys, column, lambda d: riff.webp(d, strict), "ordinal int, kind string, offset int, size int, data binary")


def jpeg_segments(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return table_function(df, keys, column, lambda d: jpeg.headers(d)[0], "ordinal int, marker int, offset int, size int, kind string, payload binary")


def iso_boxes(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    def parse(d: bytes):
        return [(*b, bmff.payload(d, b)) for b in bmff.boxes(d)]

    return table_function(df, keys, column, parse, "ordinal int, parent int, kind string, offset int, size int, header int, payload binary")


def heif_items(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    def parse(d: bytes):
        h = bmff.heif(d)
        return [(*i, i.item_id == h.primary) for i in h.items]

    return table_function(df, keys, column, parse, "item_id bigint, kind string, name string, content_type string, is_primary boolean")


def heif_references(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return table_function(df, keys, column, lambda d: bmff.heif(d).references, "kind string, from_id bigint, to_id bigint")


def heif_extents(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return table_function(df, keys, column, lambda d: bmff.heif(d).extents, "item_id bigint, method int, offset bigint, length bigint")


def tiff_entries(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return table_function(df, keys, column, tiff.entries, "ifd string, tag int, kind int, count bigint, value binary, value_offset bigint")


def photoshop_resources(df: DataFrame, keys: list[str], column: str = "content", strict: bool = False) -> DataFrame:
    return table_function(df, keys, column, lambda d: iptc.resources(d, strict), "number int, name binary, data binary")


def iim_datasets(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return table_function(df, keys, column, lambda d: [(k, *x[:3]) for k, x in enumerate(iptc.datasets(d))], "ordinal int, record int, dataset int, data binary")


def xmp_fields(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return table_function(df, keys, column, xmp.fields, "ns string, name string, text string, leaves array<string>")


def container_items(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    def parse(d: bytes):
        return [(n, k, *i) for n, own in enumerate(xmp.directories(d)) for k, i in enumerate(own)]

    return table_function(df, keys, column, parse, "directory int, ordinal int, semantic string, mime string, length bigint, padding bigint")


def jpeg_images(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    def parse(d: bytes):
        found = jpeg.layout(d)
        return [(n, a, b - a, gap, found.problem) for n, ((a, b), gap) in enumerate(zip(found.images, found.gaps))]

    return table_function(df, keys, column, parse, "image_no int, start bigint, size bigint, gap bigint, problem string")


def quant_tables(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    def parse(d: bytes):
        return [(n, t) for s in jpeg.headers(d)[0] if s.marker == jpeg.DQT for n, t in jpeg.quant_tables(s.payload).items()]

    return table_function(df, keys, column, parse, "number int, steps array<int>")


def jxl_facts(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    def parse(d: bytes):
        j = bmff.jxl(d)
        return [(len(j.boxes), j.from_jpeg, len(j.exif), len(j.xmp), len(j.jumbf), j.needs_brotli)]

    return table_function(df, keys, column, parse, "boxes int, from_jpeg boolean, exif int, xmp int, jumbf int, needs_brotli int")


def svg_reasons(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    return table_function(df, keys, column, lambda d: [(xmp.uncheckable(d),)], "reason string")


CHECKS = {"png": png.violations, "jpeg": jpeg.violations, "webp": riff.violations}


def violations(df: DataFrame, keys: list[str], fmt: str, column: str = "content") -> DataFrame:
    """Rows (keys…, rule, ordinal) of what each file of a format breaks by itself; sound files give none."""
    check = CHECKS.get(fmt) or (bmff.heif_violations if fmt == "heic" else None)
    if check is None:
        raise ValueError(f"no structure check of {fmt}")
    return table_function(df, keys, column, check, "rule string, ordinal bigint").drop("error")


def metadata_regions(df: DataFrame, keys: list[str], column: str = "content") -> DataFrame:
    """(keys…, ordinal, kind, data, error): where a file keeps its metadata; a file that cannot be taken apart is one region of no kind."""
    return table_function(df, keys, column, lambda data: [(i, k, x) for i, (k, x) in enumerate(regions.regions(data))], "ordinal int, kind string, data binary")
