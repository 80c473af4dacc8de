"""Folders of files as DataFrames, baseline and result files, and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import extension, natural_key
from ..operators.naming import once

# Extensions that are looked at, and folders that are packages.
EXTENSIONS = ("png", "jpg", "jpeg", "jpe", "mpo", "gif", "webp", "svg", "heic", "heif", "jxl")
PACKAGES = ("app", "bundle", "framework", "photoslibrary", "xcassets")


def is_candidate(path: Column) -> Column:
    """An extension of the list in any case, no hidden part, no package among the parents."""
    parts = F.split(F.regexp_replace(path, "^[a-z]+:/*", ""), "/")
    parents = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    package = F.exists(parents, lambda p: F.lower(p).rlike(r"\.(" + "|".join(PACKAGES) + ")$"))
    return extension(path).isin(*EXTENSIONS) & ~hidden & ~package


def scan(spark: SparkSession, folders: list[str], named: list[str] | None = None, skip=None, content: bool = True) -> DataFrame:
    """files: path, root (null of directly named ones), ext, length, modificationTime, content. One row per path, the first it was given by.

    Spark's file source leaves out files without any bytes. Content is a column of its own, so queries on names and sizes do not read it; skip(path) → Column leaves files out.
    """
    out = None
    for i, (root, paths) in enumerate([*((f, [f]) for f in folders), *([(None, named)] if named else [])]):
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
        if root is not None:
            df = df.where(is_candidate(F.col("path")))
        df = df.select("path", F.lit(root).cast("string").alias("root"), extension(F.col("path")).alias("ext"), "length", "modificationTime", *(["content"] if content else []), F.lit(i).alias("__given"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("nothing to scan")
    if skip is not None:
        out = out.where(~skip(F.col("path")))
    return (once(out, "path", "__given") if len(folders) + bool(named) > 1 else out).drop("__given")


def in_order(files: DataFrame) -> DataFrame:
    """By folder and natural name: numbers in names as numbers."""
    return files.orderBy(F.regexp_extract("path", "^(.*)/", 1), natural_key(F.regexp_extract("path", "([^/]*)$", 1)), "path")


#: Rows whose values bound the buckets of every_nth.
BOUNDS = 1024


def every_nth(files: DataFrame, step: int, by: str = "path") -> DataFrame:
    """Every step-th of the rows sorted by a column without repeats: buckets between bounds that are drawn once, counted, and numbered each by itself, so no task sees all rows."""
    drawn = files.select(by).where(F.col(by).isNotNull()).orderBy(F.xxhash64(by), by).limit(BOUNDS).collect()
    bounds = F.array(*[F.lit(v) for v in sorted(r[0] for r in drawn)[::4]]) if drawn else F.array().cast(f"array<{files.schema[by].dataType.simpleString()}>")
    dealt = files.withColumn("__b", F.size(F.filter(bounds, lambda x: x <= F.col(by))))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(dealt.groupBy("__b").agg(F.count("*").alias("n")).select("__b", before.alias("__n")))  # a row per bucket
    numbered = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(by)) - 1).join(starts, "__b")
    return numbered.where((F.col("__r") + F.col("__n")) % step == 0).drop("__b", "__r", "__n")


def changed(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files whose size or time is another in a later listing, or that are gone."""
    now = listing.select("path", F.col("length").alias("__l"), F.col("modificationTime").alias("__t"))
    return files.join(now, "path", "left").where("__l IS NULL OR __l <> length OR __t <> modificationTime").drop("__l", "__t")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """name<TAB>bytes."""
    return spark.read.csv(path, sep="\t", schema="name string, bytes bigint")


def write_baseline(df: DataFrame, path: str) -> None:
    df.select("name", "bytes").write.csv(path, sep="\t")


RESULTS = (
    "file string, status string, originalSize bigint, size bigint, saved bigint, identical boolean, lossy boolean, tools array<string>, result string, reason string, kind string, message string, "
    "privateData boolean, rejected array<struct<step: string, reason: string, pixelsChanged: boolean>>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of outcomes."""
    return spark.read.schema(RESULTS).json(path)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's bytes as a file of its own below folder, on a file system that all executors see; (name, bytes) of what was written.

    A file is written under a name of the attempt and then renamed, so a lost executor leaves no half file under a result's name.
    What is there already is never replaced: the same bytes, as of an attempt that was lost, count as written, others are an error.
    """
    from ..operators.tables import prepare

    prepare(df.sparkSession)

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)
        for b in batches:
            sizes = []
            for n, c in zip(b.column(0).to_pylist(), b.column(1)):
                target = f"{base}/{n}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                data = c.as_py()
                sizes.append(len(data))
                if fs.get_file_info(target).type != pafs.FileType.NotFound:
                    with fs.open_input_stream(target) as old:
                        if old.read() != data:
                            raise FileExistsError(target)
                    continue
                draft = f"{target}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as out:
                    out.write(data)
                fs.move(draft, target)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, bytes long")
