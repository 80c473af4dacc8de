"""A folder as a stream: files that arrive are detected, judged and counted. The operators are those of the batch side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import extension
from ..operators.admission import reason

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)


def admitted(files: DataFrame) -> DataFrame:
    """path, modificationTime, length, format, reason of each arriving file; bytes go no further."""
    return reason(files.withColumn("ext", extension(F.col("path")))).drop("content", "ext")


def counts(judged: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Files by format in windows of their modification time, up to `late`."""
    return judged.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), F.coalesce("format", F.lit("none")).alias("format")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def run(judged: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream into a Parquet folder or a function of (batch, id). Once: all that is there, then the end."""
    w = judged.writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w
    return w.foreachBatch(sink).start() if callable(sink) else w.format("parquet").option("path", sink).start()
