"""python -m mediaframe.cli FOLDER...: what is in the files, what would be done, as JSON lines or a table."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import admission, naming, report
from .plans.planner import EFFORTS, FORMATS, Settings
from .sources.files import scan


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="mediaframe", description="Looks at image files: format, reason to keep, destination.")
    p.add_argument("paths", nargs="+")
    p.add_argument("--lossy", action="store_true")
    p.add_argument("--quality", type=int, default=85)
    p.add_argument("--effort", choices=EFFORTS, default="standard")
    p.add_argument("--metadata", choices=("keep", "private", "copyright", "none"), default="private")
    p.add_argument("--suffix")
    p.add_argument("--output")
    p.add_argument("--to", choices=("jxl", "jpeg"))
    p.add_argument("--disable", nargs="*", choices=FORMATS, default=[])
    p.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    if a.to and a.lossy:
        p.error("--to converts without loss; it does not go with --lossy")
    if a.suffix is not None and a.output is not None:
        p.error("--suffix or --output, not both")
    try:
        a.settings = Settings(
            lossy=a.lossy, quality=a.quality, effort=a.effort, level=a.metadata, disabled=frozenset(a.disable),
            output="folder" if a.output else "suffix", folder=a.output, suffix=a.suffix if a.suffix is not None else "-small",
        )
    except ValueError as e:
        p.error(str(e))
    return a


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("mediaframe").getOrCreate()
    s: Settings = a.settings
    files = admission.reason(scan(spark, a.paths), disabled=sorted(s.disabled))
    target = naming.destination(F.col("path"), F.col("root"), s.output, s.suffix, s.folder)
    out = files.select(
        F.col("path").alias("file"), F.when(F.col("reason").isNull(), "optimized").otherwise("unchanged").alias("status"), F.col("length").alias("originalSize"), F.col("length").alias("size"),
        F.lit(0).alias("saved"), F.lit(s.lossy).alias("lossy"), F.array().cast("array<string>").alias("tools"), "reason", target.alias("result"),
    )
    shown = report.records(out) if a.json else report.lines(out.withColumn("message", F.lit(None).cast("string")))
    for row in shown.toLocalIterator():
        print(row[0])
    return report.summary(out).first()["exit_status"]


if __name__ == "__main__":
    raise SystemExit(main())
