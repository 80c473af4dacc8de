"""Outcomes as records, lines and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bytes_text, percent

# Reasons, kinds, fidelities.
REASONS = "empty notAnImage readOnly turnedOff damaged contentCredentials appleCgBI motionPhotoVideo unreadableImages uncheckable notSupported metadataNotFilterable resultRejected alreadyOptimal changedMeanwhile inconvertible".split()
FIDELITIES = ("pixelIdentical", "visiblyIdentical", "lossless", "lossy")
NOT_IN_FOLDER = ("empty", "notAnImage", "changedMeanwhile")


def fidelity(lossy: Column, hidden_colour: Column, compares_exactly: Column) -> Column:
    return F.when(lossy, "lossy").when(hidden_colour, "visiblyIdentical").when(compares_exactly, "pixelIdentical").otherwise("lossless")


def compares_exactly(fmt: Column) -> Column:
    return fmt != "svg"


def saved(status: Column, original: Column, size: Column) -> Column:
    """May be negative: privacy goes before size."""
    return F.when(status == "optimized", original - size).otherwise(0)


def final_reason(damaged: Column, metadata_failed: Column, rejections: Column) -> Column:
    """Reason of a file that was run without result."""
    return F.when(damaged, "damaged").when(metadata_failed, "metadataNotFilterable").when(rejections > 0, "resultRejected").otherwise("alreadyOptimal")


def belongs_in_folder(reason: Column) -> Column:
    return ~reason.isin(*NOT_IN_FOLDER)


def records(outcomes: DataFrame) -> DataFrame:
    """Outcomes as a JSON string each, keys in order; fields that are null or an empty list of rejections are left out."""
    names = sorted(["file", "identical", "kind", "lossy", "message", "originalSize", "privateData", "reason", "rejected", "result", "saved", "size", "status", "tools"])
    have = [n for n in names if n in outcomes.columns]
    cols = [F.when(F.size(n) > 0, F.col(n)).alias(n) if n == "rejected" else F.when(F.col(n) != F.col("file"), F.col(n)).alias(n) if n == "result" else F.col(n) for n in have]
    return outcomes.select(F.to_json(F.struct(*cols)).alias("json"))


def lines(outcomes: DataFrame) -> DataFrame:
    """One line of text per outcome, with the mark of its status."""
    mark = F.when(F.col("status") == "failed", "!").when(F.col("status") == "unchanged", F.when(F.col("reason") == "alreadyOptimal", "=").otherwise("–")).otherwise("✓")
    more = F.when(F.col("status") == "optimized", F.concat(F.lit("  −"), percent(F.col("saved"), F.col("originalSize")), F.lit(" %  "), F.array_join("tools", " + "))).otherwise(F.concat(F.lit("  "), F.coalesce("message", "reason", F.lit(""))))
    return outcomes.select(F.concat(mark, F.lit(" "), F.col("file"), more).alias("line"))


def summary(outcomes: DataFrame) -> DataFrame:
    """failed, skipped, saved, total, exit_status of a run: skipped are the unchanged that were not optimal already; total is of what was compressed or optimal."""
    optimal = F.col("reason") == "alreadyOptimal"
    skipped = (F.col("status") == "unchanged") & ~F.coalesce(optimal, F.lit(False))
    counted = (F.col("status") == "optimized") | F.coalesce(optimal, F.lit(False))
    one = outcomes.agg(
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(skipped).alias("skipped"),
        F.coalesce(F.sum(saved(F.col("status"), F.col("originalSize"), F.col("size"))), F.lit(0)).alias("saved"),
        F.coalesce(F.sum(F.when(counted, F.col("originalSize"))), F.lit(0)).alias("total"),
    )
    return one.withColumn("exit_status", F.when(F.col("failed") > 0, 2).when(F.col("skipped") > 0, 1).otherwise(0))


def summary_line(summed: DataFrame) -> DataFrame:
    return summed.where("total > 0").select(F.concat(bytes_text(F.col("saved")), F.lit(" saved ("), percent(F.col("saved"), F.col("total")), F.lit(" %)")).alias("line"))


def by_extension(outcomes: DataFrame, ext: str = "ext") -> DataFrame:
    """Files, changed, bytes before and after by extension, with a row of all."""
    changed = F.col("status") == "optimized"
    return outcomes.rollup(ext).agg(F.count("*").alias("files"), F.count_if(changed).alias("changed"), F.sum("originalSize").alias("before"), F.sum(F.when(changed, F.col("size")).otherwise(F.col("originalSize"))).alias("after"))


def by_reason(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("files"))


def regressions(results: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Results with the baseline's bytes and whether they are larger; names the baseline has not compare with themselves."""
    b = baseline.select(F.col(key), F.col("bytes").alias("baseline"))
    return results.join(b, key, "left").withColumn("delta", F.col("bytes") - F.coalesce("baseline", "bytes")).withColumn("regressed", F.col("delta") > 0)


def benchmark(runs: DataFrame, by: list[str]) -> DataFrame:
    """The fastest of each file's runs, and whether all gave the same size."""
    return runs.groupBy(*by).agg(F.min("seconds").alias("seconds"), F.min("bytes").alias("bytes"), (F.min("bytes") == F.max("bytes")).alias("stable"))


def rejections(df: DataFrame, key: str) -> DataFrame:
    """The list of rejections of each file, in order."""
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "step", "reason", "pixelsChanged"))), lambda x: F.struct(x["step"], x["reason"], x["pixelsChanged"])).alias("rejected"))
