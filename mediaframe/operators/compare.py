"""Before and after: metadata, parts, timelines, sample differences; sequence rules as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys…, before, after, status): kept, changed, lost or invented, by a full outer join."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__b"))
    status = F.when(F.col("__b").isNull(), "lost").when(F.col("__a").isNull(), "invented").when(F.col("before").eqNullSafe(F.col("after")), "kept").otherwise("changed")
    return a.join(b, keys, "full").withColumn("status", status).drop("__a", "__b")


def verify_metadata(changes: DataFrame, level: Column | str) -> DataFrame:
    """Violations in a diff whose fields have rank and derivable: what a level removes must be gone, rights must stay unless all goes, nothing may be invented."""
    from ..plans.policy import RIGHTS, removed_at

    level = F.lit(level) if isinstance(level, str) else level
    gone = removed_at(F.col("rank"), F.col("derivable"), level)
    rule = (
        F.when((F.col("status") == "invented"), "invented")
        .when((F.col("status") == "changed"), "changed")
        .when((F.col("status") == "kept") & gone, "not removed")
        .when((F.col("status") == "lost") & (level == "keep"), "lost")
        .when((F.col("status") == "lost") & (F.col("rank") == RIGHTS) & ~gone & (level != "none"), "rights lost")
    )
    return changes.withColumn("rule", rule).where("rule IS NOT NULL")


def stands_in(text: Column, region: Column) -> Column:
    """Whether a value's text occurs in a metadata region; texts under 8 bytes must be all of it."""
    return F.when(F.octet_length(text) < 8, text == region).otherwise(F.contains(region, text))


def foreign_parts(result: DataFrame, original: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of the result that the original has not."""
    return result.join(original.select(*keys).distinct(), keys, "left_anti")


def dangling(child: DataFrame, reference: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return child.join(parent.select(F.col(key).alias("__k")).distinct(), F.col(reference) == F.col("__k"), "left_anti")


def contained(points: DataFrame, at: str, ranges: DataFrame, lo: str, hi: str, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """points joined with the ranges [lo, hi) that hold them. Both go to cells of `width`, so the join is on equal cells, not on all pairs.

    Without a width it is the mean length of the ranges, so that a range is in about two cells whatever the unit is.
    """
    held = ranges.where(F.col(lo) < F.col(hi))
    width = width or max(1, int(held.agg(F.avg(F.col(hi) - F.col(lo))).first()[0] or 1))
    p = points.withColumn("__cell", F.floor(F.col(at) / width))
    r = held.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return p.join(r, [*(keys or []), "__cell"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__cell")


def overlaps(ranges: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Ranges that begin before the furthest end of those before them."""
    w = Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("__end", F.max(hi).over(w)).where(F.col(lo) < F.col("__end")).drop("__end")


def timeline(frames: DataFrame, by: list[str], order: str, duration: str) -> DataFrame:
    """frames with start and end: running sums of their durations."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col(duration).cast("bigint")).over(w)
    return frames.withColumn("end", end).withColumn("start", F.col("end") - F.col(duration))


def merge_frames(frames: DataFrame, by: list[str], order: str, picture: str, duration: str) -> DataFrame:
    """Equal neighbours as one frame (by…, frame, picture, duration): gaps and islands."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(picture).over(w).eqNullSafe(F.col(picture)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    own = frames.withColumn("__new", new).withColumn("frame", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*by, "frame").agg(F.first(picture).alias(picture), F.sum(F.col(duration).cast("bigint")).alias(duration))


def compare_timelines(a: DataFrame, b: DataFrame, by: list[str], order: str, picture: str, duration: str, least: int = 0) -> DataFrame:
    """(by…, same): whether two animations show the same at every instant and last as long. Frames are matched on the instants at which either begins one, so merged frames do not matter. A frame lasts `least` at least; one without duration is not shown."""
    out = []
    for df in (a, b):
        df = df.withColumn(duration, F.greatest(F.col(duration), F.lit(least)))
        t = timeline(df.where(F.col(duration) > 0), by, order, duration)
        out.append(t.select(*by, "start", "end", picture))
    ta, tb = out
    cuts = ta.select(*by, "start").unionByName(tb.select(*by, "start")).distinct()
    tagged = cuts.withColumns({"__k": F.lit(2), "p0": F.lit(None).cast("string"), "p1": F.lit(None).cast("string"), "end": F.lit(0).cast("bigint")})
    for k, t in enumerate((ta, tb)):
        row = t.select(*by, "start", F.lit(k).alias("__k"), *[(F.col(picture).cast("string") if j == k else F.lit(None).cast("string")).alias(f"p{j}") for j in (0, 1)], "end")
        tagged = tagged.unionByName(row)
    w = Window.partitionBy(*by).orderBy("start", "__k").rowsBetween(Window.unboundedPreceding, 0)
    seen = tagged.withColumns({"q0": F.last("p0", True).over(w), "q1": F.last("p1", True).over(w)}).where("__k = 2")
    looks = seen.groupBy(*by).agg(F.min(F.col("q0").eqNullSafe(F.col("q1")).cast("int")).alias("same"))
    ends = ta.groupBy(*by).agg(F.max("end").alias("e0")).join(tb.groupBy(*by).agg(F.max("end").alias("e1")), by, "full")
    return looks.join(ends, by).select(*by, ((F.col("same") == 1) & F.col("e0").eqNullSafe(F.col("e1"))).alias("same"))


# Sequence rules.


def out_of_turn(df: DataFrame, by: list[str], order: list[str], number: Column, cycle: int) -> DataFrame:
    """Rows whose number is not their place in the sequence, modulo cycle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("expected", (F.row_number().over(w) - 1) % cycle).where(F.col("expected") != number)


def too_late(df: DataFrame, by: list[str], order: list[str], late: Column, after: Column) -> DataFrame:
    """Rows of a kind that must not follow another kind."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__seen", F.max(after.cast("int")).over(w)).where(late & (F.col("__seen") == 1)).drop("__seen")


def falling(df: DataFrame, by: list[str], order: list[str], rank: Column) -> DataFrame:
    """Rows with a rank below that of the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", rank).withColumn("__p", F.lag("__r").over(w)).where("__r < __p").drop("__r", "__p")


def progression(scans: DataFrame, by: list[str], order: list[str], ah: str, al: str) -> DataFrame:
    """Scans that refine what was not sent: the high bit must be the low bit of the scan before, and 0 in the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scans.withColumn("before", F.lag(al).over(w)).where(F.col(ah) != F.coalesce("before", F.lit(0)))


def running_offsets(df: DataFrame, by: list[str], order: list[str], size: Column, gap: Column | int = 0) -> DataFrame:
    """df with start: sum of the sizes and gaps before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    one = size + gap if not isinstance(gap, int) else size + F.lit(gap)
    return df.withColumn("start", F.coalesce(F.sum(one.cast("bigint")).over(w), F.lit(0)))


def gaps(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    return df.withColumn("gap", F.lead(lo).over(Window.partitionBy(*by).orderBy(lo)) - F.col(hi))


# Differences of samples.


def mean_difference(a: Column, b: Column, flat: float = 1.0) -> Column:
    """Mean difference of two sample arrays relative to the range of a; NaN in both is equal, in one the full range.

    The range is that of the samples of a which both have; of a flat image it is `flat`, 255 for bytes. A mean that is not finite is infinite.
    """
    both = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    one = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.isnan(p["x"]) != F.isnan(p["y"])))
    xs = F.transform(both, lambda p: p["x"])
    span = F.coalesce(F.array_max(xs) - F.array_min(xs), F.lit(0.0))
    total = F.aggregate(both, F.lit(0.0), lambda s, p: s + F.abs(p["x"] - p["y"]))
    mean = (total / F.when(span > 0, span).otherwise(F.lit(flat)) + one) / F.size(a)
    return F.when(F.isnan(mean) | (F.abs(mean) == float("inf")), F.lit(float("inf"))).otherwise(mean)


def block_difference(samples: DataFrame, by: list[str], x: str, y: str, a: str, b: str, width: int = 8) -> DataFrame:
    """(by…, mean, block, largest) of rows (by…, x, y, a, b), one per sample of a channel: the mean absolute difference, that of the worst block of width x width pixels, and the largest one.

    Two aggregates, by block and then by image, both with partial sums.
    """
    d = samples.withColumn("__d", F.abs(F.col(a) - F.col(b)))
    blocks = d.groupBy(*by, F.floor(F.col(x) / width).alias("__bx"), F.floor(F.col(y) / width).alias("__by")).agg(F.sum("__d").alias("__s"), F.count("*").alias("__n"), F.max("__d").alias("__m"))
    return blocks.groupBy(*by).agg((F.sum("__s") / F.sum("__n")).alias("mean"), F.max(F.col("__s") / F.col("__n")).alias("block"), F.max("__m").alias("largest"))


def placed_items(items: DataFrame, by: list[str], order: str, length: str, padding: str, total: Column, from_photo: Column) -> DataFrame:
    """items with start and end, those after the first of a container: laid one after the other right after the photo, or counted from the end of the `total` bytes after it.

    Padding lies behind an item. Items of a container that does not fit have none.
    """
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    back = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    one = F.col(length) + F.col(padding)
    forward = F.sum(F.when(F.col("__first"), F.col(padding)).otherwise(one)).over(ahead)
    got = items.withColumn("__first", first).withColumn("__total", total)
    got = got.withColumn("start", F.when(from_photo, forward).otherwise(F.col("__total") - F.sum(F.when(~F.col("__first"), one)).over(back)))
    got = got.withColumn("end", F.col("start") + F.col(length))
    wrong = (F.col(length) > F.col("__total")) | (F.col(padding) > F.col("__total")) | (~F.col("__first") & ((F.col("start") < 0) | (F.col("end") > F.col("__total"))))
    got = got.withColumn("__fits", F.max(wrong.cast("int")).over(Window.partitionBy(*by)) == 0)
    return got.where("__fits AND NOT __first").drop("__first", "__total", "__fits")


def rendering_differs(pixels: Column, differing: Column, strong: Column, strict: bool) -> Column:
    """Whether two renderings differ: too many pixels, or too many strongly."""
    return (differing > F.floor(pixels / (1000 if strict else 100))) | (strong > (10 if strict else 100))


#: Mean, block and largest difference that a decoder may have, for own conversions and foreign files.
TOLERANCE = {"converted": (1.5, 4.0, 40), "foreign": (3.0, 12.0, 64)}
