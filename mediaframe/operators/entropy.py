"""Entropy coding of JPEG coefficients as relational operators: symbols of DC and AC coefficients, their counts, merged table segments.

Coefficients come as rows, or as an array per block in zigzag order. Nothing here writes a bit stream; the counts of
symbols are what code lengths and costs are computed from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bit_length

# Fixed values of the JPEG standard: the longest run of empty blocks that one symbol counts, and the symbol of 16 zeros.
LONGEST_RUN, ZEROS = 0x7FFF, 0xF0


def dc_differences(blocks: DataFrame, by: list[str], order: list[str], dc: str) -> DataFrame:
    """blocks with difference to the block before of the same component (0 before the first) and its symbol, the number of its bits."""
    w = Window.partitionBy(*by).orderBy(*order)
    diff = F.col(dc) - F.coalesce(F.lag(dc).over(w), F.lit(0))
    return blocks.withColumn("difference", diff).withColumn("symbol", bit_length(F.col("difference")))


def _pieces(block: Column, start: int, end: int) -> Column:
    """Of a block's band: (place, value) of what is not zero."""
    band = F.slice(block, start + 1, end - start + 1)
    return F.filter(F.transform(band, lambda v, i: F.struct((i + start).alias("k"), v.alias("v"))), lambda p: p["v"] != 0)


def ac_symbols(blocks: DataFrame, by: list[str], order: list[str], block: str, start: int = 1, end: int = 63) -> DataFrame:
    """(by…, symbol, n): how often each symbol of a first AC pass of the band [start, end] occurs.

    A value gives a symbol of the zeros before it and its bits, after one of 16 zeros for each 16. A block without values up to
    the band's end joins the run of empty ends that the last block with values has begun; a run gives a symbol for each
    LONGEST_RUN blocks and one for the rest. Runs are islands of blocks, found by running counts; all is counted in two steps.
    """
    own = blocks.select(*by, *order, _pieces(F.col(block), start, end).alias("p"))
    before = lambda i: F.when(i == 0, F.lit(start - 1)).otherwise(F.element_at("p", F.greatest(i, F.lit(1)))["k"])
    zeros = F.transform("p", lambda x, i: F.struct((x["k"] - before(i) - 1).alias("z"), bit_length(x["v"]).alias("b")))
    one = own.withColumn("r", zeros).select(*by, F.explode("r").alias("r"))
    values = one.select(*by, ((F.col("r.z") % 16) * 16 + F.col("r.b")).cast("int").alias("symbol"), F.lit(1).cast("bigint").alias("n"))
    long = one.where("r.z >= 16").select(*by, F.lit(ZEROS).alias("symbol"), F.floor(F.col("r.z") / 16).cast("bigint").alias("n"))
    some = F.size("p") > 0
    ends = F.when(some & (F.element_at("p", -1)["k"] == end), 0).otherwise(1)
    island = F.sum(some.cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = own.select(*by, island.alias("i"), ends.alias("e")).groupBy(*by, "i").agg(F.sum("e").alias("run"))
    run_symbol = lambda n: (bit_length(n) - 1) * 16
    full = runs.where(f"run >= {LONGEST_RUN}").select(*by, F.lit((LONGEST_RUN.bit_length() - 1) * 16).alias("symbol"), F.floor(F.col("run") / LONGEST_RUN).cast("bigint").alias("n"))
    rest = runs.withColumn("run", F.col("run") % LONGEST_RUN).where("run > 0").select(*by, run_symbol(F.col("run")).cast("int").alias("symbol"), F.lit(1).cast("bigint").alias("n"))
    return values.unionByName(long).unionByName(full).unionByName(rest).groupBy(*by, "symbol").agg(F.sum("n").alias("n"))


def merged_segments(segments: DataFrame, by: list[str], order: str, kind: str, size: str, limit: int = 65535) -> DataFrame:
    """(by…, order, group): neighbours of the same kind share a group as long as their payloads and one length field fit the limit together; those of a null kind stay alone.

    Greedy from the first on, by one pass over the sorted array of a file's segments.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k"), F.col(size).cast("bigint").alias("s"))))
    start = F.struct(F.lit(0).alias("g"), F.lit(None).cast("string").alias("k"), F.lit(0).cast("bigint").alias("s"), F.array().cast("array<int>").alias("all"))

    def step(a: Column, x: Column) -> Column:
        same = F.coalesce(a["k"] == x["k"], F.lit(False)) & (a["s"] + x["s"] + 2 <= limit)
        g = F.when(same, a["g"]).otherwise(a["g"] + 1)
        return F.struct(g.alias("g"), x["k"].cast("string").alias("k"), F.when(same, a["s"] + x["s"]).otherwise(x["s"]).alias("s"), F.concat(a["all"], F.array(g)).alias("all"))

    got = segments.groupBy(*by).agg(parts.alias("p")).withColumn("g", F.aggregate("p", start, step)["all"])
    return got.select(*by, F.explode(F.arrays_zip(F.col("p"), F.col("g"))).alias("x")).select(*by, F.col("x.p.o").alias(order), F.col("x.g").alias("group"))
