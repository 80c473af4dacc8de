"""Where results go: names by suffix or folder, and names that two files would share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parent


def destination(path: Column, root: Column, mode: str, suffix: str = "-small", folder: str | None = None) -> Column:
    """Target path: the file itself, its name with the suffix, or below folder the root's own name and the place below root, so that files of two roots do not collide. A target that is the file's own path replaces it."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    if mode == "replace":
        return path
    if mode == "suffix":
        return F.concat(F.regexp_replace(path, r"(\.[^./]*)?$", ""), F.lit(suffix), F.regexp_extract(name, r"(\.[^.]*)$", 1))
    below = F.when(root.isNotNull() & F.startswith(path, F.concat(root, F.lit("/"))), F.concat(F.regexp_extract(root, r"([^/]*)$", 1), F.lit("/"), F.substring(path, F.length(root) + 2, F.lit(2**31 - 1)))).otherwise(name)
    return F.concat(F.lit(folder.rstrip("/") + "/"), below)


def converted(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(f".{extension}"))


def is_own_output(path: Column, suffix: str = "-small", folder: str | None = None) -> Column:
    """Backups, results with the suffix, and what lies in the output folder."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", "")
    own = stem.rlike(r" \(original(?: \d+)?\)$") | F.endswith(stem, F.lit(suffix))
    return own | F.startswith(path, F.lit(folder.rstrip("/") + "/")) if folder else own


def numbered(name: Column, n: Column) -> Column:
    """The name itself for 1, and `name n.ext` after it."""
    stem, ext = F.regexp_replace(name, r"\.[^./]*$", ""), F.regexp_extract(name, r"(\.[^./]*)$", 1)
    return F.when(n == 1, name).otherwise(F.concat(stem, F.lit(" "), n.cast("string"), ext))


def claim(df: DataFrame, target: str, order: str, out: str = "claimed") -> DataFrame:
    """df with a name for each row that no other row has, whatever the case: the first in `order` keeps its target, others get `name 2`, `name 3`.

    A generated name that is some row's own target is skipped: the m-th copy gets the m-th free number from 2 on. It is m + 1
    and one more for each taken number that has fewer than m free ones before it, by windows by name. Null targets stay null.
    """
    family = lambda t: F.lower(numbered(t, F.lit(2)))  # noqa: E731  # generated names are the same only within one
    keep = df.withColumn("__n", F.row_number().over(Window.partitionBy(F.lower(target)).orderBy(order))).withColumn("__f", family(F.col(target)))
    own = keep.withColumn("__m", F.row_number().over(Window.partitionBy("__f", F.col("__n") > 1).orderBy(F.lower(target), "__n")).cast("long"))
    # names of rows that look like generated ones: their family and number; a number with zeros before it is never generated
    looks = r"(?s)^(.*) ([1-9][0-9]{0,17})((?:\.[^./]*)?)\z"
    part = lambda k: F.regexp_extract(F.lower(target), looks, k)
    taken = df.where(F.lower(target).rlike(looks)).select(F.concat(part(1), F.lit(" 2"), part(3)).alias("__f"), part(2).cast("long").alias("__t")).where("__t > 1").distinct()
    free = F.col("__t") - 1 - F.row_number().over(Window.partitionBy("__f").orderBy("__t"))
    # in the order of __k a taken number stands before the copies that it moves on
    both = own.withColumn("__k", F.when(F.col("__n") > 1, 2 * F.col("__m")).otherwise(0)).unionByName(taken.select("__f", (2 * free + 1).alias("__k"), F.lit(True).alias("__taken")), allowMissingColumns=True)
    before = F.count("__taken").over(Window.partitionBy("__f").orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.when(F.col("__n") == 1, 1).otherwise(F.col("__m") + 1 + before)
    return both.withColumn("__b", number).where("__taken IS NULL").withColumn(out, numbered(F.col(target), F.col("__b"))).select(*[c for c in df.columns if c != out], out)


def keep_first(df: DataFrame, by: list[Column], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each kind."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def once(df: DataFrame, path: str, order: str) -> DataFrame:
    """Inputs given twice count once: by path in lower case, the first in order."""
    return keep_first(df, [F.lower(path)], [F.col(order)], 1)


def folder_needed(target: Column) -> Column:
    return parent(target)
