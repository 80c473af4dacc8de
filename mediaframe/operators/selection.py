"""Choosing among candidates: the smallest that passes, stage after stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import least_size


def smallest_passing(df: DataFrame, group: list[str], size: str, tie: str, passes: Column) -> DataFrame:
    """One row per group: the smallest that passes, ties by `tie`; groups without one are left out."""
    by = Window.partitionBy(*group).orderBy(size, tie)
    return df.where(passes).withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def smallest_by(df: DataFrame, group: list[str], size: str, tie: str, passes: Column, keep: list[str]) -> DataFrame:
    """The same as an aggregate with map-side combining: one struct minimum per group."""
    return df.where(passes).groupBy(*group).agg(F.min(F.struct(size, tie, *keep)).alias("m")).select(*group, "m.*")


def fold_stages(candidates: DataFrame, originals: DataFrame, key: str = "file_id", stages: int = 4) -> DataFrame:
    """(key, size, steps, is_lossy, rejected, aborted): the run of each file through its stages.

    candidates: key, stage, cand, name, size, verified, lossy, minimum_gain, required, judged_finished, promised, has_private.
    In each stage candidates come by (size, cand); one counts if it stays under the limit of the best so far, or is required
    and its input holds something to remove, or is judged when all is finished; the first of these that is verified is
    the new best, those before it are rejected. A promised candidate that is rejected, and a required one that fails to
    run (null size), abort the file. What a trial (judged_finished) started counts only if the end is under the limit
    recorded before it. A fold over at most `stages` stages, in one aggregate per file; candidates of a file are few.
    """
    c = F.struct("stage", "size", "cand", "name", "verified", "lossy", "minimum_gain", "required", "judged_finished", "promised", "has_private")
    rows = candidates.groupBy(key).agg(F.sort_array(F.collect_list(c)).alias("cs"))
    state = originals.select(key, F.col("size").cast("bigint").alias("original")).join(rows, key, "left")
    empty = "CAST(array() AS ARRAY<STRING>)"
    start = f"struct(original AS best, original AS input, {empty} AS steps, false AS lossy, {empty} AS rejected, false AS aborted, -1 AS done, -1 AS stage, CAST(NULL AS BIGINT) AS bar, original AS saved, {empty} AS saved_steps, false AS saved_lossy)"
    enters = "(c.size < CAST(a.best * (1 - c.minimum_gain) AS BIGINT) OR (c.required AND c.has_private) OR c.judged_finished)"
    step = f"""
      IF(a.aborted OR a.done = c.stage, a,
       IF(c.size IS NULL, IF(c.required, named_struct('best', a.best, 'input', a.input, 'steps', a.steps, 'lossy', a.lossy, 'rejected', concat(a.rejected, array(c.name)), 'aborted', true, 'done', a.done, 'stage', c.stage, 'bar', a.bar, 'saved', a.saved, 'saved_steps', a.saved_steps, 'saved_lossy', a.saved_lossy), a),
       IF(NOT {enters}, a,
        IF(c.verified,
          named_struct('best', c.size, 'input', a.best, 'steps', concat(a.steps, array(c.name)), 'lossy', a.lossy OR c.lossy, 'rejected', a.rejected, 'aborted', false, 'done', c.stage, 'stage', c.stage,
            'bar', IF(c.judged_finished AND a.bar IS NULL, CAST(a.best * (1 - c.minimum_gain) AS BIGINT), a.bar),
            'saved', IF(c.judged_finished AND a.bar IS NULL, a.best, a.saved), 'saved_steps', IF(c.judged_finished AND a.bar IS NULL, a.steps, a.saved_steps), 'saved_lossy', IF(c.judged_finished AND a.bar IS NULL, a.lossy, a.saved_lossy)),
          named_struct('best', a.best, 'input', a.input, 'steps', a.steps, 'lossy', a.lossy, 'rejected', concat(a.rejected, array(c.name)), 'aborted', c.promised, 'done', a.done, 'stage', c.stage, 'bar', a.bar, 'saved', a.saved, 'saved_steps', a.saved_steps, 'saved_lossy', a.saved_lossy)))))"""
    end = f"""IF(a.aborted, struct(original AS size, {empty} AS steps, false AS is_lossy, a.rejected AS rejected, true AS aborted),
      IF(a.bar IS NOT NULL AND a.best >= a.bar, struct(a.saved AS size, a.saved_steps AS steps, a.saved_lossy AS is_lossy, a.rejected AS rejected, false AS aborted),
        struct(a.best AS size, a.steps AS steps, a.lossy AS is_lossy, a.rejected AS rejected, false AS aborted)))"""
    cs = "coalesce(cs, CAST(array() AS ARRAY<STRUCT<stage: INT, size: BIGINT, cand: INT, name: STRING, verified: BOOLEAN, lossy: BOOLEAN, minimum_gain: DOUBLE, required: BOOLEAN, judged_finished: BOOLEAN, promised: BOOLEAN, has_private: BOOLEAN>>))"
    return state.select(key, "original", F.expr(f"aggregate({cs}, {start}, (a, c) -> {step}, a -> {end})").alias("r")).select(key, "original", "r.*")


def under_limit(size: Column, best: Column, gain: Column) -> Column:
    return size < least_size(best, gain)
