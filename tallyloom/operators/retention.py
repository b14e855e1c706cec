"""Bounded logs: budgets by class, and the newest rows that fit."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def log_budget(lines: DataFrame, keys: list[str], order: str, minor: Column, minor_most: int, all_most: int) -> DataFrame:
    """The first ``minor_most`` minor lines of each key and all others, the total capped at ``all_most``."""
    ranked = lines.withColumn("_minor", minor).withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_minor").orderBy(order)))
    kept = ranked.filter(~F.col("_minor") | (F.col("_place") <= minor_most))
    return kept.withColumn("_all", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_all") <= all_most).drop("_minor", "_place", "_all")


def newest_within(rows: DataFrame, keys: list[str], order: str, size: Column, budget: int) -> DataFrame:
    """Per key the newest rows whose sizes sum to the budget at most."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_bytes", F.sum(size.cast("long")).over(w)).filter(F.col("running_bytes") <= budget)


def losses(rows: DataFrame, keys: list[str], order: str, size: Column, budget: int, longest: int) -> DataFrame:
    """Per key what a bounded log of its rows lets go: rows and bytes beyond the budget, and rows cut to ``longest`` bytes."""
    cut = F.least(size.cast("long"), F.lit(longest))
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"_cut": cut, "_long": (size > longest).cast("long"), "_upto": F.sum(cut).over(w)})
    gone = F.col("_upto") > budget
    return marked.groupBy(*keys).agg(F.count_if(gone).alias("rows_dropped"), F.coalesce(F.sum(F.when(gone, F.col("_cut"))), F.lit(0)).alias("bytes_dropped"), F.sum("_long").alias("rows_cut"))


def newest_rows(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_place") <= most).drop("_place")


def replay_state(cursor: int, oldest: int, newest: int) -> str:
    """What a subscriber at a cursor gets from a buffer: all of it after a gap, a request to start over, or what is newer."""
    if cursor == 0:
        return "gap" if oldest > 1 else "complete"
    return "resync_required" if cursor < oldest - 1 else "complete" if cursor <= newest else "ahead"


def replay(subscribers: DataFrame, window: DataFrame) -> DataFrame:
    """Subscribers (id, run_id, cursor) with what they get from their run's retained window (run_id, seq): reply and how many rows.

    From the start with rows missing it is a gap, before the window's begin a resync, else
    what is newer than the cursor.
    """
    held = window.groupBy("run_id").agg(F.min("seq").alias("oldest"), F.max("seq").alias("newest"))
    both = subscribers.join(held, "run_id", "left")
    cursor = F.col("cursor")
    reply = F.when(F.col("oldest").isNull(), "complete").when(cursor == 0, F.when(F.col("oldest") > 1, "gap").otherwise("complete")).when(cursor < F.col("oldest") - 1, "resync_required").when(cursor <= F.col("newest"), "complete").otherwise("ahead")
    sent = F.when(reply.isin("resync_required", "ahead"), 0).otherwise(F.greatest(F.lit(0), F.col("newest") - F.greatest(cursor, F.col("oldest") - 1)))
    return both.select("id", "run_id", reply.alias("reply"), F.coalesce(sent, F.lit(0)).cast("long").alias("n_rows"))


def log_level(label: Column) -> Column:
    """A log row's class by what its label says."""
    low = F.lower(label)
    return F.when(low.contains("fail") | low.contains("error"), "error").when(low.contains("warn") | low.contains("retry"), "warn").when(low.contains("debug"), "debug").otherwise("info")
