"""Counts, rates and other roll-ups of runs, nodes and sessions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.statistics import success_rate
from tallyloom.operators.reads import ACTIVE, TERMINAL


def run_counts(runs: DataFrame, workflow_id=None) -> DataFrame:
    if workflow_id is not None:
        runs = runs.filter(F.col("workflow_id") == workflow_id)
    return runs.groupBy("workflow_id", "status").agg(F.count("*").alias("n_runs"))


def run_stats(runs: DataFrame, workflow_id=None) -> DataFrame:
    """Counts by workflow and state, by workflow, by state and of all, in one pass; level tells which: 0, 1, 2, 3. Of one workflow, by state and of all only."""
    if workflow_id is not None:
        mine = runs.filter(F.col("workflow_id") == workflow_id)
        return mine.rollup("status").agg(F.count("*").alias("n_runs"), (F.grouping_id() + 2).cast("long").alias("level")).select(F.lit(None).cast(runs.schema["workflow_id"].dataType).alias("workflow_id"), "status", "n_runs", "level")
    return runs.cube("workflow_id", "status").agg(F.count("*").alias("n_runs"), F.grouping_id().cast("long").alias("level"))


def success_rates(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, active runs, and succeeded among terminal runs (null without any) by key."""
    s = F.col("status")
    return runs.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(s.isin(*ACTIVE)).alias("active"), success_rate(s == "succeeded", s.isin(*TERMINAL)).alias("rate"))


def child_pick(rows: DataFrame, slot: list[str], extra: str) -> DataFrame:
    return rows.groupBy(*slot).agg(F.min(extra).alias("picked"))


def byte_sums(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).cast("long").alias("bytes"))


def run_progress(nodes: DataFrame, ends: tuple = ()) -> DataFrame:
    """Settled among all nodes of a run, those in ``ends`` (its first and last) not counted."""
    own = nodes.filter(~F.col("node_id").isin(*ends)) if ends else nodes
    return own.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("succeeded", "failed", "skipped")).alias("done"))


def run_elapsed(times: DataFrame, keys: list[str], started: str, ended: str, now=None) -> DataFrame:
    """Microseconds from the first start to the last end, or to ``now`` while an end is missing; 0 at least, null without a start."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    end = micros(F.max(ended))
    if now is not None:
        end = F.when(F.bool_or(F.col(ended).isNull()), micros(now)).otherwise(end)
    return times.groupBy(*keys).agg(F.greatest(F.lit(0).cast("long"), end - micros(F.min(started))).alias("elapsed_us"))


def merge_losses(counters: DataFrame, keys: list[str], fields: list[str], flag: str) -> DataFrame:
    """Loss counters seen by several readers: the largest of each, and whether any reader saw the flag."""
    return counters.groupBy(*keys).agg(*[F.max(c).alias(c) for c in fields], F.bool_or(flag).alias(flag))


def observation_loss(counters: DataFrame, fields: list[str], flag: str, per_dispatch: bool = False) -> DataFrame:
    """Losses by run and dispatch as its readers saw them most, or summed over the run's dispatches."""
    each = merge_losses(counters, ["run_id", "dispatch_id"], fields, flag)
    if per_dispatch:
        return each
    return each.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in fields], F.bool_or(flag).alias(flag))


def session_stats(log: DataFrame, session: str, pos: str, is_mark, is_head, size) -> DataFrame:
    """Per session what lies after its last mark: rows, groups (a head and the rows until the next), size, and the share of heads.

    The last mark is a window maximum and groups a running count of heads, so a session's
    rows are sorted once.
    """
    whole = Window.partitionBy(session)
    marked = log.withColumn("_mark", F.coalesce(F.max(F.when(is_mark, F.col(pos))).over(whole), F.lit(-1)))
    live = marked.filter(F.col(pos) > F.col("_mark"))
    island = F.sum(is_head.cast("long")).over(whole.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    live = live.withColumns({"_island": island, "_size": size})
    return live.groupBy(session).agg(
        F.count("*").alias("n_live"), F.count_distinct("_island").alias("n_groups"), F.sum("_size").cast("long").alias("live_bytes"),
        F.try_divide(F.count_if(is_head).cast("double"), F.count("*")).alias("head_rate"), F.max("_mark").cast("long").alias("last_mark"),
    )


def cache_stats(log: DataFrame, session: str, pos: str) -> DataFrame:
    """Token sums of a session's assistant rows after its last 'cleared' row, and cache reads among input, null without input."""
    cleared = F.coalesce(F.max(F.when(F.col("kind") == "cleared", F.col(pos))).over(Window.partitionBy(session)), F.lit(-1))
    used = log.withColumn("_from", cleared).filter((F.col(pos) > F.col("_from")) & (F.col("kind") == "assistant") & F.col("input_tokens").isNotNull())
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return used.groupBy(session).agg(
        zero("input_tokens").alias("input_tokens"), zero("cache_read_tokens").alias("cache_read_tokens"), zero("cache_write_tokens").alias("cache_write_tokens"), F.count("*").alias("calls"),
        F.count_if(F.col("cache_read_tokens").isNotNull() | F.col("cache_write_tokens").isNotNull()).alias("cache_reporting_calls"), F.try_divide(zero("cache_read_tokens").cast("double"), zero("input_tokens")).alias("hit_rate"),
    )
