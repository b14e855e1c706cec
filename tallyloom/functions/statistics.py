"""Percentiles that pick a sample, and ratios."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank(value: str, percent: int) -> Column:
    """The sample at place ceil(percent / 100 * n), from 1; for 50 this is also index (n - 1) div 2."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})")


def floor_index(df: DataFrame, keys: list[str], value: str, percent: int, name: str) -> DataFrame:
    """For each group the sample at index min(floor(n * percent / 100), n - 1), from 0.

    Samples are counted by value first, so a group's window has one row a value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_n").over(group.orderBy(value))).withColumn("_all", F.sum("_n").over(group))
    at = F.least(F.floor(F.col("_all") * percent / 100), F.col("_all") - 1)
    return counts.filter(F.col("_upto") > at).groupBy(*keys).agg(F.min(value).alias(name))


def latency_summary(value: str) -> list[Column]:
    """n, min, p50, p90, p95, p99, max and mean of a sample, percentiles by nearest rank."""
    v = F.col(value)
    return [F.count(v).alias("n"), F.min(v).alias("min_value"), *[nearest_rank(value, p).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max(v).alias("max_value"), F.avg(v).alias("mean_value")]


def success_rate(succeeded: Column, terminal: Column) -> Column:
    """Succeeded among terminal rows, null where none is."""
    return F.try_divide(F.count_if(succeeded).cast("double"), F.count_if(terminal).cast("double"))
