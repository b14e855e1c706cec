"""Joins that put runs, nodes, attempts and definitions together."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyloom.operators.hierarchy import closure
from tallyloom.sources.kept import keep


def attempts_numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def current_attempts(attempts: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts that are their node's current one."""
    return attempts.join(nodes, keys, "left_semi")


def timeline(definition: DataFrame, run_nodes: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Every node of a definition in its order, with what a run has of it and of its child run, if anything."""
    out = definition.join(run_nodes, "node_id", "left")
    if children is not None:
        out = out.join(children, "node_id", "left")
    return out.orderBy("ordinal")


def assemble_runs(runs: DataFrame, nodes: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Runs with a map of their nodes' states; with ``attempts`` (run_id, node_id, attempt, status) of structs, each node's attempts in order within.

    A run without nodes has an empty map. A run's nodes are its definition's and a node has a
    hundred attempts at most, so a map is bounded.
    """
    keys, what = ["run_id", "node_id"], F.col("status")
    if attempts is not None:
        listed = attempts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", "status"))), lambda x: x["status"]).alias("attempts"))
        nodes = nodes.join(listed, keys, "left")
        what = F.struct("status", F.coalesce("attempts", F.array().cast("array<string>")).alias("attempts"))
    per_run = nodes.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("node_id", what.alias("state"))))).alias("nodes"))
    out = runs.join(per_run, "run_id", "left")
    kind = out.schema["nodes"].dataType
    empty = F.map_from_arrays(F.array().cast(T.ArrayType(kind.keyType)), F.array().cast(T.ArrayType(kind.valueType)))
    return out.withColumn("nodes", F.coalesce("nodes", empty))


def assemble_workflows(workflows: DataFrame, versions: DataFrame) -> DataFrame:
    """Workflows with a map of their versions' bodies by number, the last version, and the largest published one (null without any)."""
    per = versions.groupBy("workflow_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("version", "body")))).alias("versions"), F.max("version").alias("latest"), F.max(F.when(F.col("published"), F.col("version"))).alias("published_version"),
    )
    return workflows.join(per, "workflow_id", "left")


def cancel_cascade(cancelled: DataFrame, runs: DataFrame, most_deep: int = 16) -> DataFrame:
    """(root, run_id, depth): the open runs below each cancelled one (run_id), child by child, which are cancelled with it."""
    edges = runs.filter(~F.col("status").isin("succeeded", "failed", "cancelled")).select(F.col("parent_id").alias("parent"), F.col("run_id").alias("child")).filter("parent is not null")
    below = closure(edges, cancelled.select(F.col("run_id").alias("root")), most_deep)
    return below.filter("depth > 0").select("root", F.col("node").alias("run_id"), "depth")


def approval_status(approvals: DataFrame, runs: DataFrame) -> DataFrame:
    """Approvals with their state as it is shown: a pending one of a run that has ended is cancelled."""
    ended = runs.filter(F.col("status").isin("succeeded", "failed", "cancelled")).select("run_id", F.lit(True).alias("_ended"))
    state = F.when((F.col("state") == "pending") & F.col("_ended"), "cancelled").otherwise(F.col("state"))
    return approvals.join(ended, "run_id", "left").withColumn("shown", state).drop("_ended")


def signals_to_waits(signals: DataFrame, waits: DataFrame) -> DataFrame:
    """The first signal to each waiting node; later ones find its slot taken."""
    first = signals.groupBy("run_id", "node_id").agg(F.min(F.struct("lsn", "payload")).alias("s"), F.count("*").alias("received"))
    return waits.join(first, ["run_id", "node_id"]).select("run_id", "node_id", "s.lsn", "s.payload", (F.col("received") > 1).alias("conflicted"))


def children_of(parents: DataFrame, runs: DataFrame) -> DataFrame:
    """Ended children of waiting parents, by the child's id."""
    return parents.join(runs.filter(F.col("status").isin("succeeded", "failed", "cancelled")), parents["child_run_id"] == runs["run_id"]).select(parents["run_id"].alias("parent_id"), "child_run_id", "status")


def exclude_and_rank(rows: DataFrame, excluded: DataFrame, key: str, order: list) -> DataFrame:
    """Rows whose key, in any case, is not excluded, ranked anew.

    The rows are dealt into ranges of the order and kept; a rank is the rows of the ranges
    before, one number a range, and the place within the own range, so no task holds all.
    """
    rest = rows.join(excluded.select(F.lower(F.col(key)).alias("_key")).distinct(), F.lower(rows[key]) == F.col("_key"), "left_anti")
    ranged = keep(rest.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = ranged.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    placed = ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range", "_before")


def fixtures_by_fingerprint(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests with the outcome recorded for their path; ``matches`` tells whether the fingerprint is the recorded one."""
    return requests.join(recorded.withColumnRenamed("fingerprint", "recorded_fingerprint"), "path", "left").withColumn("matches", F.col("fingerprint").eqNullSafe(F.col("recorded_fingerprint")))
