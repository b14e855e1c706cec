"""Differences of runs and of definitions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.kept import forget, keep


def compare_rows(baseline: DataFrame, candidate: DataFrame, key: str | list[str], fields: list[str]) -> DataFrame:
    """One row a key: added, removed, changed (and in which fields, in order) or same."""
    keys = [key] if isinstance(key, str) else key
    b, c = (x.select(*keys, *[F.col(f).alias(f"{side}_{f}") for f in fields], F.lit(True).alias(f"_{side}")) for x, side in ((baseline, "b"), (candidate, "c")))
    both = b.join(c, keys, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"c_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    verdict = F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.size("changed") > 0, "changed").otherwise("same")
    both = both.withColumn("changed", changed).withColumn("verdict", verdict)
    return both.select(*keys, "verdict", F.when(F.col("verdict") == "changed", F.array_join("changed", ",")).otherwise("").alias("changed"))


def runs_pass(differences: DataFrame, keys: list[str]) -> DataFrame:
    """Per compared pair of runs the number of nodes that differ, and whether none does."""
    different = F.count_if(F.col("verdict") != "same")
    return differences.groupBy(*keys).agg(different.alias("n_different"), (different == 0).alias("passed"))


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges (from, to, port) that only one of two definitions has."""
    same = [before[c].eqNullSafe(after[c]) for c in ("from", "to", "port")]
    gone = before.join(after, same, "left_anti").withColumn("verdict", F.lit("removed"))
    return gone.unionByName(after.join(before, same, "left_anti").withColumn("verdict", F.lit("added")))


def comparable_value(inline: str, ref_digest: str):
    """A value's digest: that of its reference, else the SHA-256 of what is inline."""
    return F.coalesce(F.col(ref_digest), F.sha2(F.col(inline), 256))


def run_pairs(baseline: DataFrame, candidate: DataFrame, pairs: DataFrame, most_deep: int = 16) -> DataFrame:
    """pair_id, path, depth, b_run, c_run: each pair of runs to compare and, pair by pair, the runs that the same node of both began.

    ``baseline`` and ``candidate`` are runs (run_id, parent_id, parent_node), ``pairs`` has
    pair_id, b_run, c_run. A child that one side only has is paired with null. A level is one
    full outer join of both sides' children, kept as a table.
    """
    level = keep(pairs.select("pair_id", F.lit("").alias("path"), F.lit(0).alias("depth"), "b_run", "c_run"), "pairs")
    found, keys = [level], ["pair_id", "path", "node"]
    for depth in range(1, most_deep + 2):
        children = []
        for runs, side in ((baseline, "b_run"), (candidate, "c_run")):
            below = runs.select(F.col("parent_id").alias("_parent"), F.col("parent_node").alias("node"), F.col("run_id").alias("_child"))
            children.append(level.join(below, F.col(side) == F.col("_parent")).select(*keys, F.col("_child").alias(side)))
        path = F.concat("path", F.lit("/"), F.col("node").cast("string"))
        level = keep(children[0].join(children[1], keys, "full_outer").select("pair_id", path.alias("path"), F.lit(depth).alias("depth"), "b_run", "c_run"), "pairs")
        if level.isEmpty():
            forget(level)
            break
        if depth > most_deep:
            raise ValueError(f"runs nest more than {most_deep} deep")
        found.append(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def compare_run_trees(pairs: DataFrame, baseline: DataFrame, candidate: DataFrame, node: str, fields: list[str]) -> DataFrame:
    """pair_id, path, node, verdict, changed: the nodes (run_id, node, fields) of each pair of runs, as ``compare_rows`` tells them apart."""
    side = lambda nodes, run: pairs.select("pair_id", "path", F.col(run).alias("run_id")).join(nodes, "run_id").select("pair_id", "path", node, *fields)
    return compare_rows(side(baseline, "b_run"), side(candidate, "c_run"), ["pair_id", "path", node], fields)


def collect_fixtures(runs: DataFrame, outcomes: DataFrame, roots: DataFrame, overrides: DataFrame | None = None, most_deep: int = 16, most_runs: int = 1000) -> DataFrame:
    """root, path, fingerprint, outcome: what the nodes of each root run and of the runs below it came to; an override of a path wins.

    ``runs`` has run_id, parent_id, parent_node; ``outcomes`` run_id, node_id, fingerprint,
    outcome. More than ``most_runs`` runs below one root raise a ValueError.
    """
    none = runs.limit(0)
    tree = run_pairs(runs, none, roots.select(F.col("root").alias("pair_id"), F.col("root").alias("b_run"), F.lit(None).cast(runs.schema["run_id"].dataType).alias("c_run")), most_deep)
    if not tree.groupBy("pair_id").count().filter(F.col("count") > most_runs + 1).isEmpty():
        raise ValueError(f"a run has more than {most_runs} below it")
    out = tree.select(F.col("pair_id").alias("root"), F.col("b_run").alias("run_id"), F.col("path").alias("above")).join(outcomes, "run_id")
    out = out.select("root", F.concat("above", F.lit("/"), F.col("node_id").cast("string")).alias("path"), "fingerprint", "outcome")
    if overrides is None:
        return out
    mine = overrides.select("root", "path", F.struct("fingerprint", "outcome").alias("_o"))
    won = lambda c: F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(F.col(c)).alias(c)
    return out.join(mine, ["root", "path"], "left").select("root", "path", won("fingerprint"), won("outcome"))
