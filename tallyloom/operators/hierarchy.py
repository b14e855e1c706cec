"""Closures over parents and dependencies, level by level."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.kept import forget, keep


def closure(edges: DataFrame, roots: DataFrame, most_deep: int = 16, most_nodes: int | None = None) -> DataFrame:
    """(root, node, depth): all nodes reachable from each root, at the fewest steps; roots at 0.

    ``edges`` has parent and child, ``roots`` root. A level is one join with the level before
    and one anti-join with all found, both kept tables, so the plan of a level doesn't hold
    those before it; it ends when a level is empty. Nodes further down than ``most_deep``
    steps, or more than ``most_nodes`` below one root, raise a ValueError: none are left out
    in silence.
    """
    level = keep(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "level")
    levels = [level]
    for depth in range(1, most_deep + 2):
        found = levels[0]
        for kept in levels[1:]:
            found = found.unionByName(kept)
        below = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        level = keep(below.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            forget(level)
            break
        if depth > most_deep:
            raise ValueError(f"nodes are more than {most_deep} steps below a root")
        levels.append(level)
    found = levels[0]
    for kept in levels[1:]:
        found = found.unionByName(kept)
    if most_nodes is not None and not found.groupBy("root").count().filter(F.col("count") > most_nodes + 1).isEmpty():
        raise ValueError(f"a root has more than {most_nodes} nodes below it")
    return found


def latest_published(versions: DataFrame) -> DataFrame:
    """Of each workflow the largest version that is published: workflow_id, version, and the other columns of that row."""
    others = [c for c in versions.columns if c not in ("workflow_id", "version", "published")]
    best = F.max_by(F.struct("version", *others), "version").alias("best")
    return versions.filter("published").groupBy("workflow_id").agg(best).select("workflow_id", "best.*")


def freeze_dependencies(versions: DataFrame, calls: DataFrame, roots: DataFrame, most_deep: int = 16, most_nodes: int = 128) -> tuple[DataFrame, DataFrame]:
    """(root, node, version, depth) of all workflows a root calls, at their latest published versions, and (root, node) of those without one.

    ``versions`` has workflow_id, version, published; ``calls`` workflow_id, version, child:
    what each version calls. Only the version picked is followed.
    """
    picked = keep(latest_published(versions.select("workflow_id", "version", "published")), "picked")
    edges = calls.join(picked, ["workflow_id", "version"], "left_semi").select(F.col("workflow_id").alias("parent"), "child").distinct()
    found = closure(keep(edges, "calls"), roots, most_deep, most_nodes)
    both = found.join(picked, found["node"] == picked["workflow_id"], "left").select("root", "node", "version", "depth")
    return both.filter("version is not null"), both.filter("version is null").select("root", "node")
