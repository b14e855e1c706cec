"""Mixing sources to target weights by hash thresholds over histograms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import WORD, forget, keep, text_or_empty

#: Bits of the sampling hash, and bits that each histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Documents above the threshold that at most go into the gap it leaves.
CLOSING = 3


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point from 0, nulls last: ranges first, then places within a range."""
    first = F.col("source").isNull().cast("int"), F.col("source")
    ranged = keep(sources.repartitionByRange(8, *first).withColumn("part", F.spark_partition_id()), "sources")
    before, seen = {}, 0
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("part").count().collect()):  # one row a range
        before[part], seen = seen, seen + n
    local = F.row_number().over(Window.partitionBy("part").orderBy(*first)) - 1
    offset = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("part")) if before else F.lit(0)
    return ranged.withColumn("rank", local + offset).drop("part")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of (source, source_size): ``budget`` times all sizes, dealt by weight, at most ``most`` times a source's size.

    Weights go round by rank. What a source can't take is dealt again to the others by weight
    until none is above its limit; each round is one aggregate of two sums.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = keep(_ranked(sources).withColumn("weight", w), "weights")
    limit = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, None
    while True:  # a source once at its limit stays there, so the level only rises
        full = limit <= F.col("weight") * F.lit(level)
        n, taken, open_weight = ranked.agg(F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight or n == fixed:
            break
        level, fixed = max(level, (budget * total - (taken or 0.0)) / open_weight), n
    return ranked.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def _thresholds(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """For each source the hash below which sizes sum to ``rest`` at most, and what is then missing.

    Each level sums sizes in 4,096 hash buckets of the range still open, finds the bucket in
    which the sum passes ``rest``, and goes on within that bucket alone.
    """
    same = F.col("source").eqNullSafe(F.col("s"))
    open_ = rest.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("low"))
    for level in range(HASH_BITS // LEVEL_BITS):
        width = HASH_BITS - LEVEL_BITS * (level + 1)
        held = rows.join(open_, same).filter((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < F.lit(1 << (width + LEVEL_BITS))))
        sums = held.groupBy("source", F.shiftright("h", width).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        fits = F.col("upto") <= F.col("rest")  # all buckets that fit wholly are taken; the next one is the boundary
        before, open_ = open_, keep(
            sums.withColumn("upto", upto).join(open_, same).groupBy("s", "rest")
            .agg(F.max(F.when(fits, F.col("upto"))).alias("fit"), F.min(F.when(~fits, F.col("bucket"))).alias("edge"))
            .select("s", (F.col("rest") - F.coalesce("fit", F.lit(0))).alias("rest"), F.coalesce(F.shiftleft(F.col("edge"), width), F.lit(1 << HASH_BITS)).alias("low")),
            "open",
        )
        if level:
            forget(before)
    return open_.select(F.col("s").alias("source"), F.col("low").alias("threshold"), F.col("rest").alias("missing"))


def _plan(rows: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """For each source (as ``s``): source_size, target, whole rounds, hash threshold and closing hash. rows: source, size, h."""
    targets = keep(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    edges = _thresholds(rows, plan.filter("rest > 0").select("source", "rest"))
    plan = keep(plan.drop("rest").withColumnRenamed("source", "s").join(edges, F.col("s").eqNullSafe(F.col("source")), "left").drop("source"), "plan")
    plan = plan.withColumn("closing", F.array().cast("array<long>"))
    for n in range(CLOSING + 1):  # the last one may go beyond, if that is nearer
        left = F.col("missing") - F.col("size")
        fits = left >= 0 if n < CLOSING else F.abs(left) < F.col("missing")
        rest = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("h") >= F.col("threshold")) & (F.col("size") > 0) & fits & ~F.array_contains("closing", F.col("h")))
        best = rest.groupBy("source").agg(F.min(F.struct(F.abs(left).alias("off"), "h")).alias("best"))
        more = F.when(F.col("best").isNotNull(), F.array("best.h")).otherwise(F.array().cast("array<long>"))
        before, plan = plan, keep(
            plan.join(best, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
            .withColumns({"closing": F.concat("closing", more), "missing": F.coalesce("best.off", "missing")}).drop("best"),
            "plan",
        )
        if n:
            forget(before)
    return plan.drop("missing")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """row: the document as it is; source, size in words, h: its place in the sampling order."""
    text = text_or_empty(text_col)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("h"),
    )


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    more = F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)) | F.coalesce(F.array_contains("closing", F.col("h")), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 7,
) -> DataFrame:
    """How often a mix takes each document: id, source, size, source_size, target, copies, taken.

    A source whose target is t of its s words gives every document floor(t/s) times, and once
    more those whose hash lies below a threshold found by nested histograms; thereafter up to
    three documents above the threshold, each the largest that fits into what is still
    missing, and one that brings the sum nearer if it goes beyond; so no more is missing than
    half of any document left out. No row is sorted or ranked. ``size`` counts words.

    Nulls: a null text has size 0, a null source is a source of its own, a null id is hashed
    as such. Rows equal in id and text share a hash and are taken together. Documents of size
    0 are kept with nothing taken. An empty table gives an empty result. Columns other than
    the three named are ignored, whatever their names.
    """
    rows = keep(_sized(docs, id_col, text_col, source_col, seed).drop("row"), "sizes")
    placed = _with_copies(rows, _plan(rows, weights, budget, most))
    return placed.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 7,
) -> DataFrame:
    """The documents as the mix has them: each as many times as ``mix_sources`` takes it, its columns unchanged.

    Texts are not shuffled unless the table of sources is too large to broadcast.
    """
    rows = _sized(docs, id_col, text_col, source_col, seed)
    plan = _plan(keep(rows.drop("row"), "sizes"), weights, budget, most)
    placed = _with_copies(rows.drop("doc_id"), plan).filter("copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
