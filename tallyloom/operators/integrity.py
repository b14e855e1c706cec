"""Receipts, hash chains, and stored state held against replayed state."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.values import chain_digest, entity_digest


def first_receipts(commands: DataFrame, keys: list[str], order: str, fingerprint: str) -> DataFrame:
    """One row a command key: the first command's position and fingerprint, how many came, and whether any differed from the first.

    Minimums and counts only, so a key's rows meet after map-side sums.
    """
    first = F.min(F.struct(order, fingerprint)).alias("first")
    spread = (F.min(fingerprint) != F.max(fingerprint)).alias("conflict")
    return commands.groupBy(*keys).agg(first, F.count("*").alias("n_commands"), spread).select(*keys, F.col(f"first.{order}").alias("first_at"), F.col(f"first.{fingerprint}").alias("receipt"), "n_commands", "conflict")


def latest_state(facts: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The latest fact of each key, by one maximum rather than a sort."""
    return facts.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("last")).select(*keys, "last.*")


def live_state(facts: DataFrame, keys: list[str], order: str, body: str) -> DataFrame:
    """The latest body of each key; a null one deletes the key."""
    return latest_state(facts, keys, order, [body]).filter(F.col(body).isNotNull())


def immutable_conflicts(facts: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Keys, meant to be written once, of which two bodies exist."""
    return facts.groupBy(*keys).agg(F.count("*").alias("n_writes"), (F.min(body) != F.max(body)).alias("differs")).filter("differs")


def chain_links(facts: DataFrame, keys: list[str], order: str, digest: Column) -> DataFrame:
    """Each fact's digest, the one before it in its chain ('' at first), and the link of both."""
    before = F.lag("digest", 1, "").over(Window.partitionBy(*keys).orderBy(order))
    return facts.withColumn("digest", digest).withColumn("prev_digest", before).withColumn("link", chain_digest(F.col("prev_digest"), F.col("digest")))


def broken_links(chain: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Links that don't follow from the stored digests before them: each is recomputed alone."""
    before = F.lag("digest", 1, "").over(Window.partitionBy(*keys).orderBy(order))
    return chain.withColumn("_before", before).filter((F.col("prev_digest") != F.col("_before")) | (F.col("link") != chain_digest(F.col("prev_digest"), F.col("digest")))).drop("_before")


def recomputed(facts: DataFrame, digest: str, *parts: Column) -> DataFrame:
    """Facts whose stored digest isn't that of their parts: what a transaction's read verifies."""
    return facts.filter(~F.col(digest).eqNullSafe(entity_digest(*parts)))


def watermark(facts: DataFrame) -> DataFrame:
    """The largest log position, the number of facts, and whether positions run from 1 without a gap or repeat."""
    return facts.agg(F.max("lsn").alias("max_lsn"), F.count("*").alias("n"), ((F.max("lsn") == F.count("*")) & (F.count_distinct("lsn") == F.count("*"))).alias("whole"))


def projection_differences(replayed: DataFrame, stored: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Keys whose stored row is missing, unexpected, or differs from the replayed one."""
    r, s = replayed.select(*keys, F.col(body).alias("replayed"), F.lit(True).alias("_r")), stored.select(*keys, F.col(body).alias("stored"), F.lit(True).alias("_s"))
    kind = F.when(F.col("_s").isNull(), "missing").when(F.col("_r").isNull(), "unexpected").when(~F.col("replayed").eqNullSafe(F.col("stored")), "differs")
    return r.join(s, keys, "full_outer").withColumn("difference", kind).filter(F.col("difference").isNotNull()).select(*keys, "difference", "replayed", "stored")


def verify_transactions(transactions: DataFrame, events: DataFrame) -> DataFrame:
    """(lsn, problem) of transactions (lsn, n_events, digest, prev_digest, chain_digest) that don't hold with their events (lsn, event_index, digest).

    Checked are the number and numbering of events, the digest of their digests in order, the
    link to the transaction before, and the numbering of transactions from 1. Events of no
    transaction are reported too.
    """
    held = events.groupBy("lsn").agg(F.count("*").alias("n"), (F.max("event_index") + 1).alias("top"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "digest"))), lambda x: x["digest"]), ""), 256).alias("found"))
    both = transactions.withColumn("_t", F.lit(True)).join(held, "lsn", "full_outer")
    last = transactions.select((F.col("lsn") + 1).alias("lsn"), F.col("lsn").alias("_lsn"), F.col("chain_digest").alias("_last"))
    before = both.filter("_t").join(last, "lsn", "left").withColumn("_before", F.coalesce("_last", F.when(F.col("lsn") == 1, "")))
    problems = F.filter(F.array(
        F.when(F.coalesce("n", F.lit(0)) != F.col("n_events"), "event count"), F.when(F.coalesce("top", F.lit(0)) != F.coalesce("n", F.lit(0)), "event numbering"), F.when(F.col("n_events") > 0, F.when(~F.col("found").eqNullSafe(F.col("digest")), "digest")),
        F.when(~F.col("prev_digest").eqNullSafe(F.col("_before")), "previous digest"), F.when(~F.col("chain_digest").eqNullSafe(chain_digest(F.col("prev_digest"), F.col("digest"))), "chain"), F.when((F.col("lsn") > 1) & F.col("_lsn").isNull(), "numbering"),
    ), lambda x: x.isNotNull())
    out = before.select("lsn", F.explode(problems).alias("problem"))
    return out.unionByName(both.filter("_t is null").select("lsn", F.lit("events of no transaction").alias("problem")))
