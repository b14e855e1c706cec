"""Folds and timers over streams: runs by the engine's own aggregates, late facts apart, waits by timers."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.plans.fold import fold_runs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_runs(facts: DataFrame, terminal: dict[str, str]) -> DataFrame:
    """The stream of run states: counts, maximums and the first terminal fact are sums that the state store keeps by run.

    The same plan as the batch fold, so both give the same rows. A run is reported after each
    batch that has facts of it, and its latest row has the largest n_facts.
    """
    return fold_runs(facts, "run_id", "lsn", terminal)


def split_late(facts: DataFrame, seals: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts up to their key's seal, and those after it, which are kept as evidence and fold into nothing."""
    marked = facts.join(seals, keys, "left")
    late = F.coalesce(F.col("audit_seq") > F.col("sealed_through"), F.lit(False))
    return marked.filter(~late).drop("sealed_through"), marked.filter(late).drop("sealed_through")


class DelayTimers(StatefulProcessor):
    """Waits that fire: each row (node_id, wake_ms) sets a timer, and at its time or after all nodes of that time are given back.

    A node waits once for one time; nodes of one run may share a time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getMapState("waits", "wake long, node string", "known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentProcessingTimeInMs(), []
        for part in rows:
            for wake, node in zip(part["wake_ms"], part["node_id"], strict=True):
                if wake <= now:
                    due.append((key[0], str(node), int(wake)))
                else:
                    self.waits.updateValue((int(wake), str(node)), (True,))
                    self.handle.registerTimer(int(wake))
        if due:
            yield pd.DataFrame(due, columns=["run_id", "node_id", "woke_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wake = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k[1] for k in self.waits.keys() if k[0] == wake)
        for node in due:
            self.waits.removeKey((wake, node))
        if due:
            yield pd.DataFrame([(key[0], node, wake) for node in due], columns=["run_id", "node_id", "woke_ms"])

    def close(self) -> None:
        pass


def fire_delays(waits: DataFrame) -> DataFrame:
    """The stream of waits (run_id, node_id, wake_ms) as they come due."""
    return waits.groupBy("run_id").transformWithStateInPandas(DelayTimers(), T.StructType([waits.schema["run_id"], T.StructField("node_id", T.StringType()), T.StructField("woke_ms", T.LongType())]), "Update", "ProcessingTime")


def one_fire_a_slot(fires: DataFrame, keys: list[str]) -> DataFrame:
    """The first fire of each slot, batch or stream; a stream keeps the slots it has seen."""
    return fires.dropDuplicates(keys)


def subscribe_control(facts: DataFrame, terminal: tuple[str, ...], run_id, from_seq: int = 0) -> DataFrame:
    """A run's facts after ``from_seq`` up to its first terminal fact, batch or stream; what comes after that is no control fact.

    As a stream it is a filter; run it with availableNow to end once it has drained what is there.
    """
    return facts.filter((F.col("run_id") == run_id) & (F.col("run_seq") > from_seq)).withColumn("ends", F.col("kind").isin(*terminal))


def subscribe_audit(facts: DataFrame, from_lsn: int = 0) -> DataFrame:
    """Audit facts after a log position, of all runs: a filter that never ends by itself."""
    return facts.filter((F.col("lsn") > from_lsn) & (F.col("audit_seq") > 0))


def expire_approvals(asked: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """The stream of approvals (run_id, node_id, asked_ms) as they expire: denied, and their node failed. A time to live is 1 minute to 7 days."""
    if not 60_000 <= ttl_ms <= 7 * 86_400_000:
        raise ValueError("an approval lives for 1 minute to 7 days")
    due = fire_delays(asked.withColumn("wake_ms", F.col("asked_ms") + ttl_ms).select("run_id", "node_id", "wake_ms"))
    return due.select("run_id", "node_id", F.col("woke_ms").alias("expired_ms"), F.lit("denied").alias("decision"), F.lit("failed").alias("node_status"))
