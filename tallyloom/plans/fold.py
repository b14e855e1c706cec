"""Folding facts into state: by minimums, running sums and windows; nodes and workflows by one pass over each one's few facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a node's facts lead to: state before (with the wait, where it waits) and fact, to state and wait after (fixed values).
RESULT = {"completed": ("succeeded", None), "failed": ("failed", None), "failed_retry": ("waiting", "retry"), "wait_delay": ("waiting", "delay"), "wait_signal": ("waiting", "signal"), "wait_child": ("waiting", "child"), "wait_uncertain": ("waiting", "uncertain")}
MOVES: dict[tuple[str, str], tuple[str, str | None]] = {
    **{(s, "dispatched"): ("running", None) for s in ("absent", "pending", "waiting:retry", "running")},
    ("absent", "skipped"): ("skipped", None),
    **{("running", kind): after for kind, after in RESULT.items()},
    ("waiting:child", "failed"): ("failed", None), ("waiting:child", "failed_retry"): ("waiting", "retry"),
    **{(f"waiting:{w}", "resolved"): ("succeeded", None) for w in ("delay", "signal", "child")},
    ("waiting:uncertain", "adjudged_accept"): ("succeeded", None), ("waiting:uncertain", "adjudged_retry"): ("pending", None), ("waiting:uncertain", "adjudged_fail"): ("failed", None),
}


def _moves() -> Column:
    entries = [x for (state, kind), (after, wait) in MOVES.items() for x in (F.lit(f"{state}|{kind}"), F.struct(F.lit(after).alias("status"), F.lit(wait).cast("string").alias("wait")))]
    return F.create_map(*entries)


def fold_nodes(facts: DataFrame, keys: tuple[str, ...] = ("run_id", "node_id"), most_attempts: int = 100) -> DataFrame:
    """Each node's state, wait and attempts after all its facts (lsn, kind), and the positions of the facts it rejects.

    A fact that the node's state doesn't allow changes nothing and is listed. A node has at
    most ``most_attempts`` attempts, each of a few facts, so its facts are gathered and reduced
    in order within one expression.
    """
    ordered = F.array_sort(F.collect_list(F.struct("lsn", "kind")))
    empty = F.struct(F.lit("absent").alias("status"), F.lit(None).cast("string").alias("wait"), F.lit(0).alias("attempt"), F.array().cast("array<bigint>").alias("rejected"))
    grouped = facts.groupBy(*keys).agg(ordered.alias("_facts")).withColumn("_moves", _moves())

    def step(state: Column, fact: Column) -> Column:
        name = F.concat_ws(":", state["status"], state["wait"])
        move = F.try_element_at("_moves", F.concat(name, F.lit("|"), fact["kind"]))
        capped = (fact["kind"] == "dispatched") & (state["attempt"] >= most_attempts)
        legal = move.isNotNull() & ~capped
        return F.struct(
            F.when(legal, move["status"]).otherwise(state["status"]).alias("status"), F.when(legal, move["wait"]).otherwise(state["wait"]).alias("wait"),
            (state["attempt"] + (legal & (fact["kind"] == "dispatched")).cast("int")).alias("attempt"), F.when(legal, state["rejected"]).otherwise(F.array_append(state["rejected"], fact["lsn"])).alias("rejected"),
        )

    return grouped.withColumn("_state", F.aggregate("_facts", empty, step)).select(*keys, "_state.*")


def fold_runs(facts: DataFrame, key: str, order: str, terminal: dict[str, str], kind: str = "kind") -> DataFrame:
    """Each run's state: that of its first terminal fact, else running; with its facts, the last one, and how many came after the end.

    Minimums and maximums by key only: late facts are counted, and change nothing.
    """
    is_end = F.col(kind).isin(*terminal)
    first_end = F.min(F.when(is_end, F.struct(F.col(order).alias("at"), F.col(kind).alias("kind"))))
    names = F.create_map(*[F.lit(x) for pair in terminal.items() for x in pair])
    out = facts.groupBy(key).agg(F.count("*").alias("n_facts"), F.max(order).alias("last_at"), first_end.alias("_end"))
    return out.select(key, "n_facts", "last_at", F.coalesce(F.try_element_at(names, F.col("_end.kind")), F.lit("running")).alias("status"), F.col("_end.at").alias("ended_at"))


def fold_run_rules(facts: DataFrame, key: str, node: str, order: str, completed: str, failed: str, cancelled: str, uncertain: str, adjudged: str, kind: str = "kind") -> DataFrame:
    """Each run's state by the rules of its end: run, status, ended_at, n_rejected.

    A run waits for a person (awaiting_resume) while any of its nodes is uncertain: the latest
    of the node's ``uncertain`` and ``adjudged`` facts is the former. Before the first fact that
    ends a run, completion and failure are rejected while it waits; cancelling never is.
    After it, completion is rejected, failure and cancelling change nothing, and facts of nodes
    are evidence only. The number of uncertain nodes is a running sum of +1 and -1, so a run is
    two sorts and no list.
    """
    is_wait = F.col(kind).isin(uncertain, adjudged)
    of_node = Window.partitionBy(key, node).orderBy(order)
    moved = facts.filter(is_wait).withColumn("_on", (F.col(kind) == uncertain).cast("int"))
    moved = moved.withColumn("_step", F.col("_on") - F.coalesce(F.lag("_on").over(of_node), F.lit(0))).select(key, order, kind, "_step")
    rows = moved.unionByName(facts.filter(~is_wait).select(key, order, kind, F.lit(0).alias("_step")))
    waits = F.sum("_step").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_waits", waits)
    ends = (F.col(kind) == cancelled) | (F.col(kind).isin(completed, failed) & (F.col("_waits") == 0))
    rows = rows.withColumn("_end", F.min(F.when(ends, F.struct(F.col(order).alias("at"), F.col(kind).alias("kind")))).over(Window.partitionBy(key)))
    after = F.coalesce(F.col(order) > F.col("_end.at"), F.lit(False))
    refused = F.when(after, F.col(kind) == completed).otherwise(F.col(kind).isin(completed, failed) & (F.col("_waits") > 0))
    names = F.when(F.col("end.kind") == completed, "succeeded").when(F.col("end.kind") == failed, "failed").when(F.col("end.kind") == cancelled, "cancelled")
    out = rows.groupBy(key).agg(F.any_value("_end").alias("end"), F.max_by("_waits", order).alias("waits"), F.count_if(refused).alias("n_rejected"))
    return out.select(key, F.coalesce(names, F.when(F.col("waits") > 0, "awaiting_resume").otherwise("running")).alias("status"), F.col("end.at").alias("ended_at"), "n_rejected")


def fold_operations(facts: DataFrame, keys: list[str], order: str, kind: str = "kind") -> DataFrame:
    """Of each dispatch the operation it made on the outside: state, authorized_at, fingerprint, outcome_at, n_rejected.

    Facts have kind (prepared, intent, authorized, outcome, retry), request and fingerprint. An
    intent or an authorization before the input is prepared is rejected; so is an
    authorization whose fingerprint isn't the request's SHA-256, or one beside another that
    is not yet given up by a retry; so is an outcome without an authorization, or a second one.
    A retry gives the operation up and begins a new span. Everything is found by running
    maximums and sums.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    prepared = F.coalesce(F.max(F.col(kind) == "prepared").over(upto), F.lit(False))
    sound = (F.col(kind) == "authorized") & prepared & F.coalesce(F.col("fingerprint") == F.sha2("request", 256), F.lit(False))
    rows = facts.withColumns({"_prepared": prepared, "_sound": sound})
    rows = rows.withColumn("_span", F.sum((F.col(kind) == "retry").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy(*keys, "_span").orderBy(order)
    before = span.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_taken", F.col("_sound") & ~F.coalesce(F.max("_sound").over(before), F.lit(False)))
    rows = rows.withColumn("_open", F.coalesce(F.max("_taken").over(before), F.lit(False)))
    rows = rows.withColumn("_answered", (F.col(kind) == "outcome") & F.col("_open"))
    rows = rows.withColumn("_first", F.col("_answered") & ~F.coalesce(F.max("_answered").over(before), F.lit(False)))
    refused = ((F.col(kind) == "intent") & ~F.col("_prepared")) | ((F.col(kind) == "authorized") & ~F.col("_taken")) | ((F.col(kind) == "outcome") & ~F.col("_first"))
    last = F.max("_span").over(Window.partitionBy(*keys))
    rows = rows.withColumns({"_refused": refused, "_now": F.col("_span") == last})
    now = lambda c, value: F.max(F.when(F.col("_now") & F.col(c), F.col(value)))
    out = rows.groupBy(*keys).agg(now("_taken", order).alias("authorized_at"), now("_taken", "fingerprint").alias("fingerprint"), now("_first", order).alias("outcome_at"), F.max("_prepared").alias("_ready"), F.count_if("_refused").alias("n_rejected"))
    state = F.when(F.col("outcome_at").isNotNull(), "answered").when(F.col("authorized_at").isNotNull(), "open").otherwise("none")
    return out.select(*keys, state.alias("state"), "authorized_at", "fingerprint", "outcome_at", "n_rejected")


def fold_config(facts: DataFrame, keys: list[str], order: str, body: str, deleted: str, slots: DataFrame | None = None) -> DataFrame:
    """The configuration of each key: its latest document, whole; a deletion takes it away.

    With ``slots`` (keys, order, at), the slots that commands have fired, each key has the
    largest slot fired since its last deletion as its watermark.
    """
    last = F.max(F.struct(order, F.col(deleted).alias("gone"), F.col(body).alias("body"))).alias("last")
    cleared = F.max(F.when(F.col(deleted), F.col(order))).alias("cleared")
    out = facts.groupBy(*keys).agg(last, cleared)
    if slots is not None:
        fired = slots.join(out.select(*keys, "cleared"), keys).filter(F.col("cleared").isNull() | (F.col(order) > F.col("cleared")))
        out = out.join(fired.groupBy(*keys).agg(F.max("at").alias("watermark")), keys, "left")
    kept = out.filter(~F.col("last.gone"))
    return kept.select(*keys, F.col(f"last.{order}").alias("changed_at"), F.col("last.body").alias(body), *(["watermark"] if slots is not None else []))


def fold_workflows(facts: DataFrame, key: str, order: str, version: str = "version", kind: str = "kind") -> DataFrame:
    """Workflows by their facts (created, updated, published, deleted): versions, published_version, deleted, n_rejected.

    A second creation is rejected, and all before the first; an update must bring the version
    after the last one; only a version that is there can be published; a deletion marks, and
    keeps what was. One pass over a workflow's facts in order, which people write by hand, so
    they are gathered; created workflows only are given.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, kind, version)))
    start = F.struct(F.lit(False).alias("made"), F.lit(0).cast("long").alias("versions"), F.lit(None).cast("long").alias("published"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("rejected"))

    def step(s: Column, f: Column) -> Column:
        is_a = lambda name: f[kind] == name
        makes = is_a("created") & ~s["made"]
        adds = is_a("updated") & s["made"] & (f[version] == s["versions"] + 1)
        shows = is_a("published") & s["made"] & f[version].between(1, s["versions"])
        ends = is_a("deleted") & s["made"]
        return F.struct(
            (s["made"] | makes).alias("made"), (s["versions"] + adds.cast("long")).alias("versions"),
            F.when(shows, F.greatest(s["published"], f[version].cast("long"))).otherwise(s["published"]).alias("published"),
            (s["deleted"] | ends).alias("deleted"), (s["rejected"] + (~(makes | adds | shows | is_a("deleted"))).cast("long")).alias("rejected"),
        )

    state = facts.groupBy(key).agg(ordered.alias("_facts")).withColumn("s", F.aggregate("_facts", start, step)).filter("s.made")
    return state.select(key, "s.versions", F.col("s.published").alias("published_version"), "s.deleted", F.col("s.rejected").alias("n_rejected"))


def fold_approvals(facts: DataFrame, keys: list[str], order: str, kind: str = "kind", decision: str = "decision") -> DataFrame:
    """Each approval asked for: asked_at, its state (pending, or the first decision after the asking), decided_at."""
    asked = F.min(F.when(F.col(kind) == "permission_asked", F.col(order))).over(Window.partitionBy(*keys))
    rows = facts.withColumn("_asked", asked).filter(F.col("_asked").isNotNull())
    first = F.min(F.when((F.col(kind) == "permission_decided") & (F.col(order) > F.col("_asked")), F.struct(order, decision))).alias("d")
    out = rows.groupBy(*keys).agg(F.any_value("_asked").alias("asked_at"), first)
    return out.select(*keys, "asked_at", F.coalesce(F.col(f"d.{decision}"), F.lit("pending")).alias("state"), F.col(f"d.{order}").alias("decided_at"))


def split_sealed(results: DataFrame, audits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Results whose seal is their dispatch's last audit position, and those that come before all of it has arrived (or claim more)."""
    last = audits.groupBy(*keys).agg(F.max("audit_seq").alias("_last"))
    marked = results.join(last, keys, "left").withColumn("_whole", F.col("sealed_through") == F.coalesce("_last", F.lit(0)))
    return marked.filter("_whole").drop("_last", "_whole"), marked.filter("not _whole").drop("_last", "_whole")


def recent_receipts(receipts: DataFrame, order: str, window: int = 8192) -> DataFrame:
    """The receipts a store of this window still holds: beyond it, the older ones are let go down to half, over and over.

    So of n receipts the newest n stay, or window / 2 and what has come since the last letting go.
    """
    n = receipts.count()
    held = n if n <= window else window // 2 + (n - window - 1) % (window - window // 2 + 1)
    return receipts.orderBy(F.desc(order)).limit(held)
