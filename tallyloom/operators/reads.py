"""The read layer: filtered, paged, ordered and budgeted reads of folded state."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The values a run's state and source can have (fixed values).
RUN_STATES = ("running", "awaiting_resume", "succeeded", "failed", "cancelled")
TERMINAL, ACTIVE = RUN_STATES[2:], RUN_STATES[:2]
RUN_SOURCES = ("manual", "schedule", "webhook", "sub_workflow")
#: Limits of pages and lists, and the kinds of facts that are about permissions (fixed values).
LIST_BYTES, PAGE_ROWS, PAGE_BYTES, LIST_ROWS = 4 << 20, 256, 1 << 20, 10_000
PERMISSION_KINDS = (
    "policy_frozen", "permission_asked", "permission_decided", "run_approval_upserted", "run_approval_removed", "workflow_permissions_changed", "plugin_grant_upserted",
)
CLASSES = ("events", "audit", "all", "permission")


def filter_runs(runs: DataFrame, workflow_id=None, status: str | None = None, source: str | None = None) -> DataFrame:
    """Runs by workflow, state and source, all that are given; an unknown state or source is an error, not an empty filter."""
    for value, known in ((status, RUN_STATES), (source, RUN_SOURCES)):
        if value is not None and value not in known:
            raise ValueError(f"{value!r} is none of {', '.join(known)}")
    for column, value in (("workflow_id", workflow_id), ("status", status), ("source", source)):
        if value is not None:
            runs = runs.filter(F.col(column) == value)
    return runs


def keyset_page(rows: DataFrame, order: str, key: str, limit: int, before=None, most: int = 500) -> DataFrame:
    """A page by (order, key) descending, after the row whose key is ``before``; an unknown key begins at the top.

    ``before`` is a key, or a DataFrame of one row and column that finds it. The row's place
    is joined in rather than fetched, so it is one plan with a top-n at its end.
    """
    limit = max(1, min(limit, most))
    if before is not None:
        at = rows.join(F.broadcast(before.toDF("_before")), F.col(key) == F.col("_before"), "left_semi") if isinstance(before, DataFrame) else rows.filter(F.col(key) == before)
        cursor = at.select(F.struct(F.col(order), F.col(key)).alias("_cursor")).limit(1)
        rows = rows.crossJoin(F.broadcast(cursor.agg(F.max("_cursor").alias("_cursor"))))  # one row
        rows = rows.filter(F.col("_cursor").isNull() | (F.struct(F.col(order), F.col(key)) < F.col("_cursor"))).drop("_cursor")
    return rows.orderBy(F.desc(order), F.desc(key)).limit(limit)


def byte_budget_page(rows: DataFrame, key: str, size: Column, limit: int, after=None, budget: int = LIST_BYTES, most: int = 256) -> DataFrame:
    """The first rows by key after ``after`` whose sizes sum to the budget at most; the first row comes even if it alone exceeds it.

    Only the page's rows reach the running sum: the top-n stands below it.
    """
    if after is not None:
        rows = rows.filter(F.col(key) > after)
    page = rows.withColumn("bytes", size.cast("long")).orderBy(key).limit(max(0, min(limit, most)))
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return page.withColumns({"running_bytes": F.sum("bytes").over(w), "place": F.row_number().over(Window.orderBy(key))}).filter((F.col("running_bytes") <= budget) | (F.col("place") == 1)).drop("place")


def of_class(facts: DataFrame, name: str) -> DataFrame:
    """Facts of a class: a run's own events (run_seq above 0), audit facts (audit_seq above 0), those about permissions, or all."""
    if name not in CLASSES:
        raise ValueError(f"{name!r} is none of {', '.join(CLASSES)}")
    wanted = {"events": F.col("run_seq") > 0, "audit": F.col("audit_seq") > 0, "permission": F.col("kind").isin(*PERMISSION_KINDS), "all": None} if name != "all" else {"all": None}
    return facts if wanted[name] is None else facts.filter(wanted[name])


def event_page(
    facts: DataFrame, upper_lsn: int, run_id=None, kinds: tuple[str, ...] | None = None, after: tuple[int, int] = (0, 0), rows: int = PAGE_ROWS, size: Column | None = None, budget: int = PAGE_BYTES,
) -> DataFrame:
    """The next facts after (lsn, event_index) and up to a fixed log position, of one run and some kinds, in log order.

    With ``size`` the page's facts have at most ``budget`` bytes, the first one apart. The top-n
    stands below the running sum, which so sees a page's rows only.
    """
    order = [c for c in ("lsn", "event_index") if c in facts.columns]
    page = facts.filter((F.col("lsn") <= upper_lsn) & (F.col("lsn") >= after[0]))
    page = page.filter((F.col("lsn") > after[0]) | (F.col("event_index") > after[1]) if "event_index" in facts.columns else F.col("lsn") > after[0])
    if run_id is not None:
        page = page.filter(F.col("run_id") == run_id)
    if kinds is not None:
        page = page.filter(F.col("kind").isin(*kinds))
    page = page.orderBy(*order).limit(rows)
    if size is None:
        return page
    upto = F.sum(size.cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.orderBy(*order))
    return page.withColumns({"_upto": upto, "_place": place}).filter((F.col("_upto") <= budget) | (F.col("_place") == 1)).orderBy(*order).drop("_upto", "_place")


def next_cursor(page: DataFrame, whole: DataFrame, upper_lsn: int, bound: str) -> DataFrame:
    """Where the page after this one begins: bound (what the cursor is for), upper_lsn, lsn and event_index of the page's last fact, and whether more follow.

    ``whole`` is what the page was cut from. An empty page has a null place.
    """
    last = page.agg(F.max(F.struct("lsn", *([F.col("event_index")] if "event_index" in page.columns else [F.lit(0).alias("event_index")]))).alias("last"))
    end = whole.filter(F.col("lsn") <= upper_lsn).agg(F.max("lsn").alias("_end"))
    return last.crossJoin(end).select(F.lit(bound).alias("bound"), F.lit(upper_lsn).alias("upper_lsn"), "last.lsn", "last.event_index", F.coalesce(F.col("last.lsn") < F.col("_end"), F.lit(False)).alias("more"))  # one row each


def audit_page(facts: DataFrame, upper_lsn: int, rows: int = PAGE_ROWS, decision: str | None = None, after: tuple | None = None) -> DataFrame:
    """Audit and permission facts of all runs, run by run, then those of no run, in log order each.

    ``decision`` keeps permission_decided facts of that decision only. ``after`` is the
    (run_id, lsn) of the last row seen; a null run comes last.
    """
    page = facts.filter((F.col("lsn") <= upper_lsn) & ((F.col("audit_seq") > 0) | F.col("kind").isin(*PERMISSION_KINDS)))
    if decision is not None:
        page = page.filter((F.col("kind") == "permission_decided") & (F.get_json_object("payload", "$.decision") == decision))
    if after is not None:
        run, lsn = after
        later = (F.col("run_id").isNull() & (F.col("lsn") > lsn)) if run is None else F.col("run_id").isNull() | (F.col("run_id") > run) | ((F.col("run_id") == run) & (F.col("lsn") > lsn))
        page = page.filter(later)
    return page.orderBy(F.asc_nulls_last("run_id"), "lsn").limit(rows)


def at_point(rows: DataFrame, upper_lsn: int, lsn: str = "last_lsn") -> DataFrame:
    """Rows as of a log position: a row that is newer raises an error when it is read, for its older state is gone."""
    seen = F.when(F.col(lsn) > upper_lsn, F.raise_error(F.lit(f"a row is newer than {upper_lsn}")).cast("long")).otherwise(F.col(lsn))
    return rows.withColumn(lsn, seen)


def ordered_list(rows: DataFrame, key: str, name: str | None = None, created: str = "created_order", most: int = LIST_ROWS) -> DataFrame:
    """All rows by (name, key), or the newest first; more than ``most`` raise a ValueError instead of being cut."""
    order = [F.col(name), F.col(key)] if name else [F.desc(created), F.desc(key)]
    page = rows.orderBy(*order).limit(most + 1)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return page


def versions_newest_first(versions: DataFrame, workflow_id) -> DataFrame:
    """A workflow's versions from the last one on; a workflow without any is an error."""
    out = versions.filter(F.col("workflow_id") == workflow_id)
    if out.isEmpty():
        raise LookupError(f"no workflow {workflow_id!r}")
    return out.orderBy(F.desc("version"))


def by_activity(rows: DataFrame, started: str, ordinal: str) -> DataFrame:
    """Rows by when they started, those that didn't last, in definition order."""
    return rows.orderBy(F.asc_nulls_last(started), ordinal)


def key_parts(key: Column) -> Column:
    """parent, slot and extra of a key that is a JSON array: its second and later parts, null where it has none."""
    parts = F.from_json(key, "array<string>")
    return F.struct(F.get(parts, F.lit(0)).alias("parent"), F.get(parts, F.lit(1)).alias("slot"), F.get(parts, F.lit(2)).alias("extra"))


def body_columns(rows: DataFrame, body: str = "body", names: tuple[str, ...] = ("workflow_id", "status", "source", "name", "dispatch_id")) -> DataFrame:
    """The fields of a JSON body that reads filter by, as columns."""
    return rows.withColumns({n: F.get_json_object(body, f"$.{n}") for n in names})


def active_runs(runs: DataFrame, after) -> DataFrame:
    return runs.filter(F.col("status").isin(*ACTIVE) & (F.col("run_id") > after))


def public_events(facts: DataFrame, shown: dict[str, Column]) -> DataFrame:
    """Facts of the kinds shown outside, each with what its kind shows: nothing of a fact but its name, place and that."""
    what = F.lit(None).cast("string")
    for kind, value in shown.items():
        what = F.when(F.col("kind") == kind, value).otherwise(what)
    return facts.filter(F.col("kind").isin(*shown)).select("lsn", "run_id", "kind", what.alias("shown"))


def size_guard(body: Column, most: int) -> Column:
    """The body if it is small enough, else a mark."""
    return F.when(F.octet_length(body) <= most, body).otherwise("RESPONSE_TOO_LARGE")


def display_state(status: Column, wait_kind: Column) -> Column:
    """A node's state as it is shown: completed, retrying, running, pending, or as it is."""
    shown = F.when(status == "succeeded", "completed").when((status == "waiting") & (wait_kind == "retry"), "retrying").when(status == "waiting", "running")
    return shown.when(status.isNull(), "pending").otherwise(status)


def by_deadline(rows: DataFrame, deadline: str, key: str) -> DataFrame:
    return rows.orderBy(F.asc_nulls_last(deadline), key)


def least_loaded(executors: DataFrame) -> DataFrame:
    """The one executor, not draining and with room, that uses the fewest slots; ties go to the smallest id."""
    return executors.filter(~F.col("draining") & (F.col("used") < F.col("slots"))).orderBy("used", "executor_id").limit(1)


def bounded_report(differences: DataFrame, order: list[str], most: int = 64) -> DataFrame:
    """The first ``most`` differences, each row told whether more were cut off."""
    first = differences.orderBy(*order).limit(most + 1)
    place = F.row_number().over(Window.orderBy(*order))
    return first.withColumns({"_place": place, "truncated": F.count("*").over(Window.partitionBy()) > most}).filter(F.col("_place") <= most).drop("_place")


def merge_page(have: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """Rows at hand and those of a page that aren't among them."""
    return have.unionByName(page.join(have.select(key), key, "left_anti"))
