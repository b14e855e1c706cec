"""The catalogue of queries: each applies one operator to the driver's tables, standing in for facts, runs, nodes and logs."""

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import contracts, cron, statistics, text, values
from tallyloom.operators import assembly, differences, hierarchy, integrity, policies, reads, retention, rollups
from tallyloom.plans import evaluate, fold
from tallyloom.plans.definition import parse
from tallyloom.sources import facts, kept
from tallyloom.streaming import folds

#: Kinds of the events table that end a run.
TERMINAL = {"purchase": "succeeded", "error": "failed"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return facts.order_runs(facts.table(spark, d, "orders"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.event_facts(facts.table(spark, d, "events"))


def _raw_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts without their number within the run, which needs a window."""
    return facts.table(spark, d, "events").select((F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), "ts", "value", "props")


@query
def q01_run_counts(spark, d):
    return rollups.run_counts(_runs(spark, d))


@query
def q02_run_stats_rollup(spark, d):
    return rollups.run_stats(_runs(spark, d))


@query
def q03_success_rate(spark, d):
    e = _raw_facts(spark, d)
    return e.groupBy("run_id").agg(F.round(statistics.success_rate(F.col("kind") == "purchase", F.col("kind").isin(*TERMINAL)), 9).alias("rate"))


@query
def q04_per_workflow_rates(spark, d):
    out = rollups.success_rates(_runs(spark, d), ["workflow_id"])
    return out.withColumn("rate", F.round("rate", 9)).orderBy(F.desc("total"), "workflow_id")


@query
def q05_child_pick_min(spark, d):
    return rollups.child_pick(facts.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey")


@query
def q06_byte_sums(spark, d):
    return rollups.byte_sums(facts.table(spark, d, "documents"), ["source"], "text")


@query
def q07_fact_runseq(spark, d):
    return _facts(spark, d).select("lsn", "run_id", "run_seq")


@query
def q08_seq_contiguity(spark, d):
    """Without its views a run's numbering has gaps: the fact after each is reported with the number that was expected."""
    return facts.gaps(_facts(spark, d).filter("kind <> 'view'"), ["run_id"], "run_seq").select("run_id", "lsn", "run_seq", "expected")


@query
def q09_current_state_latest(spark, d):
    return integrity.latest_state(_raw_facts(spark, d), ["run_id"], "lsn", ["kind", "props"])


@query
def q10_fold_status_terminal_first(spark, d):
    return fold.fold_runs(_raw_facts(spark, d), "run_id", "lsn", TERMINAL)


@query
def q11_attempt_ledger(spark, d):
    nodes = facts.line_nodes(facts.table(spark, d, "lineitem"))
    return nodes.groupBy("run_id", "node_id").agg(F.max("attempt").alias("attempts"), F.max_by("part_id", "attempt").alias("current_part"))


@query
def q12_command_first_receipt(spark, d):
    return integrity.first_receipts(_raw_facts(spark, d), ["run_id", "kind"], "lsn", "props")


@query
def q13_runs_keyset_page(spark, d):
    """A page of succeeded runs, the newest first, after the succeeded run of the largest id."""
    mine = reads.filter_runs(_runs(spark, d), status="succeeded")
    page = reads.keyset_page(mine, "created_at", "run_id", 50, before=mine.agg(F.max("run_id").alias("run_id")))
    return page.select("run_id", "workflow_id", "status", "source")


@query
def q14_list_byte_budget(spark, d):
    page = reads.byte_budget_page(facts.table(spark, d, "documents"), "doc_id", F.octet_length("text"), 256, after=20, budget=100_000)
    return page.select("doc_id", "bytes", "running_bytes")


@query
def q15_events_page_filtered(spark, d):
    return reads.event_page(_raw_facts(spark, d), 900, kinds=("purchase", "error"), after=(100, 0)).select("lsn", "run_id", "kind", "props")


@query
def q16_active_runs(spark, d):
    return reads.active_runs(_runs(spark, d), 500).select("run_id", "workflow_id", "status")


@query
def q17_public_event_projection(spark, d):
    shown = {"error": F.lit("EXECUTION_FAILED"), "purchase": F.format_string("%.2f", "value"), "signup": F.lit("")}
    return reads.public_events(_raw_facts(spark, d), shown)


@query
def q18_size_guard(spark, d):
    return facts.table(spark, d, "documents").select("doc_id", F.sha2(reads.size_guard(F.col("text"), 2000), 256).alias("shown"))


@query
def q19_timeline_left_join(spark, d):
    """The parts as a definition's nodes, with the lines that used them."""
    definition = facts.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))
    used = facts.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("n_lines"), F.max("l_quantity").alias("max_quantity"))
    return assembly.timeline(definition, used)


@query
def q20_current_attempt_semi(spark, d):
    open_orders = facts.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run_id"))
    return assembly.current_attempts(facts.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "run_id"), open_orders, ["run_id"]).groupBy("run_id").agg(F.count("*").alias("n_attempts"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query
def q21_run_assembly_nested(spark, d):
    nodes = facts.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node_id")).agg(F.max("l_returnflag").alias("status"))
    out = assembly.assemble_runs(_runs(spark, d), nodes)
    return out.select("run_id", "workflow_id", F.array_join(F.transform(F.array_sort(F.map_entries("nodes")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("nodes"))


@query
def q22_approvals_sorted(spark, d):
    """Orders as approvals; those of low priority have no deadline."""
    approvals = _runs(spark, d).select("run_id", F.lit("pending").alias("state"), F.when(F.col("source") != "sub_workflow", F.unix_micros(F.col("created_at").cast("timestamp"))).alias("deadline"))
    return policies.pending_approvals(approvals, _runs(spark, d)).select("run_id", "deadline")


@query
def q23_latency_percentiles(spark, d):
    out = _raw_facts(spark, d).groupBy("kind").agg(*statistics.latency_summary("value"))
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query
def q24_capacity_summary(spark, d):
    e = _raw_facts(spark, d)
    low = e.groupBy("run_id").agg(statistics.nearest_rank("value", 50).alias("p50"), statistics.nearest_rank("value", 95).alias("p95"))
    return low.join(statistics.floor_index(e, ["run_id"], "value", 99, "p99_floor"), "run_id")


@query
def q25_run_progress(spark, d):
    nodes = facts.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node_id"), F.when(F.col("l_linestatus") == "O", "running").otherwise("succeeded").alias("status"))
    return rollups.run_progress(nodes, ends=(1,))


@query
def q26_run_elapsed(spark, d):
    return rollups.run_elapsed(_raw_facts(spark, d), ["run_id"], "ts", "ts")


def _graph(nodes: list[tuple], edges: list[tuple], **more):
    return parse({"nodes": [{"id": n[0], "type": n[1], "params": n[2] if len(n) > 2 else {}} for n in nodes], "edges": [{"from": e[0], "to": e[1], "port": e[2] if len(e) > 2 else None} for e in edges], **more})


def _order_inputs(spark, d) -> DataFrame:
    o = facts.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("flag"), F.col("o_custkey").alias("customer")).alias("input"))


def _event_inputs(spark, d) -> DataFrame:
    e = facts.table(spark, d, "events")
    return e.select(F.col("event_id").alias("run_id"), F.struct("event_id", "value", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k")).alias("input"))


@query
def q27_dag_linear(spark, d):
    graph = _graph([("start", "start"), ("double", "script", {"code": "input.k * 2"}), ("plus", "script", {"code": "nodes.double + 1"}), ("end", "end")], [("start", "double"), ("double", "plus"), ("plus", "end")])
    return evaluate.run_batch(graph, _event_inputs(spark, d)).select("run_id", "run_status", "run_output")


_BRANCH = [("start", "start"), ("big", "condition", {"expr": "input.price > 200000"}), ("yes", "script", {"code": "'large'"}), ("no", "script", {"code": "'small'"})]
_BRANCH_EDGES = [("start", "big"), ("big", "yes", "true"), ("big", "no", "false")]


@query
def q28_dag_condition(spark, d):
    graph = _graph([*_BRANCH, ("end_yes", "end"), ("end_no", "end")], [*_BRANCH_EDGES, ("yes", "end_yes"), ("no", "end_no")])
    return evaluate.run_batch(graph, _order_inputs(spark, d)).select("run_id", F.col("node_yes.status").alias("yes"), F.col("node_no.skip_reason").alias("no_reason"), "run_status", "run_output")


@query
def q29_dag_join_selected(spark, d):
    graph = _graph([*_BRANCH, ("merge", "script", {"code": "coalesce(nodes.yes, nodes.no)"}), ("end", "end")], [*_BRANCH_EDGES, ("yes", "merge"), ("no", "merge"), ("merge", "end")])
    return evaluate.run_batch(graph, _order_inputs(spark, d)).select("run_id", F.col("node_merge.status").alias("merge"), "run_status", "run_output")


@query
def q30_dag_join_all_v1(spark, d):
    graph = _graph([*_BRANCH, ("merge", "script", {"code": "'both'"}), ("end", "end")], [*_BRANCH_EDGES, ("yes", "merge"), ("no", "merge"), ("merge", "end")], semantics=1)
    return evaluate.run_batch(graph, _order_inputs(spark, d)).select("run_id", F.col("node_no.skip_reason").alias("no_reason"), F.col("node_merge.skip_reason").alias("merge_reason"), F.col("node_end.skip_reason").alias("end_reason"), "run_status")


@query
def q31_dag_failure_isolation(spark, d):
    graph = _graph(
        [("start", "start"), ("risky", "script", {"code": "input.price", "fails": "CASE WHEN input.flag = 'F' THEN 'flagged' END"}), ("safe", "script", {"code": "input.id + 1"}), ("end_a", "end"), ("end_b", "end")],
        [("start", "risky"), ("start", "safe"), ("risky", "end_a"), ("safe", "end_b")],
    )
    return evaluate.run_batch(graph, _order_inputs(spark, d)).select("run_id", F.col("node_risky.status").alias("risky"), F.col("node_end_a.skip_reason").alias("end_a_reason"), F.col("node_end_b.output").alias("end_b"), "run_status", "run_error")


@query
def q32_dag_multi_end(spark, d):
    graph = _graph([("start", "start"), ("a", "script", {"code": "input.k"}), ("b", "script", {"code": "input.kind"}), ("end_a", "end"), ("end_b", "end")], [("start", "a"), ("start", "b"), ("a", "end_a"), ("b", "end_b")])
    return evaluate.run_batch(graph, _event_inputs(spark, d)).select("run_id", "run_output")


@query
def q33_dag_subworkflow(spark, d):
    child = _graph([("start", "start"), ("is_old", "condition", {"expr": "input.customer <= 500"}), ("old", "script", {"code": "'old'"}), ("new", "script", {"code": "'new'"}), ("end", "end")], [("start", "is_old"), ("is_old", "old", "true"), ("is_old", "new", "false"), ("old", "end"), ("new", "end")])
    graph = _graph([("start", "start"), ("age", "sub_workflow", {"workflow_id": "age", "input_mapping": {"customer": "input.customer"}}), ("end", "end")], [("start", "age"), ("age", "end")])
    named = facts.table(spark, d, "customer").select(F.col("c_custkey"), "c_mktsegment")
    out = evaluate.run_batch(graph, _order_inputs(spark, d), children={"age": child})
    return out.join(named, F.col("input.customer") == F.col("c_custkey")).select("run_id", "c_mktsegment", "run_status", "run_output")


@query
def q34_dag_input_node(spark, d):
    graph = _graph([("start", "start"), ("ask", "input", {"fields": [{"key": "k"}, {"key": "note", "default": "none"}]}), ("end", "end")], [("start", "ask"), ("ask", "end")])
    e = facts.table(spark, d, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.struct(F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("long")).alias("k"), F.when(F.col("event_type") == "click", "clicked").alias("note")).alias("input"))
    return evaluate.run_batch(graph, runs).select("run_id", F.col("node_ask.status").alias("ask"), "run_status", "run_output")


@query
def q35_topo_reachability(spark, d):
    """All that lies below each region: nations, then customers."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    n, c = facts.table(spark, d, "nation"), facts.table(spark, d, "customer")
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    roots = facts.table(spark, d, "region").select(name("r", "r_regionkey").alias("root"))
    return hierarchy.closure(edges, roots).groupBy("root", "depth").agg(F.count("*").alias("n_nodes")).withColumn("depth", F.col("depth").cast("long"))


@query
def q36_dependency_closure(spark, d):
    """Each nation depends on those of the next two keys: what it needs at how many steps."""
    n = facts.table(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").alias("parent"), F.explode(F.array((F.col("n_nationkey") * 2 + 1).cast("int"), (F.col("n_nationkey") * 2 + 2).cast("int"))).alias("child")).filter("child < 25")
    return hierarchy.closure(edges, n.select(F.col("n_nationkey").alias("root"))).withColumn("depth", F.col("depth").cast("long"))


@query
def q37_compare_runs(spark, d):
    """A customer's finished orders against its open ones, by priority."""
    per = lambda flag: facts.table(spark, d, "orders").filter(F.col("o_orderstatus") == flag).groupBy(F.concat_ws("|", "o_custkey", "o_orderpriority").alias("node")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return differences.compare_rows(per("F"), per("O"), "node", ["n", "last"])


@query
def q38_projection_check(spark, d):
    """Each run's last kind against a stored copy that lacks one user in ten, and has wrong kinds for one in seven."""
    replayed = integrity.latest_state(_raw_facts(spark, d), ["run_id"], "lsn", ["kind"])
    stored = replayed.filter("run_id % 10 <> 0").withColumn("kind", F.when(F.col("run_id") % 7 == 0, "view").otherwise(F.col("kind")))
    return integrity.projection_differences(replayed, stored, ["run_id"], "kind")


@query
def q39_definition_diff(spark, d):
    p = facts.table(spark, d, "part")
    before = p.filter("p_partkey % 5 <> 0").select("p_partkey", "p_brand", "p_size")
    after = p.filter("p_partkey % 7 <> 0").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return differences.compare_rows(before, after, "p_partkey", ["p_brand", "p_size"])


@query
def q40_anti_join_rerank(spark, d):
    c = facts.table(spark, d, "customer")
    busy = facts.table(spark, d, "orders").filter("o_totalprice > 400000").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.upper("c_name").alias("c_name"))
    return assembly.exclude_and_rank(c, busy, "c_name", [F.desc("c_acctbal"), F.col("c_custkey")]).select("rank", "c_custkey", "c_name")


@query
def q41_hash_chain_links(spark, d):
    digest = F.sha2(F.concat_ws("|", "lsn", "kind", "props"), 256)
    return integrity.chain_links(_raw_facts(spark, d), ["run_id"], "lsn", digest).select("lsn", "run_id", "prev_digest", "link")


@query
def q42_cron_latest_slot(spark, d):
    """The latest slot of 'every 15 minutes from 8 to 17 on weekdays' before each event."""
    slot = cron.previous_slot("*/15 8-17 * * 1-5", F.col("ts").cast("timestamp_ntz"))
    return _raw_facts(spark, d).select("lsn", F.date_format(slot, "yyyy-MM-dd HH:mm:ss").alias("slot"))


@query
def q43_slot_dedupe(spark, d):
    slots = _raw_facts(spark, d).select("run_id", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("slot"), "lsn")
    return slots.groupBy("run_id", "slot").agg(F.min("lsn").alias("fired_by"), (F.count("*") - 1).alias("conflicts"))


_LAYERS = [
    policies.Layer("plugin", (policies.Capability("web", "net", methods=("GET",), url_prefix="https://m.ththth.example.net/en"), policies.Capability("any", "net", anything=True))),
    policies.Layer("workflow", (policies.Capability("en", "net", methods=("GET",), url_prefix="https://m.ththth.example.net/en"), policies.Capability("old", "net", methods=("GET",), url_prefix="http://ththre.example.com", ask=True))),
]


@query
def q44_policy_layers(spark, d):
    """Pages as requests, under layers built from the two pages of the smallest ids' hosts."""
    p = facts.table(spark, d, "pages")
    request = {"action": F.lit("net"), "method": F.lit("get"), "url": F.col("url")}
    return p.select("page_id", policies.decide(request, _LAYERS).alias("decision"))


@query
def q45_url_prefix_match(spark, d):
    return facts.table(spark, d, "pages").select("page_id", text.url_prefix_matches(F.lit("https://m.ththth.example.net:443/en/"), F.col("url")).alias("https_en"), text.url_prefix_matches(F.lit("http://ththre.example.com/"), F.col("url")).alias("http_any"))


@query
def q46_capability_covers(spark, d):
    """What a run does against what is granted to it, which goes by its id."""
    grants = F.array(F.array(F.lit("click"), F.lit("error"), F.lit("purchase"), F.lit("signup"), F.lit("view")), F.array(F.lit("click"), F.lit("view"), F.lit("signup")), F.array(F.lit("error"), F.lit("purchase")))
    granted = F.get(grants, (F.col("run_id") % 3).cast("int"))
    done = _raw_facts(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return done.select("run_id", policies.covers(F.col("kinds"), granted).alias("covered"), F.array_join(F.array_sort(F.array_except("kinds", granted)), ",").alias("lacking"))


@query
def q47_truthy_eval(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("kind") != "view", F.col("kind")).otherwise("")
    return _raw_facts(spark, d).select("lsn", values.truthy(k % 3, "bigint").alias("t_int"), values.truthy(kind, "string").alias("t_text"), values.truthy_variant(F.try_parse_json("props")).alias("t_object"), values.truthy(F.floor("value") - 10.0, "double").alias("t_double"))


@query
def q48_template_interpolate(spark, d):
    columns = {"input.kind": F.col("kind"), "input.user": F.col("run_id"), "input.note": F.when(F.col("kind") == "click", "yes")}
    return _raw_facts(spark, d).select("lsn", values.template("${input.user}", columns).alias("whole"), values.template("user ${input.user} did ${input.kind}: ${input.note}", columns).alias("written"))


@query
def q49_redact_url_params(spark, d):
    url = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("api_key=k"), F.col("page_id").cast("string"), F.lit("&q=1#access_token=t"))
    return facts.table(spark, d, "pages").select("page_id", text.redact_url(url).alias("url"))


@query
def q50_html_to_text(spark, d):
    return facts.table(spark, d, "pages").select("page_id", F.sha2(text.html_to_text(F.col("html")), 256).alias("text_sha256"), F.length(text.html_to_text(F.col("html"))).cast("long").alias("n_chars"))


@query
def q51_href_extract(spark, d):
    found = facts.table(spark, d, "pages").select("page_id", text.hrefs(F.col("html")).alias("h"))
    return found.select("page_id", F.size("h").cast("long").alias("n_links"), F.array_join("h", " ").alias("links"))


@query
def q52_fingerprint_canonical(spark, d):
    m = F.create_map(F.lit("user"), F.col("run_id").cast("string"), F.lit("kind"), F.col("kind"), F.lit("at"), F.col("lsn").cast("string"))
    return _raw_facts(spark, d).select("lsn", values.fingerprint(m).alias("fingerprint"))


@query
def q53_json_response_shape(spark, d):
    body = F.when(F.col("kind") == "error", F.concat(F.lit("<"), F.col("props"))).otherwise(F.col("props"))
    kind, shaped = values.json_or_text(body)
    return _raw_facts(spark, d).select("lsn", kind.alias("shape"), F.when(kind == "json", F.get_json_object(shaped, "$.k")).otherwise(shaped).alias("content"))


_CONTRACT = {"type": "object", "required": ["k", "kind"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "kind": {"enum": ["click", "view", "error"]}, "note": {"type": "string", "maxLength": 5}}, "additionalProperties": False}


@query
def q54_schema_validate(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    note = F.when(F.col("lsn") % 11 == 0, "far too long")
    body = F.to_json(F.struct(k.alias("k"), F.when(F.col("lsn") % 13 != 0, F.col("kind")).alias("kind"), note.alias("note")))
    return _raw_facts(spark, d).select("lsn", contracts.violation(_CONTRACT, F.try_parse_json(body)).alias("violation"))


@query
def q55_grep_lines(spark, d):
    found = facts.table(spark, d, "documents").select("doc_id", F.inline(text.grep_lines(F.col("text"), "licen[cs]e", ignore_case=True)))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2("match", 256).alias("match_sha256"))


@query
def q56_session_stats(spark, d):
    log = facts.table(spark, d, "conversations")
    return rollups.session_stats(log, "conv_id", "turn", F.col("role") == "system", F.col("role") == "user", F.octet_length("text")).withColumn("head_rate", F.round("head_rate", 9))


@query
def q57_log_budget(spark, d):
    return retention.log_budget(_raw_facts(spark, d), ["run_id"], "lsn", F.col("kind").isin("view", "click"), 10, 30).select("run_id", "lsn", "kind")


@query
def q58_retention_suffix(spark, d):
    docs = facts.table(spark, d, "documents")
    return retention.newest_within(docs, ["source"], "doc_id", F.octet_length("text"), 50_000).select("source", "doc_id", "running_bytes")


@query
def q59_chunk_reassembly(spark, d):
    return facts.join_value(facts.split_value(facts.table(spark, d, "documents"), "doc_id", "text", 1024), "doc_id")


@query
def q60_stream_fold_equals_batch(spark, d):
    """The fold of runs as a stream with state, run to the end of what is there; the same rows as the batch fold's."""
    schema = facts.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(_as_glob(f"{d}/events.parquet"))
    log = stream.select((F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"))
    base = kept.shared_path(spark, "stream-fold")
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", folds.ROCKS):
        folds.stream_runs(log, TERMINAL).writeStream.outputMode("update").option("checkpointLocation", f"{base}-state").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}-out/batch={n}")).start().awaitTermination()
    out = spark.read.parquet(f"{base}-out")
    return out.groupBy("run_id").agg(F.max_by(F.struct("n_facts", "last_at", "status", "ended_at"), "n_facts").alias("s")).select("run_id", "s.*")


def _as_glob(path: str) -> str:
    """A path that a file stream takes for files as well as folders: its last letter as a pattern."""
    return f"{path[:-1]}[{path[-1]}]"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query
def q61_fold_nodes(spark, d):
    """Node facts made from lines: dispatched, then by flag completed, failed, or sent to wait and resolved; the odd double completion is rejected."""
    l = facts.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").distinct()  # noqa: E741
    after = F.when(F.col("l_returnflag") == "A", F.array(F.lit("dispatched"), F.lit("completed"), F.lit("completed"))).when(F.col("l_returnflag") == "R", F.array(F.lit("dispatched"), F.lit("failed_retry"), F.lit("dispatched"), F.lit("failed"))).otherwise(F.array(F.lit("dispatched"), F.lit("wait_delay"), F.lit("resolved")))
    one = l.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_returnflag", "l_linestatus")).alias("x")).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node_id"), "x.*")
    log = one.select("run_id", "node_id", F.posexplode(after).alias("lsn", "kind")).withColumn("lsn", F.col("lsn").cast("long"))
    return fold.fold_nodes(log).select("run_id", "node_id", "status", F.col("attempt").cast("long").alias("attempt"), F.size("rejected").cast("long").alias("n_rejected"))


@query
def q62_late_facts(spark, d):
    """Facts of a run beyond its seal, its first terminal fact: evidence, by kind."""
    e = _facts(spark, d).withColumnRenamed("run_seq", "audit_seq")
    seals = e.filter(F.col("kind").isin(*TERMINAL)).groupBy("run_id").agg(F.min("audit_seq").alias("sealed_through"))
    _, late = folds.split_late(e, seals, ["run_id"])
    return late.groupBy("run_id", "kind").agg(F.count("*").alias("n_late"))


@query
def q63_display_states(spark, d):
    wait = F.when(F.col("source") == "schedule", "retry").when(F.col("source") == "webhook", "delay")
    status = F.when(F.col("status") == "awaiting_resume", "waiting").when(F.col("source") != "manual", F.col("status"))
    return _runs(spark, d).select(reads.display_state(status, wait).alias("shown")).groupBy("shown").agg(F.count("*").alias("n"))


@query
def q64_truncate_text(spark, d):
    docs = facts.table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(text.truncate_message(F.col("text"), 500, "~"), 256).alias("head"), F.sha2(text.byte_tail(F.col("text"), 512, "~"), 256).alias("tail"))


@query
def q65_log_levels(spark, d):
    label = F.concat_ws(" ", "kind", F.when(F.col("lsn") % 5 == 0, "Retry").when(F.col("lsn") % 7 == 0, "DEBUG"))
    return _raw_facts(spark, d).select(retention.log_level(label).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query
def q66_entity_digest(spark, d):
    return _raw_facts(spark, d).select("lsn", values.entity_digest(F.col("kind"), F.col("run_id").cast("string"), F.col("props")).alias("digest"))


@query
def q67_bounded_report(spark, d):
    return reads.bounded_report(q39_definition_diff(spark, d).filter("verdict <> 'same'"), ["p_partkey"])


@query
def q68_effective_permissions(spark, d):
    """Customers as nodes and their nations as workflows: what a segment's capability comes to under its nation's."""
    c = facts.table(spark, d, "customer")
    workflow = c.filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("workflow_id"), F.col("c_mktsegment").alias("action"), (F.col("c_acctbal") > 9900).alias("ask"))
    node = c.select("c_custkey", F.col("c_nationkey").alias("workflow_id"), F.col("c_mktsegment").alias("action"), (F.col("c_acctbal") < 0).alias("ask"))
    return policies.effective(workflow, node).select("c_custkey", "derived")


@query
def q69_line_range(spark, d):
    return facts.table(spark, d, "documents").select("doc_id", F.sha2(text.line_range(F.col("text"), 2, 3), 256).alias("lines"))


@query
def q70_running_window(spark, d):
    """A run's running sum of values and its rank among all, in log order."""
    w = Window.partitionBy("run_id").orderBy("lsn")
    return _raw_facts(spark, d).select("lsn", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.rank().over(Window.partitionBy("run_id").orderBy("kind")).cast("long").alias("kind_rank"))


@query
def q71_fold_run_rules(spark, d):
    """Users as runs: clicks make one of three nodes uncertain, views settle it, purchases complete, errors fail, signups cancel."""
    return fold.fold_run_rules(_raw_facts(spark, d).withColumn("node_id", F.get_json_object("props", "$.k").cast("long") % 3), "run_id", "node_id", "lsn", "purchase", "error", "signup", "click", "view")


@query
def q72_fold_operations(spark, d):
    """Signups prepare, views are intents, clicks authorize (one in ten with a wrong fingerprint), purchases answer, errors retry."""
    names = F.create_map(*[F.lit(x) for x in ("signup", "prepared", "view", "intent", "click", "authorized", "purchase", "outcome", "error", "retry")])
    e = _raw_facts(spark, d)
    log = e.select("run_id", "lsn", F.element_at(names, F.col("kind")).alias("kind"), F.col("props").alias("request"), F.when(F.col("lsn") % 10 != 0, F.sha2("props", 256)).otherwise("wrong").alias("fingerprint"))
    return fold.fold_operations(log, ["run_id"], "lsn")


@query
def q73_fold_config(spark, d):
    """Users as schedules: facts but purchases are their documents, errors delete, purchases are slots fired."""
    e = _raw_facts(spark, d)
    changes = e.filter("kind <> 'purchase'").select("run_id", "lsn", "props", (F.col("kind") == "error").alias("deleted"))
    return fold.fold_config(changes, ["run_id"], "lsn", "props", "deleted", e.filter("kind = 'purchase'").select("run_id", "lsn", F.col("lsn").alias("at")))


@query
def q74_fold_workflows(spark, d):
    """Users as workflows: signups create, views bring versions (one in seven skips a number), purchases publish, errors delete."""
    e = _facts(spark, d).filter("kind <> 'click'")
    nth = F.count_if(F.col("kind") == "view").over(Window.partitionBy("run_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0))
    names = F.create_map(*[F.lit(x) for x in ("signup", "created", "view", "updated", "purchase", "published", "error", "deleted")])
    version = F.when(F.col("kind") == "view", F.when(F.col("lsn") % 7 == 0, nth + 1).otherwise(F.greatest(F.lit(1), nth - F.col("run_id") % 4))).when(F.col("kind") == "purchase", F.col("lsn") % 5 + 1)
    return fold.fold_workflows(e.select("run_id", "lsn", F.element_at(names, F.col("kind")).alias("kind"), version.cast("long").alias("version")), "run_id", "lsn")


@query
def q75_event_page_bytes(spark, d):
    """A page of facts after the 100th of at most 2,000 bytes."""
    page = reads.event_page(_raw_facts(spark, d), 900, after=(100, 0), size=F.octet_length("props") + 20, budget=2000)
    return page.select("lsn", "run_id", "kind")


@query
def q76_audit_page(spark, d):
    """Clicks as audit facts, purchases as decisions, errors as grants of no run; the first 256 of those up to the last."""
    e = _raw_facts(spark, d)
    names = F.create_map(F.lit("purchase"), F.lit("permission_decided"), F.lit("error"), F.lit("plugin_grant_upserted"))
    log = e.select("lsn", F.when(F.col("kind") != "error", F.col("run_id")).alias("run_id"), F.coalesce(F.try_element_at(names, F.col("kind")), F.col("kind")).alias("kind"), F.when(F.col("kind") == "click", F.col("lsn")).otherwise(0).alias("audit_seq"), F.col("props").alias("payload"))
    return reads.audit_page(log, 1 << 40).select("lsn", "run_id", "kind")


@query
def q77_dag_retry(spark, d):
    """A script that fails for some, with three attempts, of which the run has made one to four."""
    graph = _graph([("start", "start"), ("risky", "script", {"code": "input.k", "fails": "CASE WHEN input.k > 50 THEN concat('too large: ', input.k) END", "retry": {"max_attempts": 3, "backoff_ms": 10}}), ("end", "end")], [("start", "risky"), ("risky", "end")])
    runs = _event_inputs(spark, d).withColumn("attempts", F.create_map(F.lit("risky"), (F.col("run_id") % 4 + 1).cast("int")))
    return evaluate.run_batch(graph, runs).select("run_id", F.col("node_risky.status").alias("risky"), "run_status", "run_output", "run_error")


@query
def q78_dag_http_status(spark, d):
    """Pages as recorded replies: one in five is not found."""
    graph = _graph([("start", "start"), ("fetch", "http_call", {"url": "${input.url}"}), ("end", "end")], [("start", "fetch"), ("fetch", "end")])
    p = facts.table(spark, d, "pages")
    runs = p.select(F.col("page_id").alias("run_id"), F.struct("url").alias("input"), F.create_map(F.lit("fetch"), F.col("url")).alias("recorded"), F.create_map(F.lit("fetch"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)).alias("statuses"))
    return evaluate.run_batch(graph, runs).select("run_id", F.col("node_fetch.status").alias("fetch"), F.col("node_end.skip_reason").alias("end_reason"), "run_status", "run_output", "run_error")


@query
def q79_dag_llm_contract(spark, d):
    """Recorded model replies that must hold a k of at most 60."""
    graph = _graph([("start", "start"), ("ask", "llm", {"url": "u", "body": "b", "response_schema": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 60}}}}), ("end", "end")], [("start", "ask"), ("ask", "end")])
    e = facts.table(spark, d, "events")
    reply = F.when(F.col("event_type") == "error", "no json").when(F.col("event_type") == "signup", "{}").otherwise(F.col("props"))
    runs = e.select(F.col("event_id").alias("run_id"), F.struct("event_id").alias("input"), F.create_map(F.lit("ask"), reply).alias("recorded"))
    return evaluate.run_batch(graph, runs).select("run_id", "run_status", "run_output", "run_error")


@query
def q80_cancel_cascade(spark, d):
    """Orders as runs, each below the one of a quarter of its key; running ones are cancelled with all open ones below them."""
    o = _runs(spark, d)
    runs = o.select("run_id", "status", F.when(F.col("run_id") >= 4, F.floor(F.col("run_id") / 4)).alias("parent_id"))
    return assembly.cancel_cascade(o.filter("status = 'running'").select("run_id"), runs).withColumn("depth", F.col("depth").cast("long"))


@query
def q81_latest_published(spark, d):
    p = facts.table(spark, d, "part")
    return hierarchy.latest_published(p.select(F.col("p_brand").alias("workflow_id"), F.col("p_partkey").alias("version"), (F.col("p_size") % 3 == 0).alias("published"), F.col("p_name").alias("name")))


@query
def q82_freeze_dependencies(spark, d):
    """Nations as workflows of three versions, the last unpublished for one in three; a version calls others by its key and number."""
    n = facts.table(spark, d, "nation").select(F.col("n_nationkey").alias("workflow_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("version"))
    versions = n.withColumn("published", (F.col("version") < 3) | (F.col("workflow_id") % 3 != 0))
    calls = n.select("workflow_id", "version", (F.col("workflow_id") * 2 + F.col("version") % 2 + 1).alias("child")).filter("child < 25")
    roots = n.select(F.col("workflow_id").alias("root")).distinct()
    return hierarchy.freeze_dependencies(versions, calls, roots)[0].select("root", "node", "version", F.col("depth").cast("long").alias("depth"))


@query
def q83_approval_status(spark, d):
    """Orders' approvals, pending where the priority is odd, as they are shown."""
    approvals = facts.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.substring("o_orderpriority", 1, 1).cast("int") % 2 == 1, "pending").otherwise("allowed").alias("state"))
    return assembly.approval_status(approvals, _runs(spark, d)).select("run_id", "shown")


@query
def q84_canonical_json(spark, d):
    body = F.concat(F.lit('{"z": '), "props", F.lit(', "a": {"y": [1, {"q": 2, "b": 3}], "c": "'), "kind", F.lit('"}}'))
    return _raw_facts(spark, d).select("lsn", F.sha2(values.canonical_json(body), 256).alias("digest"))


@query
def q85_redact_json(spark, d):
    body = F.concat(F.lit('{"user_token": "t'), F.col("lsn").cast("string"), F.lit('", "inner": {"Password": 12, "kind": "'), "kind", F.lit('"}}'))
    return _raw_facts(spark, d).select("lsn", text.redact_json_text(body).alias("shown"))


@query
def q86_policy_rules(spark, d):
    """Pages as requests of one or two specs, under the rules of two layers that are rows of a table."""
    empty = dict.fromkeys((x.split()[0] for x in policies.RULE.split(", ")))
    rule = lambda **k: tuple((empty | k).values())
    rules = spark.createDataFrame([
        rule(layer="plugin", id="any", action="net", ask=False, family="any"), rule(layer="plugin", id="note", action="email", ask=False, family="email", names=["a@x", "b@x"]),
        rule(layer="workflow", id="plain", action="net", ask=True, family="net", methods=["get"], url_prefix="http://ththre.example.com"), rule(layer="workflow", id="all", action="net", ask=False, family="net", methods=["GET"], url_prefix="https://m.ththth.example.net/en"),
        rule(layer="workflow", id="mail", action="email", ask=False, family="email", names=["a@x"]),
    ], policies.RULE)
    p = facts.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("request_id"), "page_id", "url")
    none = lambda kind: F.lit(None).cast(kind)
    rest = lambda **k: [k.get(name, none(kind)).alias(name) for name, kind in (x.split(" ", 1) for x in policies.SPEC.split(", ")) if name != "request_id"]
    specs = p.select("request_id", *rest(spec=F.lit(0), action=F.lit("net"), mutating=F.lit(False), method=F.lit("GET"), url=F.col("url")))
    mails = p.filter("page_id % 3 = 0").select("request_id", *rest(spec=F.lit(1), action=F.lit("email"), mutating=F.lit(True), recipients=F.array(F.when(F.col("page_id") % 2 == 0, "a@x").otherwise("b@x"))))
    out = policies.check_requests(p, specs.unionByName(mails), rules, ["plugin", "workflow"])
    return out.select(F.col("request_id").cast("long").alias("page_id"), "decision", F.array_join("matched", ",").alias("matched"))


@query
def q87_cron_fire(spark, d):
    """Each fact as a tick of its run's schedule, active from the day after its first one, that has fired at the tick before."""
    run = Window.partitionBy("run_id")
    at = F.col("ts").cast("timestamp_ntz")
    ticks = _raw_facts(spark, d).select("lsn", "run_id", at.alias("at"), F.min(at).over(run).alias("first"), F.lag(cron.previous_slot("30 */6 * * *", at)).over(run.orderBy("lsn")).alias("last"))
    slot = cron.due_slot("30 */6 * * *", F.col("at"), F.col("first") + F.expr("interval 1 day"), F.col("last"))
    return ticks.select("lsn", F.date_format(slot, "yyyy-MM-dd HH:mm:ss").alias("slot"))


@query
def q88_key_parts(spark, d):
    e = _raw_facts(spark, d)
    body = F.concat(F.lit('{"status": "'), "kind", F.lit('", "name": null, "workflow_id": "'), F.col("run_id").cast("string"), F.lit('"}'))
    key = F.when(F.col("lsn") % 2 == 0, F.to_json(F.array(F.col("run_id").cast("string"), F.col("kind")))).otherwise(F.to_json(F.array(F.col("run_id").cast("string"))))
    rows = reads.body_columns(e.select("lsn", key.alias("key"), body.alias("body")))
    return rows.select("lsn", reads.key_parts(F.col("key"))["parent"].alias("parent"), reads.key_parts(F.col("key"))["slot"].alias("slot"), "workflow_id", "status", "name")


@query
def q89_depth_limit(spark, d):
    """Values that nest as deep as their k says."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _raw_facts(spark, d).select("lsn", contracts.too_deep(F.concat(F.repeat(F.lit("["), k), F.lit('"[[["'), F.repeat(F.lit("]"), k))).alias("too_deep"))


@query
def q90_template_objects(spark, d):
    """Arrays and structs within text are written as JSON."""
    columns = {"input.kinds": F.array("kind", F.lit("x")), "input.who": F.struct(F.col("run_id").alias("id"), F.lit(None).cast("string").alias("name"))}
    return _raw_facts(spark, d).select("lsn", values.template("${input.kinds} by ${input.who}", columns).alias("written"))


@query
def q91_recent_receipts(spark, d):
    """The receipts that a store of 64 still holds."""
    return fold.recent_receipts(_raw_facts(spark, d).select("lsn", "run_id", "kind"), "lsn", 64)


@query
def q92_fold_approvals(spark, d):
    """Views ask, purchases allow and errors deny, user by user."""
    names = F.when(F.col("kind") == "view", "permission_asked").when(F.col("kind").isin("purchase", "error"), "permission_decided")
    log = _raw_facts(spark, d).select("run_id", "lsn", names.alias("kind"), F.when(F.col("kind") == "purchase", "allow").when(F.col("kind") == "error", "deny").alias("decision")).filter("kind is not null")
    return fold.fold_approvals(log, ["run_id"], "lsn")


@query
def q93_workflow_assembly(spark, d):
    """Brands as workflows and parts of a size as versions."""
    p = facts.table(spark, d, "part").groupBy(F.col("p_brand").alias("workflow_id"), F.col("p_size").alias("version")).agg(F.max("p_name").alias("body"), (F.max("p_partkey") % 2 == 0).alias("published"))
    out = assembly.assemble_workflows(p.select("workflow_id").distinct(), p)
    return out.select("workflow_id", F.array_join(F.transform(F.map_entries("versions"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("versions"), "latest", "published_version")


@query
def q94_run_attempts_assembly(spark, d):
    """Orders as runs with their lines as nodes, and lines of one number as attempts."""
    a = facts.line_nodes(facts.table(spark, d, "lineitem"))
    nodes = a.groupBy("run_id", "node_id").agg(F.max_by("status", "attempt").alias("status"))
    out = assembly.assemble_runs(_runs(spark, d).select("run_id"), nodes, a)
    line = lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"]["status"], F.lit("("), F.array_join(x["value"]["attempts"], "|"), F.lit(")"))
    return out.select("run_id", F.array_join(F.transform(F.map_entries("nodes"), line), ",").alias("nodes"))


@query
def q95_start_refusals(spark, d):
    """Suppliers as nodes of their nations' workflows: which may not start for want of permissions or grants."""
    s = facts.table(spark, d, "supplier")
    nodes = s.select(F.col("s_nationkey").alias("workflow_id"), F.col("s_suppkey").alias("node_id"), F.when(F.col("s_suppkey") % 3 == 0, "http_call").otherwise("script").alias("type"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("p"), (F.col("s_suppkey") % 2).cast("string"))).alias("plugin_id"))
    n = facts.table(spark, d, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("workflow_id"), F.when(F.col("n_regionkey") == 2, "bypass").otherwise("normal").alias("mode"))
    return policies.start_refusals(nodes, n, spark.createDataFrame([("p0",)], "plugin_id string"), ("http_call", "harness", "email", "llm"))


def _order_tree(spark, d) -> DataFrame:
    """Orders as runs, each below the one of a quarter of its key, begun by one of four nodes."""
    key = F.col("o_orderkey")
    return facts.table(spark, d, "orders").select(key.alias("run_id"), F.when(key >= 4, F.floor(key / 4)).alias("parent_id"), (key % 4).alias("parent_node"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", -5).alias("size"))


@query
def q96_compare_run_trees(spark, d):
    """The orders of even root keys against those of the next root, run by run down the tree."""
    runs = _order_tree(spark, d)
    pairs = differences.run_pairs(runs, runs, spark.createDataFrame([(1, 1, 2), (2, 2, 3)], "pair_id int, b_run long, c_run long"))
    nodes = runs.withColumn("node", F.col("parent_node"))
    out = differences.compare_run_trees(pairs, nodes, nodes, "node", ["status", "size"])
    return out.select("pair_id", "path", "node", "verdict", "changed")


@query
def q97_collect_fixtures(spark, d):
    """What the lines of three orders and of all orders below them were, a line of each part of the tree being overridden."""
    runs = _order_tree(spark, d)
    outcomes = facts.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node_id")).agg(F.max("l_partkey").cast("string").alias("fingerprint"), F.max("l_returnflag").alias("outcome"))
    over = spark.createDataFrame([(1, "/1", "own", "X"), (2, "/0/2", None, "Y")], "root long, path string, fingerprint string, outcome string")
    return differences.collect_fixtures(runs, outcomes, spark.createDataFrame([(1,), (2,), (3,)], "root long"), over, most_runs=1 << 30)


@query
def q98_run_stats_of_workflow(spark, d):
    return rollups.run_stats(_runs(spark, d), 1)


@query
def q99_log_losses(spark, d):
    """Documents as the lines of a bounded log of each source."""
    docs = facts.table(spark, d, "documents")
    return retention.losses(docs, ["source"], "doc_id", F.octet_length("text"), 50_000, 3000)


@query
def q100_verify_transactions(spark, d):
    """Orders as transactions of their lines: sound but for each tenth's count and each eleventh's digest."""
    line = facts.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("lsn"), F.col("l_linenumber").alias("n")).agg(F.sha2(F.max("l_partkey").cast("string"), 256).alias("digest"))
    events = line.select("lsn", (F.row_number().over(Window.partitionBy("lsn").orderBy("n")) - 1).alias("event_index"), "digest")
    per = events.groupBy("lsn").agg(F.count("*").alias("n_events"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
    link = F.sha2(F.col("lsn").cast("string"), 256)
    prev = lambda n: F.when(F.col("lsn") == 1, "").otherwise(F.sha2((F.col("lsn") - n).cast("string"), 256))
    tx = per.select("lsn", F.when(F.col("lsn") % 10 == 0, F.col("n_events") + 1).otherwise(F.col("n_events")).alias("n_events"), F.when(F.col("lsn") % 11 == 0, "x").otherwise(F.col("digest")).alias("digest"), prev(1).alias("prev_digest"), link.alias("chain_digest"))
    return integrity.verify_transactions(tx, events).filter("problem <> 'chain'").groupBy("problem").agg(F.count("*").alias("n"))
