"""For each query the SQL that gives the same rows in DuckDB on the same tables."""

_FACTS = "facts AS (SELECT event_id + 1 AS lsn, user_id AS run_id, event_type AS kind, ts, value, props FROM events)"
_RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS workflow_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'awaiting_resume' END AS status,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'manual' WHEN '2' THEN 'schedule' WHEN '3' THEN 'webhook' ELSE 'sub_workflow' END AS source, o_orderdate AS created_at FROM orders)"""
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_RATE = "round(CASE WHEN count(*) FILTER ({t}) > 0 THEN CAST(count(*) FILTER ({s}) AS DOUBLE) / count(*) FILTER ({t}) END, 9)"
_DIFF_BEFORE = "SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 5 <> 0"
_DIFF_AFTER = "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0"
_DEFINITION_DIFF = f"""SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey,
    CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' WHEN b.p_brand IS DISTINCT FROM a.p_brand OR b.p_size IS DISTINCT FROM a.p_size THEN 'changed' ELSE 'same' END AS verdict,
    CASE WHEN b.p_partkey IS NULL OR a.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.p_brand IS DISTINCT FROM a.p_brand THEN 'p_brand' END, CASE WHEN b.p_size IS DISTINCT FROM a.p_size THEN 'p_size' END) END AS changed
    FROM ({_DIFF_BEFORE}) b FULL JOIN ({_DIFF_AFTER}) a ON a.p_partkey = b.p_partkey"""
_FOLD = f"""WITH {_FACTS}, e AS (SELECT run_id, min(lsn) AS ended_at, arg_min(kind, lsn) AS kind FROM facts WHERE kind IN ('purchase', 'error') GROUP BY run_id)
    SELECT f.run_id, count(*) AS n_facts, max(lsn) AS last_at, coalesce(CASE any_value(e.kind) WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' END, 'running') AS status, any_value(e.ended_at) AS ended_at
    FROM facts f LEFT JOIN e ON e.run_id = f.run_id GROUP BY f.run_id"""
_PRICE = "o_totalprice > 200000"
_TEXT = "regexp_replace(html, '<[^>]*>', '', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_name}', '{_char}')"
_TEXT = rf"trim(regexp_replace({_TEXT}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_SENSITIVE = "authorization|cookie|token|password|secret|api_key|apikey"
_HTTPS_EN = "regexp_matches(url, '^https://m\\.ththth\\.example\\.net(:443)?/en([/?#]|$)')"

ORACLE_SQL = {
    "q01_run_counts": f"WITH {_RUNS} SELECT workflow_id, status, count(*) AS n_runs FROM runs GROUP BY 1, 2",
    "q02_run_stats_rollup": f"WITH {_RUNS} SELECT workflow_id, status, count(*) AS n_runs, CAST(grouping(workflow_id, status) AS BIGINT) AS level FROM runs GROUP BY CUBE (workflow_id, status)",
    "q03_success_rate": f"SELECT user_id AS run_id, {_RATE.format(t="WHERE event_type IN ('purchase', 'error')", s="WHERE event_type = 'purchase'")} AS rate FROM events GROUP BY 1",
    "q04_per_workflow_rates": f"WITH {_RUNS} SELECT workflow_id, count(*) AS total, count(*) FILTER (WHERE status IN ('running', 'awaiting_resume')) AS active, {_RATE.format(t="WHERE status IN ('succeeded', 'failed', 'cancelled')", s="WHERE status = 'succeeded'")} AS rate FROM runs GROUP BY 1",
    "q05_child_pick_min": "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS picked FROM lineitem GROUP BY 1, 2",
    "q06_byte_sums": "SELECT source, count(*) AS n, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "q07_fact_runseq": f"WITH {_FACTS} SELECT lsn, run_id, row_number() OVER (PARTITION BY run_id ORDER BY lsn) AS run_seq FROM facts",
    "q08_seq_contiguity": f"""WITH {_FACTS}, n AS (SELECT lsn, run_id, kind, row_number() OVER (PARTITION BY run_id ORDER BY lsn) AS run_seq FROM facts),
        g AS (SELECT run_id, lsn, run_seq, lag(run_seq, 1, 0) OVER (PARTITION BY run_id ORDER BY run_seq) + 1 AS expected FROM n WHERE kind <> 'view') SELECT * FROM g WHERE run_seq <> expected""",
    "q09_current_state_latest": f"WITH {_FACTS} SELECT run_id, lsn, kind, props FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lsn DESC) AS n FROM facts) WHERE n = 1",
    "q10_fold_status_terminal_first": _FOLD,
    "q11_attempt_ledger": """SELECT l_orderkey AS run_id, l_linenumber AS node_id, count(*) AS attempts, arg_max(l_partkey, n) AS current_part FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) GROUP BY 1, 2""",
    "q12_command_first_receipt": f"WITH {_FACTS} SELECT run_id, kind, min(lsn) AS first_at, arg_min(props, lsn) AS receipt, count(*) AS n_commands, min(props) <> max(props) AS conflict FROM facts GROUP BY 1, 2",
    "q13_runs_keyset_page": f"""WITH {_RUNS}, s AS (SELECT * FROM runs WHERE status = 'succeeded'), c AS (SELECT created_at, run_id FROM s WHERE run_id = (SELECT max(run_id) FROM s))
        SELECT run_id, workflow_id, status, source FROM s WHERE (created_at, run_id) < (SELECT (created_at, run_id) FROM c) ORDER BY created_at DESC, run_id DESC LIMIT 50""",
    "q14_list_byte_budget": """WITH p AS (SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE doc_id > 20 ORDER BY doc_id LIMIT 256),
        r AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY doc_id) AS BIGINT) AS running_bytes, row_number() OVER (ORDER BY doc_id) AS n FROM p) SELECT doc_id, bytes, running_bytes FROM r WHERE running_bytes <= 100000 OR n = 1""",
    "q15_events_page_filtered": f"WITH {_FACTS} SELECT lsn, run_id, kind, props FROM facts WHERE lsn > 100 AND lsn <= 900 AND kind IN ('purchase', 'error') ORDER BY lsn LIMIT 256",
    "q16_active_runs": f"WITH {_RUNS} SELECT run_id, workflow_id, status FROM runs WHERE status IN ('running', 'awaiting_resume') AND run_id > 500",
    "q17_public_event_projection": f"WITH {_FACTS} SELECT lsn, run_id, kind, CASE kind WHEN 'error' THEN 'EXECUTION_FAILED' WHEN 'purchase' THEN printf('%.2f', value) ELSE '' END AS shown FROM facts WHERE kind IN ('purchase', 'signup', 'error')",
    "q18_size_guard": "SELECT doc_id, sha256(CASE WHEN octet_length(encode(text)) <= 2000 THEN text ELSE 'RESPONSE_TOO_LARGE' END) AS shown FROM documents",
    "q19_timeline_left_join": "SELECT p_partkey AS node_id, p_partkey AS ordinal, p_name AS name, n_lines, max_quantity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines, max(l_quantity) AS max_quantity FROM lineitem GROUP BY 1) ON l_partkey = p_partkey",
    "q20_current_attempt_semi": "SELECT l_orderkey AS run_id, count(*) AS n_attempts, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "q21_run_assembly_nested": """SELECT o_orderkey AS run_id, o_custkey AS workflow_id, coalesce(nodes, '') AS nodes FROM orders LEFT JOIN (
        SELECT l_orderkey, string_agg(l_linenumber || '=' || f, ',' ORDER BY l_linenumber) AS nodes FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1) ON l_orderkey = o_orderkey""",
    "q22_approvals_sorted": f"WITH {_RUNS} SELECT run_id, CASE WHEN source <> 'sub_workflow' THEN epoch_us(created_at) END AS deadline FROM runs WHERE status IN ('running', 'awaiting_resume') ORDER BY deadline NULLS LAST, run_id",
    "q23_latency_percentiles": "SELECT event_type AS kind, count(value) AS n, min(value) AS min_value, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max_value, round(avg(value), 6) AS mean_value FROM events GROUP BY 1",
    "q24_capacity_summary": """WITH s AS (SELECT user_id AS run_id, list_sort(list(value)) AS v, count(value) AS n FROM events GROUP BY 1)
        SELECT run_id, v[(n - 1) // 2 + 1] AS p50, v[(n * 95 + 99) // 100] AS p95, v[least(n * 99 // 100, n - 1) + 1] AS p99_floor FROM s""",
    "q25_run_progress": "SELECT l_orderkey AS run_id, count(*) AS total, count(*) FILTER (WHERE l_linestatus <> 'O') AS done FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1",
    "q26_run_elapsed": "SELECT user_id AS run_id, greatest(0, epoch_us(max(ts)) - epoch_us(min(ts))) AS elapsed_us FROM events GROUP BY 1",
    "q27_dag_linear": f"SELECT event_id AS run_id, 'succeeded' AS run_status, CAST({_K} * 2 + 1 AS VARCHAR) AS run_output FROM events",
    "q28_dag_condition": f"""SELECT o_orderkey AS run_id, CASE WHEN {_PRICE} THEN 'succeeded' ELSE 'skipped' END AS yes, CASE WHEN {_PRICE} THEN 'inactive' END AS no_reason, 'succeeded' AS run_status,
        CASE WHEN {_PRICE} THEN '"large"' ELSE '"small"' END AS run_output FROM orders""",
    "q29_dag_join_selected": f"""SELECT o_orderkey AS run_id, 'succeeded' AS merge, 'succeeded' AS run_status, CASE WHEN {_PRICE} THEN '"large"' ELSE '"small"' END AS run_output FROM orders""",
    "q30_dag_join_all_v1": f"SELECT o_orderkey AS run_id, CASE WHEN {_PRICE} THEN 'branch_not_taken' END AS no_reason, 'upstream_skipped' AS merge_reason, 'upstream_skipped' AS end_reason, 'succeeded' AS run_status FROM orders",
    "q31_dag_failure_isolation": """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS risky, CASE WHEN o_orderstatus = 'F' THEN 'upstream_failed' END AS end_a_reason,
        CAST(o_orderkey + 1 AS VARCHAR) AS end_b, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS run_status, CASE WHEN o_orderstatus = 'F' THEN 'flagged' END AS run_error FROM orders""",
    "q32_dag_multi_end": f"""SELECT event_id AS run_id, '{{"end_a":' || {_K} || ',"end_b":"' || event_type || '"}}' AS run_output FROM events""",
    "q33_dag_subworkflow": """SELECT o_orderkey AS run_id, c_mktsegment, 'succeeded' AS run_status, CASE WHEN o_custkey <= 500 THEN '"old"' ELSE '"new"' END AS run_output FROM orders JOIN customer ON c_custkey = o_custkey""",
    "q34_dag_input_node": """SELECT event_id AS run_id, CASE WHEN event_type = 'view' THEN 'waiting' ELSE 'succeeded' END AS ask, CASE WHEN event_type = 'view' THEN 'running' ELSE 'succeeded' END AS run_status,
        CASE WHEN event_type <> 'view' THEN '{"k":' || json_extract_string(props, '$.k') || ',"note":"' || CASE WHEN event_type = 'click' THEN 'clicked' ELSE 'none' END || '"}' END AS run_output FROM events""",
    "q35_topo_reachability": """WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
        w(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT root, c, depth + 1 FROM w JOIN edges ON p = node) SELECT root, CAST(depth AS BIGINT) AS depth, count(DISTINCT node) AS n_nodes FROM w GROUP BY 1, 2""",
    "q36_dependency_closure": """WITH RECURSIVE edges AS (SELECT n_nationkey AS p, CAST(n_nationkey * 2 + k AS INTEGER) AS c FROM nation, (VALUES (1), (2)) t(k) WHERE n_nationkey * 2 + k < 25),
        w(root, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT root, c, depth + 1 FROM w JOIN edges ON p = node) SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY 1, 2""",
    "q37_compare_runs": """WITH g AS (SELECT o_orderstatus AS f, o_custkey || '|' || o_orderpriority AS node, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1, 2), b AS (SELECT * FROM g WHERE f = 'F'), a AS (SELECT * FROM g WHERE f = 'O')
        SELECT coalesce(b.node, a.node) AS node, CASE WHEN b.node IS NULL THEN 'added' WHEN a.node IS NULL THEN 'removed' WHEN b.n <> a.n OR b.last <> a.last THEN 'changed' ELSE 'same' END AS verdict,
        CASE WHEN b.node IS NULL OR a.node IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.n <> a.n THEN 'n' END, CASE WHEN b.last <> a.last THEN 'last' END) END AS changed FROM b FULL JOIN a ON a.node = b.node""",
    "q38_projection_check": """WITH r AS (SELECT user_id AS run_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1), s AS (SELECT run_id, CASE WHEN run_id % 7 = 0 THEN 'view' ELSE kind END AS kind FROM r WHERE run_id % 10 <> 0)
        SELECT r.run_id, CASE WHEN s.run_id IS NULL THEN 'missing' ELSE 'differs' END AS difference, r.kind AS replayed, s.kind AS stored FROM r LEFT JOIN s ON s.run_id = r.run_id WHERE s.run_id IS NULL OR s.kind <> r.kind""",
    "q39_definition_diff": _DEFINITION_DIFF,
    "q40_anti_join_rerank": """SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_custkey, c_name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000)""",
    "q41_hash_chain_links": f"""WITH {_FACTS}, g AS (SELECT lsn, run_id, sha256(concat_ws('|', lsn, kind, props)) AS digest FROM facts), p AS (SELECT *, lag(digest, 1, '') OVER (PARTITION BY run_id ORDER BY lsn) AS prev_digest FROM g)
        SELECT lsn, run_id, prev_digest, sha256(prev_digest || digest) AS link FROM p""",
    "q42_cron_latest_slot": f"""WITH {_FACTS}, days AS (SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series((SELECT CAST(min(ts) AS DATE) - 10 FROM facts)::TIMESTAMP, (SELECT max(ts) FROM facts)::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
        slots AS (SELECT d + INTERVAL (h) HOUR + INTERVAL (m) MINUTE AS slot FROM days, generate_series(8, 17) hs(h), (VALUES (0), (15), (30), (45)) ms(m) WHERE dayofweek(d) BETWEEN 1 AND 5)
        SELECT lsn, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot FROM facts ASOF JOIN slots ON facts.ts >= slots.slot""",
    "q43_slot_dedupe": f"WITH {_FACTS} SELECT run_id, strftime(ts, '%Y-%m-%d') AS slot, min(lsn) AS fired_by, count(*) - 1 AS conflicts FROM facts GROUP BY 1, 2",
    "q44_policy_layers": f"SELECT page_id, CASE WHEN regexp_matches(url, '^http://ththre\\.example\\.com(:80)?([/?#]|$)') THEN 'ask' WHEN {_HTTPS_EN} THEN 'allow' ELSE 'deny' END AS decision FROM pages",
    "q45_url_prefix_match": f"SELECT page_id, {_HTTPS_EN} AS https_en, regexp_matches(url, '^http://ththre\\.example\\.com(:80)?([/?#]|$)') AS http_any FROM pages",
    "q46_capability_covers": f"""WITH {_FACTS}, k AS (SELECT DISTINCT run_id, kind, CASE run_id % 3 WHEN 0 THEN true WHEN 1 THEN kind IN ('click', 'view', 'signup') ELSE kind IN ('error', 'purchase') END AS held FROM facts)
        SELECT run_id, bool_and(held) AS covered, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (WHERE NOT held), '') AS lacking FROM k GROUP BY 1""",
    "q47_truthy_eval": f"WITH {_FACTS} SELECT lsn, coalesce({_K} % 3 <> 0, false) AS t_int, kind <> 'view' AS t_text, true AS t_object, coalesce(floor(value) <> 10, false) AS t_double FROM facts",
    "q48_template_interpolate": f"WITH {_FACTS} SELECT lsn, run_id AS whole, 'user ' || run_id || ' did ' || kind || ': ' || CASE WHEN kind = 'click' THEN 'yes' ELSE 'null' END AS written FROM facts",
    "q49_redact_url_params": f"SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_key=k' || page_id || '&q=1#access_token=t', '([?&#][^=&#]*({_SENSITIVE})[^=&#]*=)[^&#]*', '\\1***', 'gi') AS url FROM pages",
    "q50_html_to_text": f"SELECT page_id, sha256({_TEXT}) AS text_sha256, length({_TEXT}) AS n_chars FROM pages",
    "q51_href_extract": """SELECT page_id, len(h) AS n_links, array_to_string(h, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""",
    "q52_fingerprint_canonical": f"""WITH {_FACTS} SELECT lsn, sha256('{{"at":"' || lsn || '","kind":"' || kind || '","user":"' || run_id || '"}}') AS fingerprint FROM facts""",
    "q53_json_response_shape": f"WITH {_FACTS} SELECT lsn, CASE WHEN kind = 'error' THEN 'text' ELSE 'json' END AS shape, CASE WHEN kind = 'error' THEN '<' || props ELSE json_extract_string(props, '$.k') END AS content FROM facts",
    "q54_schema_validate": f"""WITH {_FACTS} SELECT lsn, CASE WHEN lsn % 13 = 0 THEN '$.kind: required property missing' WHEN {_K} < 10 OR {_K} > 90 THEN '$.k: number outside bounds'
        WHEN kind NOT IN ('click', 'view', 'error') THEN '$.kind: value is outside enum' WHEN lsn % 11 = 0 THEN '$.note: more than maxLength' END AS violation FROM facts""",
    "q55_grep_lines": "SELECT doc_id, line, sha256(m) AS match_sha256 FROM (SELECT doc_id, unnest(l) AS m, unnest(generate_series(1, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(m, '(?i)licen[cs]e')",
    "q56_session_stats": """WITH m AS (SELECT *, coalesce(max(turn) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id), -1) AS mark FROM conversations),
        l AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m WHERE turn > mark)
        SELECT conv_id, count(*) AS n_live, count(DISTINCT island) AS n_groups, CAST(sum(octet_length(encode(text))) AS BIGINT) AS live_bytes, round(CAST(count(*) FILTER (WHERE role = 'user') AS DOUBLE) / count(*), 9) AS head_rate, max(mark) AS last_mark FROM l GROUP BY 1""",
    "q57_log_budget": f"""WITH {_FACTS}, r AS (SELECT run_id, lsn, kind, kind IN ('view', 'click') AS minor, row_number() OVER (PARTITION BY run_id, kind IN ('view', 'click') ORDER BY lsn) AS n FROM facts),
        k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lsn) AS a FROM r WHERE NOT minor OR n <= 10) SELECT run_id, lsn, kind FROM k WHERE a <= 30""",
    "q58_retention_suffix": "SELECT * FROM (SELECT source, doc_id, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_bytes FROM documents) WHERE running_bytes <= 50000",
    "q59_chunk_reassembly": "SELECT doc_id, greatest(1, (octet_length(encode(text)) + 1023) // 1024) AS chunk_count, octet_length(encode(text)) AS total_bytes, sha256(text) AS value_digest, true AS whole FROM documents",
    "q60_stream_fold_equals_batch": _FOLD,
    "q61_fold_nodes": """SELECT l_orderkey AS run_id, l_linenumber AS node_id, CASE f WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'succeeded' END AS status, CASE f WHEN 'R' THEN 2 ELSE 1 END::BIGINT AS attempt, CASE f WHEN 'A' THEN 1 ELSE 0 END::BIGINT AS n_rejected
        FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)""",
    "q62_late_facts": f"""WITH {_FACTS}, s AS (SELECT run_id, min(lsn) AS sealed FROM facts WHERE kind IN ('purchase', 'error') GROUP BY 1) SELECT f.run_id, kind, count(*) AS n_late FROM facts f JOIN s ON s.run_id = f.run_id WHERE lsn > sealed GROUP BY 1, 2""",
    "q63_display_states": f"""WITH {_RUNS}, w AS (SELECT CASE WHEN status = 'awaiting_resume' THEN 'waiting' WHEN source <> 'manual' THEN status END AS status, CASE source WHEN 'schedule' THEN 'retry' WHEN 'webhook' THEN 'delay' END AS wait FROM runs)
        SELECT CASE WHEN status = 'succeeded' THEN 'completed' WHEN status = 'waiting' AND wait = 'retry' THEN 'retrying' WHEN status = 'waiting' THEN 'running' WHEN status IS NULL THEN 'pending' ELSE status END AS shown, count(*) AS n FROM w GROUP BY 1""",
    "q65_log_levels": f"""WITH {_FACTS}, l AS (SELECT lower(concat_ws(' ', kind, CASE WHEN lsn % 5 = 0 THEN 'Retry' WHEN lsn % 7 = 0 THEN 'DEBUG' END)) AS x FROM facts)
        SELECT CASE WHEN contains(x, 'fail') OR contains(x, 'error') THEN 'error' WHEN contains(x, 'warn') OR contains(x, 'retry') THEN 'warn' WHEN contains(x, 'debug') THEN 'debug' ELSE 'info' END AS level, count(*) AS n FROM l GROUP BY 1""",
    "q67_bounded_report": f"SELECT p_partkey, verdict, changed, (SELECT count(*) FROM ({_DEFINITION_DIFF}) WHERE verdict <> 'same') > 64 AS truncated FROM ({_DEFINITION_DIFF}) WHERE verdict <> 'same' ORDER BY p_partkey LIMIT 64",
    "q68_effective_permissions": """WITH g AS (SELECT c_nationkey, c_mktsegment, bool_or(c_acctbal > 9900) AS ask FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2)
        SELECT c_custkey, CASE WHEN g.ask IS NULL THEN 'not_granted_by_workflow' WHEN g.ask OR c_acctbal < 0 THEN 'requires_approval' ELSE 'auto' END AS derived FROM customer c LEFT JOIN g ON g.c_nationkey = c.c_nationkey AND g.c_mktsegment = c.c_mktsegment""",
    "q69_line_range": "SELECT doc_id, sha256(coalesce(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), '')) AS lines FROM documents",
    "q70_running_window": f"WITH {_FACTS} SELECT lsn, round(sum(value) OVER (PARTITION BY run_id ORDER BY lsn ROWS UNBOUNDED PRECEDING), 4) AS running, rank() OVER (PARTITION BY run_id ORDER BY kind) AS kind_rank FROM facts",
    "q64_truncate_text": """WITH t AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents)
        SELECT doc_id, sha256(CASE WHEN n > 500 THEN left(text, CAST(list_max(list_filter(generate_series(0, 500), lambda c: octet_length(encode(left(text, c))) <= 500)) AS BIGINT)) || '~' ELSE text END) AS head,
        sha256(CASE WHEN n > 512 THEN '~' || right(text, CAST(list_max(list_filter(generate_series(0, 512), lambda c: octet_length(encode(right(text, c))) <= 512)) AS BIGINT)) ELSE text END) AS tail FROM t""",
    "q66_entity_digest": f"""WITH {_FACTS}, p AS (SELECT lsn, [kind, CAST(run_id AS VARCHAR), props] AS parts FROM facts)
        SELECT lsn, sha256(unhex(array_to_string(list_transform(parts, lambda x: printf('%02x%02x', octet_length(encode(x)) % 256, octet_length(encode(x)) // 256) || '000000000000' || hex(encode(x))), ''))) AS digest FROM p""",
    "q71_fold_run_rules": f"""WITH {_FACTS}, m AS (SELECT run_id, lsn, kind, CASE WHEN kind = 'click' THEN 1 ELSE 0 END - coalesce(lag(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, {_K} % 3 ORDER BY lsn), 0) AS step FROM facts WHERE kind IN ('click', 'view')),
        a AS (SELECT f.run_id, f.lsn, f.kind, coalesce(m.step, 0) AS step FROM facts f LEFT JOIN m ON m.lsn = f.lsn), w AS (SELECT *, sum(step) OVER (PARTITION BY run_id ORDER BY lsn) AS waits FROM a),
        e AS (SELECT run_id, min(lsn) AS ended_at, arg_min(kind, lsn) AS how FROM w WHERE kind = 'signup' OR kind IN ('purchase', 'error') AND waits = 0 GROUP BY 1)
        SELECT w.run_id, coalesce(CASE any_value(how) WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' END, CASE WHEN arg_max(waits, lsn) > 0 THEN 'awaiting_resume' ELSE 'running' END) AS status, any_value(ended_at) AS ended_at,
        count(*) FILTER (WHERE CASE WHEN lsn > ended_at THEN kind = 'purchase' ELSE kind IN ('purchase', 'error') AND waits > 0 END) AS n_rejected FROM w LEFT JOIN e ON e.run_id = w.run_id GROUP BY w.run_id""",
    "q72_fold_operations": f"""WITH RECURSIVE {_FACTS}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lsn) AS n FROM facts),
        s(run_id, n, ready, opened, fp, out_at, rejected) AS (SELECT DISTINCT run_id, 0::BIGINT, false, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, 0::BIGINT FROM facts UNION ALL
            SELECT s.run_id, o.n, ready OR kind = 'signup', CASE WHEN kind = 'error' THEN NULL WHEN kind = 'click' AND ready AND lsn % 10 <> 0 AND opened IS NULL THEN lsn ELSE opened END,
            CASE WHEN kind = 'error' THEN NULL WHEN kind = 'click' AND ready AND lsn % 10 <> 0 AND opened IS NULL THEN sha256(props) ELSE fp END,
            CASE WHEN kind = 'error' THEN NULL WHEN kind = 'purchase' AND opened IS NOT NULL AND out_at IS NULL THEN lsn ELSE out_at END,
            rejected + CASE WHEN kind = 'view' AND NOT ready OR kind = 'click' AND NOT (ready AND lsn % 10 <> 0 AND opened IS NULL) OR kind = 'purchase' AND NOT (opened IS NOT NULL AND out_at IS NULL) THEN 1 ELSE 0 END
            FROM s JOIN o ON o.run_id = s.run_id AND o.n = s.n + 1)
        SELECT run_id, CASE WHEN out_at IS NOT NULL THEN 'answered' WHEN opened IS NOT NULL THEN 'open' ELSE 'none' END AS state, opened AS authorized_at, fp AS fingerprint, out_at AS outcome_at, rejected AS n_rejected
        FROM s WHERE n = (SELECT max(n) FROM o WHERE o.run_id = s.run_id)""",
    "q73_fold_config": f"""WITH {_FACTS}, c AS (SELECT run_id, max(lsn) AS changed_at, arg_max(props, lsn) AS props, arg_max(kind, lsn) AS kind, max(lsn) FILTER (WHERE kind = 'error') AS cleared FROM facts WHERE kind <> 'purchase' GROUP BY 1)
        SELECT run_id, changed_at, props, (SELECT max(lsn) FROM facts f WHERE f.run_id = c.run_id AND f.kind = 'purchase' AND (cleared IS NULL OR f.lsn > cleared)) AS watermark FROM c WHERE kind <> 'error'""",
    "q74_fold_workflows": f"""WITH RECURSIVE {_FACTS}, t AS (SELECT *, count(*) FILTER (WHERE kind = 'view') OVER (PARTITION BY run_id ORDER BY lsn) AS nth, row_number() OVER (PARTITION BY run_id ORDER BY lsn) AS n FROM facts WHERE kind <> 'click'),
        v AS (SELECT run_id, n, kind, CASE WHEN kind = 'view' THEN CASE WHEN lsn % 7 = 0 THEN nth + 1 ELSE greatest(1, nth - run_id % 4) END WHEN kind = 'purchase' THEN lsn % 5 + 1 END AS version FROM t),
        s(run_id, n, made, versions, published, deleted, rejected) AS (SELECT DISTINCT run_id, 0::BIGINT, false, 0::BIGINT, NULL::BIGINT, false, 0::BIGINT FROM v UNION ALL
            SELECT s.run_id, v.n, made OR kind = 'signup', versions + CASE WHEN kind = 'view' AND made AND version = versions + 1 THEN 1 ELSE 0 END,
            CASE WHEN kind = 'purchase' AND made AND version <= versions THEN greatest(coalesce(published, 0), version) ELSE published END, deleted OR (kind = 'error' AND made),
            rejected + CASE kind WHEN 'signup' THEN made::INT WHEN 'view' THEN (NOT (made AND version = versions + 1))::INT WHEN 'purchase' THEN (NOT (made AND version <= versions))::INT ELSE 0 END
            FROM s JOIN v ON v.run_id = s.run_id AND v.n = s.n + 1)
        SELECT run_id, versions, published AS published_version, deleted, rejected AS n_rejected FROM s WHERE made AND n = (SELECT max(n) FROM v WHERE v.run_id = s.run_id)""",
    "q75_event_page_bytes": f"""WITH {_FACTS}, p AS (SELECT lsn, run_id, kind, octet_length(encode(props)) + 20 AS n FROM facts WHERE lsn > 100 AND lsn <= 900 ORDER BY lsn LIMIT 256),
        u AS (SELECT *, sum(n) OVER (ORDER BY lsn) AS upto, row_number() OVER (ORDER BY lsn) AS place FROM p) SELECT lsn, run_id, kind FROM u WHERE upto <= 2000 OR place = 1""",
    "q76_audit_page": f"""WITH {_FACTS}, l AS (SELECT lsn, CASE WHEN kind <> 'error' THEN run_id END AS run_id, CASE kind WHEN 'purchase' THEN 'permission_decided' WHEN 'error' THEN 'plugin_grant_upserted' ELSE kind END AS kind FROM facts WHERE kind IN ('click', 'purchase', 'error'))
        SELECT lsn, run_id, kind FROM l ORDER BY run_id NULLS LAST, lsn LIMIT 256""",
    "q77_dag_retry": f"""WITH r AS (SELECT event_id AS run_id, {_K} AS k, event_id % 4 + 1 AS made FROM events)
        SELECT run_id, CASE WHEN k <= 50 THEN 'succeeded' WHEN made < 3 THEN 'waiting' ELSE 'failed' END AS risky, CASE WHEN k <= 50 THEN 'succeeded' WHEN made < 3 THEN 'running' ELSE 'failed' END AS run_status,
        CASE WHEN k <= 50 THEN CAST(k AS VARCHAR) END AS run_output, CASE WHEN k > 50 AND made >= 3 THEN 'too large: ' || k END AS run_error FROM r""",
    "q78_dag_http_status": """SELECT page_id AS run_id, CASE WHEN page_id % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS fetch, CASE WHEN page_id % 5 = 0 THEN 'upstream_failed' END AS end_reason, CASE WHEN page_id % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS run_status,
        CASE WHEN page_id % 5 <> 0 THEN '{"status":200,"headers":{},"body":' || CAST(to_json(url) AS VARCHAR) || '}' END AS run_output, CASE WHEN page_id % 5 = 0 THEN 'HTTP status 404' END AS run_error FROM pages""",
    "q79_dag_llm_contract": f"""WITH e AS (SELECT event_id AS run_id, CASE WHEN event_type = 'error' THEN 'the reply is no JSON' WHEN event_type = 'signup' THEN 'response contract: $.k: required property missing' WHEN {_K} > 60 THEN 'response contract: $.k: number outside bounds' END AS run_error, {_K} AS k FROM events)
        SELECT run_id, CASE WHEN run_error IS NULL THEN 'succeeded' ELSE 'failed' END AS run_status, CASE WHEN run_error IS NULL THEN '{{"k":' || k || '}}' END AS run_output, run_error FROM e""",
    "q80_cancel_cascade": f"""WITH RECURSIVE {_RUNS}, w(root, run_id, depth) AS (SELECT run_id, run_id, 0 FROM runs WHERE status = 'running' UNION ALL SELECT root, r.run_id, depth + 1 FROM w JOIN runs r ON r.run_id >= 4 AND r.run_id // 4 = w.run_id WHERE r.status <> 'succeeded')
        SELECT root, run_id, CAST(depth AS BIGINT) AS depth FROM w WHERE depth > 0""",
    "q81_latest_published": "SELECT p_brand AS workflow_id, max(p_partkey) AS version, arg_max(p_name, p_partkey) AS name FROM part WHERE p_size % 3 = 0 GROUP BY 1",
    "q82_freeze_dependencies": """WITH RECURSIVE v AS (SELECT n_nationkey AS w, CASE WHEN n_nationkey % 3 <> 0 THEN 3 ELSE 2 END AS version FROM nation), e AS (SELECT w AS p, w * 2 + version % 2 + 1 AS c FROM v WHERE w * 2 + version % 2 + 1 < 25),
        x(root, node, depth) AS (SELECT w, w, 0 FROM v UNION SELECT root, c, depth + 1 FROM x JOIN e ON p = node), m AS (SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM x GROUP BY 1, 2) SELECT root, node, version, depth FROM m JOIN v ON w = node""",
    "q83_approval_status": f"WITH {_RUNS} SELECT run_id, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 2 = 0 THEN 'allowed' WHEN status = 'succeeded' THEN 'cancelled' ELSE 'pending' END AS shown FROM runs JOIN orders ON o_orderkey = run_id",
    "q84_canonical_json": f"""WITH {_FACTS} SELECT lsn, sha256('{{"a":{{"c":"' || kind || '","y":[1,{{"b":3,"q":2}}]}},"z":{{"k":' || {_K} || '}}}}') AS digest FROM facts""",
    "q85_redact_json": f"""WITH {_FACTS} SELECT lsn, '{{"user_token": "***", "inner": {{"Password": "***", "kind": "' || kind || '"}}}}' AS shown FROM facts""",
    "q86_policy_rules": f"""WITH p AS (SELECT page_id, regexp_matches(url, '^http://ththre\\.example\\.com(:80)?([/?#]|$)') AS plain, {_HTTPS_EN} AS en, page_id % 3 = 0 AS mail, page_id % 2 = 0 AS to_a FROM pages)
        SELECT page_id, CASE WHEN NOT (plain OR en) OR mail AND NOT to_a THEN 'deny' WHEN plain THEN 'ask' ELSE 'allow' END AS decision,
        concat_ws(',', 'plugin:any', CASE WHEN mail THEN 'plugin:note' END, CASE WHEN en THEN 'workflow:all' END, CASE WHEN mail AND to_a THEN 'workflow:mail' END, CASE WHEN plain THEN 'workflow:plain' END) AS matched FROM p""",
    "q87_cron_fire": f"""WITH {_FACTS}, s AS (SELECT lsn, run_id, ts, min(ts) OVER (PARTITION BY run_id) AS first, time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 30 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL 30 MINUTE AS slot FROM facts),
        l AS (SELECT *, lag(slot) OVER (PARTITION BY run_id ORDER BY lsn) AS last FROM s) SELECT lsn, CASE WHEN slot >= first + INTERVAL 1 DAY AND (last IS NULL OR slot > last) THEN strftime(slot, '%Y-%m-%d %H:%M:%S') END AS slot FROM l""",
    "q88_key_parts": f"WITH {_FACTS} SELECT lsn, CAST(run_id AS VARCHAR) AS parent, CASE WHEN lsn % 2 = 0 THEN kind END AS slot, CAST(run_id AS VARCHAR) AS workflow_id, kind AS status, NULL AS name FROM facts",
    "q89_depth_limit": f"WITH {_FACTS} SELECT lsn, {_K} > 64 AS too_deep FROM facts",
    "q90_template_objects": f"""WITH {_FACTS} SELECT lsn, '["' || kind || '","x"] by {{"id":' || run_id || ',"name":null}}' AS written FROM facts""",
    "q91_recent_receipts": f"WITH {_FACTS}, n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM facts) SELECT lsn, run_id, kind FROM facts, n WHERE lsn > (SELECT max(lsn) FROM facts) - CASE WHEN n <= 64 THEN n ELSE 32 + (n - 65) % 33 END",
    "q92_fold_approvals": f"""WITH {_FACTS}, a AS (SELECT run_id, min(lsn) AS asked_at FROM facts WHERE kind = 'view' GROUP BY 1), d AS (SELECT a.run_id, min(lsn) AS decided_at, arg_min(kind, lsn) AS kind FROM a JOIN facts f ON f.run_id = a.run_id AND lsn > asked_at AND kind IN ('purchase', 'error') GROUP BY 1)
        SELECT a.run_id, asked_at, CASE kind WHEN 'purchase' THEN 'allow' WHEN 'error' THEN 'deny' ELSE 'pending' END AS state, decided_at FROM a LEFT JOIN d ON d.run_id = a.run_id""",
    "q93_workflow_assembly": """WITH v AS (SELECT p_brand, p_size, max(p_name) AS body, max(p_partkey) % 2 = 0 AS published FROM part GROUP BY 1, 2)
        SELECT p_brand AS workflow_id, string_agg(p_size || '=' || body, ',' ORDER BY p_size) AS versions, max(p_size) AS latest, max(p_size) FILTER (WHERE published) AS published_version FROM v GROUP BY 1""",
    "q94_run_attempts_assembly": """WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'running' ELSE 'succeeded' END AS status,
            row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem),
        m AS (SELECT l_orderkey, l_linenumber, l_linenumber || ':' || arg_max(status, n) || '(' || string_agg(status, '|' ORDER BY n) || ')' AS node FROM a GROUP BY 1, 2)
        SELECT o_orderkey AS run_id, coalesce(string_agg(node, ',' ORDER BY l_linenumber), '') AS nodes FROM orders LEFT JOIN m ON l_orderkey = o_orderkey GROUP BY 1""",
    "q95_start_refusals": """WITH s AS (SELECT s_nationkey AS workflow_id, s_suppkey AS node_id, s_suppkey % 3 = 0 AS outside, CASE WHEN s_suppkey % 5 = 0 THEN 'p' || s_suppkey % 2 END AS plugin, n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        t AS (SELECT workflow_id, node_id, CASE WHEN r = 1 THEN CASE WHEN outside OR plugin IS NOT NULL THEN 'no permissions' END WHEN r <> 2 AND plugin = 'p1' THEN 'plugin not granted' END AS reason FROM s) SELECT * FROM t WHERE reason IS NOT NULL""",
    "q96_compare_run_trees": """WITH RECURSIVE t AS (SELECT o_orderkey AS k, o_orderkey // 4 AS p, o_orderkey % 4 AS node, o_orderstatus AS status, round(o_totalprice, -5) AS size FROM orders),
        w(pair_id, path, b, c) AS (SELECT * FROM (VALUES (1, '', 1::BIGINT, 2::BIGINT), (2, '', 2::BIGINT, 3::BIGINT)) UNION ALL
            SELECT pair_id, path || '/' || n, CASE WHEN EXISTS (SELECT 1 FROM t WHERE k = b * 4 + n) THEN b * 4 + n END, CASE WHEN EXISTS (SELECT 1 FROM t WHERE k = c * 4 + n) THEN c * 4 + n END FROM w, range(0, 4) r(n)
            WHERE EXISTS (SELECT 1 FROM t WHERE k = b * 4 + n) OR EXISTS (SELECT 1 FROM t WHERE k = c * 4 + n)),
        x AS (SELECT pair_id, path, node, status, size FROM w JOIN t ON k = b), y AS (SELECT pair_id, path, node, status, size FROM w JOIN t ON k = c)
        SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.path, y.path) AS path, coalesce(x.node, y.node) AS node, CASE WHEN x.pair_id IS NULL THEN 'added' WHEN y.pair_id IS NULL THEN 'removed' WHEN x.status <> y.status OR x.size <> y.size THEN 'changed' ELSE 'same' END AS verdict,
        CASE WHEN x.pair_id IS NULL OR y.pair_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN x.status <> y.status THEN 'status' END, CASE WHEN x.size <> y.size THEN 'size' END) END AS changed
        FROM x FULL JOIN y ON x.pair_id = y.pair_id AND x.path = y.path AND x.node = y.node""",
    "q97_collect_fixtures": """WITH RECURSIVE w(root, run, path) AS (SELECT o_orderkey, o_orderkey, '' FROM orders WHERE o_orderkey IN (1, 2, 3) UNION ALL SELECT root, o_orderkey, path || '/' || o_orderkey % 4 FROM w JOIN orders ON o_orderkey >= 4 AND o_orderkey // 4 = run),
        o AS (SELECT root, path || '/' || l_linenumber AS path, CAST(max(l_partkey) AS VARCHAR) AS fingerprint, max(l_returnflag) AS outcome FROM w JOIN lineitem ON l_orderkey = run GROUP BY root, w.path, l_linenumber)
        SELECT root, path, CASE WHEN root = 1 AND path = '/1' THEN 'own' WHEN root = 2 AND path = '/0/2' THEN NULL ELSE fingerprint END AS fingerprint, CASE WHEN root = 1 AND path = '/1' THEN 'X' WHEN root = 2 AND path = '/0/2' THEN 'Y' ELSE outcome END AS outcome FROM o""",
    "q98_run_stats_of_workflow": f"WITH {_RUNS} SELECT CAST(NULL AS BIGINT) AS workflow_id, status, count(*) AS n_runs, CAST(grouping(status) + 2 AS BIGINT) AS level FROM runs WHERE workflow_id = 1 GROUP BY ROLLUP (status)",
    "q99_log_losses": """WITH c AS (SELECT source, doc_id, least(octet_length(encode(text)), 3000) AS n, octet_length(encode(text)) > 3000 AS long FROM documents), u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM c)
        SELECT source, count(*) FILTER (WHERE upto > 50000) AS rows_dropped, CAST(coalesce(sum(n) FILTER (WHERE upto > 50000), 0) AS BIGINT) AS bytes_dropped, count(*) FILTER (WHERE long) AS rows_cut FROM u GROUP BY 1""",
    "q100_verify_transactions": """WITH t AS (SELECT DISTINCT l_orderkey + 1 AS k FROM lineitem) SELECT problem, count(*) AS n FROM (SELECT 'event count' AS problem FROM t WHERE k % 10 = 0 UNION ALL SELECT 'digest' FROM t WHERE k % 11 = 0
        UNION ALL SELECT 'numbering' FROM t WHERE k > 1 AND k - 1 NOT IN (SELECT k FROM t) UNION ALL SELECT 'previous digest' FROM t WHERE k > 1 AND k - 1 NOT IN (SELECT k FROM t)) GROUP BY 1""",
}
