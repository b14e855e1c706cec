"""Trees of runs, fixtures, verified transactions, bounded logs and searched files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import differences, integrity, retention, rollups
from tallyloom.plans.definition import normalise_fragment
from tallyloom.sources import facts

RUNS = "run_id string, parent_id string, parent_node string"


def test_run_trees_are_compared_child_by_child(spark):
    base = spark.createDataFrame([("b", None, None), ("b1", "b", "x"), ("b2", "b1", "y"), ("b3", "b", "only")], RUNS)
    cand = spark.createDataFrame([("c", None, None), ("c1", "c", "x"), ("c2", "c1", "y")], RUNS)
    pairs = differences.run_pairs(base, cand, spark.createDataFrame([(1, "b", "c")], "pair_id int, b_run string, c_run string"))
    assert sorted(((r["path"], r["b_run"], r["c_run"]) for r in pairs.collect())) == [("", "b", "c"), ("/only", "b3", None), ("/x", "b1", "c1"), ("/x/y", "b2", "c2")]
    nodes = lambda rows: spark.createDataFrame(rows, "run_id string, node string, status string")
    out = differences.compare_run_trees(pairs, nodes([("b", "n", "ok"), ("b2", "n", "ok"), ("b3", "n", "ok")]), nodes([("c", "n", "ok"), ("c2", "n", "failed"), ("c2", "m", "ok")]), "node", ["status"])
    assert sorted((r["path"], r["node"], r["verdict"]) for r in out.collect()) == [("", "n", "same"), ("/only", "n", "removed"), ("/x/y", "m", "added"), ("/x/y", "n", "changed")]
    with pytest.raises(ValueError, match="more than 1 deep"):
        differences.run_pairs(base, cand, spark.createDataFrame([(1, "b", "c")], "pair_id int, b_run string, c_run string"), most_deep=1)


def test_fixtures_by_path_with_overrides(spark):
    runs = spark.createDataFrame([("a", None, None), ("k", "a", "sub")], RUNS)
    outcomes = spark.createDataFrame([("a", "n", "f1", "o1"), ("k", "m", "f2", "o2")], "run_id string, node_id string, fingerprint string, outcome string")
    over = spark.createDataFrame([("a", "/sub/m", None, "mine")], "root string, path string, fingerprint string, outcome string")
    got = differences.collect_fixtures(runs, outcomes, spark.createDataFrame([("a",)], "root string"), over)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "/n", "f1", "o1"), ("a", "/sub/m", None, "mine")]
    with pytest.raises(ValueError, match="more than 0"):
        differences.collect_fixtures(runs, outcomes, spark.createDataFrame([("a",)], "root string"), most_runs=0)


def test_transactions_hold_with_their_events(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    events, tx, before = [], [], ""
    for lsn in (1, 2, 3):
        own = [sha(f"{lsn}/{i}") for i in range(lsn)]
        events += [(lsn, i, x) for i, x in enumerate(own)]
        digest = sha("".join(own))
        chain = sha(before + digest)
        tx.append((lsn, lsn, digest, before, chain))
        before = chain
    e, t = spark.createDataFrame(events, "lsn long, event_index int, digest string"), spark.createDataFrame(tx, "lsn long, n_events int, digest string, prev_digest string, chain_digest string")
    assert integrity.verify_transactions(t, e).count() == 0
    problems = lambda tx, ev: sorted(tuple(r) for r in integrity.verify_transactions(tx, ev).collect())
    assert problems(t, e.filter("not (lsn = 3 and event_index = 1)")) == [(3, "digest"), (3, "event count"), (3, "event numbering")]
    assert problems(t.filter("lsn <> 2"), e) == [(2, "events of no transaction"), (3, "numbering"), (3, "previous digest")]
    assert problems(t.withColumn("chain_digest", F.when(F.col("lsn") == 2, "x").otherwise(F.col("chain_digest"))), e) == [(2, "chain"), (3, "previous digest")]


def test_bounded_logs_tell_what_they_let_go(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([10, 50, 20, 20, 100])], "source string, pos int, n long")
    assert [tuple(r) for r in retention.losses(rows, ["source"], "pos", F.col("n"), 75, 40).collect()] == [("s", 3, 70, 2)]
    subscribers = spark.createDataFrame([("a", "r", 0), ("b", "r", 3), ("c", "r", 4), ("d", "r", 9), ("e", "r", 11), ("f", "q", 5), ("g", "p", 0)], "id string, run_id string, cursor long")
    window = spark.createDataFrame([("r", i) for i in range(5, 10)] + [("p", 1), ("p", 2)], "run_id string, seq long")
    got = {r["id"]: (r["reply"], r["n_rows"]) for r in retention.replay(subscribers, window).collect()}
    assert got == {"a": ("gap", 5), "b": ("resync_required", 0), "c": ("complete", 5), "d": ("complete", 0), "e": ("ahead", 0), "f": ("complete", 0), "g": ("complete", 2)}
    counters = spark.createDataFrame([("r", "d1", 3, False), ("r", "d1", 5, False), ("r", "d2", 2, True)], "run_id string, dispatch_id string, dropped long, gap boolean")
    assert [tuple(r) for r in rollups.observation_loss(counters, ["dropped"], "gap").collect()] == [("r", 7, True)]
    assert rollups.observation_loss(counters, ["dropped"], "gap", per_dispatch=True).count() == 2


def test_files_are_searched_and_torn_lines_told(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\nTwo\nthree two")
    (tmp_path / "b.log").write_text("two")
    got = facts.grep_files(spark, str(tmp_path), "two", glob="*.txt", ignore_case=True).collect()
    assert [(r["line"], r["match"]) for r in got] == [(2, "Two"), (3, "three two")] and facts.grep_files(spark, str(tmp_path), "t", most=1).count() == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id"')
    assert sorted(r["id"] for r in facts.read_sessions(spark, str(tmp_path / "s"), "id long").collect()) == [1, 2]
    assert [r["n"] for r in facts.torn_lines(spark, str(tmp_path / "s")).collect()] == [1]
    values = spark.createDataFrame([("a", 5, "x"), ("b", 50, "y")], "key string, total_bytes long, body string")
    assert [r["body"] for r in facts.values_within(values, 10).orderBy("key").collect()] == ["x", None]


def test_fragments_keep_what_is_known():
    got = normalise_fragment({"nodes": [{"id": "a", "type": "script", "params": {"code": "1"}, "color": "red"}, {"id": "b", "type": "end"}], "edges": [{"from": "a", "to": "b", "label": "x"}], "more": 1})
    assert got == {"nodes": [{"id": "a", "type": "script", "params": {"code": "1"}}, {"id": "b", "type": "end"}], "edges": [{"from": "a", "to": "b"}]}
    for bad in ({"nodes": [{"id": "a"}]}, {"nodes": [{"id": "a", "type": "end"}] * 2}, {"nodes": [{"id": "a", "type": "end"}], "edges": [{"from": "a", "to": "z"}]}):
        with pytest.raises(ValueError):
            normalise_fragment(bad)


def test_stats_of_one_workflow(spark):
    df = spark.createDataFrame([("w", "succeeded"), ("w", "failed"), ("x", "succeeded")], "workflow_id string, status string")
    assert sorted((r["status"] or "", r["n_runs"], r["level"]) for r in rollups.run_stats(df, "w").collect()) == [("", 2, 3), ("failed", 1, 2), ("succeeded", 1, 2)]
