"""Rules of definitions and schemas, limits of values, patterns on long texts, cron slots, and numbers drawn from a seed."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import contracts, cron, text, values
from tallyloom.operators import hierarchy
from tallyloom.plans.definition import parse, problems
from tallyloom.sources import kept

START_END = [("s", "start"), ("e", "end")]


def graph(nodes, edges, **more):
    return parse({"nodes": [{"id": n[0], "type": n[1], "params": n[2] if len(n) > 2 else {}} for n in nodes], "edges": [{"from": e[0], "to": e[1], "port": e[2] if len(e) > 2 else None} for e in edges], **more})


@pytest.mark.parametrize(("rule", "node", "edges"), [
    ("port", ("c", "condition", {"expr": "true"}), [("s", "c"), ("c", "e")]), ("join", ("x", "script", {"code": "1", "join": "some"}), [("s", "x"), ("x", "e")]),
    ("param", ("x", "script", {"code": 5}), [("s", "x"), ("x", "e")]), ("param", ("x", "delay", {"ms": -1}), [("s", "x"), ("x", "e")]), ("param", ("x", "input", {"fields": [{"key": "a"}, {"key": "a"}]}), [("s", "x"), ("x", "e")]),
    ("param", ("x", "script", {"code": "1", "retry": {"max_attempts": "two"}}), [("s", "x"), ("x", "e")]), ("response_schema", ("x", "llm", {"url": "u", "body": "b", "response_schema": {"enum": []}}), [("s", "x"), ("x", "e")]),
])
def test_more_rules_of_definitions(rule, node, edges):
    assert rule in {r for r, _ in problems(graph([*START_END, node], edges))}


def test_two_ports_into_one_node_are_refused_in_the_first_semantics_only():
    nodes, edges = [*START_END, ("c", "condition", {"expr": "true"})], [("s", "c"), ("c", "e", "true"), ("c", "e", "false")]
    assert problems(graph(nodes, edges)) == []
    assert {r for r, _ in problems(graph(nodes, edges, semantics=1))} == {"two_ports"}
    assert problems(graph([*START_END, ("x", "own.type", {})], [("s", "x"), ("x", "e")]), frozenset({"own.type"})) == []


@pytest.mark.parametrize("schema", [
    {"enum": []}, {"enum": "a"}, {"required": "a"}, {"required": [1]}, {"minLength": -1}, {"maxItems": 1.5}, {"minLength": True}, {"minimum": "1"}, {"type": "date"}, {"type": ["string"]}, {"format": "x"}, {"properties": []}, {"items": 5},
])
def test_schemas_outside_the_subset_are_refused(schema):
    with pytest.raises(ValueError, match="bad schema"):
        contracts.check_schema(schema)


def test_nesting_is_measured_outside_strings(spark):
    cases = [("[" * 64 + "]" * 64, False), ("[" * 65 + "]" * 65, True), ('{"a":' * 65 + '"[[{"' + "}" * 65, True), ('["' + "[" * 200 + '"]', False), ('["\\"[[[[", ' + "[" * 63 + "]" * 63 + "]", False), (None, False), ("[],[]" * 100, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r["d"] for r in df.select("i", contracts.too_deep(F.col("t")).alias("d")).orderBy("i").collect()] == [want for _, want in cases]


def test_long_secrets_are_masked(spark):
    long = json.dumps({"note": "x" * 1_000_000, "token": 'a"\\' * 400_000, "deep": {"PASSWORD": 5, "api_key": None, "plain": "y" * 10}})
    got = json.loads(spark.createDataFrame([(long,)], "t string").select(text.redact_json_text(F.col("t"))).first()[0])
    assert got == {"note": "x" * 1_000_000, "token": "***", "deep": {"PASSWORD": "***", "api_key": "***", "plain": "y" * 10}}


def test_a_closure_of_sixteen_levels_is_sixteen_short_plans(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(16)], "parent int, child int")
    roots = spark.createDataFrame([(0,)], "root int")
    got = hierarchy.closure(edges, roots)
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == [(i, i) for i in range(17)]
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    with pytest.raises(ValueError, match="more than 10 nodes"):
        hierarchy.closure(edges, roots, most_nodes=10)


def test_dependencies_follow_the_version_picked(spark):
    versions = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), ("c", 1, True), ("d", 1, False)], "workflow_id string, version int, published boolean")
    calls = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c"), ("b", 1, "d")], "workflow_id string, version int, child string")
    found, lacking = hierarchy.freeze_dependencies(versions, calls, spark.createDataFrame([("a",)], "root string"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", "a", 1, 0), ("a", "b", 1, 1)]
    assert [tuple(r) for r in lacking.collect()] == [("a", "d")]


def slots_before(spec, at, days):
    """The latest slot by trying every second backwards within a day, day by day."""
    seconds, minutes, hours, month_days, months, week_days = cron.parse(spec)
    week = {d % 7 for d in week_days}
    times = sorted(h * 3600 + m * 60 + s for h in hours for m in minutes for s in seconds)
    for back in range(days):
        day = at.date() - datetime.timedelta(days=back)
        dom, dow = day.day in month_days, day.isoweekday() % 7 in week
        if day.month in months and (dom or dow if len(month_days) < 31 and len(week) < 7 else dom and dow):
            upto = [t for t in times if back or t <= at.hour * 3600 + at.minute * 60 + at.second]
            if upto:
                return datetime.datetime.combine(day, datetime.time()) + datetime.timedelta(seconds=upto[-1])
    return None


@pytest.mark.parametrize("spec", ["*/15 8-17 * * 1-5", "* * * * * *", "5 30 */6 * * *", "0 0 29 2 *", "0 12 13 * 5", "59 59 23 31 12 *", "7,20 3 1 */3 *", "0 0 30 2 *", "10-20/5 * * * 0"])
def test_cron_slots_equal_a_search(spark, spec):
    rng = random.Random(3)
    start = datetime.datetime(2023, 1, 1)
    times = [start + datetime.timedelta(seconds=rng.randrange(4 * 366 * 86400)) for _ in range(40)] + [datetime.datetime(2024, 2, 29), datetime.datetime(2024, 2, 29, 23, 59, 59), datetime.datetime(2100, 3, 1, 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, at timestamp_ntz")
    got = {r["i"]: r["s"] for r in df.select("i", cron.previous_slot(spec, F.col("at")).alias("s")).collect()}
    assert got == {i: slots_before(spec, t, 9 * 366) for i, t in enumerate(times)}


def test_slots_fire_once_and_not_before_the_schedule_is_active(spark):
    rows = [("2024-01-02 10:20", "2024-01-01", None, "2024-01-02 10:15"), ("2024-01-02 10:20", "2024-01-02 10:16", None, None), ("2024-01-02 10:20", "2024-01-01", "2024-01-02 10:15", None), ("2024-01-02 10:20", "2024-01-01", "2024-01-02 09:00", "2024-01-02 10:15")]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, now string, since string, last string")
    slot = cron.due_slot("*/15 * * * *", *(F.col(c).cast("timestamp_ntz") for c in ("now", "since", "last")))
    assert [r[1] for r in df.select("i", F.date_format(slot, "yyyy-MM-dd HH:mm")).orderBy("i").collect()] == [r[3] for r in rows]


def test_values(spark):
    def draws(x, n):
        out = []
        for _ in range(n):
            x ^= x << 13 & 0xFFFFFFFF
            x ^= x >> 17
            x ^= x << 5 & 0xFFFFFFFF
            out.append(x / 2**32)
        return out

    df = spark.createDataFrame([(2463534242,), (1,), (0,)], "seed long")
    assert [list(r[0]) for r in df.select(values.xorshift32(F.col("seed"), 5)).collect()] == [draws(s or 1, 5) for s in (2463534242, 1, 0)]
    row = spark.createDataFrame([("a", {"x": "1", "y": "2"}, {"y": "3", "z": "4"}, [1, 2])], "name string, doc map<string,string>, patch map<string,string>, list array<int>")
    assert row.select(values.config_patch(F.col("doc"), F.col("patch"))).first()[0] == {"x": "1", "y": "3", "z": "4"}
    assert row.select(values.node_key_path(F.col("name"), F.lit("b"))).first()[0] == '["a","b"]'
    tree = values.template_tree({"to": "${input.name}", "body": ["hi ${input.name}", "${input.list}"], "code": "${kept}", "n": 3}, {"input.name": F.col("name"), "input.list": F.col("list")}, opaque=("code",))
    assert row.select(tree.alias("t")).first()["t"].asDict() == {"to": "a", "body": ["hi a", "[1,2]"], "code": "${kept}", "n": 3}
    assert row.select(values.canonical_json(F.lit('{"b": [ {"d":1, "c":null} ], "a": 1}'))).first()[0] == '{"a":1,"b":[{"c":null,"d":1}]}'


def test_shared_folder_is_asked_for_on_a_cluster():
    class Unset:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        kept.shared_dir(Unset())
