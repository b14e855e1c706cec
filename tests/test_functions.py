import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import contracts, cron, statistics, text, values
from tallyloom.operators import retention


def one(spark, column, **values_):
    row = spark.createDataFrame([tuple(values_.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values_.items())) if values_ else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("prefix", "url", "want"), [
    ("https://a.example/v1", "https://a.example/v1", True), ("https://a.example/v1", "https://a.example/v1/x?q=1", True), ("https://a.example/v1", "https://a.example/v10", False),
    ("https://a.example/v1/", "https://a.example:443/v1/y", True), ("https://a.example", "http://a.example/", False), ("https://a.example:8443/", "https://a.example/", False),
    ("https://a.example/", "https://a.example.evil/", False), ("https://A.example/", "https://a.EXAMPLE/z", True), ("not a url", "not a url", False),
])
def test_url_prefixes(spark, prefix, url, want):
    assert one(spark, text.url_prefix_matches(F.col("p"), F.col("u")), p=prefix, u=url) is want


@pytest.mark.parametrize(("path", "want"), [("a/b", True), ("a", True), ("ab", False), ("", True)])
def test_subtrees(spark, path, want):
    assert one(spark, text.subtree_matches(F.col("p"), directory=F.lit("a")), p=path) is want
    assert one(spark, text.subtree_matches(F.col("p"), exact=F.lit("a")), p=path) is (path == "a")


def test_redaction(spark):
    assert one(spark, text.redact_url(F.col("u")), u="http://h/?My_Token=1&a=2#secret=x") == "http://h/?My_Token=***&a=2#secret=***"
    assert one(spark, text.redact_json_text(F.col("j")), j='{"a":{"API_KEY":"q\\"x","n":1},"token":5}') == '{"a":{"API_KEY":"***","n":1},"token":"***"}'
    assert one(spark, F.to_json(text.redact_map(F.create_map(F.lit("Cookie"), F.lit("x"), F.lit("b"), F.lit("y"))))) == '{"Cookie":"***","b":"y"}'


@pytest.mark.parametrize("body", ["short", "é" * 300, "a" + "é" * 300, "😀" * 140, "x" * 512, "x" * 513])
def test_texts_are_cut_between_characters(spark, body):
    raw = body.encode()
    head, tail = one(spark, text.truncate_message(F.col("b"), 512, "~"), b=body), one(spark, text.byte_tail(F.col("b"), 512, "~"), b=body)
    if len(raw) <= 512:
        assert head == tail == body
    else:
        assert head == raw[:512].decode(errors="ignore") + "~" and tail == "~" + raw[-512:].decode(errors="ignore")


def test_html(spark):
    assert one(spark, text.html_to_text(F.col("h")), h="<p>a &lt;b&gt;\n &amp;amp; <i>c</i></p> ") == "a <b> &amp; c"
    assert one(spark, text.to_number(F.col("n")), n="1,234") == 1234 and one(spark, text.to_number(F.col("n")), n="x") is None


@pytest.mark.parametrize(("json", "want"), [("null", False), ("false", False), ("true", True), ("0", False), ("0.0", False), ("-1", True), ('""', False), ('"0"', True), ("[]", True), ("{}", True)])
def test_truth(spark, json, want):
    assert one(spark, values.truthy_variant(F.try_parse_json("j")), j=json) is want


def test_templates(spark):
    columns = {"a": F.col("n"), "b": F.lit(None).cast("string")}
    assert one(spark, values.template("${a}", columns), n=9007199254740993) == 9007199254740993
    assert one(spark, values.template("x ${a} ${b} ${c}", columns), n=1) == "x 1 null null"


@pytest.mark.parametrize(("value", "want"), [("0", 0), ("18446744073709551615", 18446744073709551615), ("18446744073709551616", None), ("01", None), ("-1", None), ("", None)])
def test_counters(spark, value, want):
    got = one(spark, values.u64(F.col("v")), v=value)
    assert (None if got is None else int(got)) == want


def test_instants(spark):
    key = values.instant_key(F.col("t"))
    assert one(spark, key, t="2026-01-01T08:00:00.000000001+08:00") == one(spark, key, t="2026-01-01T00:00:00.000000001Z") == "2026-01-01T00:00:00.000000001Z"
    assert one(spark, key, t="nonsense") == ""


def test_digests(spark):
    want = hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in (b"run", "é".encode(), b"{}"))).hexdigest()
    assert one(spark, values.entity_digest(F.lit("run"), F.lit("é"), F.lit("{}"))) == want
    assert one(spark, values.fingerprint(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == hashlib.sha256(b'{"a":"1","b":"2"}').hexdigest()


@pytest.mark.parametrize(("spec", "at", "want"), [
    ("*/15 * * * *", "2026-03-04 10:15:00", "2026-03-04 10:15:00"), ("*/15 * * * *", "2026-03-04 10:14:59", "2026-03-04 10:00:00"), ("0 9 * * 1", "2026-03-04 08:00:00", "2026-03-02 09:00:00"),
    ("30 0 0 1 1 *", "2026-03-04 08:00:00", "2026-01-01 00:00:30"), ("0 0 31 * *", "2026-03-04 00:00:00", "2026-01-31 00:00:00"), ("0 0 13 * 5", "2026-03-12 01:00:00", "2026-03-06 00:00:00"),
])
def test_cron(spark, spec, at, want):
    assert str(one(spark, cron.previous_slot(spec, F.col("t").cast("timestamp_ntz")), t=at)) == want


def test_bad_cron():
    for spec in ("61 * * * *", "* * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            cron.parse(spec)


SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 9007199254740993}, "b": {"type": "array", "maxItems": 2, "items": {"type": "string", "minLength": 2}}}, "additionalProperties": {"type": "boolean"}}


@pytest.mark.parametrize(("value", "want"), [
    ('{"a":9007199254740993}', None), ('{"a":9007199254740992}', "$.a: number outside bounds"), ("[]", "$: expected object"), ("{}", "$.a: required property missing"), ('{"a":null}', "$.a: expected integer"),
    ('{"a":9007199254740993.5}', "$.a: expected integer"), ('{"a":9007199254740994,"b":["xx","y"]}', "$.b[1]: fewer than minLength"), ('{"a":9007199254740994,"b":["xx","yy","zz"]}', "$.b: more than maxItems"),
    ('{"a":9007199254740994,"z":1}', "$.z: expected boolean"), ('{"a":9007199254740994,"z":true}', None),
])
def test_contracts(spark, value, want):
    assert one(spark, contracts.violation(SCHEMA, F.try_parse_json("j")), j=value) == want


def test_schemas_outside_the_subset():
    for schema in ({"pattern": "x"}, {"type": "date"}, {"minimum": "1"}, {"items": {"oneOf": []}}):
        with pytest.raises(ValueError):
            contracts.check_schema(schema)


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    got = df.agg(*[statistics.nearest_rank("v", p).alias(f"p{p}") for p in (50, 90, 95, 99)]).first()
    assert tuple(got) == (5.0, 9.0, 10.0, 10.0)
    assert statistics.floor_index(df.withColumn("k", F.lit(1)), ["k"], "v", 50, "x").first()["x"] == 6.0


def test_replay_states():
    assert [retention.replay_state(c, 5, 9) for c in (0, 3, 4, 7, 12)] == ["gap", "resync_required", "complete", "complete", "ahead"]
