"""Licence notices amid long foreign text are retrieved."""

from pyspark.sql import functions as F

from tallyloom.llm import license_scan
from tests.llm.fixtures import table


def test_bands_hold_what_the_comment_says(spark):
    for r in license_scan.template_table(spark, license_scan.TEMPLATES).select("span", F.size("parts").alias("n")).collect():
        similar = 0.8 * r["n"] / (license_scan.STRETCH * r["span"] + 0.2 * r["n"])
        assert (1 - similar) ** license_scan.BANDS < 1e-4


def test_notices_within_long_distinct_text_are_found(spark):
    notice = license_scan.TEMPLATES["apache-2.0-notice"].split()
    part = " ".join(notice[: -(-len(notice) * 9 // 10)])
    text = lambda i: " ".join([f"a{i}x{k}" for k in range(i % 400)] + [part] + [f"b{i}x{k}" for k in range(500)])
    rows = [(i, text(i), None, None, 1, "x", "y", "z", 1, False, "q") for i in range(1200)]
    names = license_scan.scan_licenses(table(spark, rows)).filter(~F.array_contains(F.split("licenses", ","), "apache-2.0-notice"))
    assert names.count() == 0


def test_a_library_in_a_table_and_an_empty_one(spark):
    texts = [license_scan.TEMPLATES["mit-text"], "pre " * 40 + license_scan.TEMPLATES["zlib"] + " post" * 40, "one two three four five six seven", None]
    rows = [(i, t, None, None, 1, "x", "y", "z", 1, False, "q") for i, t in enumerate(texts)]
    own = spark.createDataFrame([("own", "one two three four five six"), ("zlib", license_scan.TEMPLATES["zlib"]), ("short", "too short"), ("none", None)], "template string, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_licenses"]) for r in license_scan.scan_licenses(table(spark, rows), templates=own).collect()}
    assert got == {0: ("", 0), 1: ("zlib", 1), 2: ("own", 1), 3: ("", 0)}
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert got == {0: "mit-notice,mit-text", 1: "zlib", 2: "", 3: ""}
    assert {r["licenses"] for r in license_scan.scan_licenses(table(spark, rows), templates={}).collect()} == {""}
