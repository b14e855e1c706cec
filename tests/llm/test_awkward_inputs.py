"""The pipeline's stages against brute force on the awkward fixture, empty tables, very long texts, and columns that clash."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import exact_dedup, language_id, license_scan, ngram_join, packing, quality_crf, secret_scan, source_mixing, warc_bundles
from tests.llm.fixtures import DOCS, documents, table, words

SPACE, WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int"


def labels(spark, empty=False):
    rows = [(r[0], int(r[0] % 5 != 0)) for r in documents() if r[0] is not None and r[0] < 60]
    return spark.createDataFrame([] if empty else [*rows, (None, 1), (3, None)], LABELS)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_each_stage_equals_brute_force_on_its_own_input(spark):
    docs, marks = table(spark), labels(spark)
    scores = {}
    for r in quality_crf.score_quality(docs, marks).collect():
        scores.setdefault(r["doc_id"], []).append(r["predicted"])
    kept = quality_crf.keep_good(docs, marks)
    assert kept.columns == docs.columns
    for i, n in Counter(r["doc_id"] for r in kept.collect()).items():
        assert n == sum(scores[i])
    assert kept.count() == sum(sum(p) for p in scores.values())

    groups = defaultdict(list)
    for r in docs.collect():
        groups[SPACE.sub("", r["text"] or "")].append(r)
    once = exact_dedup.drop_duplicates(docs)
    best = [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    assert bag(r[:2] for r in once.collect()) == bag(r[:2] for r in best)

    held = once.collect()
    sets = []
    for r in held:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and r["doc_id"] is not None else set())
    parent = list(range(len(held)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(held)):
        for b in range(a):
            if sets[a] and sets[b] and (100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) or held[a]["doc_id"] == held[b]["doc_id"]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, r in enumerate(held):
        if r["doc_id"] is not None and sets[k]:
            least[root(k)] = min(least.get(root(k), r["doc_id"]), r["doc_id"])
    want = bag(r for k, r in enumerate(held) if r["doc_id"] is None or not sets[k] or least[root(k)] == r["doc_id"])
    assert bag(ngram_join.drop_similar(spark.createDataFrame(held, DOCS).repartition(3)).collect()) == want

    taken = Counter({})
    for r in source_mixing.mix_sources(docs).collect():
        taken[(r["doc_id"], r["source"])] += r["copies"]
    mixed = source_mixing.take_mix(docs)
    assert mixed.columns == docs.columns and Counter((r["doc_id"], r["source"]) for r in mixed.collect()) == +taken


def test_the_pipeline_runs_on_awkward_and_on_empty_tables(spark, tmp_path):
    for name, docs, marks in (("awkward", table(spark), labels(spark)), ("empty", table(spark, []), labels(spark, empty=True))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        marks.write.parquet(str(folder / "labels.parquet"))
        packed = corpus_pipeline.run(spark, str(folder))
        pieces = packed.collect()
        assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(packed.columns)
        assert bool(pieces) == (name == "awkward")
        full = Counter()
        for p in pieces:
            full[p["sequence_id"]] += p["length"]
        assert all(n <= 2048 for n in full.values()) and sum(n < 2048 for n in full.values()) <= 1


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(31)
    long = words(rng, 250_000)
    rows = [(1, long, "en", "a", 1, "x", "y", "z", 1, False, "q"), (2, long + " end", "en", "b", 1, "x", "y", "z", 1, False, "q"), (3, "x" * 2_000_000, "en", "a", 1, "x", "y", "z", 1, False, "q"), (4, "short text of some words", "de", "b", 1, "x", "y", "z", 1, False, "q")]
    return table(spark, [*rows, (5, "password=12345678\n" * 20_000, "en", "a", 1, "x", "y", "z", 1, False, "q")]).cache()


@pytest.mark.parametrize(("name", "apply"), [
    ("op1", lambda d, s: secret_scan.secret_digest(d)), ("op2", lambda d, s: source_mixing.mix_sources(d)), ("op3", lambda d, s: quality_crf.score_quality(d, s.createDataFrame([(1, 1), (3, 0)], LABELS))), ("op5", lambda d, s: exact_dedup.dedup_exact(d)),
    ("op6", lambda d, s: ngram_join.similar_sets(d)), ("op7", lambda d, s: packing.pack_documents(d, with_ids=False).filter("start = 0")), ("op8", lambda d, s: license_scan.scan_licenses(d)), ("op9", lambda d, s: language_id.predict_languages(d)),
])
def test_very_long_texts(spark, long_docs, name, apply):
    got = {r["doc_id"]: r for r in apply(long_docs, spark).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    if name == "op1":
        assert got[5]["n_assign"] == 20_000
    if name == "op6":
        assert got[2]["component_id"] == 1 and got[3]["component_id"] == 3


def test_pages_with_columns_that_clash(spark):
    rows = [(i, "u", "abc" * 500 if i % 2 else "abc", "x", 1, None, True, "y") for i in range(6)] + [(None, None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int, first string, same boolean, refers_to string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_bundles.archive_digest(pages).collect()}
    assert got == {0: ("response", None), 1: ("revisit", 5), 2: ("response", None), 3: ("revisit", 5), 4: ("response", None), 5: ("response", None), None: ("response", None)}


def test_lines_are_labelled(spark):
    rng = random.Random(4)
    line = lambda junk: " ".join(("##" if junk else "") + words(rng, 1) + ("$$$" if junk else "") for _ in range(9))
    doc = lambda i, t: (i, t, None, None, 1, "x", "y", "z", 1, False, "q")
    rows = [doc(i, "\n".join(line(i % 2 == 0) for _ in range(6))) for i in range(160)]
    rows += [doc(900, "\n".join([line(False), "", line(True), line(True), line(False), line(False)])), doc(901, None), doc(902, " \n ")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(160)], LABELS)
    found = [r for r in quality_crf.label_lines(table(spark, rows), marks).collect() if r["doc_id"] in (900, 901, 902)]
    assert [r["line"] for r in sorted(found, key=lambda r: r["line"])] == [1, 2, 3, 4, 5] and all(0 <= r["p_good"] <= 1 and r["n_bytes"] > 0 for r in found)
    whole = [r for r in quality_crf.label_lines(table(spark, rows), marks).filter(F.col("doc_id") < 160).collect()]
    assert sum(r["good"] == bool(r["doc_id"] % 2) for r in whole) >= 0.95 * len(whole)
