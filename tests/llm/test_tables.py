"""Embeddings, pages, components, and the pipeline."""

import hashlib
import math
import random

import corpus_pipeline
from tallyloom.llm import embedding_dedup, queries, warc_bundles
from tallyloom.llm.components import components
from tests.compare import duck, spark_rows


def test_components_of_paths_hubs_and_repeats(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(300, 200), (200, 300), (200, 200), (None, 5), (400, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_split_with_the_same_components(spark, monkeypatch):
    from tallyloom.llm import components as module

    monkeypatch.setattr(module, "HUB", 3)
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 300)] + [(300, i) for i in range(301, 500)] + [(rng.randint(600, 900), rng.randint(600, 900)) for _ in range(250)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def vectors():
    rng = random.Random(5)
    rows = []
    for i in range(300):
        base = [rng.gauss(0, 1) for _ in range(16)]
        for k in range(rng.choice([1, 1, 2, 4])):
            rows.append((len(rows), [x + rng.gauss(0, 0.05) for x in base] if k else base, i % 4))
    rows += [(len(rows) + k, [2.5 * x for x in rows[0][1]], rows[0][2]) for k in range(3)]  # longer, and alike
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [0.0] * 15, [], rows[0][1][:8]]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(odd)]
    rows += [(9000, rows[1][1], None), (None, rows[1][1], rows[1][2]), rows[2], (9001, [1e200] * 16, 1), (9002, [2e-200] * 16, 1)]
    return rows


def test_vectors_link_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rows = vectors()

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        big = max(map(abs, v))
        size = math.sqrt(sum((x / big) ** 2 for x in v)) * big
        return [x / size for x in v]

    units = {r[0]: (unit(r[1]), r[2]) for r in rows if r[0] is not None}
    links, parent = dict.fromkeys(units, 0), {i: i for i in units}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (u, label) in units.items():
        for b, (v, other) in units.items():
            if a < b and u and v and len(u) == len(v) and label is not None and label == other and sum(x * y for x, y in zip(u, v, strict=True)) >= 0.98:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    twice = {root(rows[2][0])}
    got = embedding_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
            continue
        assert r["component_id"] == root(r["vec_id"]) and r["kept"] == (r["component_id"] == r["vec_id"])
        if root(r["vec_id"]) not in twice:
            assert r["n_links"] == links[r["vec_id"]]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.similar_vectors(none).count() == 0


def pages():
    rng = random.Random(6)
    body = ["".join(rng.choice("abc é😀\r\n") for _ in range(n)) for n in (0, 10, 999, 1000, 1500, 5000)]
    rows = [(i, f"http://h/{i}", body[i % 6]) for i in range(30)]
    return [*rows, (40, None, None), (41, "bad\r\nurl ü", body[4]), (None, "x", body[4]), (None, "y", body[0]), rows[4]]


def test_archives_give_back_what_was_written(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", -1))
    index = warc_bundles.write_bundles(df, str(tmp_path), frame_bytes=4000, bundle_bytes=3000)
    found = warc_bundles.read_bundles(spark, index).collect()
    assert len(found) == len(rows) and index.select("bundle").distinct().count() > 3
    for r in found:
        i = None if r["record_id"] is None else int(r["record_id"])
        options = [(u, h or "") for j, u, h in rows if j == i]
        hit = [(u, h) for u, h in options if hashlib.sha1(h.encode()).hexdigest() == r["payload_digest"]]
        assert hit and r["payload_bytes"] == len(hit[0][1].encode())
        revisit = r["payload_bytes"] >= 1000 and last[hit[0][1]] != i
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (str(last[hit[0][1]]) if revisit else None)
        assert r["payload"] == (None if revisit else hit[0][1].encode())
    some = warc_bundles.fetch_records(index.filter("record_id in ('29', '28', '40')")).collect()
    assert sorted(r["record_id"] for r in some) == ["28", "29", "40"]


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    import zstandard

    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    warc_bundles.write_bundles(df, str(tmp_path), frame_bytes=3000)
    (path,) = list(tmp_path.glob("*.zst"))
    raw = path.read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(pages())
    with path.open("rb") as f:
        size = len(raw)
        f.seek(size - 9)
    import pyarrow as pa

    table = warc_bundles.seek_table(pa.OSFile(str(path)))
    assert len(table) > 3 and sum(n for _, _, n in table) == len(whole)


def test_empty_archive(spark):
    assert warc_bundles.archive_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_queries_equal_their_sql(spark, sf_dir):
    for name, sql in queries.ORACLE_SQL.items():
        assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck(sf_dir, sql)


def test_pipeline_keeps_good_documents_once_and_packs_them(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        held.append(docs)
        if docs is not held[-1] or len(held) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    quality, exact, near, mixed, packed = held
    bad = {r[0] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select("doc_id").collect()}
    kept = {r[0] for r in quality.select("doc_id").collect()}
    assert len(bad & kept) <= 0.2 * len(bad)
    squeezed = ["".join(r[0].split()) for r in exact.select("text").collect()]
    assert len(squeezed) == len(set(squeezed)) and near.count() <= len(squeezed)
    assert {r[0] for r in mixed.select("doc_id").distinct().collect()} <= {r[0] for r in near.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert packed.filter("start = 0").count() == mixed.count()
