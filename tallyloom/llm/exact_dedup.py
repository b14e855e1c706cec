"""Exact deduplication by a stream with keyed state on disk, and a check of full texts on every hit."""

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import delete, exists, if_small, keep, shared_path, text_or_empty

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for logs
}


@contextmanager
def _disk_state(spark: SparkSession):
    """Keep the state of streams started within in RocksDB; the session's own settings return afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        text = F.replace(text, F.lit(chr(code)), F.lit(""))
    return text


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest, points, doc_id, locator of every row: what the state keeps of a text.

    The locator is the file that holds the text, empty where the rows don't come from one table
    of files; within it the row is found by its id and, where ids repeat, its code points.
    """
    text = text_or_empty(text_col)
    try:
        docs = docs.withColumn("locator", F.input_file_name())
    except AnalysisException:  # several tables beneath
        docs = docs.withColumn("locator", F.lit(""))
    return docs.select(F.sha2(normalised(text), 256).alias("digest"), F.length(text).cast("long").alias("points"), F.col(id_col).alias("doc_id"), "locator")


def _order(*more: str) -> Column:
    return F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *more)


def keepers(rows: DataFrame) -> DataFrame:
    """The state of each digest: group_size, and the row that stays (most code points, then smallest id, null last) with its locator.

    ``rows`` may be a stream: then this is its keyed state, which never expires.
    """
    state = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(_order("locator")).alias("best"))
    return state.select("digest", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), F.col("best.locator").alias("keep_locator"))


def stream_keepers(rows: DataFrame, checkpoint: str, table: str, landed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 500) -> list[str]:
    """Drive a stream of digest rows to its end; batch n's changed groups go to ``table/batch=n``.

    State lives in RocksDB and, by version, under ``checkpoint``: a later call with the same
    two folders goes on where this one ended, and a batch run anew overwrites its own folder.
    Each call ends with the check of its hits: for every group of two or more that it made or
    let grow, the full texts (in ``docs``, found by way of ``landed``, the rows streamed so
    far) are compared with the keeper's. The digests under which texts differ are returned.
    """
    batches = []

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")
        batches.append(batch)

    spark = rows.sparkSession
    with _disk_state(spark):
        keepers(rows).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not batches:
        return []
    grown = _states(spark, table, landed.schema["doc_id"].dataType).filter(F.col("batch").isin(batches) & (F.col("group_size") > 1)).select("digest").distinct()
    now = latest_keepers(spark, table, landed.schema["doc_id"].dataType).join(grown, "digest", "left_semi")
    return _unequal(docs, landed, now, id_col, text_col, rows_per_salt)


def _states(spark: SparkSession, table: str, id_type: T.DataType) -> DataFrame:
    schema = T.StructType().add("digest", "string").add("group_size", "long").add("keep_id", id_type).add("keep_points", "long").add("keep_locator", "string").add("batch", "long")
    return spark.read.schema(schema).option("basePath", table).parquet(table)


def latest_keepers(spark: SparkSession, table: str, id_type: T.DataType) -> DataFrame:
    """Each digest's state after the last batch: groups only grow, so its row of the largest size."""
    last = F.max_by(F.struct("group_size", "keep_id", "keep_points", "keep_locator"), "group_size").alias("last")
    return _states(spark, table, id_type).groupBy("digest").agg(last).select("digest", "last.*")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1000, rows_per_salt: int = 500) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Digest rows are landed in the shared folder and streamed through ``stream_keepers``, at
    most ``files_per_batch`` files at a time. On every hit (a group of two or more) the full
    normalised texts of row and keeper are compared; texts of groups of one are not read
    again. The keeper's text is dealt over one salt per ``rows_per_salt`` rows, so a group of
    any size is spread. Should texts of one digest differ, the digest's rows are grouped once
    more by the full text.

    Nulls: a null text is the empty text; a null id is a row like others, kept last among
    ties. Rows equal in id and text repeat in the result; one of them counts as kept, all of
    them bear ``kept`` since their id is the keeper's. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    return _shape(_grouped(docs, id_col, text_col, files_per_batch, rows_per_salt), id_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str, files_per_batch: int = 1000, rows_per_salt: int = 500) -> DataFrame:
    """digest, points, doc_id, group_size, keep_id, keep_points of every row, its group's texts compared."""
    spark = docs.sparkSession
    landed, state, table = (shared_path(spark, x) for x in ("digests", "dedup-state", "keepers"))
    digest_rows(docs, id_col, text_col).write.parquet(landed)
    rows = spark.read.parquet(landed)
    id_type = rows.schema["doc_id"].dataType
    clash = stream_keepers(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(landed), state, table, rows, docs, id_col, text_col, rows_per_salt)
    rows = rows.drop("locator")
    if not exists(spark, table):
        return rows.withColumns({"group_size": F.lit(0).cast("long"), "keep_id": F.col("doc_id"), "keep_points": F.col("points")})
    groups = keep(latest_keepers(spark, table, id_type).drop("keep_locator"), "groups")
    for spent in (state, table):
        delete(spark, spent)
    joined = rows.join(groups, "digest")
    if clash:
        bad = spark.createDataFrame([(d,) for d in clash], "digest string")
        joined = joined.join(bad, "digest", "left_anti").unionByName(_by_full_text(docs, bad, id_col, text_col))
    return joined


def _is_keeper() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))


def _shape(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", _is_keeper().alias("kept"), F.col("digest").alias("text_sha256"))


def _full(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("points"), normalised(text).alias("content"))
    return rows.withColumn("digest", F.sha2("content", 256))


def _unequal(docs: DataFrame, landed: DataFrame, hits: DataFrame, id_col: str, text_col: str, rows_per_salt: int) -> list[str]:
    """Digests under which two different normalised texts were found: SHA-256 collisions, so none, or a handful.

    The rows of the groups ``hits`` are named by id and code points, from what was landed; only
    texts so named are normalised and hashed again, and only those of the groups are shuffled.
    """
    hits = hits.select("digest", "keep_id", "keep_points", F.ceil(F.col("group_size") / rows_per_salt).cast("int").alias("salts"))
    named = landed.select("digest", "points", "doc_id").distinct().join(if_small(keep(hits, "hits")), "digest")
    named = if_small(keep(named.withColumns({"_id": F.col("doc_id"), "_points": F.col("points")}).drop("doc_id", "points"), "named"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("points"), text.alias("text"))
    held = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("points") == F.col("_points"))).withColumn("content", normalised(F.col("text")))
    held = held.filter(F.sha2("content", 256) == F.col("digest"))
    mine = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    dealt = held.filter(~mine).withColumn("salt", F.pmod(F.xxhash64("doc_id", "points"), F.col("salts")))
    one = held.filter(mine).select("digest", F.col("content").alias("keep_content"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - F.lit(1).cast("long"))).alias("salt"))
    against = dealt.select("digest", "salt", "content").join(one, ["digest", "salt"])
    return [r[0] for r in against.filter("content <> keep_content").select("digest").distinct().collect()]


def _by_full_text(docs: DataFrame, digests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of a few digests, grouped by the whole normalised text instead."""
    rows = _full(docs, id_col, text_col).join(digests, "digest")
    best = rows.groupBy("content").agg(F.count("*").alias("group_size"), F.min(_order()).alias("best"))
    return rows.join(best, "content").select("digest", "points", "doc_id", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that ``dedup_exact`` keeps, one row for each distinct text, their columns unchanged.

    Only the dropped rows' ids, code points and digests meet the documents, by an anti-join:
    as in ``dedup_exact`` a row is told from others of its id and digest by its code points.
    Rows that agree in all three are told apart by their place in the file only, so the few
    digests that have such rows are reduced to one row each.
    """
    out = keep(_grouped(docs, id_col, text_col, **options).select("doc_id", "points", "digest", _is_keeper().alias("kept")), "dedup")
    dropped = out.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("points").alias("_points"), F.unhex("digest").alias("_sha"))
    dropped = if_small(keep(dropped, "dropped"))
    text = text_or_empty(text_col)
    digest = F.sha2(normalised(text), 256)
    same = F.array_contains(F.array("_sha"), F.unhex(digest))  # no key of the join: only rows that agree in id and code points are hashed
    rest = docs.join(dropped, F.col(id_col).eqNullSafe(F.col("_id")) & (F.length(text) == F.col("_points")) & same, "left_anti")
    twice = keep(out.filter("kept").groupBy(F.col("digest").alias("_sha")).count().filter("count > 1").select("_sha"), "repeated")
    if twice.isEmpty():
        return rest
    marked = rest.select(F.struct("*").alias("row"), digest.alias("_sha"))
    once = marked.join(twice, "_sha").groupBy("_sha").agg(F.first("row").alias("row"))
    return marked.join(twice, "_sha", "left_anti").select("row.*").unionByName(once.select("row.*"))
