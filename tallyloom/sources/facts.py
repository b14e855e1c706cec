"""Fact logs: their shape, the tables that stand in for them, contiguity, and files they come from and go to."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyloom.functions.text import grep_lines

FACTS = T.StructType([
    T.StructField("lsn", T.LongType()), T.StructField("event_index", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("run_seq", T.LongType()), T.StructField("node_id", T.StringType()), T.StructField("dispatch_id", T.StringType()), T.StructField("audit_seq", T.LongType()), T.StructField("payload", T.StringType()),
])
OBSERVATIONS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("dispatch_id", T.StringType()), T.StructField("ts", T.StringType()),
    T.StructField("line", T.StructType([T.StructField("level", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("message", T.StringType())])),
    T.StructField("_corrupt", T.StringType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_facts(events: DataFrame) -> DataFrame:
    """The events table as facts: one event a transaction, users as runs, numbered within their run."""
    return events.select(
        (F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("run_id"), F.col("event_type").alias("kind"), "ts", "value", "props",
        F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("run_seq"),
    )


def order_status(flag: Column) -> Column:
    """Order flags as run states: F succeeded, P running, O awaiting_resume."""
    return F.when(flag == "F", "succeeded").when(flag == "P", "running").otherwise("awaiting_resume")


def order_runs(orders: DataFrame) -> DataFrame:
    """The orders table as runs: customers as workflows, priorities as sources."""
    source = F.when(F.col("o_orderpriority").startswith("1"), "manual").when(F.col("o_orderpriority").startswith("2"), "schedule").when(F.col("o_orderpriority").startswith("3"), "webhook").otherwise("sub_workflow")
    return orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("workflow_id"), order_status(F.col("o_orderstatus")).alias("status"), source.alias("source"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"))


def line_nodes(lineitem: DataFrame) -> DataFrame:
    """The lineitem table as attempts at run nodes: line numbers as nodes, rows of one node in a fixed order as its attempts."""
    every = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "running").otherwise("succeeded")
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*every)
    return lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node_id"), F.row_number().over(order).cast("long").alias("attempt"), status.alias("status"), F.col("l_partkey").alias("part_id"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("started_at"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts from JSON lines; a line that is no fact fails the read, for a log must be whole."""
    return spark.read.schema(FACTS).option("mode", "FAILFAST").json(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Log lines from JSON-lines segments; lines that don't parse, such as a torn last one, are left out."""
    rows = spark.read.schema(OBSERVATIONS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter(F.col("_corrupt").isNull() & F.col("seq").isNotNull()).drop("_corrupt")


def read_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Session rows from JSON lines, whatever their columns; a torn last line, or any that doesn't parse, is left out, and ``torn_lines`` tells how many."""
    fields = T.StructType.fromDDL(schema).add("_corrupt", "string")
    return spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt is null").drop("_corrupt")


def torn_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n) of files with lines that are no JSON."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNull()).groupBy("path").agg(F.count("*").alias("n"))


def grep_files(spark: SparkSession, path: str, pattern: str, glob: str = "*", ignore_case: bool = False, most: int = 1000) -> DataFrame:
    """(path, line, match) of the first ``most`` lines below a folder that a pattern is found in, by path and line from 1."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    found = files.select(F.col("_metadata.file_path").alias("path"), F.inline(grep_lines(F.col("value"), pattern, ignore_case)))
    return found.orderBy("path", "line").limit(most)


def values_within(values: DataFrame, budget: int) -> DataFrame:
    """Values whose bytes (total_bytes) keep to the budget; the others with a null body, for their sizes are told and not fetched."""
    return values.withColumn("body", F.when(F.col("total_bytes") <= budget, F.col("body")))


def write_run_bundle(facts: DataFrame, run_id: str, path: str) -> None:
    """One run's facts as JSON lines in log order."""
    facts.filter(F.col("run_id") == run_id).repartitionByRange(4, "lsn", "event_index").sortWithinPartitions("lsn", "event_index").write.mode("errorifexists").json(path)


def list_files(spark: SparkSession, path: str, glob: str = "*", most: int = 2000) -> DataFrame:
    """Files below a path by a name pattern, at most ``most`` in path order, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").orderBy("path").limit(most)


def split_value(values: DataFrame, key: str, body: str, size: int) -> DataFrame:
    """Chunks of at most ``size`` bytes of each value: key, chunk_index, chunk, its digest. Each chunk row holds its own bytes only."""
    n = F.greatest(F.ceil(F.octet_length("_raw") / size).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("_raw", i * size + 1, F.lit(size)))
    cut = values.select(F.col(key), F.encode(F.col(body), "UTF-8").alias("_raw")).select(key, F.posexplode(pieces).alias("chunk_index", "chunk"))
    return cut.withColumn("digest", F.sha2("chunk", 256))


def join_value(chunks: DataFrame, key: str) -> DataFrame:
    """Values from their chunks: chunk_count, total_bytes, the value's digest, and whether indexes run from 0 without a gap and digests hold.

    Chunks are put together once, as one text of hexadecimal digits.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", F.hex("chunk").alias("digits"))))
    out = chunks.groupBy(key).agg(
        F.unhex(F.array_join(F.transform(ordered, lambda x: x["digits"]), "")).alias("value"), F.count("*").alias("chunk_count"), F.sum(F.octet_length("chunk")).cast("long").alias("total_bytes"),
        ((F.max("chunk_index") + 1 == F.count("*")) & (F.count_distinct("chunk_index") == F.count("*")) & F.bool_and(F.sha2("chunk", 256) == F.col("digest"))).alias("whole"),
    )
    return out.select(key, "chunk_count", "total_bytes", F.sha2("value", 256).alias("value_digest"), "whole")


def gaps(facts: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows whose number isn't one more than the one before in their group (the first must be 1)."""
    before = F.lag(seq, 1, 0).over(Window.partitionBy(*keys).orderBy(seq))
    return facts.withColumn("expected", before + 1).filter(F.col(seq) != F.col("expected"))
