"""Helpers shared by the training-data operators: tables kept between jobs, and words of raw bytes in numpy."""

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, local mode, as in tests, gets a folder of its own; a cluster an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyloom-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that were measured are broadcast up to this size; a row takes so many bytes besides its columns.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 48


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows to the shared folder and read them back: they outlive any executor, and lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def _path(spark: SparkSession, path: str):
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out.getFileSystem(spark._jsc.hadoopConfiguration()), out


def exists(spark: SparkSession, path: str) -> bool:
    files, out = _path(spark, path)
    return files.exists(out)


def delete(spark: SparkSession, path: str) -> None:
    files, out = _path(spark, path)
    files.delete(out, True)


def forget(df: DataFrame) -> None:
    """Delete what ``keep`` wrote, once nothing to come reads it."""
    delete(df.sparkSession, df.kept_at)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables of this session, those too that results still read: for the end of a job."""
    delete(spark, shared_dir(spark))


def is_small(df: DataFrame) -> bool:
    """Whether a kept table's rows, as measured, fit in BROADCAST_BYTES."""
    measure = {"string": F.octet_length, "binary": F.octet_length, "array": lambda c: 8 * F.size(c)}
    sized = [F.coalesce(F.sum(measure[kind](F.col(f.name))), F.lit(0)) for f in df.schema if (kind := f.dataType.typeName()) in measure]
    rows, *more = df.agg(F.count("*"), *sized).first()
    return rows * (ROW_BYTES + 8 * len(df.columns)) + sum(more) <= BROADCAST_BYTES


def if_small(df: DataFrame) -> DataFrame:
    """A kept table, to be broadcast if it is small; else as it is, to be shuffled."""
    return F.broadcast(df) if is_small(df) else df


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def by_hash_mod(id_col: str, parts: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of one text, A-Z lower-cased for the hashes, in order."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=sums[1:])
    return starts, ends, mix64((sums[ends] - sums[starts]) * _power(_BACK, len(raw))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    return words_of(text)[2]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, no word gives none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(out)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "32m"):
    """Within it, Python gets batches of at most so many rows and about so many bytes, so that long texts don't add up."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
