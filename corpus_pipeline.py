"""A training corpus from raw documents, in five stages: quality, exact copies, near copies, mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns
the columns of documents; the last one returns the pieces of the packed sequences.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import forget, keep
from tallyloom.llm.exact_dedup import drop_duplicates
from tallyloom.llm.ngram_join import drop_similar
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.quality_crf import keep_good
from tallyloom.llm.source_mixing import take_mix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, learned from the labelled ones, rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one stays: most code points, then smallest id."""
    return drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles one stays: the smallest id."""
    return drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 ids, each at its place in a sequence."""
    return pack_documents(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("mixing to target weights", mix),
    ("packing", pack),
]

#: SQL has no line CRF and no tokenizer: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written to the shared folder, read by the next, and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            out = keep(out, "stage")
        if n:
            forget(docs)  # the last stage too has written all that its result reads
        docs = out
    return docs
