"""A training corpus from documents: quality, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blkscope.llm import exact_dedup, packing, quality, secret_scan, simhash
from blkscope.llm.common import scratch, sealed, text_of, unused, written
from blkscope.llm.queries import TOKENIZER

#: Words of a shingle, differing bits of fingerprints that are linked, and the exact Jaccard similarity
#: of the sets of shingles from which texts are near duplicates at any number of bits.
SHINGLE, BITS, JACCARD = 5, 4, 0.8

#: Texts of a quality block. Python workers keep what a block took of them for the stages after, so blocks are smaller here.
QUALITY_BLOCK_BYTES = 4 << 20


def _rows_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key and text are among gone's (key, sha); texts that differ under one key are told apart.

    Documents move once for it, at any size alike: what is taken out grows with them.
    """
    (sha,) = unused(docs, "sha")
    ids = written(gone.select(F.col("key").alias("gone_key"), F.unhex("sha").alias("gone_sha")).distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_key")) & (F.col(sha) == F.col("gone_sha"))
    return docs.withColumn(sha, F.unhex(F.sha2(text_of("text"), 256))).join(ids.hint("merge"), same, "left_anti").drop(sha)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, each row by its own text.

    Null texts, empty ones and those of white space only go; rows with a null
    doc_id are judged like others; of rows that repeat doc_id and text all stay
    if one does. No rows: no rows.
    """
    return _rows_without(docs, quality.rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), block_bytes=QUALITY_BLOCK_BYTES))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space squeezed, the row with the smallest doc_id, and one row of those that repeat it.

    Null and empty texts are equal. A row without a doc_id stays only if its
    whole group has none. No rows: no rows.
    """
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints and similar texts the document with the smallest doc_id.

    Of several texts under that doc_id one stays; a row without a doc_id stays
    only if its whole group has none. Texts without words are one group. Rows
    that repeat doc_id and text stay together. No rows: no rows.
    """
    found = simhash.near_groups(docs, shingle=SHINGLE, k=BITS, jaccard=JACCARD).withColumnRenamed("doc_id", "key")
    first = found.filter(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("sha").alias("first"))
    gone = found.join(first, "group").filter(~F.col("key").eqNullSafe(F.col("component_id")) | (F.col("sha") != F.col("first")))
    return _rows_without(docs, gone)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null and empty texts have none. No rows: no rows."""
    return secret_scan.redacted(docs, *secret_scan.trained(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    A null or empty text is one piece of one token. No rows: no rows.
    """
    return packing.best_fit_packing(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: The classifier's model and the forest are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what is left of documents. A stage's intermediate tables are deleted once its output is written, all outputs but the last at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as kept:
        for k, (_, stage) in enumerate(STAGES):
            with scratch(spark) as own:
                docs = sealed(stage(spark, docs, sf_dir), f"stage-{k}", own)
        kept.extend(own)
    return docs
