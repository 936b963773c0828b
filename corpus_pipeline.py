"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Every stage takes the documents that its predecessor kept and returns documents with the same columns; the last one
returns token counts and digests. Stages are written as Parquet in between, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.llm import linedup, minhash, mixing, quality, queries
from quietwire.llm.scratch import delete, shared_dir, staged_tables

#: Tables staged by a stage that has since been written, by the folder it runs on.
_written: dict[str, list[str]] = {}


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage is called when its predecessor's result has been written; what that one staged can go. One pipeline a folder at a time."""

    @wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _written.pop(sf_dir, []):
            delete(spark, path)
        with staged_tables() as tables:
            result = function(spark, docs, sf_dir)
        _written[sf_dir] = tables
        return result

    return staged


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filter_quality(docs, _labels(spark, sf_dir))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; n_chars follows the text."""
    left = linedup.drop_recurring_lines(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Rows are told apart by id and text, so different texts of one id, or without an id, are different documents. Of a group's rows with
    its smallest id, that of the smallest text hash stays. Documents without words are in no group and all stay.
    """
    verdicts = minhash.near_duplicates(docs, with_group=True).filter("kept")
    kept = verdicts.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), F.col("group").alias("kept_group")).distinct()
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    whole = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["hash"] == kept["kept_hash"]))
    alone = F.when(F.col("kept_group").isNull(), F.monotonically_increasing_id())  # no two rows without words have a group in common
    return whole.groupBy("id", "kept_group", alone.alias("alone")).agg(F.min_by("row", F.struct("hash", F.xxhash64("row"))).alias("row")).select("row.*")


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights leave no use for go."""
    return mixing.filter_mixed(docs, _labels(spark, sf_dir).select("doc_id", mixing.label_domain().alias("domain")))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return queries.token_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: Hashing, the classifier and the tokenizer have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. The last stage is not run yet when this returns, so its input stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    before = None
    for _, function in stages:
        path = f"{shared_dir(spark)}/quietwire-pipeline-{uuid.uuid4().hex}"
        function(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return last(spark, docs, sf_dir)
