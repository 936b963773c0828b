"""Checks of outputs and runs, as tables of what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.config import ACTIONS, MESSAGE_TYPES
from quietwire.sources.sinks import output_rows
from quietwire.sources.staging import stage


def _found(df: DataFrame, condition: Column, check: str) -> DataFrame:
    return df.filter(condition).select(F.lit(check).alias("check"), "message_id")


def expected_minus_got(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(check, message_id) of ids that are missing or extra."""
    e, g = expected.select("message_id").distinct(), got.select("message_id").distinct()
    return e.join(g, "message_id", "left_anti").select(F.lit("missing").alias("check"), "message_id").unionByName(g.join(e, "message_id", "left_anti").select(F.lit("extra").alias("check"), "message_id"))


def validate_output(output: DataFrame, expected: DataFrame) -> DataFrame:
    """Q01: (check, message_id) of everything wrong with an output whose columns are all strings."""
    number = F.col("confidence").try_cast("double")
    vocabulary = [
        _found(output, ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action"),
        _found(output, ~F.coalesce(F.col("message_type").isin(*MESSAGE_TYPES), F.lit(False)), "message_type"),
        _found(output, F.trim(F.coalesce("reason", F.lit(""))) == "", "reason"),
        _found(output, F.trim(F.coalesce("evidence_message_ids", F.lit(""))) == "", "evidence"),
        _found(output, number.isNull() | (number < 0) | (number > 1), "confidence"),
    ]
    twice = output.groupBy("message_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("check"), "message_id")
    return reduce(DataFrame.unionByName, [*vocabulary, twice, expected_minus_got(expected, output)])


def unresolved_media(messages: DataFrame, media: DataFrame) -> DataFrame:
    """Q02: attached records that nobody extracted."""
    asked = messages.filter("media_type <> '' and media_id <> ''").select("media_type", "media_id").distinct()
    return asked.join(media.select("media_type", "media_id").distinct(), ["media_type", "media_id"], "left_anti")


def readiness(decisions: DataFrame, messages: DataFrame, media: DataFrame, accuracy: DataFrame, critical: DataFrame) -> DataFrame:
    """Q03: (check, passed, detail), one row each."""
    rows = [
        decisions.agg(F.lit("one_decision_a_message").alias("check"), ((F.count("*") == messages.agg(F.count("*").alias("n")).scalar()) & (F.count("*") == F.count_distinct("message_id"))).alias("passed"), F.count("*").cast("string").alias("detail")),
        decisions.agg(F.lit("no_repairs").alias("check"), (F.count_if(F.size("violations") > 0) == 0).alias("passed"), F.count_if(F.size("violations") > 0).cast("string").alias("detail")),
        unresolved_media(messages, media).agg(F.lit("media_resolves").alias("check"), (F.count("*") == 0).alias("passed"), F.count("*").cast("string").alias("detail")),
        validate_output(output_rows(decisions), messages).agg(F.lit("output_contract").alias("check"), (F.count("*") == 0).alias("passed"), F.count("*").cast("string").alias("detail")),
        accuracy.select(F.lit("type_accuracy").alias("check"), (F.col("type_accuracy") >= 0.90).alias("passed"), F.format_string("%.4f", F.col("type_accuracy")).alias("detail")),
        accuracy.select(F.lit("accuracy").alias("check"), (F.col("action_accuracy") >= 0.90).alias("passed"), F.format_string("%.4f", F.col("action_accuracy")).alias("detail")),
        accuracy.select(F.lit("confidence_error").alias("check"), (F.col("confidence_error") <= 0.05).alias("passed"), F.format_string("%.4f", F.col("confidence_error")).alias("detail")),
        critical.agg(F.lit("no_critical_errors").alias("check"), (F.coalesce(F.sum("n"), F.lit(0)) == 0).alias("passed"), F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, rows)


#: Groups of rows whose fingerprints two runs are compared by.
BUCKETS = 4096


def fingerprints(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, fingerprint) of the rows by a hash of ``key``: sums that no order or dealing of rows changes."""
    hashed = df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), *[F.xxhash64(F.lit(i), *df.columns).cast("decimal(38,0)").alias(f"h{i}") for i in (0, 1)])
    return hashed.groupBy("bucket").agg(F.count("*").alias("rows"), F.struct(F.sum("h0"), F.sum("h1")).alias("fingerprint"))


def differences(left: DataFrame, right: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Q07: rows that two runs don't have in common, with repetitions.

    What is compared first is a fingerprint of each of ``buckets`` groups, summed where the rows stand; rows are only sent and compared one by one in
    groups whose fingerprints differ, none if the runs agree.
    """
    one, other = fingerprints(left, key, buckets), fingerprints(right, key, buckets)
    unlike = one.join(other, "bucket", "full").filter(~one["rows"].eqNullSafe(other["rows"]) | ~one["fingerprint"].eqNullSafe(other["fingerprint"])).select("bucket")
    unlike = F.broadcast(stage(unlike))  # of ``buckets`` rows at most
    some = [df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).join(unlike, "bucket", "left_semi").drop("bucket") for df in (left, right)]
    return some[0].exceptAll(some[1]).unionByName(some[1].exceptAll(some[0]))
