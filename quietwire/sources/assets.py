"""Attached files: which of them an extraction has still to see, and what is known of those referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.sources import folders


def asset_key(salt: str, name: Column, content: Column) -> Column:
    """Changes with the file, its name, and the salt that stands for the extraction's version and settings."""
    return F.substring(F.sha2(F.concat(F.lit(salt).cast("binary"), name.cast("binary"), content.cast("binary")), 256), 1, 24)


def read_assets(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


#: Bits of the filter of known keys, for each key, and at most: 16 MB that are broadcast.
BITS_A_KEY, MOST_BITS = 16, 1 << 27


def _position(bits: int) -> Column:
    return F.pmod(F.xxhash64("asset_key"), F.lit(bits))


def known_bits(features: DataFrame) -> tuple[DataFrame, int]:
    """((bucket, bitmap), bits): a bit for each known ``asset_key``, set by partition and merged; a row has 4 kB, all of them MOST_BITS at most."""
    bits = 1 << 15
    n = features.count()
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    at = features.filter("asset_key is not null").select(_position(bits).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")), bits


def incremental_new_assets(assets: DataFrame, features: DataFrame, salt: str) -> DataFrame:
    """Assets (name, content) without a row in ``features`` (asset_key).

    An asset whose bit is not set is new and stays where it is; only the others, known ones and a few that share a bit, are sent to be
    compared with the keys themselves. None is lost, however full the filter is.
    """
    keyed = assets.withColumn("asset_key", asset_key(salt, F.col("name"), F.col("content")))
    filled, bits = known_bits(features)
    bit = F.bitmap_bit_position(_position(bits))
    byte = F.conv(F.hex(F.substring("_bitmap", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    held = F.broadcast(filled.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))  # MOST_BITS at most
    told = keyed.join(held, F.bitmap_bucket_number(_position(bits)) == F.col("_bucket"), "left").withColumn("_suspected", F.coalesce(is_set, F.lit(False)))
    sure = told.filter(~F.col("_suspected")).select(*keyed.columns)
    suspected = told.filter("_suspected").select(*keyed.columns)
    return sure.unionByName(suspected.join(features.select("asset_key"), "asset_key", "left_anti").select(*keyed.columns))


def record_assets(spark: SparkSession, features: DataFrame, ledger: str) -> str:
    """Append what has been extracted (asset_key, ...) to the ledger, as one folder that is there whole or not at all."""
    return folders.append(spark, features, ledger)


def read_ledger(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    parts = [p for p in folders.listed(spark, ledger) if p.rsplit("/", 1)[-1].startswith("part-")]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def load_media_features(messages: DataFrame, features: DataFrame) -> DataFrame:
    """Extraction records of what messages refer to; what is missing is left out."""
    asked = messages.filter("media_type <> '' and media_id <> ''").select("media_type", "media_id").distinct()
    return features.join(asked, ["media_type", "media_id"], "left_semi")
