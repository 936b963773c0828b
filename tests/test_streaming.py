"""A stream gives what the batch gives."""

import os

import pytest
from pyspark.sql import functions as F

from quietwire.operators import profiles as batch_profiles
from quietwire.plans import driver_views, route
from quietwire.streaming import profiles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_windowed_engagement(spark, tmp_path):
    v = driver_views.views(spark, SF)
    events = v["message_events"].join(v["history"].select("message_id", F.col("created_at").cast("timestamp").alias("ts")), "message_id")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = profiles.windowed_engagement(stream).writeStream.outputMode("complete").format("memory").queryName("engagement").start()
    q.processAllAvailable()
    q.stop()
    batch = profiles.windowed_engagement(events)
    key = lambda rows: sorted((r.user_id, str(r.start), r.seen, r.opened, r.dismissed, r.affinity) for r in rows)
    assert key(spark.table("engagement").collect()) == key(batch.collect())


def test_message_facts(spark, tmp_path):
    v = driver_views.views(spark, SF)
    messages = v["messages"]
    messages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    shown = ("message_id", "combined", "n_urgency", "quiet", "mismatch", "is_member", "sender_admin", "rel_active", "is_stranger")
    q = profiles.message_facts(stream, v).select(*shown).writeStream.outputMode("append").format("memory").queryName("facts").start()
    q.processAllAvailable()
    q.stop()
    batch = route.facts(v).select(*shown)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(spark.table("facts").collect()) == key(batch.collect())


def test_profile_table_in_any_batches(spark, tmp_path):
    v = driver_views.views(spark, SF)
    events, history = v["message_events"], v["history"]
    key = lambda df: sorted(tuple(r) for r in df.select("user_id", "grain", "key", "seen", "opened", "replied", "dismissed", "muted", "reported", "fast", "affinity").collect())
    whole = key(batch_profiles.engagement_profile(events, history))
    for k in range(4):
        events.filter(F.crc32("message_id") % 4 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    table = profiles.ProfileTable(spark, str(tmp_path / "profile"))
    assert table.profile().count() == 0
    q = table.follow(stream, lambda: history).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    q.processAllAvailable()
    q.stop()
    assert key(table.profile()) == whole
    table.add(events.filter(F.crc32("message_id") % 4 == 0), history, 1000)
    table.add(events.filter(F.crc32("message_id") % 4 == 1), history, 1000)  # run again, a batch replaces what it wrote
    more = key(table.profile())
    assert more != whole
    table.compact()
    assert key(table.profile()) == more and len(table._folders("batch-")) == 0 and len(table._folders("base-")) == 1
    table.add(events, history, 1000)  # a batch that is in the base already adds nothing
    assert key(table.profile()) == more
    table.compact()
    assert key(table.profile()) == more
