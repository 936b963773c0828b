"""CSV in, CSV out."""

import pytest
from pyspark.sql import functions as F

from quietwire.operators import checks, decide
from quietwire.sources import assets, folders, sinks, tables


def test_quoted_lines_casts_and_last_row_wins(spark, tmp_path):
    file = tmp_path / "messages.csv"
    file.write_text(
        '﻿message_id,user_id,conversation_type,created_at,message_text,forwarded_count\n'
        'm1,u1,personal,2026-08-01 14:00,"two\nlines, ""quoted""",3\n'
        "m1,u1,group,2026-08-02,later row, x \n"
        "m2, u2 ,group,soon,,7\n",
        encoding="utf-8",
    )
    rows = {r.message_id: r for r in tables.typed(tables.read_table(spark, str(file)), "messages").collect()}
    assert set(rows) == {"m1", "m2"}
    assert (rows["m1"].conversation_type, rows["m1"].message_text, rows["m1"].forwarded_count) == ("group", "later row", 0)
    assert (rows["m2"].user_id, rows["m2"].created_at, rows["m2"].message_text, rows["m2"].forwarded_count, rows["m2"].media_id) == ("u2", None, "", 7, "")


def test_output_round_trip(spark, tmp_path):
    decisions = spark.createDataFrame([("m1", "mute", "scam", 'a "reason", here', 0.8, ["h1", "h2"]), ("m2", "digest", "event", "b", 0.845, [])], "message_id string, action string, message_type string, reason string, confidence double, evidence array<string>")
    sinks.write_output(decisions, str(tmp_path / "out"))
    rows = {r.message_id: r for r in spark.read.options(header=True, escape='"').csv(str(tmp_path / "out")).collect()}
    assert rows["m1"].evidence_message_ids == "h1;h2" and rows["m1"].confidence == "0.80" and rows["m1"].reason == 'a "reason", here'
    assert rows["m2"].evidence_message_ids == "none"


def test_missing_key_column_fails(spark):
    raw = spark.createDataFrame([("u1",)], "user_id string").withColumn("seq", F.lit(0))
    with pytest.raises(ValueError, match="message_id"):
        tables.typed(raw, "messages")


def test_last_row_wins_over_files_however_they_are_split(spark, tmp_path):
    rows = [(f"m{i % 5}", f"u{i}") for i in range(60)]
    for form in ("csv", "parquet"):
        folder = tmp_path / f"messages.{form}"
        for k in range(3):
            part = spark.createDataFrame(rows[20 * k : 20 * k + 20], "message_id string, user_id string").coalesce(1)
            part.write.csv(str(folder / f"file{k}"), header=True) if form == "csv" else part.write.parquet(str(folder / f"file{k}"))
        path = str(folder / "*") if form == "parquet" else str(folder / "*" / "*.csv")
        last = {m: u for m, u in rows}
        for size in ("64m", "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = tables.read_table(spark, path)
            got = {r.message_id: r.user_id for r in tables.typed(read, "messages").collect()}
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert got == last
            assert [tuple(r) for r in read.orderBy("seq").select("message_id", "user_id").collect()] == rows


def test_only_suspected_assets_are_compared(spark, tmp_path):
    kept = [(f"n{i}", f"text {i}") for i in range(400)]
    df = spark.createDataFrame(kept, "name string, content string")
    ledger = str(tmp_path / "ledger")
    schema = "asset_key string"
    assert assets.incremental_new_assets(df, assets.read_ledger(spark, ledger, schema), "v1").count() == 400
    for part in (0, 1):
        known = df.filter(F.crc32("name") % 3 == part).select(assets.asset_key("v1", F.col("name"), F.col("content")).alias("asset_key"))
        assets.record_assets(spark, known, ledger)
    left = assets.incremental_new_assets(df, assets.read_ledger(spark, ledger, schema), "v1")
    assert sorted(r.name for r in left.collect()) == sorted(r.name for r in df.filter(F.crc32("name") % 3 == 2).collect())
    before = assets.MOST_BITS
    assets.MOST_BITS = 8  # a full filter loses nothing
    try:
        full = assets.incremental_new_assets(df, assets.read_ledger(spark, ledger, schema), "v1")
        assert sorted(r.name for r in full.collect()) == sorted(r.name for r in left.collect())
    finally:
        assets.MOST_BITS = before


def test_an_append_is_whole_or_not_at_all(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    folders.append(spark, spark.range(3), ledger)
    with pytest.raises(Exception):  # noqa: B017
        folders.append(spark, spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), ledger)
    assert len(folders.listed(spark, ledger)) >= 1
    parts = [p for p in folders.listed(spark, ledger) if "/part-" in p]
    assert len(parts) == 1 and spark.read.parquet(*parts).count() == 3


def test_a_bad_row_is_deferred_alone(spark):
    columns = {c: 0.5 for c in decide.NEEDED if c not in ("action", "message_type")}
    row = lambda m, **more: {"message_id": m, "action": "notify", "message_type": "urgent", "rationale": "direct_ask", "reason": "as it was", "evidence": ["h"], "violations": [], **columns, **more}
    schema = ", ".join(["message_id string, action string, message_type string, rationale string, reason string, evidence array<string>, violations array<string>", *[f"{c} double" for c in columns]])
    rows = {r.message_id: r for r in decide.with_fallback(spark.createDataFrame([row("good"), row("bad", trust=None, priority=None)], schema)).collect()}
    assert (rows["good"].action, rows["good"].reason, rows["good"].evidence, rows["good"].errors) == ("notify", "as it was", ["h"], [])
    assert (rows["bad"].action, rows["bad"].message_type, rows["bad"].confidence, rows["bad"].evidence, rows["bad"].errors) == ("digest", "unknown", 0.8, [], ["trust", "priority"])
    assert rows["bad"].reason == decide.DEFERRED


def test_differences_of_runs(spark):
    rows = [(f"m{i}", i % 3) for i in range(300)] + [("m1", 1)]
    left = spark.createDataFrame(rows, "message_id string, x int")
    same = spark.createDataFrame(rows[::-1], "message_id string, x int").repartition(7)
    assert checks.differences(left, same, "message_id", 16).count() == 0
    other = spark.createDataFrame([*rows[:-1], ("m7", 9)], "message_id string, x int")
    assert sorted(tuple(r) for r in checks.differences(left, other, "message_id", 16).collect()) == [("m1", 1), ("m7", 9)]
