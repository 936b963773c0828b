"""Work is dealt over tasks by what it costs, whatever the rows have in common."""

import datetime

import pytest
from pyspark.sql import functions as F

from quietwire.operators import content, joins, similarity, tiles
from quietwire.plans import driver_views, route

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plain_joins(spark):
    """Sort-merge joins as planned: large tables are neither broadcast nor are their partitions put together."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def messages(spark, texts):
    at = datetime.datetime(2024, 1, 25)
    rows = [(f"m{i}", f"u_{i}", "personal", "", "", "", at, x, "", "", 0) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "message_id string, user_id string, conversation_type string, group_id string, business_id string, sender_user_id string, created_at timestamp, message_text string, media_type string, media_id string, forwarded_count int")


MEDIA = "media_type string, media_id string, ok boolean, media_text string, layout string, has_qr boolean, duration_s double, wpm double"


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_messages_without_a_key_are_in_many_tasks(plain_joins):
    spark = plain_joins
    sent = messages(spark, ["hello"] * 200)
    media = spark.createDataFrame([("image", "img_1", True, "x", "", False, 0.0, 0.0), ("", "", True, "must not be met", "", False, 0.0, 0.0)], MEDIA)
    seen = content.with_media(sent, media)
    assert tasks_with_rows(seen) == 4
    assert seen.count() == 200 and seen.filter("media_raw <> ''").count() == 0
    groups = spark.createDataFrame([("g_1", "family"), ("", "must not be met")], "group_id string, group_type string")
    joined = joins.join_groups(sent, groups)
    assert tasks_with_rows(joined) == 4
    assert [tuple(r) for r in joined.groupBy("group_type").count().collect()] == [("", 200)]


def test_equal_texts_are_analysed_once(spark, monkeypatch):
    given = []
    whole = content.text_features
    monkeypatch.setattr(content, "text_features", lambda told: given.append(told) or whole(told))
    texts = ["Please share your OTP @u_0", None, "", "flat 50% off, shop now"] * 50
    found = content.content_features(messages(spark, texts), spark.createDataFrame([], MEDIA))
    assert given[0].count() == 4 and given[0].rdd.getNumPartitions() == 4
    rows = {r.message_id: r for r in found.select("message_id", "n_credential", "n_promo", "is_empty", "mentions_user").collect()}
    assert len(rows) == 200
    assert rows["m0"].n_credential == rows["m4"].n_credential > 0 and rows["m0"].mentions_user and not rows["m4"].mentions_user
    assert rows["m1"].is_empty and rows["m2"].is_empty and rows["m3"].n_promo == rows["m7"].n_promo > 0


def test_near_pairs_give_the_same_repetition(spark):
    v = driver_views.views(spark, SF)
    asked = content.content_features(route.varied(v["messages"]), v["media"]).select("message_id", "plain_id", "variant", "user_id", "combined", "message_text", *tiles.PAIRED)
    asked = route.stage(asked)
    every, near = (route.stage(route.best_pairs(v, asked, near=x)) for x in (None, similarity.NEAR))
    assert near.count() < every.count()
    told = [sorted(map(tuple, similarity.repetition(similarity.similar_topk(x)).collect()), key=str) for x in (every, near)]
    assert told[0] == told[1]


def test_scores_without_history_make_no_pairs(spark, monkeypatch):
    from quietwire.plans.all_queries import QUERIES

    def refused(*args, **kwargs):
        raise AssertionError("pairs are not asked for")

    monkeypatch.setattr(route, "best_pairs", refused)
    n = driver_views.views(spark, SF)["messages"].count()
    for name in ("g01_urgency", "g02_actionability", "g06_relationship_score", "g07_topic_importance", "d02_warrants_interruption"):
        assert QUERIES[name](spark, SF).count() == n, name


def test_routing_stages_no_column_that_nobody_reads(spark, monkeypatch):
    from quietwire.plans.all_queries import QUERIES

    staged, whole = [], route.stage
    monkeypatch.setattr(route, "stage", lambda df: staged.append(df.columns) or whole(df))
    rows = QUERIES["d06_select_rationale"](spark, SF)
    assert staged[-1] == ["message_id", "rationale"] and max(map(len, staged)) < 70
    assert rows.count() == driver_views.views(spark, SF)["messages"].count() and not any("signals" in columns for columns in staged)


def test_partners_are_counted_without_pairs(spark, monkeypatch):
    from quietwire.plans.all_queries import QUERIES

    v = driver_views.views(spark, SF)
    told = content.content_features(v["messages"], v["media"]).select("message_id", "user_id", F.when(F.col("combined") != "", F.col("combined")).otherwise(F.col("message_text")).alias("text"))
    pairs = similarity.lexical_similarity(told, similarity.history_texts(v["history"], v["media"]))
    wanted = sorted(map(tuple, pairs.groupBy("message_id").count().collect()))
    monkeypatch.setattr(similarity, "lexical_similarity", None)
    assert wanted and sorted(map(tuple, QUERIES["j17_token_index_join"](spark, SF).collect())) == wanted


def test_last_history_of_a_key_needs_no_pairs(plain_joins):
    from quietwire.plans.route_queries import _gold_evidence

    v = driver_views.views(plain_joins, SF)
    found = _gold_evidence(v)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and " OR " not in plan  # each key is a join of its own, met with one row
    m, h = v["messages"].alias("m"), v["history"].alias("h")
    same = lambda c: (F.col(f"m.{c}") != "") & (F.col(f"m.{c}") == F.col(f"h.{c}"))
    met = m.join(h, (F.col("m.user_id") == F.col("h.user_id")) & (same("business_id") | same("sender_user_id")))
    wanted = {r.message_id: [r.g] for r in met.groupBy("m.message_id").agg(F.max_by("h.message_id", "h.seq").alias("g")).collect()}
    assert wanted and {r.message_id: r.true_evidence for r in found.collect()} == wanted


def test_texts_are_found_without_the_joins_of_the_facts(plain_joins):
    v = driver_views.views(plain_joins, SF)
    plan = route.facts(v)._jdf.queryExecution().executedPlan().toString()
    assert sum("lineitem.parquet" in line and "FileScan" in line for line in plan.splitlines()) == 1


def test_relationships_of_others_are_left_out_before_they_are_counted(spark):
    v = driver_views.views(spark, SF)
    facts = route.facts(v)
    lines = facts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    counted = next(i for i, line in enumerate(lines) if "Aggregate [o_custkey" in line)
    read = next(i for i, line in enumerate(lines) if i > counted and "Relation [o_orderkey" in line)
    assert any("LeftSemi" in line and "o_custkey" in line for line in lines[counted:read])
    columns = ["message_id", "has_rel", "rel_active", "opted_out", "rel_ignored", "why"]
    every = joins.join_relationships(v["messages"], v["relationships"]).select(columns)
    found = sorted(map(tuple, facts.select(columns).collect()))
    assert any(row[1] for row in found) and found == sorted(map(tuple, every.collect()))
