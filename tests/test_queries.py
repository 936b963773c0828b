"""Registered queries against their SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from quietwire.plans import all_queries
from quietwire.plans.driver_views import BASE_TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
#: One of each family; the driver runs all of them.
SAMPLE = ("s02_load_context", "s03_casts", "s04_dedupe_last", "p04_brand_lookalike_domain", "p07_topic_bucket", "p08_evidence_ids", "j12_is_cold_sender", "j13_shares_group_type", "a01_engagement_profile", "a03_affinity", "a04_notification_load", "c07_extract_urls", "c23_intent_verdict", "c24_tokenize", "c25_clean_ocr_tokens", "c30_voice_prosody", "e01_lexical_similarity", "w01_similar_topk", "f07_threats", "d09_route", "q01_validate_output")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(all_queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(tuple(map(plain, row)) for row in cursor.fetchall())
    df = all_queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got == expected


def test_route_invariants(spark):
    from quietwire.plans import driver_views, route

    t = driver_views.views(spark, SF)
    rows = route.route(t).select("message_id", "user_id", "action", "message_type", "risk", "confidence", "evidence").collect()
    assert len({r.message_id for r in rows}) == len(rows) == t["messages"].count()
    assert not [r for r in rows if r.action == "notify" and r.risk >= 0.35]
    assert not [r for r in rows if r.message_type == "scam" and r.action != "mute"]
    assert all(0.78 <= r.confidence <= 0.91 for r in rows)
    owner = {r.message_id: r.user_id for r in t["history"].select("message_id", "user_id").collect()}
    assert all(owner[e] == r.user_id for r in rows for e in r.evidence)
