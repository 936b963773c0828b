"""Vectors, intents and second opinions in the routing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietwire.operators import similarity
from quietwire.plans import driver_views, route

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_intents_equal_plain_cosines(spark):
    rng = np.random.default_rng(4)
    vectors = [(f"m{i}", rng.normal(size=6).tolist()) for i in range(40)] + [("short", [1.0, 2.0]), ("zero", [0.0] * 6)]
    exemplars = [("fraud", rng.normal(size=6).tolist()) for _ in range(3)] + [("urgent", rng.normal(size=6).tolist()) for _ in range(2)] + [("benign", rng.normal(size=5).tolist())]
    schema = "string, vector array<double>"
    got = {r.message_id: (r.intent, r.margin) for r in similarity.intent_verdict(spark.createDataFrame(vectors, f"message_id {schema}"), spark.createDataFrame(exemplars, f"intent {schema}")).collect()}
    assert set(got) == {m for m, v in vectors if len(v) == 6}
    for message, vector in vectors[:40]:
        x = np.array(vector)
        best = {}
        for intent, example in exemplars[:5]:
            y = np.array(example)
            best[intent] = max(best.get(intent, -2), round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 3))
        first, second = sorted(best.values(), reverse=True)
        sure = round(first - second, 9) >= 0.12 and first >= 0.35
        assert got[message] == (max(best, key=best.get) if sure else "", pytest.approx(first - second, abs=1e-9))


def test_vectors_and_intents_reach_the_decisions(spark):
    t = driver_views.views(spark, SF)
    plain = {r.message_id: r for r in route.scored(t)[0].select("message_id", "threats", "lexicon_hit_count", "combined").collect()}
    quiet = [m for m, r in plain.items() if not r.lexicon_hit_count and len(r.combined.split()) >= 3]
    loud = [m for m, r in plain.items() if r.lexicon_hit_count]
    t["vectors"] = spark.createDataFrame([(m, [1.0, 0.1]) for m in quiet + loud], "message_id string, vector array<double>")
    t["exemplars"] = spark.createDataFrame([("fraud", [1.0, 0.1]), ("benign", [-1.0, 0.3])], "intent string, vector array<double>")
    messages, candidates = route.scored(t)
    got = {r.message_id: r for r in messages.select("message_id", "threats", "scam", "intent").collect()}
    assert quiet and all(got[m].intent == "fraud" and "multilingual_fraud_similarity" in got[m].threats and got[m].scam >= 0.58 for m in quiet)
    assert loud and all(got[m].intent == "" for m in loud)  # their own words say enough
    assert candidates.filter("semantic < 0 or semantic > 1.000001").count() == 0


def test_opinions_refresh_reason_and_evidence(spark):
    t = driver_views.views(spark, SF)
    opinions = t["messages"].select("message_id", F.lit("mute").alias("action"), F.lit("promotion").alias("message_type"))
    before = {r.message_id: r for r in route.route(t).collect()}
    after = {r.message_id: r for r in route.route(t, verdicts=opinions).collect()}
    moved = [m for m, r in after.items() if r.second_opinion == "override"]
    assert moved and set(after) == set(before)
    for m in moved:
        assert before[m].gray_zone and before[m].action == "digest" or before[m].violations
        r = after[m]
        assert r.action == "mute" or r.violations
        assert r.reason != before[m].reason and 0.81 <= r.confidence <= 0.87 or r.action != "mute"
    assert all(after[m].action == before[m].action and after[m].reason == before[m].reason for m in after if after[m].second_opinion in ("none", "agrees", "refused_jump", "refused_risk"))
