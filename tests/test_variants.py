"""Variants of a run share what they have in common."""

import os

import pytest
from pyspark.sql import functions as F

from quietwire.operators import content, tiles
from quietwire.operators.similarity import Variant
from quietwire.plans import driver_views, route

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_a_history_row_is_sent_once_for_all_variants(spark, monkeypatch):
    v = driver_views.views(spark, SF)
    variants = (route.FULL, Variant("no_vectors", vectors=False), Variant("voice_only", ("voice",)))
    sent, whole = [], tiles.tiled
    monkeypatch.setattr(tiles, "tiled", lambda left, right, *rest: sent.append((left, right)) or whole(left, right, *rest))

    def pairs(t, some):
        asked = content.content_features(route.varied(t["messages"], some), t["media"]).select("message_id", "plain_id", "variant", "user_id", "combined", "message_text", *tiles.PAIRED)
        # a product of matrices may differ in the last bits with their shape
        return sorted((*row[:4], round(row[4], 9), row[5]) for row in route.best_pairs(t, route.stage(asked), some).collect())

    got = pairs(v, variants)
    assert sent[0][1].count() == v["history"].count()
    assert sent[0][0].count() == len(variants) * v["messages"].count()
    names = ("messages", "history", "message_events")
    for variant in variants:  # each as on its own, with the tables that it reads
        t = {name: v[name] for name in names} | {"media": v["media"].filter(F.col("media_type").isin(*variant.media)), "vectors": v["vectors"].filter(F.lit(variant.vectors))}
        alone = pairs(t, (route.FULL,))
        assert alone and [(m.split("/")[1], *rest) for m, *rest in got if m.startswith(variant.name + "/")] == alone
