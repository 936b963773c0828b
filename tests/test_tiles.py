"""Pairs in tiles of bounded size: every pair once, scores as plainly worked out, and the same best ones as from all pairs."""

import os
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quietwire.config import DEFAULT
from quietwire.operators import similarity, tiles
from quietwire.plans import driver_views, route

SF = "/root/testdata/sf0.001"


def test_every_pair_is_in_one_tile(spark):
    keys = ["hot"] * 60 + [f"k{i % 7}" for i in range(40)] + [None] * 3
    left = spark.createDataFrame([(f"m{i}", k) for i, k in enumerate(keys)], "id string, key string")
    right = spark.createDataFrame([(f"h{i}", k) for i, k in enumerate(keys[:90] + ["alone"] * 5)], "id string, key string")

    def listed(a, b):
        pairs = tiles.KeyPairs(a["key"], b["key"])
        assert len(a) < 60 and len(b) < 60  # no tile has all rows of the hot key
        return pa.table([a["id"].take(pa.array(pairs.i)), b["id"].take(pa.array(pairs.j)), pa.array([len(a)] * len(pairs), pa.int32())], names=["a", "b", "rows"])

    rows = tiles.tiled(left, right, "key", ("id", "id"), (F.lit(10), F.lit(10)), listed, "a string, b string, rows int", tile_rows=12).collect()
    expected = Counter((f"m{i}", f"h{j}") for i, x in enumerate(keys) for j, y in enumerate(keys[:90]) if x is not None and x == y)
    assert Counter((r.a, r.b) for r in rows) == expected
    assert tiles.tiled(left.limit(0), right, "key", ("id", "id"), (F.lit(10), F.lit(10)), listed, "a string, b string, rows int").count() == 0


def test_small_keys_fill_a_tile_by_their_pairs(spark):
    rows = spark.createDataFrame([(f"x{i}", f"k{i // 3}") for i in range(600)], "id string, key string")

    def listed(a, b):
        pairs = tiles.KeyPairs(a["key"], b["key"])
        return pa.table([pa.array([len(pairs)], pa.int64())], names=["pairs"])

    found = [r.pairs for r in tiles.tiled(rows, rows, "key", ("id", "id"), (F.lit(10), F.lit(10)), listed, "pairs long", tile_rows=12).collect()]
    assert sum(found) == 200 * 9 and max(found) <= 12 * 12  # no more pairs than a tile of one key has
    assert len(found) < 100  # a group for each key would be 200


def test_first_pairs_are_the_same_however_far_apart_the_numbers_are():
    rng = np.random.default_rng(3)
    pairs = tiles.KeyPairs(pa.array(rng.choice(["a", "b"], size=20).tolist()), pa.array(rng.choice(["a", "b", "c"], size=30).tolist()))
    at = np.flatnonzero(rng.random(len(pairs)) < 0.8)
    score, tie = rng.integers(-3, 4, size=len(pairs)), rng.permutation(len(pairs))
    expected = [p for i in range(20) for p in sorted((p for p in at.tolist() if pairs.i[p] == i), key=lambda p: (-score[p], tie[p]))[:4]]
    for far in (1, 1 << 30):
        assert tiles.first_of(pairs, at, score * far, tie * far, 4).tolist() == expected
    assert len(tiles.first_of(pairs, at[:0], score, tie, 4)) == 0


def test_scores_of_pairs_equal_plain_ones():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    weight = {w: float(rng.uniform(0.2, 3)) for w in words}

    def side(n):
        tokens = [None if rng.random() < 0.1 else [{"token": w, "w": weight[w]} for w in rng.choice(words, size=rng.integers(0, 6), replace=False)] for _ in range(n)]
        vectors = [[None, [0.0] * 3, rng.normal(size=3).tolist(), rng.normal(size=4).tolist(), [1.0, float("nan"), 0.0]][k] for k in rng.integers(0, 5, size=n)]
        return pa.table([pa.array(rng.choice(["a", "b", "c"], size=n).tolist()), pa.array(tokens, pa.list_(pa.struct([("token", pa.string()), ("w", pa.float64())]))), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "tokens", "vector"])

    left, right = side(30), side(40)
    tiles.STEP, before = 7, tiles.STEP
    try:
        pairs = tiles.KeyPairs(left["key"], right["key"])
        lexical, close = tiles.pair_lexical(pairs, left["tokens"], right["tokens"]), tiles.pair_cosines(pairs, left["vector"], right["vector"])
    finally:
        tiles.STEP = before
    a, b = left.to_pylist(), right.to_pylist()
    assert sorted(zip(pairs.i.tolist(), pairs.j.tolist(), strict=True)) == [(i, j) for i in range(30) for j in range(40) if a[i]["key"] == b[j]["key"]]
    for p, (i, j) in enumerate(zip(pairs.i, pairs.j, strict=True)):
        x, y = ({t["token"] for t in r["tokens"] or ()} for r in (a[i], b[j]))
        shared, sums = sum(weight[t] for t in x & y), [sum(weight[t] for t in z) for z in (x, y)]
        assert lexical[p] == pytest.approx(shared / (sums[0] * sums[1]) ** 0.5 if shared else 0.0)
        u, v = a[i]["vector"], b[j]["vector"]
        if not u or not v or len(u) != len(v) or np.isnan(u + v).any():
            assert np.isnan(close[p])
        else:
            n = np.linalg.norm(u) * np.linalg.norm(v)
            assert close[p] == pytest.approx(np.dot(u, v) / n if n else 0.0)
    assert tiles.rounded(np.array([0.00005, 0.12345, 1.00015, 0.042, -0.00005])).tolist() == [1, 1235, 10002, 420, -1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_best_pairs_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(tiles.tiled, "__defaults__", (9, 1 << 14))  # heavy users take many tiles
    t = driver_views.views(spark, SF)
    messages = route.stage(route.facts(t).select("message_id", "plain_id", "variant", "user_id", "combined", "message_text", *tiles.PAIRED))
    few = replace(DEFAULT, evidence=replace(DEFAULT.evidence, similar_k=2))
    every, best = route.stage(route.pairs(t, messages)), route.stage(route.best_pairs(t, messages, settings=few))
    assert best.count() < every.count()
    top = lambda df: sorted((r.message_id, r.rank, r.hist_id, r.score) for r in similarity.similar_topk(df, 2).collect())
    assert top(every) == top(best)
    for intent in similarity.SUPPORT:
        wanted = messages.select("message_id", F.lit(intent).alias("intent"), (F.crc32("message_id") % (similarity.MOST_CITED + 1)).cast("int").alias("want"))
        cited = lambda df: {r.message_id: r.evidence for r in similarity.evidence_topk(df, wanted).collect()}  # noqa: B023, E731
        assert cited(every) == cited(best)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_variants_decide_as_runs_of_their_own(spark):
    t = driver_views.views(spark, SF)
    variants = (route.FULL, route.Variant("quiet", (), False))
    together = defaultdict(dict)
    for r in route.route(t, variants=variants).select("variant", "plain_id", "action", "message_type", "rationale", "evidence").collect():
        together[r.variant][r.plain_id] = r[2:]
    own = {"media": t["media"].limit(0), **{k: t[k] for k in ("messages", "history", "message_events", "users", "groups", "group_members", "businesses", "relationships", "daily")}}
    alone = {r.message_id: r[1:] for r in route.route({**own, "vectors": None}).select("message_id", "action", "message_type", "rationale", "evidence").collect()}
    assert together["quiet"] == alone and together["full"] != alone and set(together["full"]) == set(alone)
