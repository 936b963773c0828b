"""Engagement of each user, at five grains in one pass over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.functions import derive as d
from quietwire.functions.text import topic_bucket

COUNTS = ("seen", "opened", "replied", "dismissed", "muted", "reported", "fast")


def events_with_history(events: DataFrame, history: DataFrame) -> DataFrame:
    """Each event with the dimensions of its message; they are null where the message is unknown."""
    topics = history.select("message_id", "sender_user_id", "group_id", "business_id", topic_bucket(F.col("message_text"), F.col("forwarded_count")).alias("topic"))
    return events.join(topics, "message_id", "left")


def engagement_counts(events: DataFrame, history: DataFrame) -> DataFrame:
    """(user_id, grain, key, counts) by user, and by user with sender, group, business and topic.

    Every event is turned into one row for each grain it counts in before the only shuffle, where it is first summed up.
    """
    joined = events_with_history(events, history)
    grain = lambda name, key: F.struct(F.lit(name).alias("grain"), key.alias("key"))
    grains = F.array(grain("user", F.lit("")), *[grain(g, F.col(c)) for g, c in (("sender", "sender_user_id"), ("group", "group_id"), ("business", "business_id"), ("topic", "topic"))])
    rows = joined.withColumn("g", F.explode(F.filter(grains, lambda x: (x["grain"] == "user") | (F.coalesce(x["key"], F.lit("")) != ""))))
    fast = (F.col("reaction_minutes") >= 0) & (F.col("reaction_minutes") <= 5)
    flags = {"opened": "message_opened", "replied": "message_replied", "dismissed": "notification_dismissed", "muted": "muted_after", "reported": "reported"}
    sums = [F.count_if(F.col(c)).alias(k) for k, c in flags.items()]
    return rows.groupBy("user_id", F.col("g.grain").alias("grain"), F.col("g.key").alias("key")).agg(F.count("*").alias("seen"), *sums, F.count_if(fast).alias("fast"))


def add_counts(counts: DataFrame) -> DataFrame:
    """Counts of several sets of events, put together, as those of all events."""
    return counts.groupBy("user_id", "grain", "key").agg(*[F.sum(c).alias(c) for c in COUNTS])


def engagement_profile(events: DataFrame, history: DataFrame) -> DataFrame:
    """The counts of ``engagement_counts``, and affinity."""
    return with_affinity(engagement_counts(events, history))


def with_affinity(counts: DataFrame) -> DataFrame:
    """A03."""
    return counts.withColumn("affinity", d.affinity(*[F.col(c) for c in ("seen", "opened", "replied", "fast", "dismissed", "muted", "reported")]))


def join_stats(df: DataFrame, profile: DataFrame, grain: str, key: str) -> DataFrame:
    """``<grain>_seen`` and ``<grain>_affinity`` for (user_id, key); zeros where nothing was seen."""
    side = profile.filter(F.col("grain") == grain).select(F.col("user_id").alias("_u"), F.col("key").alias("_k"), F.col("seen").alias(f"{grain}_seen"), F.col("affinity").alias(f"{grain}_affinity"))
    out = df.join(side, (df["user_id"] == side["_u"]) & (df[key] == side["_k"]), "left").drop("_u", "_k")
    return out.fillna({f"{grain}_seen": 0, f"{grain}_affinity": 0.0})


def notification_load(daily: DataFrame) -> DataFrame:
    """Mean notifications a day and the share dismissed, by user."""
    sums = daily.groupBy("user_id").agg(F.sum("sent").alias("sent"), F.sum("dismissed").alias("dismissed"), F.count("*").alias("days"))
    ratio = F.when(F.col("sent") > 0, F.round(F.col("dismissed") / F.col("sent"), 3)).otherwise(0.0)
    return sums.select("user_id", F.round(F.col("sent") / F.col("days"), 3).alias("load"), ratio.alias("dismissal_ratio"))


def user_baselines(users: DataFrame) -> DataFrame:
    """A05."""
    total = F.col("opened_30d") + F.col("dismissed_30d")
    return users.select(
        "user_id",
        F.when(total > 0, F.round(F.col("opened_30d") / total, 3)).otherwise(0.5).alias("engagement_baseline"),
        F.round(F.col("reported_30d") / F.greatest("opened_30d", F.lit(1)), 4).alias("report_propensity"),
    )


def fatigue(load: DataFrame) -> DataFrame:
    """A06."""
    tired = (F.col("dismissal_ratio") >= 0.5) & (F.col("load") >= 2.0)
    return load.select("user_id", F.when(tired, F.round(F.least(F.lit(1.0), (F.col("dismissal_ratio") - 0.5) * 2.0), 3)).otherwise(0.0).alias("fatigue"))
