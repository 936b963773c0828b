"""Streaming forms: profiles from a stream of reactions, and facts joined to a stream of messages.

An extension of the batch plans; the same operators run on streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.functions import derive as d
from quietwire.operators import content, joins, profiles
from quietwire.sources import folders


def windowed_engagement(events: DataFrame, time_col: str = "ts", window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts by user and window of a stream (user_id, time, message_opened, message_replied, notification_dismissed, muted_after, reported, reaction_minutes).

    Rows later than the watermark are dropped by Spark, and a window is final once the watermark has passed it.
    """
    fast = (F.col("reaction_minutes") >= 0) & (F.col("reaction_minutes") <= 5)
    sums = {"opened": "message_opened", "replied": "message_replied", "dismissed": "notification_dismissed", "muted": "muted_after", "reported": "reported"}
    grouped = events.withWatermark(time_col, lateness).groupBy(F.window(time_col, window), "user_id")
    counts = grouped.agg(F.count("*").alias("seen"), *[F.count_if(F.col(c)).alias(k) for k, c in sums.items()], F.count_if(fast).alias("fast"))
    shown = counts.select("user_id", F.col("window.start").alias("start"), "seen", *sums, "fast")
    return shown.withColumn("affinity", d.affinity(*[F.col(c) for c in ("seen", "opened", "replied", "fast", "dismissed", "muted", "reported")]))


def message_facts(messages: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """Content and facts of a stream of messages, joined to static tables."""
    df = content.content_features(messages, t["media"])
    for join, table in ((joins.join_users, "users"), (joins.join_groups, "groups"), (joins.join_businesses, "businesses"), (joins.join_memberships, "group_members"), (joins.join_relationships, "relationships"), (joins.join_prior_contact, "history")):
        df = join(df, t[table])
    return df


#: Counts as they are written.
_COUNTS = f"user_id string, grain string, key string, {', '.join(f'{c} long' for c in profiles.COUNTS)}"


class ProfileTable:
    """A01 kept up to date: a base of counts, and the counts of every batch of events since, in a folder that all executors share.

    A batch writes what it adds, by its number, so a batch that is run again replaces what it wrote; the profile is the sum. ``compact`` sums the
    batches up to one into a new base, which takes effect by one rename; what it replaces is deleted after that. Only one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, events: DataFrame, history: DataFrame, batch: int) -> None:
        """Count one batch of events, each of which comes in one batch, after its message."""
        if batch > self._base():
            counts = profiles.engagement_counts(events, history)
            folders.replace(self.spark, counts.select(*[F.col(f.name).cast(f.dataType) for f in self._none().schema]), f"{self.path}/batch-{batch:012d}")

    def counts(self) -> DataFrame:
        base = self._base()
        paths = [p for p in self._folders("batch-") if int(p[-12:]) > base] + [p for p in self._folders("base-") if int(p[-12:]) == base]
        return profiles.add_counts(self.spark.read.schema(_COUNTS).parquet(*paths)) if paths else self._none()

    def profile(self) -> DataFrame:
        """(user_id, grain, key, counts, affinity) of all events so far."""
        return profiles.with_affinity(self.counts())

    def compact(self) -> None:
        """Sum all batches so far into the base."""
        batches = self._folders("batch-")
        if batches:
            last = max(int(p[-12:]) for p in batches)
            if last > self._base():
                folders.replace(self.spark, self.counts(), f"{self.path}/base-{last:012d}")
            for old in [p for p in batches if int(p[-12:]) <= last] + [p for p in self._folders("base-") if int(p[-12:]) < last]:
                folders.delete(self.spark, old)

    def follow(self, events: DataFrame, history: Callable[[], DataFrame]):
        """A stream writer that adds every micro-batch of ``events``; ``history`` gives the messages known when a batch is run."""
        return events.writeStream.foreachBatch(lambda rows, number: self.add(rows, history(), number)).outputMode("update")

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], _COUNTS)

    def _folders(self, prefix: str) -> list[str]:
        return [p for p in folders.listed(self.spark, self.path) if p.rsplit("/", 1)[-1].startswith(prefix)]

    def _base(self) -> int:
        return max((int(p[-12:]) for p in self._folders("base-")), default=-1)
