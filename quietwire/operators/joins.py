"""The facts that belong to a (message, recipient) pair: left equi-joins with defaults, never a lost message.

Sides small enough are broadcast by the optimizer, which knows their sizes; nothing is hinted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.config import WORK_GROUPS
from quietwire.functions import derive as d


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def spread_blanks(key: Column, asked: Column, own: str | Column = "message_id") -> Column:
    """``key`` where something is ``asked`` for, else a key of the row's own (its message's id, or ``own``) that meets nothing.

    Messages without a key would all be dealt to the one task of the blank key, with all that is worked out after the join.
    """
    return F.when(asked, key).otherwise(F.concat(F.lit("\0"), own))


def _left(df: DataFrame, side: DataFrame, on: dict[str, str], take: dict[str, str], found: str | None = None) -> DataFrame:
    """Left join on df column -> side column; blank keys meet nothing; ``take`` maps new names to the side's columns."""
    right = side.select(*[F.col(v).alias(f"_k{i}") for i, v in enumerate(on.values())], *[F.col(v).alias(k) for k, v in take.items()], *([F.lit(True).alias(found)] if found else []))
    asked: Column = F.lit(True)
    for k in on:
        asked = asked & (df[k] != "")
    own = "message_id" if "message_id" in df.columns else F.xxhash64(*[df[c] for c in df.columns]).cast("string")
    condition = asked
    for i, k in enumerate(on):
        condition = condition & ((df[k] if i else spread_blanks(df[k], asked, own)) == right[f"_k{i}"])
    out = df.join(right, condition, "left").drop(*[f"_k{i}" for i in range(len(on))])
    return out.withColumn(found, F.coalesce(found, F.lit(False))) if found else out


def join_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """J01, P02."""
    out = _left(df, users, {"user_id": "user_id"}, {"dnd_window": "dnd_window"})
    return out.withColumn("quiet", d.quiet_hours(F.coalesce("dnd_window", F.lit("")), F.col("created_at"))).drop("dnd_window")


def join_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """J02."""
    return _left(df, groups, {"group_id": "group_id"}, {"group_type": "group_type"}).fillna("", ["group_type"])


def join_businesses(df: DataFrame, businesses: DataFrame) -> DataFrame:
    """J03, P03, P04."""
    columns = ("verified", "official_domain", "used_domain", "account_age_days", "sent_30d", "reports_30d", "domain_age_days")
    out = _left(df, businesses, {"business_id": "business_id"}, {f"biz_{c}": c for c in columns}, "has_biz")
    out = out.fillna({"biz_verified": False, "biz_official_domain": "", "biz_used_domain": ""})
    pair = F.col("biz_official_domain"), F.col("biz_used_domain")
    return out.withColumns({"mismatch": F.col("has_biz") & d.domain_mismatch(*pair), "lookalike": F.col("has_biz") & d.lookalike_domain(*pair)})


def join_memberships(df: DataFrame, members: DataFrame) -> DataFrame:
    """Of the recipient and of the sender in the message's group."""
    mine = {"mem_role": "role", "mem_read": "read_30d", "mem_replies": "replies_30d", "mem_dismissed": "dismissed_30d", "mem_muted": "muted"}
    out = _left(df, members, {"group_id": "group_id", "user_id": "user_id"}, mine, "is_member")
    out = _left(out, members, {"group_id": "group_id", "sender_user_id": "user_id"}, {"snd_role": "role"}, "snd_member")
    return out.withColumn("sender_admin", F.coalesce(F.col("snd_role") == "admin", F.lit(False))).drop("snd_role")


def join_relationships(df: DataFrame, relationships: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """J06, P05.

    ``asked`` has the recipients (user_id) of ``df``: relationships of others, which meet no message, are left out. Where it is staged, its
    size is known, and a small one leaves them out before the relationships themselves are worked out.
    """
    if asked is not None:
        relationships = relationships.join(asked, "user_id", "left_semi")
    columns = ("why", "allows_promotions", "opted_out_at", "activity_180d", "opened_30d", "dismissed_30d", "replied_30d")
    out = _left(df, relationships, {"user_id": "user_id", "business_id": "business_id"}, {f"rel_{c}": c for c in columns}, "has_rel")
    active = F.col("has_rel") & ((F.col("rel_activity_180d") > 0) | (F.col("rel_replied_30d") > 0))
    opted_out = F.col("has_rel") & (F.col("rel_opted_out_at").isNotNull() | ~F.col("rel_allows_promotions"))
    ignored = F.col("has_rel") & (F.col("rel_dismissed_30d") >= 3) & (F.col("rel_opened_30d") <= 1)
    why = F.lower(F.coalesce("rel_why", F.lit("")))
    return out.withColumns({"rel_active": active, "opted_out": opted_out, "rel_ignored": ignored, "why": why})


def join_prior_contact(df: DataFrame, history: DataFrame) -> DataFrame:
    """Whether the recipient's history has this sender, or this business."""
    senders = history.filter("sender_user_id <> ''").select("user_id", "sender_user_id").distinct()
    firms = history.filter("business_id <> ''").select("user_id", "business_id").distinct()
    out = _left(df, firms, {"user_id": "user_id", "business_id": "business_id"}, {}, "knows_business")
    out = _left(out, senders, {"user_id": "user_id", "sender_user_id": "sender_user_id"}, {}, "knows_sender")
    has_sender, has_business = F.col("sender_user_id") != "", F.col("business_id") != ""
    cold = F.when(has_sender, ~F.col("knows_sender")).when(has_business, ~F.col("rel_active") & ~F.col("knows_business")).otherwise(False)
    return out.withColumns({"is_stranger": has_sender & ~F.col("knows_sender"), "is_cold": cold})


def shared_group_pairs(members: DataFrame, groups: DataFrame, types: tuple[str, ...] = WORK_GROUPS) -> DataFrame:
    """(user_id, other_id) who are both in a group of one of the types."""
    inside = members.join(groups.filter(F.col("group_type").isin(*types)).select("group_id"), "group_id", "left_semi").select("group_id", "user_id").distinct()
    return inside.join(inside.select("group_id", F.col("user_id").alias("other_id")), "group_id").select("user_id", "other_id").distinct()


def shares_group_type(df: DataFrame, members: DataFrame, groups: DataFrame, types: tuple[str, ...] = WORK_GROUPS, asked: DataFrame | None = None) -> DataFrame:
    """J13 for each message, without building all pairs of members: the recipient's groups meet the sender's.

    ``asked`` has the recipients and senders of ``df``, where another table has them without the joins that ``df`` went through.
    """
    inside = members.join(groups.filter(F.col("group_type").isin(*types)).select("group_id"), "group_id", "left_semi").select("group_id", "user_id").distinct()
    asked = (df if asked is None else asked).filter("sender_user_id <> ''").select("user_id", "sender_user_id").distinct()
    mine = asked.join(inside, "user_id")
    both = mine.join(inside.select(F.col("group_id"), F.col("user_id").alias("sender_user_id")), ["group_id", "sender_user_id"]).select("user_id", "sender_user_id").distinct()
    return _left(df, both, {"user_id": "user_id", "sender_user_id": "sender_user_id"}, {}, "shares_work")
