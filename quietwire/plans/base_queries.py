"""Queries of sources, derived fields, joins, profiles and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.config import WORK_GROUPS
from quietwire.functions import derive as d
from quietwire.functions import text as t
from quietwire.operators import checks, joins, profiles
from quietwire.plans.registry import query
from quietwire.sources import assets

_CONTEXT = ("messages", "history", "message_events", "users", "groups", "group_members", "businesses", "relationships", "daily", "media")


@query("s01_read_table", "SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey AS region_key FROM nation")
def s01(v):
    raw = v["nation"].select(*[F.col(c).cast("string").alias(c) for c in v["nation"].columns])
    return raw.select(d.cast_int(F.col("n_nationkey")).alias("nation_key"), d.text(F.col("n_name")).alias("name"), d.cast_int(F.col("n_regionkey")).alias("region_key"))


@query("s02_load_context", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in _CONTEXT))
def s02(v):
    return reduce(DataFrame.unionByName, [v[n].agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in _CONTEXT])


@query(
    "s03_casts",
    """SELECT event_id, coalesce(TRY_CAST(trim(v) AS INTEGER), 0) AS as_int, coalesce(TRY_CAST(trim(v) AS DOUBLE), -1.0) AS as_float, trim(b) IN ('1', 'true', 'True', 'yes') AS as_bool,
    coalesce(try_strptime(ts, '%Y-%m-%d %H:%M:%S'), try_strptime(ts, '%Y-%m-%d %H:%M'), try_strptime(ts, '%Y-%m-%d')) AS as_ts
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || CAST(event_id AS VARCHAR) || ' ' WHEN 1 THEN 'x' || CAST(event_id AS VARCHAR) WHEN 2 THEN '' ELSE CAST(event_id % 100 AS VARCHAR) || '.5' END AS v,
    CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN ' True' WHEN 2 THEN 'no' WHEN 3 THEN '1' ELSE '' END AS b,
    CASE event_id % 4 WHEN 0 THEN '2024-01-05 10:20:30' WHEN 1 THEN '2024-01-05 10:20' WHEN 2 THEN '2024-01-05' ELSE 'soon' END AS ts FROM events)""",
)
def s03(v):
    cells = v["events"].selectExpr(
        "event_id",
        "CASE event_id % 4 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN 'x' || event_id WHEN 2 THEN '' ELSE (event_id % 100) || '.5' END AS v",
        "CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN ' True' WHEN 2 THEN 'no' WHEN 3 THEN '1' ELSE '' END AS b",
        "CASE event_id % 4 WHEN 0 THEN '2024-01-05 10:20:30' WHEN 1 THEN '2024-01-05 10:20' WHEN 2 THEN '2024-01-05' ELSE 'soon' END AS ts",
    )
    whole = F.when(F.trim("v").rlike(r"^[+-]?\d+(\.\d*)?$"), F.round(F.trim("v").try_cast("double")).cast("int"))
    return cells.select("event_id", F.coalesce(whole, F.lit(0)).alias("as_int"), d.cast_float(F.col("v"), -1.0).alias("as_float"), d.cast_bool(F.col("b")).alias("as_bool"), d.cast_ts(F.col("ts")).cast("timestamp_ntz").alias("as_ts"))


@query("s04_dedupe_last", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def s04(v):
    return joins.dedupe_last(v["events"].select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(
    "s08_incremental_new_assets",
    """SELECT page_id, key AS asset_key FROM (SELECT page_id, substr(sha256('v1' || url || html), 1, 24) AS key FROM pages) p
    WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 3 = 0 AND substr(sha256('v1' || q.url || q.html), 1, 24) = p.key)""",
)
def s08(v):
    pages = v["pages"].select("page_id", F.col("url").alias("name"), F.col("html").alias("content"))
    done = pages.filter("page_id % 3 = 0").select(assets.asset_key("v1", F.col("name"), F.col("content")).alias("asset_key"))
    return assets.incremental_new_assets(pages, done, "v1").select("page_id", "asset_key")


@query("s09_load_media_features", "SELECT media_type, media_id, ok, layout FROM media m WHERE EXISTS (SELECT 1 FROM messages x WHERE x.media_type = m.media_type AND x.media_id = m.media_id AND x.media_id <> '')")
def s09(v):
    return assets.load_media_features(v["messages"], v["media"]).select("media_type", "media_id", "ok", "layout")


@query("p01_message_flags", "SELECT message_id, conversation_type = 'group' AS is_group, conversation_type = 'business' AS is_business, conversation_type = 'personal' AS is_personal, media_type <> '' AND media_id <> '' AS has_media FROM messages")
def p01(v):
    kind = F.col("conversation_type")
    return v["messages"].select("message_id", (kind == "group").alias("is_group"), (kind == "business").alias("is_business"), (kind == "personal").alias("is_personal"), ((F.col("media_type") != "") & (F.col("media_id") != "")).alias("has_media"))


_QUIET = """CASE coalesce(u.dnd_window, '') WHEN '22:00-07:00' THEN hour(created_at) >= 22 OR hour(created_at) < 7
  WHEN '13:00-15:30' THEN hour(created_at) * 60 + minute(created_at) BETWEEN 780 AND 929 ELSE false END"""


@query("p02_quiet_hours", f"SELECT message_id, {_QUIET} AS quiet FROM messages LEFT JOIN users u USING (user_id)")
def p02(v):
    return joins.join_users(v["messages"], v["users"]).select("message_id", "quiet")


_MISMATCH = "(official_domain <> '' AND used_domain <> '' AND official_domain <> used_domain)"
_LOOKALIKE = f"({_MISMATCH} AND length(split_part(official_domain, '.', 1)) >= 3 AND contains(replace(replace(used_domain, '-', ''), '_', ''), split_part(official_domain, '.', 1)))"


@query("p03_domain_mismatch", f"SELECT business_id, {_MISMATCH} AS mismatch FROM businesses")
def p03(v):
    return v["businesses"].select("business_id", d.domain_mismatch(F.col("official_domain"), F.col("used_domain")).alias("mismatch"))


@query("p04_brand_lookalike_domain", f"SELECT business_id, {_LOOKALIKE} AS lookalike FROM businesses")
def p04(v):
    return v["businesses"].select("business_id", d.lookalike_domain(F.col("official_domain"), F.col("used_domain")).alias("lookalike"))


@query("p05_relationship_flags", "SELECT user_id, business_id, opted_out_at IS NOT NULL OR NOT allows_promotions AS opted_out, activity_180d > 0 OR replied_30d > 0 AS active FROM relationships")
def p05(v):
    # each relationship meets itself, also one whose user or business is null: there a text stands that no id is
    r = v["relationships"].fillna("\0", ["user_id", "business_id"])
    joined = joins.join_relationships(r.select("user_id", "business_id"), r)
    return joined.select(*[F.nullif(c, F.lit("\0")).alias(c) for c in ("user_id", "business_id")], "opted_out", F.col("rel_active").alias("active"))


_OUTCOME = "CASE WHEN notification_dismissed OR muted_after OR reported THEN 'negative' WHEN message_opened OR message_replied THEN 'positive' ELSE 'neutral' END"


@query("p06_event_outcome", f"SELECT message_id, {_OUTCOME} AS outcome FROM message_events")
def p06(v):
    marks = [F.col(c) for c in ("message_opened", "message_replied", "notification_dismissed", "muted_after", "reported")]
    return v["message_events"].select("message_id", d.outcome(F.lit(True), *marks).alias("outcome"))


def _contains_any(column: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words.split("|")) + ")"


TOPIC_SQL = "CASE " + " ".join(
    f"WHEN {_contains_any('lower(message_text)', w)} THEN '{k}'"
    for k, w in (
        ("security_prompt", "otp|verify|blocked|kyc|password|pin"),
        ("promotion", "off|sale|offer|discount|cashback|deal|coupon"),
        ("logistics", "order|delivery|shipped|tracking|dispatch"),
        ("event", "meeting|appointment|booking|circular|trip|event|class"),
        ("greeting", "good morning|blessed|stay positive|god bless"),
        ("payment", "bill|due|payment|emi|statement|maintenance"),
    )
) + " WHEN forwarded_count >= 3 THEN 'forward' ELSE 'other' END"


@query("p07_topic_bucket", f"SELECT message_id, {TOPIC_SQL} AS topic FROM history")
def p07(v):
    return v["history"].select("message_id", t.topic_bucket(F.col("message_text"), F.col("forwarded_count")).alias("topic"))


@query(
    "p08_evidence_ids",
    """SELECT event_id, len(ids) AS n, CASE WHEN len(ids) > 0 THEN array_to_string(ids, ';') ELSE 'none' END AS formatted FROM (
    SELECT event_id, CASE WHEN trim(raw) = 'none' THEN [] ELSE list_filter(list_transform(string_split(raw, ';'), lambda x: trim(x)), lambda x: x <> '') END AS ids FROM (
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN '' WHEN 2 THEN 'a' || event_id || '; b' ELSE ' c;;d' || event_id END AS raw FROM events))""",
)
def p08(v):
    raw = v["events"].selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN '' WHEN 2 THEN 'a' || event_id || '; b' ELSE ' c;;d' || event_id END AS raw")
    ids = raw.withColumn("ids", d.parse_ids(F.col("raw")))
    return ids.select("event_id", F.size("ids").cast("long").alias("n"), d.format_ids(F.col("ids")).alias("formatted"))


@query("p09_is_admin", "SELECT group_id, user_id, role = 'admin' AS is_admin FROM group_members")
def p09(v):
    return v["group_members"].select("group_id", "user_id", (F.col("role") == "admin").alias("is_admin"))


@query(
    "p10_evidence_intent",
    """SELECT DISTINCT action, kind, CASE WHEN action = 'notify' THEN 'promote' WHEN action = 'mute' AND kind NOT IN ('scam', 'spam') THEN 'suppress' ELSE 'neutral' END AS intent FROM (
    SELECT CASE event_id % 3 WHEN 0 THEN 'notify' WHEN 1 THEN 'digest' ELSE 'mute' END AS action, CASE event_id % 4 WHEN 0 THEN 'scam' WHEN 1 THEN 'spam' WHEN 2 THEN 'event' ELSE 'personal' END AS kind FROM events)""",
)
def p10(v):
    rows = v["events"].selectExpr("CASE event_id % 3 WHEN 0 THEN 'notify' WHEN 1 THEN 'digest' ELSE 'mute' END AS action", "CASE event_id % 4 WHEN 0 THEN 'scam' WHEN 1 THEN 'spam' WHEN 2 THEN 'event' ELSE 'personal' END AS kind").distinct()
    return rows.withColumn("intent", d.evidence_intent(F.col("action"), F.col("kind")))


@query("j01_message_users", f"SELECT message_id, user_id, {_QUIET} AS quiet FROM messages LEFT JOIN users u USING (user_id)")
def j01(v):
    return joins.join_users(v["messages"], v["users"]).select("message_id", "user_id", "quiet")


@query("j02_message_groups", "SELECT message_id, coalesce(g.group_type, '') AS group_type FROM messages m LEFT JOIN groups g ON m.group_id = g.group_id AND m.group_id <> ''")
def j02(v):
    return joins.join_groups(v["messages"], v["groups"]).select("message_id", "group_type")


@query("j03_message_businesses", f"SELECT message_id, b.business_id IS NOT NULL AS has_biz, coalesce(verified, false) AS verified, coalesce({_MISMATCH}, false) AS mismatch, coalesce({_LOOKALIKE}, false) AS lookalike FROM messages m LEFT JOIN businesses b ON m.business_id = b.business_id AND m.business_id <> ''")
def j03(v):
    return joins.join_businesses(v["messages"], v["businesses"]).select("message_id", "has_biz", F.col("biz_verified").alias("verified"), "mismatch", "lookalike")


_MEMBERS_SQL = """SELECT message_id, a.user_id IS NOT NULL AS is_member, a.read_30d AS mem_read, a.muted AS mem_muted, b.user_id IS NOT NULL AS snd_member, coalesce(b.role = 'admin', false) AS sender_admin
FROM messages m LEFT JOIN group_members a ON m.group_id = a.group_id AND m.user_id = a.user_id LEFT JOIN group_members b ON m.group_id = b.group_id AND m.sender_user_id = b.user_id AND m.sender_user_id <> ''"""


@query("j04_recipient_membership", f"SELECT message_id, is_member, mem_read, mem_muted FROM ({_MEMBERS_SQL})")
def j04(v):
    return joins.join_memberships(v["messages"], v["group_members"]).select("message_id", "is_member", "mem_read", "mem_muted")


@query("j05_sender_membership", f"SELECT message_id, snd_member, sender_admin FROM ({_MEMBERS_SQL})")
def j05(v):
    return joins.join_memberships(v["messages"], v["group_members"]).select("message_id", "snd_member", "sender_admin")


@query("j06_message_relationship", "SELECT message_id, r.user_id IS NOT NULL AS has_rel, coalesce(activity_180d > 0 OR replied_30d > 0, false) AS active, lower(coalesce(why, '')) AS why FROM messages m LEFT JOIN relationships r ON m.user_id = r.user_id AND m.business_id = r.business_id AND m.business_id <> ''")
def j06(v):
    return joins.join_relationships(v["messages"], v["relationships"]).select("message_id", "has_rel", F.col("rel_active").alias("active"), "why")


@query("j07_events_history", f"SELECT e.message_id, e.user_id, h.sender_user_id, h.business_id, {TOPIC_SQL} AS topic FROM message_events e JOIN history h ON e.message_id = h.message_id")
def j07(v):
    return profiles.events_with_history(v["message_events"], v["history"]).select("message_id", "user_id", "sender_user_id", "business_id", "topic")


@query("j08_history_pairs", "SELECT m.message_id, count(*) AS candidates FROM messages m JOIN history h ON m.user_id = h.user_id AND m.message_id <> h.message_id GROUP BY m.message_id")
def j08(v):
    h = v["history"].select("user_id", F.col("message_id").alias("hist_id"))
    m = v["messages"].select("user_id", "message_id")
    return m.join(h, "user_id").filter("message_id <> hist_id").groupBy("message_id").agg(F.count("*").alias("candidates"))


@query("j10_message_media", "SELECT message_id, coalesce(x.media_text, '') AS media_text, CASE WHEN m.media_type = '' THEN 'text' ELSE m.media_type END AS modality, CASE WHEN m.media_type = '' THEN false ELSE NOT coalesce(x.ok, false) END AS media_failed FROM messages m LEFT JOIN media x ON m.media_type = x.media_type AND m.media_id = x.media_id")
def j10(v):
    from quietwire.operators.content import with_media

    return with_media(v["messages"], v["media"]).select("message_id", F.col("media_raw").alias("media_text"), "modality", "media_failed")


CONTACT_SQL = """SELECT m.message_id, m.sender_user_id <> '' AND NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = m.user_id AND h.sender_user_id = m.sender_user_id) AS is_stranger,
CASE WHEN m.sender_user_id <> '' THEN NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = m.user_id AND h.sender_user_id = m.sender_user_id)
  WHEN m.business_id <> '' THEN NOT coalesce(r.activity_180d > 0 OR r.replied_30d > 0, false) AND NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = m.user_id AND h.business_id = m.business_id)
  ELSE false END AS is_cold
FROM messages m LEFT JOIN relationships r ON m.user_id = r.user_id AND m.business_id = r.business_id"""


@query("j11_is_stranger", f"SELECT message_id, is_stranger FROM ({CONTACT_SQL})")
def j11(v):
    return joins.join_prior_contact(joins.join_relationships(v["messages"], v["relationships"]), v["history"]).select("message_id", "is_stranger")


@query("j12_is_cold_sender", f"SELECT message_id, is_cold FROM ({CONTACT_SQL})")
def j12(v):
    return joins.join_prior_contact(joins.join_relationships(v["messages"], v["relationships"]), v["history"]).select("message_id", "is_cold")


_WORK = ", ".join(f"'{g}'" for g in WORK_GROUPS)
SHARED_SQL = f"""SELECT m.message_id, m.sender_user_id <> '' AND EXISTS (SELECT 1 FROM group_members a JOIN group_members b ON a.group_id = b.group_id JOIN groups g ON g.group_id = a.group_id
WHERE g.group_type IN ({_WORK}) AND a.user_id = m.user_id AND b.user_id = m.sender_user_id) AS shares_work FROM messages m"""


@query("j13_shares_group_type", SHARED_SQL)
def j13(v):
    return joins.shares_group_type(v["messages"], v["group_members"], v["groups"]).select("message_id", "shares_work")


@query("j19_group_members", "SELECT group_id, count(*) AS members, sum(CASE WHEN role = 'admin' THEN 1 ELSE 0 END)::BIGINT AS admins FROM group_members GROUP BY group_id")
def j19(v):
    return v["group_members"].groupBy("group_id").agg(F.count("*").alias("members"), F.count_if(F.col("role") == "admin").alias("admins"))


_SUMS = """count(*) AS seen, sum(message_opened::INT)::BIGINT AS opened, sum(message_replied::INT)::BIGINT AS replied, sum(notification_dismissed::INT)::BIGINT AS dismissed, sum(muted_after::INT)::BIGINT AS muted,
sum(reported::INT)::BIGINT AS reported, sum((reaction_minutes BETWEEN 0 AND 5)::INT)::BIGINT AS fast"""
PROFILE_CTE = f"""
joined_events AS (SELECT e.*, h.sender_user_id, h.group_id, h.business_id, {TOPIC_SQL} AS topic FROM message_events e LEFT JOIN history h ON e.message_id = h.message_id),
counted AS (
  SELECT user_id, 'user' AS grain, '' AS key, {_SUMS} FROM joined_events GROUP BY user_id
  UNION ALL SELECT user_id, 'sender', sender_user_id, {_SUMS} FROM joined_events WHERE coalesce(sender_user_id, '') <> '' GROUP BY user_id, sender_user_id
  UNION ALL SELECT user_id, 'group', group_id, {_SUMS} FROM joined_events WHERE coalesce(group_id, '') <> '' GROUP BY user_id, group_id
  UNION ALL SELECT user_id, 'business', business_id, {_SUMS} FROM joined_events WHERE coalesce(business_id, '') <> '' GROUP BY user_id, business_id
  UNION ALL SELECT user_id, 'topic', topic, {_SUMS} FROM joined_events WHERE topic IS NOT NULL GROUP BY user_id, topic
),
profile AS (
  SELECT *, CASE WHEN good + bad > 0 THEN round((good - bad) / (good + bad) * (1 - exp(-seen / 2.5)), 3) ELSE 0.0 END AS affinity
  FROM (SELECT *, opened + 1.5::DOUBLE * replied + 0.5::DOUBLE * fast AS good, dismissed + 1.5::DOUBLE * muted + 3.0::DOUBLE * reported AS bad FROM counted)
)"""


@query("a01_engagement_profile", "SELECT user_id, grain, key, seen, opened, replied, dismissed, muted, reported, fast FROM profile", PROFILE_CTE)
def a01(v):
    return profiles.engagement_profile(v["message_events"], v["history"]).drop("affinity")


@query("a02_smoothed_rates", "SELECT user_id, round((opened + 1.5) / (seen + 3.0), 6) AS open_rate, round((replied + 0.75) / (seen + 3.0), 6) AS reply_rate, round((dismissed + muted + reported + 1.05) / (seen + 3.0), 6) AS rejection_rate FROM profile WHERE grain = 'user'", PROFILE_CTE)
def a02(v):
    p = profiles.engagement_profile(v["message_events"], v["history"]).filter("grain = 'user'")
    rejected = F.col("dismissed") + F.col("muted") + F.col("reported")
    rate = lambda n, prior: F.round(d.smoothed_rate(n, F.col("seen"), prior), 6)
    return p.select("user_id", rate(F.col("opened"), 0.5).alias("open_rate"), rate(F.col("replied"), 0.25).alias("reply_rate"), rate(rejected, 0.35).alias("rejection_rate"))


@query("a03_affinity", "SELECT user_id, grain, key, affinity FROM profile", PROFILE_CTE)
def a03(v):
    return profiles.engagement_profile(v["message_events"], v["history"]).select("user_id", "grain", "key", "affinity")


LOAD_SQL = "SELECT user_id, round(sum(sent) / count(*), 3) AS load, CASE WHEN sum(sent) > 0 THEN round(sum(dismissed) / sum(sent), 3) ELSE 0.0 END AS dismissal_ratio FROM daily GROUP BY user_id"


@query("a04_notification_load", LOAD_SQL)
def a04(v):
    return profiles.notification_load(v["daily"])


@query("a05_user_baselines", "SELECT user_id, CASE WHEN opened_30d + dismissed_30d > 0 THEN round(opened_30d / (opened_30d + dismissed_30d), 3) ELSE 0.5 END AS engagement_baseline, round(reported_30d / greatest(opened_30d, 1), 4) AS report_propensity FROM users")
def a05(v):
    return profiles.user_baselines(v["users"])


FATIGUE_SQL = f"SELECT user_id, CASE WHEN dismissal_ratio >= 0.5 AND load >= 2 THEN round(least(1.0, (dismissal_ratio - 0.5) * 2.0), 3) ELSE 0.0 END AS fatigue FROM ({LOAD_SQL})"


@query("a06_fatigue_penalty", FATIGUE_SQL)
def a06(v):
    return profiles.fatigue(profiles.notification_load(v["daily"]))


@query("j14_profile_stats", "SELECT message_id, coalesce(s.seen, 0) AS sender_seen, coalesce(s.affinity, 0.0) AS sender_affinity, coalesce(b.seen, 0) AS business_seen, coalesce(b.affinity, 0.0) AS business_affinity FROM messages m LEFT JOIN profile s ON s.grain = 'sender' AND s.user_id = m.user_id AND s.key = m.sender_user_id LEFT JOIN profile b ON b.grain = 'business' AND b.user_id = m.user_id AND b.key = m.business_id", PROFILE_CTE)
def j14(v):
    p = profiles.engagement_profile(v["message_events"], v["history"])
    out = profiles.join_stats(profiles.join_stats(v["messages"], p, "sender", "sender_user_id"), p, "business", "business_id")
    return out.select("message_id", "sender_seen", "sender_affinity", "business_seen", "business_affinity")


@query("u01_union_messages", "SELECT message_id, CAST(NULL AS VARCHAR) AS label FROM messages UNION ALL SELECT message_id, 'labelled' FROM history WHERE seq % 50 = 0")
def u01(v):
    samples = v["history"].filter("seq % 50 = 0").select("message_id", F.lit("labelled").alias("label"))
    return v["messages"].select("message_id").unionByName(samples, allowMissingColumns=True)


@query("u02_expected_minus_got", "SELECT 'missing' AS \"check\", message_id FROM messages WHERE seq % 10 = 0 UNION ALL SELECT 'extra', message_id FROM history WHERE seq % 97 = 0")
def u02(v):
    got = v["messages"].filter("seq % 10 <> 0").select("message_id").unionByName(v["history"].filter("seq % 97 = 0").select("message_id"))
    return checks.expected_minus_got(v["messages"], got)


@query("u03_media_coverage", "SELECT media_type, media_id, EXISTS (SELECT 1 FROM media x WHERE x.media_type = m.media_type AND x.media_id = m.media_id) AS resolved FROM (SELECT DISTINCT media_type, media_id FROM messages WHERE media_id <> '') m")
def u03(v):
    asked = v["messages"].filter("media_id <> ''").select("media_type", "media_id")
    known = v["media"].select("media_type", "media_id")
    return asked.intersect(known).withColumn("resolved", F.lit(True)).unionByName(asked.subtract(known).withColumn("resolved", F.lit(False)))


@query("q02_media_coverage_check", "SELECT DISTINCT media_type, media_id FROM messages m WHERE media_id <> '' AND NOT EXISTS (SELECT 1 FROM media x WHERE x.media_type = m.media_type AND x.media_id = m.media_id)")
def q02(v):
    return checks.unresolved_media(v["messages"], v["media"])
