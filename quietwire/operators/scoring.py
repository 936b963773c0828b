"""How pressing, how wanted and what kind of message it is, and the priority that follows."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.config import DEFAULT, OPERATIONAL_GROUPS, SCHOOL_GROUPS, WORK_GROUPS, Settings
from quietwire.functions.derive import smoothed_rate
from quietwire.operators.safety import add, any_hit

# Priors by group type, importance and history topic by message type.
GROUP_PRIOR = {
    "family": 0.10, "school_group": 0.12, "coworker": 0.10, "society": 0.06, "caregiving": 0.12, "safety": 0.10, "extended_family": 0.02,
    "investment_tips": -0.16, "marketplace": -0.08, "local_food": -0.06, "tech_community": -0.04, "book_club": -0.04, "alumni": -0.04,
}
IMPORTANCE = {
    "urgent": 0.92, "payment": 0.70, "event": 0.62, "business_update": 0.55, "personal": 0.50, "unknown": 0.35,
    "forward": 0.20, "greeting": 0.18, "promotion": 0.22, "spam": 0.05, "scam": 0.0,
}
TOPIC_OF_TYPE = {"promotion": "promotion", "spam": "promotion", "greeting": "greeting", "forward": "forward", "payment": "payment", "event": "event", "business_update": "logistics", "scam": "security_prompt"}


def look_up(table: dict, key: Column, default) -> Column:
    """The value of a small table of one type; the table is one constant of the plan."""
    kind = {str: "string", int: "int", float: "double"}[type(next(iter(table.values())))]
    return F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>"), key), F.lit(default))


def unit(score: Column, digits: int = 3) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), digits)


def damping() -> Column:
    return F.when(F.col("n_deescalation") > 0, F.least(F.lit(0.85), 0.35 * F.col("n_deescalation"))).otherwise(0.0)


def urgency() -> Column:
    """G01."""
    group, voice = F.col("group_type"), F.col("modality") == "voice"
    raw = add(
        (any_hit("urgency"), F.least(F.lit(0.34), 0.16 * F.col("n_urgency"))),
        (F.col("intent") == "urgent", 0.34 + F.least(F.lit(0.16), F.col("intent_margin"))),
        (F.col("intent").isin("promotion", "benign"), -0.10),
        (any_hit("translit_urgency"), F.least(F.lit(0.24), 0.12 * F.col("n_translit_urgency"))),
        (any_hit("time"), F.when(F.col("same_day"), 0.26).otherwise(0.12)),
        (F.col("mentions_user"), 0.14),
        (voice & (F.col("wpm") >= 165.0), 0.16),
        (voice & (F.col("duration_s") > 0) & (F.col("duration_s") <= 12) & any_hit("urgency"), 0.10),
        (voice & (F.col("duration_s") >= 30), -0.12),
        (group.isin(*WORK_GROUPS), 0.10),
        (group.isin(*SCHOOL_GROUPS), 0.12),
        (group.isin(*OPERATIONAL_GROUPS), 0.06),
        (F.col("sender_admin"), 0.10),
        (F.col("n_promo") >= 2, -0.22),
        (any_hit("greeting") & ~F.col("direct_request"), -0.16),
        (F.col("forwarded_count") >= 3, -0.14),
    )
    return unit(raw * (1.0 - damping()))


def actionability() -> Column:
    """G02."""
    feedback = any_hit("feedback")
    raw = add((F.col("direct_request") & ~feedback, 0.42), (feedback, 0.05), (F.col("question"), 0.14), (F.col("mentions_user"), 0.34))
    return unit(raw * (1.0 - damping() * 0.6))


def urgency_drivers() -> list[Column]:
    """G11, first part, in order."""
    voice = F.col("modality") == "voice"
    damped = any_hit("deescalation")
    feedback = any_hit("feedback")
    return [
        F.when(any_hit("urgency"), "explicit_urgency_language"),
        F.when(F.col("intent") == "urgent", "multilingual_urgency_similarity"),
        F.when(any_hit("translit_urgency"), "transliterated_urgency"),
        # one de-escalating phrase damps by 0.35, which already takes the deadline back
        F.when(any_hit("time") & F.col("same_day") & ~damped, "same_day_deadline"),
        F.when(F.col("direct_request") & ~feedback, "direct_request").when(feedback, "feedback_request"),
        F.when(F.col("mentions_user"), "direct_mention"),
        F.when(voice & (F.col("wpm") >= 165.0), "rushed_speech"),
        F.when(voice & (F.col("duration_s") >= 30), "long_monologue"),
        F.when(F.col("sender_admin"), "sender_is_group_admin"),
        F.when(F.col("n_promo") >= 2, "manufactured_urgency"),
        F.when(damped, "sender_deprioritised_message"),
    ]


def cold_solicitation() -> Column:
    """G04."""
    return ((F.col("modality") == "voice") & (F.col("duration_s") >= 20)) | F.col("why").rlike("^(ignored|cold|unknown)")


def classify_type() -> Column:
    """(type, driver), the first rule that holds."""
    answer = lambda kind, driver: F.struct(F.lit(kind).alias("kind"), F.lit(driver).alias("driver"))
    business, personal = F.col("conversation_type") == "business", F.col("conversation_type") == "personal"
    promo, payment, event = F.col("n_caption_promo"), F.col("n_caption_payment"), F.col("n_caption_event")
    timed, request = any_hit("time"), F.col("direct_request")
    rules = [
        ((F.col("injection") >= 0.5) | F.col("is_scam"), "scam", "fraud_signals"),
        (F.col("is_spam") & cold_solicitation(), "spam", "cold_solicitation"),
        (F.col("is_spam"), "promotion", "unwanted_marketing"),
        (any_hit("greeting") & (F.col("word_count") < 45) & (~request | any_hit("deescalation")), "greeting", "greeting_language"),
        ((F.col("forwarded_count") >= 3) & (any_hit("forward") | ~request), "forward", "forward_chain"),
        (~business & (any_hit("caption_marketplace") | ((promo > 0) & any_hit("commerce") & (F.col("media_text") == ""))), "promotion", "peer_to_peer_offer"),
        ((promo >= 2) | ((promo >= 1) & F.col("opt_out_footer")), "promotion", "promotional_language"),
        ((F.col("layout") == "promotional_poster") & ~any_hit("caption_business_update"), "promotion", "promotional_poster"),
        ((payment >= 2) | ((payment >= 1) & F.col("low").rlike("due|pay by|outstanding|bill|emi|challan")), "payment", "payment_language"),
        (F.col("group_type").isin(*SCHOOL_GROUPS) & ((event > 0) | timed), "event", "school_operations"),
        (F.col("group_type").isin(*OPERATIONAL_GROUPS) & F.col("sender_admin") & timed & (F.col("urgency") >= 0.35), "urgent", "admin_operational_alert"),
        ((F.col("urgency") >= 0.55) & (request | any_hit("urgency")), "urgent", "time_critical"),
        ((event >= 1) & (timed | (event >= 2)), "event", "scheduled_activity"),
        ((F.col("has_biz") | business) & any_hit("caption_business_update"), "business_update", "service_update"),
        ((F.col("has_biz") | business) & (promo >= 1), "promotion", "promotional_language"),
        (F.col("has_biz") | business, "business_update", "business_sender"),
    ]
    direct = personal | (F.col("sender_user_id") != "")
    rules += [
        (direct & request & (F.col("urgency") >= 0.45), "urgent", "direct_time_bound_request"),
        (direct & F.col("is_empty"), "unknown", "no_recoverable_content"),
        (direct & personal & F.col("is_stranger"), "unknown", "no_prior_contact"),
        (direct, "personal", "interpersonal_message"),
    ]
    chain = F
    for condition, kind, driver in rules:
        chain = chain.when(condition, answer(kind, driver))
    return chain.otherwise(answer("unknown", "insufficient_signal"))


def trust() -> Column:
    """G05."""
    biz, age = F.col("has_biz"), F.col("biz_account_age_days")
    raw = add(
        (biz, F.when(F.col("biz_verified"), 0.22).otherwise(-0.12)),
        (F.col("mismatch"), -0.34),
        (biz & (age >= 730), 0.08),
        (biz & (age < 120), -0.10),
        (biz & (F.col("biz_reports_30d") >= 10), -0.14),
        (biz & F.col("rel_active"), 0.16),
        (F.col("sender_admin"), 0.14),
        ((F.col("group_id") != "") & (F.col("sender_user_id") != "") & ~F.col("snd_member"), -0.08),
        ((F.col("sender_user_id") != "") & (F.col("sender_seen") >= 2), 0.18 * F.col("sender_affinity")),
        start=0.5,
    )
    return unit(raw - 0.45 * F.col("risk"))


def trust_drivers() -> list[Column]:
    biz = F.col("has_biz")
    return [
        F.when(biz & F.col("biz_verified"), "verified_business"),
        F.when(F.col("mismatch"), "sender_domain_mismatch"),
        F.when(biz & (F.col("biz_account_age_days") < 120), "new_business_account"),
        F.when(biz & (F.col("biz_reports_30d") >= 10), "business_widely_reported"),
        F.when(biz & F.col("rel_active"), "known_counterparty"),
        F.when(F.col("sender_admin"), "group_admin_sender"),
    ]


def relationship() -> Column:
    """G06."""
    grouped = (F.col("conversation_type") == "group") & (F.col("group_id") != "")
    member = grouped & F.col("is_member")
    read = smoothed_rate(F.col("mem_read"), F.greatest(F.col("mem_read") + F.col("mem_dismissed"), F.lit(1)))
    sender, firm = F.col("sender_user_id") != "", F.col("business_id") != ""
    raw = add(
        (member & F.col("mem_muted"), -0.20),
        (member, 0.24 * (read - 0.5) * 2),
        (member & (F.col("mem_replies") >= 3), 0.10),
        (member & (F.col("mem_dismissed") >= 5) & (F.col("mem_replies") == 0), -0.14),
        (member & (F.col("mem_role") == "admin"), 0.04),
        (grouped & (F.col("group_seen") > 0), 0.18 * F.col("group_affinity")),
        (grouped, look_up(GROUP_PRIOR, F.col("group_type"), 0.0)),
        (sender & (F.col("sender_seen") > 0), 0.30 * F.col("sender_affinity")),
        (sender & (F.col("sender_seen") == 0), -0.06),
        (firm & F.col("rel_active"), 0.18),
        (firm & F.col("opted_out") & F.col("topic").isin("promotion", "greeting"), -0.26),
        (firm & F.col("rel_ignored"), -0.18),
        (firm & F.col("has_rel") & (F.col("rel_replied_30d") >= 1), 0.10),
        (firm & ~F.col("has_rel"), -0.12),
        (firm & (F.col("business_seen") > 0), 0.16 * F.col("business_affinity")),
        (F.col("topic_seen") >= 2, 0.12 * F.col("topic_affinity")),
        start=0.5,
    )
    return unit(raw)


def relationship_drivers() -> list[Column]:
    grouped = (F.col("conversation_type") == "group") & (F.col("group_id") != "") & F.col("is_member")
    sender, firm, a = F.col("sender_user_id") != "", F.col("business_id") != "", F.col("sender_affinity")
    return [
        F.when(grouped & F.col("mem_muted"), "user_muted_group"),
        F.when(grouped & (F.col("mem_replies") >= 3), "user_replies_in_group"),
        F.when(grouped & (F.col("mem_dismissed") >= 5) & (F.col("mem_replies") == 0), "user_dismisses_group"),
        F.when(sender & (F.col("sender_seen") == 0), "unknown_sender").when(sender & (a <= -0.4), "sender_usually_ignored").when(sender & (a >= 0.4), "sender_usually_engaged"),
        F.when(firm & F.col("rel_active"), "active_business_relationship"),
        F.when(firm & F.col("opted_out") & F.col("topic").isin("promotion", "greeting"), "opted_out_of_promotions"),
        F.when(firm & F.col("rel_ignored"), "business_messages_dismissed"),
        F.when(firm & ~F.col("has_rel"), "no_business_relationship"),
        F.when((F.col("topic_seen") >= 2) & (F.col("topic_affinity") <= -0.45), F.concat(F.lit("user_rejects_"), F.col("topic"))),
    ]


def importance() -> Column:
    """G07."""
    live = (F.col("business_id") != "") & F.col("kind").isin("business_update", "event", "payment") & F.col("rel_active")
    raw = add(
        (F.col("group_type").isin(*SCHOOL_GROUPS, *OPERATIONAL_GROUPS), 0.06),
        (live, 0.24),
        (live & any_hit("business_update", "event"), 0.08),
        start=look_up(IMPORTANCE, F.col("kind"), 0.35),
    )
    return F.round(F.least(F.lit(1.0), raw), 3)


def transactional() -> Column:
    """G08."""
    return F.col("kind").isin("business_update", "payment", "event") & (F.col("business_id") != "") & F.col("rel_active") & any_hit("business_update", "payment", "event")


def priority(settings: Settings = DEFAULT) -> Column:
    """G10."""
    w = settings.weights
    raw = w.urgency * F.col("urgency") + w.trust * F.col("trust") + w.relationship * F.col("relationship") + w.actionability * F.col("actionability") + w.importance * F.col("importance")
    raw = raw - w.repetition * F.col("repetition") - w.fatigue * F.col("fatigue") - w.promo * F.col("promo_pressure")
    raw = raw - F.when(F.col("quiet"), w.quiet).otherwise(0.0)
    raw = raw - F.when(F.col("forwarded_count") >= 8, w.forward * F.least(F.lit(1.0), F.col("forwarded_count") / 20.0)).otherwise(0.0)
    return unit(raw, 4)


def classify(df: DataFrame) -> DataFrame:
    """G01, G02, G03, G07 to G09 on an assessed message: the scores that need none of the recipient's history."""
    df = df.withColumns({"urgency": urgency(), "actionability": actionability()})
    df = df.withColumn("_type", classify_type())
    df = df.withColumns({"kind": F.col("_type.kind"), "kind_driver": F.col("_type.driver")}).drop("_type")
    topic = look_up(TOPIC_OF_TYPE, F.col("kind"), "other")
    return df.withColumns({"topic": topic, "importance": importance(), "transactional": transactional(), "promo_pressure": F.least(F.lit(1.0), F.col("n_promo") / 4.0)})


#: Grains of the profile, and what of a classified message is looked up in them.
GRAINS = (("sender", "sender_user_id"), ("group", "group_id"), ("business", "business_id"), ("topic", "topic"))


def with_stats(df: DataFrame, profile: DataFrame, repetition: DataFrame | None = None, fatigue: DataFrame | None = None) -> DataFrame:
    """G05, G06 on a classified message, with its stats by grain; and ``repetition`` and ``fatigue``, where they are given.

    What is looked up by a message's own keys is looked up for rows of keys alone: the wide rows of ``df`` are sent once, not once a join. ``df``
    is read twice, and is best staged.
    """
    from quietwire.operators.profiles import join_stats

    keys = ["message_id", "user_id", *[key for _, key in GRAINS]]
    found = df.select(*keys).distinct()
    for grain, key in GRAINS:
        found = join_stats(found, profile, grain, key)
    if fatigue is not None:
        found = found.join(fatigue, "user_id", "left").fillna({"fatigue": 0.0})
    if repetition is not None:
        found = found.join(repetition.select("message_id", "repetition", "repetition_driver"), "message_id", "left").fillna({"repetition": 0.0})
    found = found.withColumnsRenamed({key: f"_{key}" for key in keys})
    same = reduce(and_, [df[key].eqNullSafe(found[f"_{key}"]) for key in keys])
    return df.join(found, same).drop(*[f"_{key}" for key in keys]).withColumns({"trust": trust(), "relationship": relationship()})


def score(df: DataFrame, profile: DataFrame, repetition: DataFrame, fatigue: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """G01 to G11 on a classified message, whose id is its own."""
    df = with_stats(df, profile, repetition, fatigue).withColumns(
        {
            "drivers": F.array_compact(
                F.array(
                    *urgency_drivers(), F.col("kind_driver"), *trust_drivers(), *relationship_drivers(), F.col("repetition_driver"),
                    F.when(F.col("quiet"), "inside_quiet_hours"), F.when(F.col("forwarded_count") >= 8, "mass_forwarded_chain"),
                )
            ),
        }
    )
    return df.withColumn("priority", priority(settings))
