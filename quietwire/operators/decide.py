"""From scores to an action, its reason and confidence, and the invariants that no decision may break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.config import ACTIONS, DEFAULT, MESSAGE_TYPES, SCHOOL_GROUPS, WORK_GROUPS, Settings
from quietwire.functions.derive import evidence_intent
from quietwire.operators.rationale import BY_KEY, FALLBACK, ORDERED
from quietwire.operators.scoring import look_up

_STEP = {action: i for i, action in enumerate(("notify", "digest", "mute"))}


def warrants_interruption(settings: Settings = DEFAULT) -> Column:
    """D02."""
    th = settings.thresholds
    return (F.col("urgency") >= th.urgency_gate) | (F.col("actionability") >= th.action_gate) | F.col("transactional")


def decide(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``action``, ``message_type`` and whether the decision is a close one."""
    th = settings.thresholds
    hostile = (F.col("injection") >= th.injection_mute) | (F.col("scam") >= th.scam_mute)
    bulk = (F.col("spam") >= th.spam_mute) & F.col("kind").isin("promotion", "spam", "business_update")
    wanted = (F.col("priority") >= th.notify_floor) & warrants_interruption(settings)
    action = F.when(hostile | bulk, "mute").when(wanted & (F.col("risk") >= th.notify_veto), "digest").when(wanted, "notify").when(F.col("priority") <= th.mute_ceiling, "mute").otherwise("digest")
    near = F.least(F.abs(F.col("priority") - th.notify_floor), F.abs(F.col("priority") - th.mute_ceiling)) <= th.gray_halfwidth
    return df.withColumns({"action": action, "message_type": F.when(hostile, "scam").otherwise(F.col("kind")), "gray_zone": ~F.col("is_scam") & (F.col("injection") < 0.5) & near})


def flags(df: DataFrame) -> DataFrame:
    """The flags that rules are written in."""
    driver = lambda name: F.array_contains("drivers", name)
    threat = lambda name: F.array_contains("threats", name)
    sender = F.col("sender_user_id") != ""
    return df.withColumns(
        {
            "is_group": F.col("conversation_type") == "group",
            "is_business": F.col("conversation_type") == "business",
            "verified_business": F.col("has_biz") & F.col("biz_verified") & ~F.col("mismatch"),
            "order_history": F.col("rel_active") & F.col("why").rlike("order|delivery|grocery|purchase|shopping"),
            "booking_history": F.col("rel_active") & F.col("why").rlike("booking|appointment|reservation|ticket|travel|health"),
            "dismissed_similar": driver("business_messages_dismissed") | (F.col("repetition") >= 0.5),
            "repeated_pattern": driver("repeated_pattern_rejected") | (F.col("repetition") >= 0.6),
            "trusted_sender": sender & (F.col("sender_seen") >= 1) & (F.col("sender_affinity") >= 0.2),
            "unknown_sender": driver("unknown_sender"),
            "first_contact": threat("first_contact_sender"),
            "same_day_deadline": driver("same_day_deadline"),
            "work_context": F.col("group_type").isin(*WORK_GROUPS) | F.col("shares_work"),
            "school_context": F.col("group_type").isin(*SCHOOL_GROUPS),
            "has_link": F.size("urls") > 0,
            "local_language_urgency": F.col("n_translit_urgency") > 0,
            "directed": F.col("mentions_user") | F.col("direct_request") | (F.col("modality") == "voice"),
            "support_framing": (F.col("n_impersonation") > 0) | F.col("low").rlike("support alert|helpdesk|support team|customer care"),
            "injected": F.col("injection") >= 0.5,
            "credential_request": threat("credential_request"),
            "account_pressure": threat("account_threat_pressure"),
            "payment_risk": threat("payment_demand") | threat("payment_qr_risk"),
            "interest_match": (F.col("rel_active") & ~F.col("opted_out")) | (sender & (F.col("sender_seen") >= 2) & (F.col("sender_affinity") >= 0.5)),
            "forwarded_chain": F.col("forwarded_count") >= 3,
            "impersonating": threat("brand_impersonation"),
        }
    )


#: What ``flags`` adds, which the rules read.
FLAGS = (
    "is_group", "is_business", "verified_business", "order_history", "booking_history", "dismissed_similar", "repeated_pattern", "trusted_sender", "unknown_sender", "first_contact", "same_day_deadline",
    "work_context", "school_context", "has_link", "local_language_urgency", "directed", "support_framing", "injected", "credential_request", "account_pressure", "payment_risk", "interest_match",
    "forwarded_chain", "impersonating",
)


def best_rule(action: Column, kind: Column) -> Column:
    """Key of the first fitting rule in the order of priority."""
    chain = F
    for rule in ORDERED:
        fits = (action == rule.action) & F.expr(rule.condition)
        if rule.kinds:
            fits = fits & kind.isin(*rule.kinds.split())
        chain = chain.when(fits, rule.key)
    return chain.otherwise(look_up(FALLBACK, action, "digest_fallback"))


def rule_value(key: Column, field: str, default) -> Column:
    return look_up({k: getattr(rule, field) for k, rule in BY_KEY.items()}, key, default)


def band(action: Column, settings: Settings = DEFAULT) -> tuple[Column, Column]:
    return look_up({a: low for a, low, _ in settings.bands}, action, 0.0), look_up({a: high for a, _, high in settings.bands}, action, 1.0)


def confidence(settings: Settings = DEFAULT) -> Column:
    """D03."""
    th, p = settings.thresholds, F.col("priority")
    nearest = F.least(F.abs(p - th.notify_floor), F.abs(p - th.mute_ceiling))
    margin = F.when(F.col("action") == "notify", p - th.notify_floor).when(F.col("action") == "mute", F.greatest("scam", "injection", "spam", th.mute_ceiling - p)).otherwise(nearest)
    adjusted = rule_value(F.col("rationale"), "confidence", 0.8) + F.greatest(F.lit(-0.02), F.least(F.lit(0.02), (margin - 0.12) * 0.12))
    low, high = band(F.col("action"), settings)
    return F.round(F.greatest(low, F.least(high, adjusted)), 2)


def explain_choice(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """D05, D06, D03 and what evidence to look for."""
    df = flags(df).withColumn("rationale", best_rule(F.col("action"), F.col("message_type")))
    return _sought(df.withColumn("confidence", confidence(settings)))


def _sought(df: DataFrame) -> DataFrame:
    return df.withColumns({"want": rule_value(F.col("rationale"), "want", 1), "intent_sought": evidence_intent(F.col("action"), F.col("message_type"))})


def filter_contradictory(df: DataFrame) -> DataFrame:
    """Evidence whose outcome argues against the action goes, unless nothing would be left. Needs ``cited``."""
    against = F.when(F.col("action") == "mute", "positive").when(F.col("action") == "notify", "negative").otherwise("-")
    kept = F.transform(F.filter("cited", lambda x: x["outcome"] != against), lambda x: x["hist_id"])
    keep_all = F.col("message_type").isin("scam", "spam") | F.col("cited").isNull() | (F.size(kept) == 0)
    return df.withColumn("evidence", F.when(keep_all, F.coalesce("evidence", F.array().cast("array<string>"))).otherwise(kept))


def repair(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Nine rules in order, each seeing what the ones before it have changed; ``violations`` lists those that struck."""
    th = settings.thresholds
    struck: dict[str, Column] = {}

    def rule(df: DataFrame, name: str, condition: Column, changes: dict[str, Column]) -> DataFrame:
        holds = F.coalesce(condition, F.lit(False))
        struck[name] = F.when(F.col(f"_{name}"), name)
        return df.withColumns({f"_{name}": holds} | {c: F.when(holds, v).otherwise(F.col(c)) for c, v in changes.items()})

    action, kind, mute = F.col("action"), F.col("message_type"), F.lit("mute")
    df = rule(df, "scam_not_muted", (F.col("is_scam") | (F.col("injection") >= 0.5)) & (action != "mute"), {"action": mute, "message_type": F.lit("scam")})
    df = rule(df, "scam_type_action_mismatch", (kind == "scam") & (action != "mute"), {"action": mute})
    df = rule(df, "spam_notified", (kind == "spam") & (action == "notify"), {"action": mute})
    df = rule(df, "risky_notify", (action == "notify") & (F.col("risk") >= th.notify_veto), {"action": F.lit("digest")})
    asked = (F.col("mentions_user") | F.col("direct_request")) & (F.col("urgency") >= 0.5) & (F.col("relationship") >= 0.5)
    df = rule(df, "urgent_muted", (action == "mute") & (F.col("risk") < 0.25) & (kind != "spam") & asked, {"action": F.when(F.col("urgency") >= 0.65, "notify").otherwise("digest")})
    df = rule(df, "empty_content_typed", F.col("is_empty") & ~kind.isin("unknown", "scam", "spam"), {"message_type": F.lit("unknown")})
    replacement = best_rule(action, kind)
    df = rule(df, "reason_action_mismatch", rule_value(F.col("rationale"), "action", "") != action, {"rationale": replacement, "confidence": rule_value(replacement, "confidence", 0.8)})
    low, high = band(action, settings)
    df = rule(df, "confidence_out_of_band", (F.col("confidence") < low) | (F.col("confidence") > high), {"confidence": F.round(F.least(high, F.greatest(low, F.col("confidence"))), 2)})
    df = df.withColumn("_before", F.coalesce("evidence", F.array().cast("array<string>")))
    df = filter_contradictory(df)
    struck["contradictory_evidence"] = F.when(F.col("evidence") != F.col("_before"), "contradictory_evidence")
    df = df.withColumns({"violations": F.array_compact(F.array(*struck.values())), "reason": rule_value(F.col("rationale"), "text", "")})
    return df.drop("_before", *[f"_{name}" for name in struck])


# Fixed value: the reason of a message that could not be analysed.
DEFERRED = "The message could not be fully analysed, so it is deferred rather than dropped."
#: What a decision is made of; a row that lacks any of it is not decided on.
NEEDED = ("scam", "spam", "injection", "risk", "urgency", "actionability", "trust", "relationship", "importance", "repetition", "fatigue", "priority", "action", "message_type", "confidence")


def with_fallback(decisions: DataFrame) -> DataFrame:
    """A row that could not be analysed is put off to the digest as unknown, without repair; ``errors`` names what could not be worked out.

    Casts and look-ups give null where a value is bad and nulls run through every score, so a bad row shows in the scores that need what it lacks,
    and no row stops the others.
    """
    there = [c for c in NEEDED if c in decisions.columns]
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in there]))
    fixed = {"action": F.lit("digest"), "message_type": F.lit("unknown"), "confidence": F.lit(0.80), "rationale": F.lit("digest_fallback"), "reason": F.lit(DEFERRED), "evidence": F.array().cast("array<string>"), "violations": F.array().cast("array<string>")}
    broken = F.size("errors") > 0
    return decisions.withColumn("errors", lacking).withColumns({c: F.when(broken, v).otherwise(F.col(c)) for c, v in fixed.items()})


def parse_verdict(raw: Column) -> Column:
    """(action, message_type, note) from the first braces in a text; null without an action of the vocabulary."""
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "action string, message_type string, note string")
    action, kind = F.lower(F.trim(parsed["action"])), F.lower(F.trim(parsed["message_type"]))
    good = F.struct(action.alias("action"), F.when(kind.isin(*MESSAGE_TYPES), kind).otherwise("").alias("message_type"), F.substring(F.coalesce(parsed["note"], F.lit("")), 1, 80).alias("note"))
    return F.when(action.isin(*ACTIONS), good)


def reconcile_verdicts(decisions: DataFrame, verdicts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Second opinions (message_id, action, message_type) on close decisions, the first ``second_opinions`` by seq.

    ``decisions`` are those of ``explain_choice``: rationale, confidence and the evidence to look for follow an opinion that is taken, and the
    repair comes after it. An opinion is refused if it jumps over the digest, or wants to interrupt at a risk. ``second_opinion`` says what came of it.
    """
    consulted = decisions.filter("gray_zone").orderBy("seq").limit(settings.second_opinions).select("message_id")
    v = verdicts.join(consulted, "message_id", "left_semi").select("message_id", F.col("action").alias("v_action"), F.col("message_type").alias("v_type"))
    df = decisions.join(v, "message_id", "left")
    step = lambda c: look_up(_STEP, c, 1)
    kind = F.when(F.coalesce("v_type", F.lit("")) == "", F.col("message_type")).otherwise(F.col("v_type"))
    equal = F.col("v_action") == F.col("action")
    jump = F.abs(step(F.col("v_action")) - step(F.col("action"))) > 1
    risky = (F.col("v_action") == "notify") & (F.col("risk") >= settings.thresholds.notify_veto)
    result = F.when(F.col("v_action").isNull(), "none").when(equal, "agrees").when(jump, "refused_jump").when(risky, "refused_risk").otherwise("override")
    df = df.withColumn("second_opinion", result)
    taken = F.col("second_opinion") == "override"
    df = df.withColumns({"message_type": F.when(taken, kind).otherwise(F.col("message_type")), "action": F.when(taken, F.col("v_action")).otherwise(F.col("action"))})
    df = df.withColumn("rationale", F.when(taken, best_rule(F.col("action"), F.col("message_type"))).otherwise(F.col("rationale")))
    return _sought(df.withColumn("confidence", F.when(taken, confidence(settings)).otherwise(F.col("confidence"))).drop("v_action", "v_type"))
