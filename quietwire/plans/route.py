"""The whole routing as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.config import DEFAULT, Settings
from quietwire.functions.text import needs_fallback
from quietwire.operators import content, decide, joins, profiles, safety, scoring, similarity, tiles
from quietwire.operators.similarity import Variant
from quietwire.sources.staging import release, stage, stage_alone


FULL = Variant("full")


def varied(messages: DataFrame, variants: tuple[Variant, ...] = (FULL,)) -> DataFrame:
    """Every message once a variant. With several, its id begins with the variant's name; ``plain_id`` is the one that it came with."""
    told = F.array(*[F.struct(F.lit(v.name).alias("variant"), F.array(*map(F.lit, v.media)).cast("array<string>").alias("_kinds"), F.lit(v.vectors).alias("use_vectors")) for v in variants])
    rows = messages.select("*", F.col("message_id").alias("plain_id"), F.inline(told)).withColumn("media_seen", F.array_contains("_kinds", F.col("media_type"))).drop("_kinds")
    return rows if len(variants) == 1 else rows.withColumn("message_id", F.concat_ws("/", "variant", "plain_id"))


def facts(t: dict[str, DataFrame], variants: tuple[Variant, ...] = (FULL,)) -> DataFrame:
    """Messages with their content and with what is known of sender, group, business and recipient, once a variant.

    Where there are ``vectors`` (message_id, vector) and ``exemplars`` (intent, vector), a message whose words tell little takes the
    intent of the exemplars that it is nearest to.
    """
    # what a message says comes last, so that the joins before send rows without it; those with equal keys stand together
    messages = content.in_many_tasks(t["messages"], "message_id")
    said = content.with_media(varied(messages, variants), t["media"])
    several = len(variants) > 1  # who sent it to whom is the same in all: these joins are made before a message is there once a variant
    df = messages if several else said
    df = joins.join_memberships(df, t["group_members"])
    customers = stage(t["messages"].filter("business_id <> ''").select("user_id").distinct())
    df = joins.join_relationships(df, t["relationships"], asked=customers)
    df = joins.join_prior_contact(df, t["history"])
    df = joins.shares_group_type(df, t["group_members"], t["groups"], asked=t["messages"])
    df = joins.join_users(df, t["users"])
    df = joins.join_groups(df, t["groups"])
    df = joins.join_businesses(df, t["businesses"])
    if several:
        df = content.with_media(varied(df, variants), t["media"])
    df = content.with_texts(df, said)
    df = df.drop(*[c for c in df.columns if c.endswith("_hits")], "caption")  # counted; no later step reads the terms themselves
    vectors, exemplars = t.get("vectors"), t.get("exemplars")
    if vectors is None or exemplars is None or not any(v.vectors for v in variants):
        return df
    asked = df.filter(F.col("use_vectors") & needs_fallback(F.col("combined"), F.col("lexicon_hit_count"))).select("message_id", "plain_id")
    asked = asked.join(vectors.select(F.col("message_id").alias("plain_id"), "vector"), "plain_id").drop("plain_id")
    near = similarity.intent_verdict(asked, exemplars).select("message_id", "intent", F.col("margin").alias("intent_margin"))
    return df.join(near, "message_id", "left").fillna({"intent": "", "intent_margin": 0.0})


def _text() -> Column:
    return F.when(F.col("combined") != "", F.col("combined")).otherwise(F.coalesce("message_text", F.lit(""))).alias("text")


def pairs(t: dict[str, DataFrame], messages: DataFrame) -> DataFrame:
    """Every message with its recipient's history: the pairs one by one, which ``best_pairs`` does without."""
    lexical = similarity.lexical_similarity(messages.select("message_id", "user_id", _text()), similarity.history_texts(t["history"], t["media"]))
    return similarity.candidate_pairs(messages, t["history"], t["message_events"], lexical, t.get("vectors"))


def best_pairs(t: dict[str, DataFrame], messages: DataFrame, variants: tuple[Variant, ...] = (FULL,), settings: Settings = DEFAULT, near: float | None = None) -> DataFrame:
    """Of the pairs of every message with its recipient's history, those that any later step can take; ``near`` as in ``similarity.best_pairs``."""
    asked = messages.select("message_id", "plain_id", "variant", "user_id", _text(), *tiles.PAIRED)
    return similarity.best_pairs(asked, t["history"], t["message_events"], t["media"], t.get("vectors"), variants, settings, near)


def classified(t: dict[str, DataFrame], variants: tuple[Variant, ...] = (FULL,)) -> DataFrame:
    """Messages with their facts, risks and the scores that need none of the recipient's history."""
    return scoring.classify(safety.assess(facts(t, variants)))


def related(t: dict[str, DataFrame]) -> DataFrame:
    """Classified messages with trust and relationship, without the pairs that only repetition and evidence need."""
    return scoring.with_stats(stage(classified(t)), stage(_profile(t)))


def _profile(t: dict[str, DataFrame]) -> DataFrame:
    return profiles.engagement_profile(t["message_events"], t["history"])


#: What the steps after classification read of a message: pairs, scores, choice.
SCORED_FROM = (
    "message_id", "plain_id", "variant", "user_id", "combined", "message_text", *tiles.PAIRED, "duration_s", "wpm", "modality", "mem_role", "mem_read", "mem_replies", "mem_dismissed", "mem_muted",
    "is_member", "snd_member", "sender_admin", "rel_replied_30d", "has_rel", "rel_active", "opted_out", "rel_ignored", "why", "shares_work", "quiet", "group_type", "biz_verified", "biz_account_age_days",
    "biz_reports_30d", "has_biz", "mismatch", "low", "urls", "direct_request", "n_translit_urgency", "n_impersonation", "n_urgency", "n_deescalation", "n_feedback", "n_promo", "n_time", "is_empty", "same_day",
    "mentions_user", "intent", "spam", "scam", "injection", "threats", "risk", "is_scam", "urgency", "actionability", "kind", "kind_driver", "topic", "importance", "transactional", "promo_pressure",
)
#: What the steps after the choice read of it: second opinions, evidence, repair, fallback.
DECIDED_FROM = (
    "message_id", "seq", "sender_admin", "rel_active", "opted_out", "group_type", "direct_request", "is_empty", "mentions_user", "is_scam", "gray_zone", "intent_sought", "want", "rationale", *decide.NEEDED, *decide.FLAGS,
)


def _only(df: DataFrame, columns: tuple[str, ...] | None) -> DataFrame:
    return df if columns is None else df.select(*[c for c in df.columns if c in columns])


def scored(
    t: dict[str, DataFrame], settings: Settings = DEFAULT, variants: tuple[Variant, ...] = (FULL,), then: Callable[[DataFrame], DataFrame] = lambda df: df, columns: tuple[str, ...] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scored messages, pairs with their history), both staged, as the classified messages in between: each is read by several branches.

    ``then`` is done to the messages before they are staged. ``columns`` are those that the caller reads of them, or all: a message has some 170, and
    what nobody reads is neither worked out nor written.
    """
    known = stage(_only(classified(t, variants), None if columns is None else (*SCORED_FROM, *columns)))
    candidates = stage_alone(lambda: best_pairs(t, known, variants, settings, similarity.NEAR))
    repeated = similarity.repetition(similarity.similar_topk(candidates, settings.evidence.similar_k))
    profile = stage(_profile(t))  # read once a grain
    tired = profiles.fatigue(profiles.notification_load(t["daily"]))
    messages = stage(_only(then(scoring.score(known, profile, repeated, tired, settings)), columns))
    release(known, profile)
    return messages, candidates


def choice(settings: Settings = DEFAULT) -> Callable[[DataFrame], DataFrame]:
    """Scored messages with their action, its reason and the evidence to look for."""
    return lambda df: decide.explain_choice(decide.decide(df, settings), settings)


def route(t: dict[str, DataFrame], settings: Settings = DEFAULT, verdicts: DataFrame | None = None, variants: tuple[Variant, ...] = (FULL,), columns: tuple[str, ...] | None = None) -> DataFrame:
    """One repaired decision for each message, and each of ``variants``, which are routed together: what they share is worked out once.

    ``verdicts`` (message_id, action, message_type) are second opinions on close decisions. They come before the evidence is looked up and before the
    repair, so reason, evidence and invariants are those of the action that is taken. ``columns`` are those that the caller reads of a message besides its
    decision and ``DECIDED_FROM``; without them all are there.
    """
    chosen, candidates = scored(t, settings, variants, choice(settings), None if columns is None else (*DECIDED_FROM, *columns))
    if verdicts is not None:
        first, chosen = chosen, stage(decide.reconcile_verdicts(chosen, verdicts, settings))
        release(first)
    wanted = chosen.select("message_id", F.col("intent_sought").alias("intent"), "want")
    evidence = similarity.evidence_topk(candidates, wanted, settings)
    return decide.with_fallback(decide.repair(chosen.join(evidence, "message_id", "left"), settings))
