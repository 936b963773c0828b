"""Decisions against labels, counts of a run, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietwire.operators.scoring import look_up

_STEP = {"notify": 0, "digest": 1, "mute": 2}


def with_labels(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (message_id, true_action, true_type, true_reason, true_confidence, true_evidence); unanswered ones are skipped."""
    return decisions.join(labels, "message_id")


def accuracy(joined: DataFrame) -> DataFrame:
    """A11."""
    right_action, right_type = F.col("action") == F.col("true_action"), F.col("message_type") == F.col("true_type")
    apart = F.abs(look_up(_STEP, F.col("action"), 1) - look_up(_STEP, F.col("true_action"), 1))
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return joined.agg(
        F.count("*").alias("n"),
        share(right_action).alias("action_accuracy"),
        share(right_type).alias("type_accuracy"),
        share(right_action & right_type).alias("joint_accuracy"),
        F.count_if(apart == 1).alias("adjacent_errors"),
        F.count_if(F.col("reason") == F.col("true_reason")).alias("reason_matches"),
        F.round(F.avg(F.abs(F.col("confidence") - F.col("true_confidence"))), 4).alias("confidence_error"),
    )


def confusion(joined: DataFrame, field: str) -> DataFrame:
    """Counts by (true, predicted) of "action" or "type"."""
    predicted = "action" if field == "action" else "message_type"
    return joined.groupBy(F.col(f"true_{field}").alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def critical_errors(joined: DataFrame) -> DataFrame:
    """A13."""
    kind = F.when((F.col("true_action") == "notify") & (F.col("action") == "mute"), "urgent_message_muted").when((F.col("true_action") == "mute") & (F.col("action") == "notify"), "unsafe_message_notified")
    return joined.withColumn("error", kind).filter("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def evidence_recall(joined: DataFrame) -> DataFrame:
    """A14, U04."""
    gold, cited = F.col("true_evidence"), F.col("evidence")
    return joined.agg(
        F.sum(F.size(F.array_intersect(gold, cited))).alias("found"),
        F.sum(F.size(F.array_distinct(gold))).alias("gold"),
        F.round(F.sum(F.size(F.array_intersect(gold, cited))) / F.greatest(F.sum(F.size(F.array_distinct(gold))), F.lit(1)), 4).alias("recall"),
        F.count_if(F.array_sort(F.array_distinct(gold)) == F.array_sort(F.array_distinct(cited))).alias("exact_sets"),
        F.count_if((F.size(gold) == 0) & (F.size(cited) == 0)).alias("none_correct"),
    )


def calibration(joined: DataFrame, bins: int = 5) -> DataFrame:
    """A15, by bin."""
    right = (F.col("action") == F.col("true_action")).cast("int")
    at = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int")
    return joined.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(right).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """A15, as one number."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def run_stats(decisions: DataFrame) -> DataFrame:
    """Counts by action, by type and in all, in one pass."""
    sets = decisions.groupingSets([[F.col("action")], [F.col("message_type")], []], F.col("action"), F.col("message_type"))
    return sets.agg(F.count("*").alias("n"), F.count_if("gray_zone").alias("gray_zone"))


def run_metrics(decisions: DataFrame) -> DataFrame:
    """A10, of decisions."""
    return decisions.agg(
        F.count("*").alias("messages"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in _STEP],
        F.count_if(F.col("message_type").isin("scam", "spam")).alias("safety_muted"),
        F.count_if(F.size("evidence") > 0).alias("evidence_cited"),
        F.count_if(F.size("evidence") == 0).alias("evidence_none"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.count_if(F.size("violations") > 0).alias("repaired"),
    )


def media_metrics(messages: DataFrame, media: DataFrame) -> DataFrame:
    """A10, U03, of what is attached."""
    asked = messages.filter("media_type <> '' and media_id <> ''").select("media_type", "media_id").distinct()
    known = media.select("media_type", "media_id", "ok").withColumn("known", F.lit(True))
    counts = asked.join(known, ["media_type", "media_id"], "left").agg(F.count("*").alias("referenced"), F.count("known").alias("resolved"), F.count_if(F.col("known").isNull()).alias("failed"))
    texts = media.agg(F.count_if(F.col("ok") & (F.col("media_type") == "image")).alias("ocr_ok"), F.count_if(F.col("ok") & (F.col("media_type") == "voice")).alias("asr_ok"))
    return counts.select("*", *[texts.select(c).scalar().alias(c) for c in texts.columns])


def critic_report(decisions: DataFrame) -> DataFrame:
    """Decisions by broken rule."""
    return decisions.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def changed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Messages on whose (action, type) two runs differ."""
    r = right.select("message_id", F.col("action").alias("other_action"), F.col("message_type").alias("other_type"))
    return left.join(r, "message_id").filter((F.col("action") != F.col("other_action")) | (F.col("message_type") != F.col("other_type"))).select("message_id", "action", "message_type", "other_action", "other_type")


def churn(left: DataFrame, right: DataFrame) -> DataFrame:
    """A17."""
    return changed(left, right).agg(F.count("*").alias("changed"))


def ablation(runs: DataFrame, labels: DataFrame, whole: str) -> DataFrame:
    """Q05: a row for each ``variant`` of ``runs`` (variant, message_id, decision, true_evidence), all in one pass: how right it is, and on how
    many messages it decides otherwise than the variant ``whole``."""
    own = Window.partitionBy("message_id")
    joined = with_labels(runs.select("variant", "message_id", "action", "message_type", "evidence", "true_evidence"), labels.select("message_id", "true_action", "true_type"))
    first = joined.withColumn("_whole", F.max(F.when(F.col("variant") == whole, F.struct("action", "message_type"))).over(own))
    right_action, right_type = F.col("action") == F.col("true_action"), F.col("message_type") == F.col("true_type")
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    gold = F.sum(F.size(F.array_distinct("true_evidence")))
    critical = ((F.col("true_action") == "notify") & (F.col("action") == "mute")) | ((F.col("true_action") == "mute") & (F.col("action") == "notify"))
    return first.groupBy("variant").agg(
        F.count("*").alias("n"),
        share(right_action).alias("action_accuracy"),
        share(right_type).alias("type_accuracy"),
        share(right_action & right_type).alias("joint_accuracy"),
        F.round(F.sum(F.size(F.array_intersect("true_evidence", "evidence"))) / F.greatest(gold, F.lit(1)), 4).alias("recall"),
        F.count_if(critical).alias("critical_errors"),
        F.count_if((F.col("action") != F.col("_whole.action")) | (F.col("message_type") != F.col("_whole.message_type"))).alias("changed"),
    )
