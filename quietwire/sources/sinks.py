"""Decisions, traces and metrics as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwire.functions.derive import format_ids


def output_rows(decisions: DataFrame) -> DataFrame:
    """The six columns of the output, as text."""
    return decisions.select("message_id", "action", "message_type", "reason", F.format_string("%.2f", "confidence").alias("confidence"), format_ids(F.col("evidence")).alias("evidence_message_ids"))


def trace_rows(decisions: DataFrame) -> DataFrame:
    """One JSON object for each decision."""
    shown = ("message_id", "action", "message_type", "rationale", "confidence", "urgency", "actionability", "trust", "relationship", "importance", "repetition", "fatigue", "priority", "scam", "spam", "injection", "risk", "threats", "signals", "drivers", "evidence", "violations", "errors")
    return decisions.select("message_id", F.to_json(F.struct(*[c for c in shown if c in decisions.columns])).alias("trace"))


def explain(decisions: DataFrame, message_id: str) -> DataFrame:
    """Q04: the trace of one decision."""
    return trace_rows(decisions.filter(F.col("message_id") == message_id))


def write_output(decisions: DataFrame, path: str) -> None:
    output_rows(decisions).write.option("escape", '"').csv(path, header=True)


def write_trace(decisions: DataFrame, path: str) -> None:
    trace_rows(decisions).select("trace").write.text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """S07."""
    metrics.write.json(path)
