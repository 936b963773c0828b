"""Derived fields of the base tables, and lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """Trimmed; missing is the empty string, which predicates test for."""
    return F.trim(F.coalesce(c, F.lit("")))


def cast_int(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


def cast_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(default))


def cast_bool(c: Column) -> Column:
    return F.coalesce(F.trim(c).isin("1", "true", "True", "yes"), F.lit(False))


def cast_ts(c: Column) -> Column:
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in forms])


def minute_of(hhmm: Column) -> Column:
    """Minutes of the day, or null if it is no time."""
    good = hhmm.rlike(r"^\s*([01]?\d|2[0-3]):[0-5]?\d\s*$")
    return F.when(good, F.split_part(F.trim(hhmm), F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(F.trim(hhmm), F.lit(":"), F.lit(2)).cast("int"))


def quiet_hours(window: Column, ts: Column) -> Column:
    """Inside [start, end), which may go past midnight."""
    whole = F.when(window.contains("-"), window)
    start, end = minute_of(F.split_part(whole, F.lit("-"), F.lit(1))), minute_of(F.split_part(whole, F.lit("-"), F.lit(2)))
    at = F.hour(ts) * 60 + F.minute(ts)
    inside = F.when(start <= end, (start <= at) & (at < end)).otherwise((at >= start) | (at < end))
    return F.coalesce(F.when(start.isNotNull() & end.isNotNull(), inside), F.lit(False))


def domain_mismatch(official: Column, used: Column) -> Column:
    """P03."""
    return (official != "") & (used != "") & (official != used)


def lookalike_domain(official: Column, used: Column) -> Column:
    """The brand's own name inside a domain that is not the brand's."""
    brand = F.split_part(official, F.lit("."), F.lit(1))
    return domain_mismatch(official, used) & (F.char_length(brand) >= 3) & (F.instr(F.translate(used, "-_", ""), brand) > 0)


def outcome(known: Column, opened: Column, replied: Column, dismissed: Column, muted: Column, reported: Column) -> Column:
    """P06."""
    return F.when(~known, "unknown").when(dismissed | muted | reported, "negative").when(opened | replied, "positive").otherwise("neutral")


def parse_ids(c: Column) -> Column:
    """``a;b`` or ``none``."""
    ids = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "none", F.array().cast("array<string>")).otherwise(ids)


def format_ids(ids: Column) -> Column:
    return F.when(F.size(ids) > 0, F.array_join(ids, ";")).otherwise("none")


def evidence_intent(action: Column, kind: Column) -> Column:
    """P10."""
    return F.when(action == "notify", "promote").when((action == "mute") & ~kind.isin("scam", "spam"), "suppress").otherwise("neutral")


def smoothed_rate(n: Column, d: Column, prior: float = 0.5) -> Column:
    """A02."""
    return (n + prior * 3.0) / (d + 3.0)


def affinity(seen: Column, opened: Column, replied: Column, fast: Column, dismissed: Column, muted: Column, reported: Column) -> Column:
    """From -1 (rejected) to 1 (engaged), nearer to 0 the less has been seen."""
    good = opened + 1.5 * replied + 0.5 * fast
    bad = dismissed + 1.5 * muted + 3.0 * reported
    value = (good - bad) / (good + bad) * (1 - F.exp(-seen / 2.5))
    return F.when((seen > 0) & (good + bad > 0), F.round(value, 3)).otherwise(0.0)
