"""Typed tables of the domain from CSV or Parquet.

Every column is read as text and cast leniently, since a bad cell must not lose a row. Rows keep their order in ``seq``, over all
files of a table; it decides between rows with equal keys and between ties.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.functions import derive as d
from quietwire.operators.joins import dedupe_last

_S, _I, _F, _B, _T = d.text, d.cast_int, d.cast_float, d.cast_bool, d.cast_ts
_MESSAGE = {
    "message_id": ("message_id", _S), "user_id": ("user_id", _S), "conversation_type": ("conversation_type", _S), "group_id": ("group_id", _S),
    "business_id": ("business_id", _S), "sender_user_id": ("sender_user_id", _S), "created_at": ("created_at", _T),
    "message_text": ("message_text", lambda c: F.coalesce(c, F.lit(""))), "media_type": ("media_type", _S), "media_id": ("media_id", _S), "forwarded_count": ("forwarded_count", _I),
}
_LABEL = {"action": ("action", _S), "message_type": ("message_type", _S), "reason": ("reason", _S), "confidence": ("confidence", _F), "evidence": ("evidence_message_ids", d.parse_ids)}
# Column of the result, column of the file, cast; keys; whether the file must be there.
TABLES: dict[str, tuple[dict, tuple[str, ...], bool]] = {
    "messages": (_MESSAGE, ("message_id",), True),
    "message_history": (_MESSAGE, ("message_id",), True),
    "sample_messages": (_MESSAGE | _LABEL, ("message_id",), False),
    "message_events": (
        {"user_id": ("user_id", _S), "message_id": ("message_id", _S), "message_opened": ("message_opened", _B), "message_replied": ("message_replied", _B), "reaction_minutes": ("reaction_time_minutes", lambda c: _F(c, -1.0)), "notification_dismissed": ("notification_dismissed", _B), "muted_after": ("muted_after_message", _B), "reported": ("message_reported", _B)},
        ("user_id", "message_id"), True,
    ),
    "users": ({"user_id": ("user_id", _S), "dnd_window": ("do_not_disturb_window", _S), "opened_30d": ("messages_opened_30d", _I), "replied_30d": ("messages_replied_30d", _I), "dismissed_30d": ("notifications_dismissed_30d", _I), "reported_30d": ("messages_reported_30d", _I)}, ("user_id",), True),
    "groups": ({"group_id": ("group_id", _S), "group_name": ("group_name", _S), "group_type": ("group_type", _S), "member_count": ("member_count", _I), "admin_count": ("admin_count", _I), "created_at": ("created_at", _T), "messages_30d": ("messages_30d", _I)}, ("group_id",), True),
    "group_members": ({"group_id": ("group_id", _S), "user_id": ("user_id", _S), "role": ("role", _S), "read_30d": ("messages_read_30d", _I), "replies_30d": ("replies_sent_30d", _I), "dismissed_30d": ("notifications_dismissed_30d", _I), "muted": ("group_muted_by_user", _B)}, ("group_id", "user_id"), True),
    "business_accounts": (
        {"business_id": ("business_id", _S), "display_name": ("display_name", _S), "verified": ("verified", _B), "official_domain": ("official_domain", lambda c: F.lower(_S(c))), "used_domain": ("domain_used_by_sender", lambda c: F.lower(_S(c))), "account_age_days": ("account_age_days", _I), "sent_30d": ("messages_sent_30d", _I), "reports_30d": ("user_reports_30d", _I), "domain_age_days": ("domain_used_by_sender_age_days", _I)},
        ("business_id",), True,
    ),
    "user_business_history": (
        {"user_id": ("user_id", _S), "business_id": ("business_id", _S), "why": ("why_user_knows_account", _S), "allows_promotions": ("allows_promotions", _B), "opted_out_at": ("promotions_opted_out_at", _T), "activity_180d": ("activity_count_180d", _I), "opened_30d": ("messages_opened_30d", _I), "dismissed_30d": ("messages_dismissed_30d", _I), "replied_30d": ("messages_replied_30d", _I)},
        ("user_id", "business_id"), True,
    ),
    "daily_notification_summary": ({"user_id": ("user_id", _S), "date": ("date", _T), "sent": ("notifications_sent", _I), "dismissed": ("notifications_dismissed", _I)}, (), True),
    "images": ({"media_id": ("image_id", _S), "file_path": ("file_path", _S)}, ("media_id",), False),
    "voice_notes": ({"media_id": ("voice_note_id", _S), "file_path": ("file_path", _S)}, ("media_id",), False),
}


#: Files of one table whose order is looked up in a broadcast table of their names.
MAX_FILES = 100_000
_FILE_BITS = 40


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with headers, quoted line ends and possibly byte order marks, or Parquet files; all columns as text, and seq.

    ``seq`` follows the files by name and the rows of each file as they stand there, however the read is split: the file's place among the names
    above a row number that rises within the file. A row of Parquet has its index; a CSV file with quoted line ends is read by one task, in order.
    """
    if path.endswith(".csv"):
        raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").csv(path)
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its place in the task that has all of its file
    else:
        raw = spark.read.parquet(path)
        row = F.col("_metadata.row_index")
    cells = [F.col(f"`{c}`").cast("string").alias(c.lstrip("\ufeff")) for c in raw.columns]
    names = sorted(raw.inputFiles())
    if len(names) > MAX_FILES:
        raise ValueError(f"more than {MAX_FILES} files in {path}")
    numbered = raw.select(*cells, F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/").alias("_file"), row.alias("_row"))
    if len(names) <= 1:
        return numbered.withColumn("seq", F.col("_row")).drop("_file", "_row")
    places = spark.createDataFrame([(i, re.sub("^([a-z0-9]+):/+", r"\1:/", name)) for i, name in enumerate(names)], "_place long, _file string")
    placed = numbered.join(F.broadcast(places), "_file", "left")  # a row for each file, MAX_FILES at most
    placed = placed.withColumn("_place", F.coalesce("_place", F.raise_error(F.concat(F.lit("a file that was not listed: "), F.col("_file"))).cast("long")))
    return placed.select(*[c for c in numbered.columns if c not in ("_file", "_row")], (F.shiftleft("_place", _FILE_BITS) + F.col("_row")).alias("seq"))


def typed(raw: DataFrame, name: str) -> DataFrame:
    """Cast columns; a missing key column is an error, another missing column has its default."""
    columns, keys, _ = TABLES[name]
    missing = [columns[k][0] for k in keys if columns[k][0] not in raw.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")

    def cell(source: str, cast) -> Column:
        return cast(F.col(source) if source in raw.columns else F.lit(None).cast("string"))

    out = raw.select(*[cell(source, cast).alias(c) for c, (source, cast) in columns.items()], "seq")
    return dedupe_last(out, list(keys), "seq") if keys else out


def load_context(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder of CSV files; an absent optional file is left out, an absent required one is an error."""
    found = {}
    for name, (_, _, required) in TABLES.items():
        try:
            found[name] = typed(read_table(spark, f"{folder}/{name}.csv"), name)
        except AnalysisException:
            if required:
                raise
    return found
