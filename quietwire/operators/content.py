"""Everything that is said in a message, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.functions import text as t
from quietwire.functions.lexicons import LEXICONS
from quietwire.operators.joins import spread_blanks
from quietwire.operators.safety import text_threats

#: Lexicons that count as having understood a text (C20), with the time-pressure hits.
COUNTED = ("credential", "account_threat", "payment_demand", "prize", "investment", "urgency", "promo", "greeting", "event", "payment", "business_update", "translit_risk", "translit_urgency")
#: Lexicons read off the sender's own words only.
CAPTION = ("marketplace", "promo", "payment", "event", "business_update")


def with_media(messages: DataFrame, media: DataFrame) -> DataFrame:
    """The attached record's text and properties; modality; whether something attached could not be read."""
    m, x = messages.alias("m"), media.select("media_type", "media_id", "ok", "media_text", "layout", "has_qr", "duration_s", "wpm").alias("x")
    seen = F.col("m.media_seen") if "media_seen" in messages.columns else F.lit(True)  # what a variant leaves out is as if it were not there
    asked = F.col("m.media_type").isin("image", "voice") & seen
    joined = m.join(x, (F.col("m.media_type") == F.col("x.media_type")) & (spread_blanks(F.col("m.media_id"), asked) == F.col("x.media_id")) & asked, "left")
    failed = F.when(F.col("m.media_type") == "", F.lit(False)).otherwise(~F.coalesce("x.ok", F.lit(False)))
    return joined.select(
        "m.*",
        F.coalesce("x.media_text", F.lit("")).alias("media_raw"),
        F.coalesce("x.layout", F.lit("")).alias("layout"),
        F.coalesce("x.has_qr", F.lit(False)).alias("has_qr"),
        F.coalesce("x.duration_s", F.lit(0.0)).alias("duration_s"),
        F.coalesce("x.wpm", F.lit(0.0)).alias("wpm"),
        F.when(F.col("m.media_type") == "", "text").otherwise(F.col("m.media_type")).alias("modality"),
        failed.alias("media_failed"),
    )


def content_features(messages: DataFrame, media: DataFrame) -> DataFrame:
    """``messages`` with content columns.

    What follows from the words alone is worked out once for each different text with its attachment's text, however many messages
    carry it, and dealt over all tasks: a scan of short rows has few tasks, and this is the dear part of the routing.
    """
    joined = with_media(messages, media)
    return with_texts(joined, joined)


def with_texts(joined: DataFrame, said: DataFrame) -> DataFrame:
    """Rows of ``with_media`` with what follows from their words. ``said`` has their texts, where another table has them without the joins that ``joined`` went through."""
    if joined.isStreaming:  # a stream can't be met with its own distinct texts
        return with_mentions(text_features(joined).drop("media_raw"))
    told = text_features(in_many_tasks(said.select(*TOLD).distinct(), *TOLD))
    same = [joined[c].eqNullSafe(told[c]) for c in TOLD]
    found = joined.join(told, same[0] & same[1]).drop(*[told[c] for c in TOLD], joined["media_raw"])
    return with_mentions(found)


def with_mentions(df: DataFrame) -> DataFrame:
    return df.withColumn("mentions_user", t.mentions_user(F.col("mentions"), F.col("user_id")))


#: What the words of a message are: its own, and those of what is attached.
TOLD = ("message_text", "media_raw")


def in_many_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over as many tasks as shuffles have, by a hash, so that it isn't taken for the shuffle before; adaptive execution joins no tasks of a given number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def text_features(told: DataFrame) -> DataFrame:
    """Rows of ``TOLD`` with what follows from them. Texts are prepared once, then read by all lexicons and patterns."""
    texts = told.withColumns({"text": t.normalize_text(F.col("message_text")), "spaced": t.normalize_keep_spacing(F.col("message_text")), "media_text": t.normalize_text(F.col("media_raw"))})
    views = texts.withColumns({"combined": t.combine(F.col("text"), F.col("media_text")), "low": t.deobfuscate(t.combine(F.col("spaced"), F.col("media_text")))}).drop("spaced")
    views = views.withColumn("caption", F.when(F.col("text") != "", F.lower("text")).otherwise(F.col("low")))
    # each step reads the columns of the one before it, so that none is worked out twice
    views = views.withColumns({"_words": t.words_apart(F.col("low")), "_caption_words": t.words_apart(F.col("caption"))})
    views = views.withColumns({"_runs": t.word_runs(F.col("_words")), "_caption_runs": t.word_runs(F.col("_caption_words"))})
    views = views.withColumns({"_places": t.lexicon_places(F.col("_runs"), tuple(LEXICONS)), "_caption_places": t.lexicon_places(F.col("_caption_runs"), CAPTION)})
    low, combined = F.col("low"), F.col("combined")
    hits: dict[str, Column] = {f"{name}_hits": t.lexicon_hits(F.col("_places"), low, name) for name in LEXICONS}
    hits |= {f"caption_{name}_hits": t.lexicon_hits(F.col("_caption_places"), F.col("caption"), name) for name in CAPTION}
    hits |= {
        "char_count": F.char_length(combined),
        "word_count": t.word_count(combined),
        "urls": t.extract_urls(combined),
        "amounts": t.extract_amounts(combined),
        "mentions": t.extract_mentions(combined),
        "injection_hits": t.injection_hits(low),
        "time_hits": t.time_pressure_hits(combined),
        "direct_request": t.has(combined, t.DIRECT_REQUEST),
        "question": combined.contains("?"),
        "opt_out_footer": t.has(combined, t.OPT_OUT),
        "demands_amount": t.has(combined, t.PAY_AMOUNT),
        "qr_payment": t.has(combined, t.QR_PAYMENT),
        "active_demand": t.active_credential_demand(combined),
    }
    found = views.withColumns(hits).drop("_words", "_runs", "_places", "_caption_words", "_caption_runs", "_caption_places")
    counts = {f"n_{k.removesuffix('_hits')}": F.size(k) for k in hits if k.endswith("_hits")}
    found = found.withColumns(counts | {"domains": t.extract_domains(F.col("urls")), "is_empty": combined == ""})
    lexicon_total = sum((F.col(f"n_{name}") for name in COUNTED), F.col("n_time"))
    return found.withColumns(
        {
            "lexicon_hit_count": lexicon_total,
            "suspicious_host": t.suspicious_host(F.col("domains")),
            "shortened_link": t.shortened_link(F.col("domains")),
            "same_day": t.is_same_day(F.col("time_hits")),
            **text_threats(),
            "advisory": t.is_advisory(combined, F.col("advisory_hits"), F.col("payment_demand_hits"), F.col("active_demand")),
        }
    )
