"""Records extracted from images and voice notes: cleaning, layout, tags, speech figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token forms of recognised text and words of layouts.
EDGES = ".,:;!?()[]{}<>\"'|\\/*_~`^=+"
WORD = r"^[A-Za-z][A-Za-z'\-]{2,}$"
NUMBER = r"^[₹$%#@&]?[\d][\d,.:/\-]*%?$"
CAPITALS = r"^[A-Z]{2,}$"
LAYOUT_WORDS = (
    ("document", "statement|consent form|certificate|page no|account no|permission"),
    ("receipt", "receipt|invoice|transaction id|txn|paid to"),
    ("screenshot", "inbox|meeting notes|calendar|webinar"),
    ("promotional_poster", "off|sale|offer|book now|discount|cashback|unbeatable|price"),
)


def clean_ocr_tokens(raw: Column) -> Column:
    """(text, words): tokens that are words, numbers or capitals; under two words nothing is believed."""
    tokens = F.transform(F.split(F.coalesce(raw, F.lit("")), r"(?U)\s+"), lambda x: F.btrim(x, F.lit(EDGES)))
    kept = F.filter(tokens, lambda x: (x != "") & (x.rlike(WORD) | x.rlike(NUMBER) | x.rlike(CAPITALS)))
    words = F.size(F.filter(kept, lambda x: x.rlike(WORD)))
    return F.when(words >= 2, F.struct(F.array_join(kept, " ").alias("text"), words.alias("words"))).otherwise(F.struct(F.lit("").alias("text"), F.lit(0).alias("words")))


def classify_layout(text: Column, tags: Column, words: Column) -> Column:
    """By what the text says, then by what the picture shows."""
    low = F.lower(text)
    chain = F
    for layout, pattern in LAYOUT_WORDS:
        chain = chain.when((words >= 4) & low.rlike(pattern), layout)
    tagged = lambda tag: F.array_contains(tags, tag)
    chain = chain.when(tagged("app_screenshot"), "screenshot").when(tagged("official_document") & (words >= 4), "document").when(words >= 8, "poster")
    return chain.when(tagged("retail_product_photo") | tagged("personal_photo"), "photo").otherwise("unknown")


def scene_tags(similarities: Column) -> Column:
    """Of a map label -> cosine, the labels with the two largest softmax(100 x) shares, if 0.12 or more."""
    entries = F.map_entries(similarities)
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    weights = F.transform(entries, lambda e: F.struct(F.exp(100 * (e["value"] - top)).alias("w"), e["key"].alias("k")))
    total = F.aggregate(weights, F.lit(0.0), lambda s, e: s + e["w"])
    ranked = F.slice(F.reverse(F.array_sort(weights)), 1, 2)
    return F.transform(F.filter(ranked, lambda e: e["w"] / total >= 0.12), lambda e: e["k"])


def text_density(text: Column, width: Column, height: Column) -> Column:
    """Characters for 10,000 pixels."""
    return F.round(F.char_length(text) / (F.greatest(F.lit(1), width * height) / 10000.0), 5)


def media_ok(text: Column, tags: Column) -> Column:
    return (text != "") | (F.size(tags) > 0)


def image_text(ocr_text: Column, tags: Column, has_qr: Column) -> Column:
    """What text operators read of an image."""
    parts = F.array(F.trim(ocr_text), F.when(F.size(tags) > 0, F.concat(F.lit("[visual: "), F.array_join(tags, ", "), F.lit("]"))), F.when(has_qr, "[contains QR code]"))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def voice_prosody(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """From (media_id, at, start_s, end_s, text, logprob, no_speech) and (media_id, duration_s)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    sums = segments.groupBy("media_id").agg(
        F.trim(F.regexp_replace(text, r"\s+", " ")).alias("transcript"),
        F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).alias("voiced"),
        F.round(F.avg("logprob"), 3).alias("avg_logprob"),
        F.round(F.avg("no_speech"), 3).alias("no_speech_prob"),
    )
    joined = durations.join(sums, "media_id", "left").fillna({"transcript": "", "voiced": 0.0, "avg_logprob": 0.0, "no_speech_prob": 0.0})
    words = F.size(F.array_remove(F.split("transcript", " "), ""))
    wpm = F.when(F.col("voiced") > 1.0, F.round(words / (F.col("voiced") / 60.0), 1)).otherwise(0.0)
    ratio = F.when(F.col("duration_s") > 0, F.round(F.col("voiced") / F.col("duration_s"), 3)).otherwise(0.0)
    out = joined.select("media_id", "transcript", "duration_s", words.alias("word_count"), wpm.alias("wpm"), ratio.alias("speech_ratio"), "avg_logprob", "no_speech_prob")
    return out.withColumns({"is_rushed": F.col("wpm") >= 165.0, "is_short_burst": (F.col("duration_s") > 0) & (F.col("duration_s") <= 12.0), "ok": F.col("transcript") != ""})
