"""Queries of texts and of extracted media records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwire.functions import media as md
from quietwire.functions import text as t
from quietwire.functions.lexicons import LEXICONS
from quietwire.operators import content, similarity
from quietwire.plans.registry import query
from quietwire.plans.route_oracle import CONTENT_CTE, doubles, hits, lit, matches, names

#: Terms that the driver's documents have.
DOCUMENT_TERMS = ("the", "license", "version", "token", "and", "of", "with", "under the")


@query("c01_normalize_text")
def c01(v):
    return v["documents"].select("doc_id", t.normalize_text(F.col("text")).alias("text"))


@query("c02_normalize_keep_spacing")
def c02(v):
    return v["documents"].select("doc_id", t.normalize_keep_spacing(F.col("text")).alias("text"))


@query("c03_deobfuscate")
def c03(v):
    return v["all_messages"].select("message_id", t.deobfuscate(F.concat(F.col("message_text"), F.lit(" s h a r e  your 0tp or acc0unt 4 pm"))).alias("low"))


@query("c04_lexicon_hits", f"SELECT doc_id, len(h) AS n, array_to_string(h, '|') AS hits FROM (SELECT doc_id, {hits('lower(text)', DOCUMENT_TERMS)} AS h FROM documents)")
def c04(v):
    found = v["documents"].select("doc_id", t.term_hits(F.lower("text"), DOCUMENT_TERMS).alias("h"))
    return found.select("doc_id", F.size("h").cast("long").alias("n"), F.array_join("h", "|").alias("hits"))


_ALL_HITS = "SELECT message_id, " + ", ".join(f"n_{n}" for n in LEXICONS) + " FROM content"


@query("c05_lexicons", _ALL_HITS, CONTENT_CTE)
def c05(v):
    return content.content_features(v["messages"], v["media"]).select("message_id", *[F.col(f"n_{n}").cast("long").alias(f"n_{n}") for n in LEXICONS])


@query("c06_combined_text", "SELECT message_id, combined, length(combined) AS char_count, word_count FROM content", CONTENT_CTE)
def c06(v):
    return content.content_features(v["messages"], v["media"]).select("message_id", "combined", F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"))


def _joined_list(pattern: str, group: int, n: int, change: str = "x") -> str:
    extracted = f"regexp_extract_all(text, {lit('(?i)' + pattern)}, {group})"
    return f"array_to_string(list_slice(list_sort(list_distinct(list_transform({extracted}, lambda x: {change}))), 1, {n}), '|')"


@query("c07_extract_urls", f"SELECT doc_id, {_joined_list(t.URL, 1, 10, chr(114) + 'trim(lower(x), ' + lit('.,') + ')')} AS urls FROM documents")
def c07(v):
    return v["documents"].select("doc_id", F.array_join(t.extract_urls(F.col("text")), "|").alias("urls"))


@query("c08_extract_domains", "SELECT message_id, array_to_string(domains, '|') AS domains FROM content", CONTENT_CTE)
def c08(v):
    return content.content_features(v["messages"], v["media"]).select("message_id", F.array_join("domains", "|").alias("domains"))


@query("c09_extract_amounts", f"SELECT message_id, {_joined_list(t.AMOUNT, 0, 8)} AS amounts FROM (SELECT message_id, message_text AS text FROM all_messages)")
def c09(v):
    return v["all_messages"].select("message_id", F.array_join(t.extract_amounts(F.col("message_text")), "|").alias("amounts"))


@query("c10_extract_mentions", f"SELECT doc_id, {_joined_list(t.MENTION, 1, 10)} AS mentions FROM documents")
def c10(v):
    return v["documents"].select("doc_id", F.array_join(t.extract_mentions(F.col("text")), "|").alias("mentions"))


@query("c11_extract_phones_dates", f"SELECT doc_id, {_joined_list(t.PHONE, 0, 5)} AS phones, {_joined_list(t.DATE, 1, 6)} AS dates FROM documents")
def c11(v):
    return v["documents"].select("doc_id", F.array_join(t.extract_phones(F.col("text")), "|").alias("phones"), F.array_join(t.extract_dates(F.col("text")), "|").alias("dates"))


@query("c12_time_pressure_hits")
def c12(v):
    return v["said"].select("message_id", F.array_join(t.time_pressure_hits(F.col("message_text")), "|").alias("hits"))


@query("c13_request_flags", f"SELECT message_id, {matches('message_text', t.DIRECT_REQUEST)} AS direct_request, contains(message_text, '?') AS question, {matches('message_text', t.OPT_OUT)} AS opt_out FROM said")
def c13(v):
    x = F.col("message_text")
    return v["said"].select("message_id", t.has(x, t.DIRECT_REQUEST).alias("direct_request"), x.contains("?").alias("question"), t.has(x, t.OPT_OUT).alias("opt_out"))


@query("c14_payment_phrases", f"SELECT message_id, {matches('message_text', t.PAY_AMOUNT)} AS demands_amount, {matches('message_text', t.QR_PAYMENT)} AS qr_payment FROM said")
def c14(v):
    x = F.col("message_text")
    return v["said"].select("message_id", t.has(x, t.PAY_AMOUNT).alias("demands_amount"), t.has(x, t.QR_PAYMENT).alias("qr_payment"))


@query("c15_active_credential_demand")
def c15(v):
    return v["said"].select("message_id", t.active_credential_demand(F.col("message_text")).alias("active_demand"))


@query("c16_is_safety_advisory", "SELECT message_id, advisory FROM content", CONTENT_CTE)
def c16(v):
    return content.content_features(v["messages"], v["media"]).select("message_id", "advisory")


@query("c17_injection_hits", "SELECT message_id, n_injection FROM content", CONTENT_CTE)
def c17(v):
    return v["messages"].select("message_id", F.size(t.injection_hits(F.lower("message_text"))).cast("long").alias("n_injection"))


@query("c18_url_risk_flags", "SELECT message_id, suspicious_host, shortened_link FROM content", CONTENT_CTE)
def c18(v):
    return content.content_features(v["messages"], v["media"]).select("message_id", "suspicious_host", "shortened_link")


@query("c19_caption_hits", "SELECT message_id, " + ", ".join(f"n_caption_{c}" for c in content.CAPTION) + " FROM content", CONTENT_CTE)
def c19(v):
    return content.content_features(v["messages"], v["media"]).select("message_id", *[F.col(f"n_caption_{c}").cast("long").alias(f"n_caption_{c}") for c in content.CAPTION])


@query("c20_lexicon_hit_count", "SELECT message_id, lexicon_hit_count FROM content", CONTENT_CTE)
def c20(v):
    return content.content_features(v["messages"], v["media"]).select("message_id", F.col("lexicon_hit_count").cast("long").alias("lexicon_hit_count"))


_RATIO = "CASE WHEN length(regexp_replace({c}, '\\P{{L}}', '', 'g')) = 0 THEN 0.0 ELSE round(1 - length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) / length(regexp_replace({c}, '\\P{{L}}', '', 'g')), 3) END"


@query("c21_non_latin_ratio", f"SELECT doc_id, {_RATIO.format(c='text')} AS ratio FROM documents")
def c21(v):
    return v["documents"].select("doc_id", t.non_latin_ratio(F.col("text")).alias("ratio"))


@query("c22_needs_semantic_fallback", "SELECT message_id, word_count >= 3 AND lexicon_hit_count = 0 AS needs FROM content", CONTENT_CTE)
def c22(v):
    known = content.content_features(v["messages"], v["media"])
    return known.select("message_id", t.needs_fallback(F.col("combined"), F.col("lexicon_hit_count")).alias("needs"))


@query(
    "c23_intent_verdict",
    """SELECT message_id, CASE WHEN s1 - coalesce(s2, 0) >= 0.12 AND s1 >= 0.35 THEN intent ELSE '' END AS intent, round(s1 - coalesce(s2, 0), 3) AS margin FROM (
    SELECT message_id, max(score) FILTER (WHERE r = 1) AS s1, max(score) FILTER (WHERE r = 2) AS s2, max(intent) FILTER (WHERE r = 1) AS intent FROM (
    SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, intent DESC) AS r FROM (
    SELECT e.vec_id AS message_id, CAST(x.label AS VARCHAR) AS intent, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))), 3) AS score
    FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings WHERE label < 4 GROUP BY label) x GROUP BY ALL)) GROUP BY message_id)""",
)
def c23(v):
    vectors = v["embeddings"].select(F.col("vec_id").alias("message_id"), F.col("embedding").alias("vector"))
    exemplars = v["embeddings"].filter("label < 4").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("string").alias("intent"), "vector")
    return similarity.intent_verdict(vectors, exemplars)


_STOP = names(t.STOP_WORDS)


@query("c24_tokenize", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) > 1 AND x NOT IN {_STOP}))), ' ') AS tokens FROM documents")
def c24(v):
    return v["documents"].select("doc_id", F.array_join(F.array_sort(t.tokenize(F.col("text"))), " ").alias("tokens"))


_EDGES = lit(md.EDGES)
_OCR = f"""ocr AS (SELECT page_id, CASE WHEN w >= 2 THEN array_to_string(kept, ' ') ELSE '' END AS text, CASE WHEN w >= 2 THEN w ELSE 0 END AS words FROM (
  SELECT *, len(list_filter(kept, lambda x: regexp_matches(x, {lit(md.WORD)}))) AS w FROM (
  SELECT page_id, list_filter(list_transform(string_split_regex(html, '\\s+'), lambda x: trim(x, {_EDGES})), lambda x: regexp_matches(x, {lit(md.WORD)}) OR regexp_matches(x, {lit(md.NUMBER)}) OR regexp_matches(x, {lit(md.CAPITALS)})) AS kept FROM pages)))"""


@query("c25_clean_ocr_tokens", "SELECT page_id, text, words FROM ocr", _OCR)
def c25(v):
    return v["pages"].select("page_id", md.clean_ocr_tokens(F.col("html")).alias("x")).select("page_id", "x.text", F.col("x.words").cast("long").alias("words"))


_TAGS = "CASE page_id % 4 WHEN 0 THEN 'app_screenshot' WHEN 1 THEN 'official_document' WHEN 2 THEN 'personal_photo' ELSE '' END"


@query(
    "c26_classify_layout",
    f"""SELECT page_id, CASE {' '.join(f"WHEN words >= 4 AND regexp_matches(lower(text), '{p}') THEN '{k}'" for k, p in md.LAYOUT_WORDS)} WHEN tag = 'app_screenshot' THEN 'screenshot' WHEN tag = 'official_document' AND words >= 4 THEN 'document'
    WHEN words >= 8 THEN 'poster' WHEN tag = 'personal_photo' THEN 'photo' ELSE 'unknown' END AS layout FROM (SELECT *, {_TAGS} AS tag FROM (SELECT page_id, text, CASE WHEN page_id % 3 = 0 THEN 2 ELSE words END AS words FROM ocr))""",
    _OCR,
)
def c26(v):
    read = v["pages"].select("page_id", md.clean_ocr_tokens(F.col("html")).alias("x"), F.array(F.expr(_TAGS)).alias("tags"))
    words = F.when(F.col("page_id") % 3 == 0, 2).otherwise(F.col("x.words"))
    return read.select("page_id", md.classify_layout(F.col("x.text"), F.col("tags"), words).alias("layout"))


@query(
    "c27_scene_tag_select",
    """SELECT vec_id, array_to_string(list(k ORDER BY s DESC, k DESC), '|') AS tags FROM (SELECT vec_id, k, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k DESC) AS r, exp(100 * (s - max(s) OVER (PARTITION BY vec_id))) / sum(exp(100 * (s - m))) OVER (PARTITION BY vec_id) AS p
    FROM (SELECT vec_id, k, s, max(s) OVER (PARTITION BY vec_id) AS m FROM (SELECT vec_id, 't' || CAST(i AS VARCHAR) AS k, CAST(embedding[i] AS DOUBLE) AS s FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)))) WHERE r <= 2 AND p >= 0.12 GROUP BY vec_id""",
)
def c27(v):
    cells = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.concat(F.lit("t"), i.cast("string"))), F.transform("embedding", lambda x: x.cast("double")))
    return v["embeddings"].select("vec_id", F.array_join(md.scene_tags(cells), "|").alias("tags"))


@query("c28_text_density", "SELECT page_id, round(length(text) / (greatest(1, (page_id % 50) * 20) / 10000.0e0), 5) AS density, text <> '' AS ok FROM ocr", _OCR)
def c28(v):
    read = v["pages"].select("page_id", md.clean_ocr_tokens(F.col("html"))["text"].alias("text"))
    return read.select("page_id", md.text_density(F.col("text"), F.col("page_id") % 50, F.lit(20)).alias("density"), md.media_ok(F.col("text"), F.array().cast("array<string>")).alias("ok"))


@query("c29_media_as_text", f"SELECT page_id, array_to_string(list_filter([trim(text), CASE WHEN {_TAGS} <> '' THEN '[visual: ' || {_TAGS} || ']' END, CASE WHEN page_id % 5 = 0 THEN '[contains QR code]' END], lambda x: x <> ''), chr(10)) AS text FROM ocr", _OCR)
def c29(v):
    read = v["pages"].select("page_id", md.clean_ocr_tokens(F.col("html"))["text"].alias("text"), F.filter(F.array(F.expr(_TAGS)), lambda x: x != "").alias("tags"))
    return read.select("page_id", md.image_text(F.col("text"), F.col("tags"), F.col("page_id") % 5 == 0).alias("text"))


@query(
    "c30_voice_prosody",
    doubles("""SELECT media_id, len(list_filter(string_split(transcript, ' '), lambda x: x <> '')) AS word_count, CASE WHEN voiced > 1 THEN round(len(list_filter(string_split(transcript, ' '), lambda x: x <> '')) / (voiced / 60.0), 1) ELSE 0.0 END AS wpm,
    CASE WHEN duration_s > 0 THEN round(voiced / duration_s, 3) ELSE 0.0 END AS speech_ratio, avg_logprob FROM (
    SELECT conv_id AS media_id, trim(regexp_replace(string_agg(trim(text, ' '), ' ' ORDER BY turn), '\\s+', ' ', 'g')) AS transcript, sum(2.0 + turn % 3) AS voiced, sum(4.0 + turn % 3) AS duration_s, round(avg(-0.125 * (turn % 4)), 3) AS avg_logprob FROM conversations GROUP BY conv_id)"""),
)
def c30(v):
    turns = v["conversations"].select(F.col("conv_id").alias("media_id"), F.col("turn").alias("at"), F.lit(0.0).alias("start_s"), (2.0 + F.col("turn") % 3).alias("end_s"), "text", (-0.125 * (F.col("turn") % 4)).alias("logprob"), F.lit(0.0).alias("no_speech"))
    durations = v["conversations"].groupBy(F.col("conv_id").alias("media_id")).agg(F.sum(4.0 + F.col("turn") % 3).alias("duration_s"))
    return md.voice_prosody(turns, durations).select("media_id", F.col("word_count").cast("long").alias("word_count"), "wpm", "speech_ratio", "avg_logprob")


@query("c31_modality", "SELECT message_id, modality FROM content", CONTENT_CTE)
def c31(v):
    return content.with_media(v["messages"], v["media"]).select("message_id", "modality")


@query("w05_topn_distinct", "SELECT user_id, array_to_string(list_slice(list_sort(list_distinct(list(event_type))), 1, 3), '|') AS kinds FROM events GROUP BY user_id")
def w05(v):
    return v["events"].groupBy("user_id").agg(F.collect_set("event_type").alias("k")).select("user_id", F.array_join(t.distinct_top(F.col("k"), 3), "|").alias("kinds"))
