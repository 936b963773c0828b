"""Column functions on literal texts."""

import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quietwire.functions import derive as d
from quietwire.functions import text as t
from quietwire.functions.lexicons import LEXICONS
from quietwire.operators.decide import parse_verdict
from quietwire.plans import driver_views

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "term", "hit"),
    [
        ("the supervisor email address", "emi", False), ("your emi is due", "emi", True), ("a cashier counter", "cash", False),
        ("your orders shipped", "order", True), ("we are offering a deal", "offer", True), ("flat 50% off today", "% off", True),
    ],
)
def test_term_hits(spark, text, term, hit):
    assert one(spark, t.term_hits(F.col("v"), (term,)), v=text) == ([term] if hit else [])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Share your 0TP now or acc0unt blocked", "share your otp now or account blocked"),
        ("S H A R E  your O T P  n o w", "share  your otp  now"),
        ("pay 499 by 6 pm", "pay 499 by 6 pm"),
        ("", ""),
    ],
)
def test_deobfuscate(spark, text, expected):
    assert one(spark, t.deobfuscate(F.col("v")), v=text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Please share your OTP to avoid account closure.", True), ("We will never ask for your OTP.", False),
        ("We never ask for OTP. Now send your OTP quickly.", True), ("hello", False), ("", False),
        ("Please send the form, then we never give pin", True),  # one match, from "send", and nothing before it
    ],
)
def test_active_credential_demand(spark, text, expected):
    assert one(spark, t.active_credential_demand(F.col("v")), v=text) is expected


def test_normalize(spark):
    raw = "  Ｈｅｌｌｏ​\tworld‮ \x00  x  "
    assert one(spark, t.normalize_text(F.col("v")), v=raw) == "Hello world \x00 x"
    assert one(spark, t.normalize_keep_spacing(F.col("v")), v="a   b ") == "a   b"
    assert one(spark, t.normalize_text(F.col("v")), v=None) == ""


def test_time_pressure_looks_ahead(spark):
    assert one(spark, t.time_pressure_hits(F.col("v")), v="Now that we met, call me NOW") == ["now"]
    assert one(spark, t.time_pressure_hits(F.col("v")), v="nothing here") == []


@pytest.mark.parametrize(
    ("window", "at", "quiet"),
    [("22:00-07:00", "2026-08-01 23:30:00", True), ("22:00-07:00", "2026-08-01 03:00:00", True), ("22:00-07:00", "2026-08-01 12:00:00", False), ("soon", "2026-08-01 12:00:00", False), ("", None, False)],
)
def test_quiet_hours(spark, window, at, quiet):
    assert one(spark, d.quiet_hours(F.col("w"), F.col("a").cast("timestamp")), w=window, a=at) is quiet


@pytest.mark.parametrize(
    ("raw", "action", "kind"),
    [
        ('{"action":"mute","message_type":"scam","note":"ok"}', "mute", "scam"), ('noise {"action":"digest"} tail', "digest", ""),
        ('{"action":"NOTIFY_NOW"}', None, None), ("not json at all", None, None), ('{"action":"digest","message_type":"weird"}', "digest", ""),
    ],
)
def test_parse_verdict(spark, raw, action, kind):
    found = one(spark, parse_verdict(F.col("v")), v=raw)
    assert (found and found.action, found and found.message_type) == (action, kind)


def test_affinity_values(spark):
    counts = spark.createDataFrame([(32, 19, 14, 14, 13, 13, 2), (11, 8, 1, 1, 3, 3, 3), (17, 12, 11, 11, 5, 5, 3), (2, 2, 1, 1, 0, 0, 0), (3, 0, 0, 0, 3, 3, 1), (0, 0, 0, 0, 0, 0, 0)], "seen int, opened int, replied int, fast int, dismissed int, muted int, reported int")
    got = [r.x for r in counts.select(d.affinity(*[F.col(c) for c in counts.columns]).alias("x")).collect()]
    assert got == [0.099, -0.242, 0.225, 0.551, -0.699, 0.0]


@pytest.mark.parametrize(("official", "used", "mismatch", "lookalike"), [("amazon.in", "amazonpay-delivery.in", True, True), ("thrillophilia.com", "link.wame.pro", True, False), ("", "x.in", False, False), ("a.in", "a.in", False, False)])
def test_domains(spark, official, used, mismatch, lookalike):
    assert one(spark, d.domain_mismatch(F.col("o"), F.col("u")), o=official, u=used) is mismatch
    assert one(spark, d.lookalike_domain(F.col("o"), F.col("u")), o=official, u=used) is lookalike


def test_mentions_phones_and_dates_of_all_texts(spark):
    from quietwire.plans import text_queries

    rows = [(1, "ask @u_7 on 05/06/2024"), (2, "für @Ünal, @bob: 12 mar – 9876543210 — 1/2/25"), (3, None), (4, "日本 @a_1")]
    found = {"documents": spark.createDataFrame(rows, "doc_id long, text string")}
    mentions = {r.doc_id: set(r.mentions.split("|")) if r.mentions else set() for r in text_queries.c10(found).collect()}
    dates = {r.doc_id: (r.phones, set(r.dates.split("|")) if r.dates else set()) for r in text_queries.c11(found).collect()}
    assert set(mentions) == set(dates) == {1, 2, 3, 4}
    assert "bob" in mentions[2] and mentions[4] == {"a_1"}
    assert dates[2] == ("9876543210", {"12 mar", "1/2/25"}) and dates[1] == ("", {"05/06/2024"})


def test_lexicons_by_runs_equal_patterns(spark):
    rng = random.Random(3)
    words = [w for terms in LEXICONS.values() for term in rng.sample(terms, 6) for w in term.split(" ")] + ["and", "ordering", "bills", "naïve", "日本", "x_y"]
    texts = ["", " ", "one"] + ["".join(rng.choice(words) + rng.choice(["", "", "s", "ed", "ing", "es"]) + rng.choice([" ", " ", " ", "  ", ", ", "-", "\n", "."]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    texts += [f"so {term}{ending} it is" for terms in LEXICONS.values() for term in terms for ending in ("", "s")]
    df = spark.createDataFrame([(i, x.lower()) for i, x in enumerate(texts)], "i long, low string")
    df = df.withColumn("words", t.words_apart(F.col("low"))).withColumn("runs", t.word_runs(F.col("words"))).withColumn("places", t.lexicon_places(F.col("runs"), tuple(LEXICONS)))
    names = ("promo", "greeting", "event", "commerce", "marketplace", "deescalation")
    rows = df.select("low", *[t.lexicon_hits(F.col("places"), F.col("low"), n).alias(n) for n in names], *[t.term_hits(F.col("low"), LEXICONS[n]).alias(f"plain_{n}") for n in names]).collect()
    assert sum(len(r[n]) for r in rows for n in names) > 300
    assert all(r[n] == r[f"plain_{n}"] for r in rows for n in names)


# the queries that no SQL expresses, against plain Python over all that is said and written

ODD = [
    "", " \t x  y\u200b\u202ez\u3000 ", "\uff33\uff48are your \uff2fTP now\ufb01", "O T P  and p i n 0f acc0unt p4$$word 13 x1", "S H A R E the C V V", "we will never ask you to share your otp. Send the pin to me", "please don't, but tell me your password; never",
    "call in 20 minutes or by 5 pm, not now that it rains, NOW", "Next Monday tonight TODAY today within the next 3 hrs 12:30pm", "\u00e9n\u00e9rgie  \u0130STANBUL \u00df na\u00efve", "share otp share pin", "a b c d e\nf g h",
]


def said(spark):
    if os.path.isdir(SF):
        return driver_views.views(spark, SF)["said"].select(F.col("message_text").alias("text")).union(spark.createDataFrame([(x,) for x in ODD], "text string"))
    return spark.createDataFrame([(x,) for x in ODD], "text string")


def plain_kept(text):
    return re.sub(t.INVISIBLE, "", unicodedata.normalize("NFKC", text)).strip()


def plain_read(text):
    joined = re.sub(t.LETTERS_APART, lambda m: m[0].replace(" ", ""), text.lower())
    return re.sub(t.DIGITS_AS_LETTERS, lambda m: m[0].translate(str.maketrans(t.LEET_FROM, t.LEET_TO)), joined)


def plain_demand(text):
    for clause in re.split(t.CLAUSE_END, text):
        for m in re.finditer(t.CREDENTIAL_DEMAND, clause, re.I):
            if not re.search(t.NEGATION, clause[max(0, m.start() - 30) : m.start()], re.I):
                return True
    return False


@pytest.mark.parametrize(
    ("column", "plain"),
    [
        (t.normalize_text, lambda x: re.sub(r"[ \t]+", " ", re.sub(t.INVISIBLE, "", unicodedata.normalize("NFKC", x))).strip()),
        (t.normalize_keep_spacing, plain_kept),
        (t.deobfuscate, plain_read),
        (lambda c: F.array_join(t.time_pressure_hits(c), "|"), lambda x: "|".join(sorted({m[0].lower() for m in re.finditer(t.TIME_PRESSURE, x, re.I)})[:8])),
        (t.active_credential_demand, plain_demand),
    ],
    ids=["c01", "c02", "c03", "c12", "c15"],
)
def test_texts_equal_plain_python(spark, column, plain):
    rows = said(spark).select("text", column(F.col("text")).alias("got")).collect()
    assert len(rows) >= len(ODD)
    assert [r for r in rows if r.got != plain(r.text)] == []
