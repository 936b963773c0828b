"""Texts: normalisation, lexicon hits, extracted entities and phrase patterns.

Patterns carry (?U) so that case and word characters follow Unicode.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwire.functions.lexicons import INJECTION_PATTERNS, LEXICONS, STOP_WORDS, SUSPICIOUS_TLDS, URL_SHORTENERS

# Patterns of entities and phrases.
INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2066-\u2069]"
URL = r"\b((?:https?://)?(?:[a-z0-9][a-z0-9\-]{0,62}\.)+[a-z]{2,24}(?:/[^\s]*)?)\b"
AMOUNT = r"(?:rs\.?|inr|₹|\$)\s?[\d,]+(?:\.\d{1,2})?"
PHONE = r"\b(?:\+?\d{1,3}[\s-]?)?\d{10}\b"
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DATE = rf"\b(\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{2,4}}|\d{{1,2}}\s+{MONTH}[a-z]*|{MONTH}[a-z]*\s+\d{{1,2}})\b"
MENTION = r"@(u_\d+|\w+)"
TIME_PRESSURE = (
    r"\b(today|tonight|this (?:morning|afternoon|evening)|tomorrow|now(?!\s+that)"
    r"|within (?:the )?next \d+ ?(?:min|minutes|hours?|hrs?)|in (?:the )?next \d+ ?(?:min|minutes|hours?|hrs?)"
    r"|within \d+ ?(?:min|minutes|hours?|hrs?)|by \d{1,2}(?::\d{2})? ?(?:am|pm)?|before \d{1,2}(?::\d{2})?"
    r"|\d{1,2}:\d{2} ?(?:am|pm)?|next \d+ ?(?:min|minutes|hours?)|in the next"
    r"|(?:next |this )?(?:mon|tues|wednes|thurs|fri|satur|sun)day|next week|this weekend)\b"
)
DIRECT_REQUEST = (
    r"\b(can you|could you|please (?:call|send|share|confirm|check|join|reply|come|bring|pay)"
    r"|pls (?:call|send|share|confirm|check|join|reply|come)|let me know|need you to|waiting for your"
    r"|are you (?:free|available|around|still)|do you have|would you|will you|reply once|confirm before"
    r"|send me|call me|ping me|join the|revert)\b"
)
OPT_OUT = r"\b(reply stop|unsubscribe|opt out|stop to unsubscribe)\b"
PAY_AMOUNT = r"\b(pay|send|transfer|deposit|remit)\b[^.!?;\n]{0,25}?(?:rs\.?|inr|₹|\$)?\s?\d{2,}(?:[,.]\d+)*"
QR_PAYMENT = r"\b(scan|scanning)\b[^.!?;\n]{0,40}?\b(qr|code|barcode)\b|\bqr\b[^.!?;\n]{0,30}?\b(pay|payment|send)\b"
NEGATED_CREDENTIAL = (
    r"\b(never|do not|don'?t|will not|won'?t|no ?one (?:will|should)|nobody|avoid|refrain from)\b"
    r"[^.!?]{0,60}?\b(ask|share|disclose|reveal|give|send|provide|tell)\b"
    r"[^.!?]{0,60}?\b(otp|pin|password|cvv|card|credential|details)\b"
)
NO_CREDENTIAL_NEEDED = (
    r"\b(no|not|never|without)\b[^.!?;\n]{0,45}?"
    r"\b(otp|pin|password|cvv|payment|card details|bank details|verification)\b"
    r"[^.!?;\n]{0,35}?\b(required|needed|necessary|asked|requested|involved)\b"
)
CREDENTIAL_DEMAND = (
    r"\b(share|send|provide|confirm|enter|give|tell|reply with|forward|submit|ask for|verify with)\b"
    r"[^.!?;\n]{0,50}?\b(otp|pin|password|cvv|card number|card details|bank details|"
    r"account details|login code|verification code|security code|credential)"
)
NEGATION = r"\b(never|not|don'?t|won'?t|cannot|can'?t|no ?one|nobody|avoid|refrain)\b"
CLAUSE_END = r"[.!?;\n]+"
LETTERS_APART = r"\b(?:[A-Za-z]\s){2,}[A-Za-z]\b"
DIGITS_AS_LETTERS = r"(?<=[A-Za-z])[013457@$]+(?=[A-Za-z])|\b[013457@$]+(?=[A-Za-z]{2,})"
LEET_FROM, LEET_TO = "013457@$", "oieastas"

#: Around spans to be rewritten; private-use characters that no text has after they are removed.
_OPEN, _CLOSE = "\ue000", "\ue001"


def unicode_pattern(pattern: str) -> str:
    return "(?iU)" + pattern


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """NFKC. Only texts beyond ASCII travel to Python with their characters; the others stay as they are."""
    foreign = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_nfkc(foreign), text)


def _python_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_keep_spacing(text: Column) -> Column:
    """NFKC without invisible and direction characters; runs of spaces stay, since word gaps matter to C03."""
    return _python_strip(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), INVISIBLE, ""))


def normalize_text(text: Column) -> Column:
    """As C02, with runs of spaces and tabs made one space."""
    return _python_strip(F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), INVISIBLE, ""), r"[ \t]+", " "))


def _rewrite(text: Column, pattern: str, change) -> Column:
    """Apply ``change`` to every match: mark the matches, split at the marks, change every second part."""
    marked = F.regexp_replace(text, f"(?U)({pattern})", f"{_OPEN}$1{_OPEN}")
    parts = F.split(marked, _OPEN)
    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, change(part)).otherwise(part)), "")


def deobfuscate(text: Column) -> Column:
    """Lower case; spaced-out letters joined; digits and signs read as letters, only beside letters."""
    low = F.lower(F.translate(text, _OPEN, ""))
    joined = _rewrite(low, LETTERS_APART, lambda part: F.replace(part, F.lit(" "), F.lit("")))
    return _rewrite(joined, DIGITS_AS_LETTERS, lambda part: F.translate(part, LEET_FROM, LEET_TO))


def term_pattern(term: str) -> str:
    """Whole words: a boundary only beside a letter or digit, with usual endings after the last one."""
    left = r"\b" if term[0].isalnum() else ""
    right = r"(?:s|es|ed|ing)?\b" if term[-1].isalnum() else ""
    return left + re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", term) + right


def term_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that stand in a text, in the order given. One alternation decides whether any is looked for."""
    patterns = [unicode_pattern(term_pattern(t)) for t in terms]
    any_of = unicode_pattern("|".join(f"(?:{term_pattern(t)})" for t in terms))
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in zip(terms, patterns, strict=True)]))
    return F.when(text.rlike(any_of), found).otherwise(F.array().cast("array<string>"))


#: Endings that a term may take after a last letter or digit.
ENDINGS = ("", "s", "es", "ed", "ing")
_WORDS_ONLY = re.compile(r"\w+(?: \w+)*")
#: Words of the longest term that is words with a space between them. Such terms are looked up among a text's runs of words.
LONGEST_TERM = max(term.count(" ") + 1 for terms in LEXICONS.values() for term in terms if _WORDS_ONLY.fullmatch(term))


def words_apart(low: Column) -> Column:
    """The words of a lower-cased text; "|" stands between two words with anything but one space between them."""
    return F.array_remove(F.split(F.regexp_replace(low, r"(?U)[^\w]{2,}|[^\w ]", " | "), " "), "")


def word_runs(words: Column) -> Column:
    """The distinct runs of 1 to LONGEST_TERM words. ``words`` is a column of its own, or it would be worked out for every run."""

    def runs(k: int) -> Column:
        whole = F.transform(words, lambda x, i: F.when(i + k <= F.size(words), F.array_join(F.slice(words, i + 1, F.lit(k)), " ")))
        return F.slice(whole, F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(0)))

    return F.array_distinct(F.concat(words, *[runs(k) for k in range(2, LONGEST_TERM + 1)]))


def _places(lexicons: tuple[str, ...]) -> Column:
    """Map from every form of a term to the (lexicon, place in it) that it stands for: one constant, however many terms there are."""
    forms: dict[str, list[dict]] = {}
    for name in lexicons:
        for i, term in enumerate(LEXICONS[name]):
            if _WORDS_ONLY.fullmatch(term):
                for ending in ENDINGS:
                    forms.setdefault(term + ending, []).append({"lexicon": name, "at": i})
    return F.from_json(F.lit(json.dumps(forms)), "map<string,array<struct<lexicon:string,at:int>>>")


def lexicon_places(runs: Column, lexicons: tuple[str, ...]) -> Column:
    """(lexicon, place) of the terms of ``lexicons`` that are words and stand in a text with these word runs."""
    table = _places(lexicons)
    return F.flatten(F.transform(F.array_intersect(F.map_keys(table), runs), lambda form: F.element_at(table, form)))


def lexicon_hits(places: Column, low: Column, lexicon: str) -> Column:
    """The terms of a lexicon that stand in a text, in the order of the lexicon; terms with signs are looked for in the text itself."""
    terms = LEXICONS[lexicon]
    found = F.transform(F.filter(places, lambda x: x["lexicon"] == lexicon), lambda x: x["at"])
    signs = [F.when(low.rlike(unicode_pattern(term_pattern(t))), F.lit(i)) for i, t in enumerate(terms) if not _WORDS_ONLY.fullmatch(t)]
    if signs:
        found = F.concat(found, F.array_compact(F.array(*signs)))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda i: F.element_at(F.from_json(F.lit(json.dumps(terms)), "array<string>"), i + 1))


def injection_hits(text: Column) -> Column:
    """C17: numbers of the patterns met, from 0."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), F.lit(i)) for i, p in enumerate(INJECTION_PATTERNS)]))


def distinct_top(found: Column, n: int) -> Column:
    """Sorted, distinct, the first n."""
    return F.slice(F.array_sort(F.array_distinct(found)), 1, n)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode_pattern(pattern if group or "(" in pattern else f"({pattern})")), group)


def extract_urls(text: Column) -> Column:
    """C07."""
    return distinct_top(F.transform(_all(text, URL, 1), lambda u: F.rtrim(F.lower(u), F.lit(".,"))), 10)


def domain_of(url: Column) -> Column:
    return F.trim(F.split_part(F.regexp_replace(F.trim(F.lower(url)), "^https?://", ""), F.lit("/"), F.lit(1)))


def extract_domains(urls: Column) -> Column:
    """From extracted links."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(urls, domain_of), lambda d: d != "")))


def extract_amounts(text: Column) -> Column:
    """C09."""
    return distinct_top(_all(text, AMOUNT, 0), 8)


def extract_mentions(text: Column) -> Column:
    """C10."""
    return distinct_top(_all(text, MENTION, 1), 10)


def mentions_user(mentions: Column, user_id: Column) -> Column:
    return F.exists(mentions, lambda m: F.lower(m) == F.lower(user_id))


def extract_phones(text: Column) -> Column:
    """C11."""
    return distinct_top(_all(text, PHONE, 0), 5)


def extract_dates(text: Column) -> Column:
    """C11."""
    return distinct_top(_all(text, DATE, 1), 6)


def time_pressure_hits(text: Column) -> Column:
    """C12."""
    return distinct_top(F.transform(_all(text, TIME_PRESSURE, 0), F.lower), 8)


def is_same_day(hits: Column) -> Column:
    now = ("today", "tonight", "now", "this morning", "this afternoon", "this evening")
    return F.exists(hits, lambda h: h.isin(*now) | h.rlike("^(in |within |by |before |next )"))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(unicode_pattern(pattern))


def active_credential_demand(text: Column) -> Column:
    """A clause demands a secret, with no negation in the 30 characters before the demand.

    Demands are taken left to right without overlap, so each clause is cut at its demands: the marks stand before a match
    and after it, and what precedes a mark is what precedes the demand.
    """
    def demanded(clause: Column) -> Column:
        parts = F.split(F.regexp_replace(F.translate(clause, _OPEN + _CLOSE, ""), unicode_pattern(f"({CREDENTIAL_DEMAND})"), f"{_OPEN}$1"), _OPEN)
        before = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "")
        return (F.size(parts) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (i < F.size(parts)) & ~has(F.right(before(i), F.lit(30)), NEGATION))

    return F.exists(F.split(text, CLAUSE_END), demanded)


def is_advisory(combined: Column, advisory_hits: Column, payment_demand_hits: Column, active_demand: Column) -> Column:
    """C16."""
    framed = has(combined, NEGATED_CREDENTIAL) | has(combined, NO_CREDENTIAL_NEEDED) | (F.size(advisory_hits) > 0)
    return framed & ~active_demand & (F.size(payment_demand_hits) == 0)


def suspicious_host(domains: Column) -> Column:
    """C18."""
    return F.exists(domains, lambda d: d.rlike("(" + "|".join(re.escape(t) for t in SUSPICIOUS_TLDS) + ")$"))


def shortened_link(domains: Column) -> Column:
    return F.exists(domains, lambda d: d.rlike("|".join(re.escape(s) for s in URL_SHORTENERS)))


def non_latin_ratio(text: Column) -> Column:
    """C21."""
    letters = F.char_length(F.regexp_replace(text, r"\P{L}", ""))
    latin = F.char_length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.round(1 - latin / letters, 3))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))


def needs_fallback(text: Column, hit_count: Column) -> Column:
    """C22."""
    return (word_count(text) >= 3) & ((non_latin_ratio(text) >= 0.3) | (hit_count == 0))


def tokenize(text: Column) -> Column:
    """Distinct topic words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), 1)
    return F.array_distinct(F.filter(F.array_except(tokens, F.array(*map(F.lit, STOP_WORDS))), lambda t: F.char_length(t) > 1))


def combine(text: Column, media_text: Column) -> Column:
    """Both, blanks skipped."""
    return F.array_join(F.filter(F.array(text, media_text), lambda x: x != ""), "\n")


def topic_bucket(text: Column, forwarded: Column) -> Column:
    """The first group of substrings that is met."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Substrings by topic, in order.
    groups = (
        ("security_prompt", "otp|verify|blocked|kyc|password|pin"),
        ("promotion", "off|sale|offer|discount|cashback|deal|coupon"),
        ("logistics", "order|delivery|shipped|tracking|dispatch"),
        ("event", "meeting|appointment|booking|circular|trip|event|class"),
        ("greeting", "good morning|blessed|stay positive|god bless"),
        ("payment", "bill|due|payment|emi|statement|maintenance"),
    )
    chain = F
    for topic, words in groups:
        chain = chain.when(low.rlike(words), topic)
    return chain.when(forwarded >= 3, "forward").otherwise("other")
