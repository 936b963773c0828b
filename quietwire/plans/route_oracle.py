"""The routing in DuckDB's SQL, as common table expressions over the shared views: the oracle of the routing queries.

Written for the template texts, which need no Unicode folding and hold no obfuscated words.
"""

from __future__ import annotations

import re

from quietwire.config import OPERATIONAL_GROUPS, SCHOOL_GROUPS, WORK_GROUPS
from quietwire.functions import text as t
from quietwire.functions.lexicons import BRAND_TOKENS, INJECTION_PATTERNS, LEXICONS, SUSPICIOUS_TLDS, URL_SHORTENERS
from quietwire.operators.content import CAPTION, COUNTED
from quietwire.operators.rationale import ORDERED
from quietwire.operators.safety import BAIT, LOOKALIKE, SALUTATION
from quietwire.operators.scoring import GROUP_PRIOR, IMPORTANCE, TOPIC_OF_TYPE
from quietwire.plans.base_queries import CONTACT_SQL, FATIGUE_SQL, PROFILE_CTE, SHARED_SQL


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def doubles(sql: str) -> str:
    """Decimal literals as doubles, as they are in the plans."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


def hits(column: str, terms: tuple[str, ...]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({column}, {lit(t.term_pattern(x))}) THEN {lit(x)} END" for x in terms)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit('(?i)' + pattern)})"


def some(*lexicons: str) -> str:
    return "(" + " OR ".join(f"n_{x} > 0" for x in lexicons) + ")"


def names(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def case_of(table: dict, column: str, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else repr(float(v))}" for k, v in table.items()) + f" ELSE {default} END"


_FOUND = ",\n".join(
    [f"{hits('low', terms)} AS {name}_hits" for name, terms in LEXICONS.items()]
    + [f"{hits('caption', LEXICONS[name])} AS caption_{name}_hits" for name in CAPTION]
    + [
        "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {lit(p)}) THEN {i} END" for i, p in enumerate(INJECTION_PATTERNS)) + "], lambda x: x IS NOT NULL) AS injection_hits",
        f"list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(combined, {lit('(?i)' + t.TIME_PRESSURE.replace('now(?!\\s+that)', 'now'))}), lambda x: lower(x)))), 1, 8) AS time_hits",
        f"list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(combined, {lit('(?i)' + t.URL)}, 1), lambda x: rtrim(lower(x), '.,')))), 1, 10) AS urls",
        f"list_slice(list_sort(list_distinct(regexp_extract_all(combined, {lit('(?i)' + t.MENTION)}, 1))), 1, 10) AS mentions",
        f"{matches('combined', t.DIRECT_REQUEST)} AS direct_request",
        "contains(combined, '?') AS question",
        f"{matches('combined', t.OPT_OUT)} AS opt_out_footer",
        f"{matches('combined', t.PAY_AMOUNT)} AS demands_amount",
        f"{matches('combined', t.QR_PAYMENT)} AS qr_payment",
        f"len(list_filter(string_split_regex(combined, '[.!?;\\n]+'), lambda x: {matches('x', t.CREDENTIAL_DEMAND)} AND NOT {matches('right(regexp_extract(x, ' + lit('(?is)^(.*?)' + t.CREDENTIAL_DEMAND) + ', 1), 30)', t.NEGATION)})) > 0 AS active_demand",
        f"{matches('combined', t.NEGATED_CREDENTIAL)} OR {matches('combined', t.NO_CREDENTIAL_NEEDED)} AS framed",
        "len(list_filter(string_split_regex(combined, '\\s+'), lambda x: x <> '')) AS word_count",
    ]
)
_COUNTS = ", ".join(f"len({n}_hits) AS n_{n}" for n in (*LEXICONS, *(f"caption_{c}" for c in CAPTION), "injection", "time"))

CONTENT_CTE = f"""
texts AS (
  SELECT m.*, trim(regexp_replace(m.message_text, '[ \\t]+', ' ', 'g')) AS text, coalesce(x.media_text, '') AS media_text, coalesce(x.layout, '') AS layout, coalesce(x.has_qr, false) AS has_qr,
    coalesce(x.duration_s, 0) AS duration_s, coalesce(x.wpm, 0) AS wpm, CASE WHEN m.media_type = '' THEN 'text' ELSE m.media_type END AS modality
  FROM messages m LEFT JOIN media x ON m.media_type = x.media_type AND m.media_id = x.media_id),
joined_texts AS (SELECT *, array_to_string(list_filter([text, media_text], lambda x: x <> ''), chr(10)) AS combined FROM texts),
lowered AS (SELECT *, lower(combined) AS low, CASE WHEN text <> '' THEN lower(text) ELSE lower(combined) END AS caption FROM joined_texts),
found AS MATERIALIZED (SELECT *, {_FOUND} FROM lowered),
counted_hits AS (SELECT *, {_COUNTS}, list_sort(list_distinct(list_filter(list_transform(urls, lambda x: trim(split_part(regexp_replace(x, '^https?://', ''), '/', 1))), lambda x: x <> ''))) AS domains FROM found),
content AS MATERIALIZED (SELECT *, {' + '.join(f'n_{c}' for c in COUNTED)} + n_time AS lexicon_hit_count, combined = '' AS is_empty,
  len(list_filter(mentions, lambda x: lower(x) = lower(user_id))) > 0 AS mentions_user,
  len(list_filter(domains, lambda x: {' OR '.join(f"ends_with(x, {lit(s)})" for s in SUSPICIOUS_TLDS)})) > 0 AS suspicious_host,
  len(list_filter(domains, lambda x: {' OR '.join(f"contains(x, {lit(s)})" for s in URL_SHORTENERS)})) > 0 AS shortened_link,
  len(list_filter(time_hits, lambda x: x IN ('today', 'tonight', 'now', 'this morning', 'this afternoon', 'this evening') OR regexp_matches(x, '^(in |within |by |before |next )'))) > 0 AS same_day,
  (framed OR n_advisory > 0) AND NOT active_demand AND n_payment_demand = 0 AS advisory
  FROM counted_hits)"""

_MISMATCH = "(b.business_id IS NOT NULL AND official_domain <> '' AND used_domain <> '' AND official_domain <> used_domain)"
KNOWN_CTE = f"""
contact AS ({CONTACT_SQL}), shared AS ({SHARED_SQL}),
known AS MATERIALIZED (SELECT c.*, CASE coalesce(u.dnd_window, '') WHEN '22:00-07:00' THEN hour(created_at) >= 22 OR hour(created_at) < 7 WHEN '13:00-15:30' THEN hour(created_at) * 60 + minute(created_at) BETWEEN 780 AND 929 ELSE false END AS quiet,
  coalesce(g.group_type, '') AS group_type, b.business_id IS NOT NULL AS has_biz, coalesce(b.verified, false) AS biz_verified, coalesce(official_domain, '') AS official_domain, b.account_age_days, b.domain_age_days, b.reports_30d AS biz_reports, b.sent_30d AS biz_sent,
  coalesce({_MISMATCH}, false) AS mismatch,
  coalesce({_MISMATCH} AND length(split_part(official_domain, '.', 1)) >= 3 AND contains(replace(replace(used_domain, '-', ''), '_', ''), split_part(official_domain, '.', 1)), false) AS lookalike,
  a.user_id IS NOT NULL AS is_member, a.role AS mem_role, a.read_30d AS mem_read, a.replies_30d AS mem_replies, a.dismissed_30d AS mem_dismissed, a.muted AS mem_muted, s.user_id IS NOT NULL AS snd_member, coalesce(s.role = 'admin', false) AS sender_admin,
  r.user_id IS NOT NULL AS has_rel, lower(coalesce(r.why, '')) AS why, coalesce(r.activity_180d > 0 OR r.replied_30d > 0, false) AS rel_active, coalesce(r.opted_out_at IS NOT NULL OR NOT r.allows_promotions, false) AS opted_out,
  coalesce(r.dismissed_30d >= 3 AND r.opened_30d <= 1, false) AS rel_ignored, coalesce(r.replied_30d, 0) AS rel_replied, is_stranger, is_cold, shares_work
  FROM content c LEFT JOIN users u ON c.user_id = u.user_id LEFT JOIN groups g ON c.group_id = g.group_id LEFT JOIN businesses b ON c.business_id = b.business_id
  LEFT JOIN group_members a ON c.group_id = a.group_id AND c.user_id = a.user_id LEFT JOIN group_members s ON c.group_id = s.group_id AND c.sender_user_id = s.user_id
  LEFT JOIN relationships r ON c.user_id = r.user_id AND c.business_id = r.business_id JOIN contact USING (message_id) JOIN shared USING (message_id))"""


def add(*parts: tuple[str, str]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0.0 END" for c, v in parts)


_PRESSED = some("credential", "account_threat")
_HOSTLIKE = f"len(list_filter(domains, lambda x: {matches('x', LOOKALIKE)})) > 0"
_BRANDS = "(" + " OR ".join(f"contains(low, {lit(x)})" for x in BRAND_TOKENS) + ")"
_UNDER = add(
    ("mismatch AND lookalike", "0.72"), ("mismatch AND NOT lookalike AND NOT biz_verified", "0.18"), ("mismatch AND NOT biz_verified", "0.10"), ("mismatch AND account_age_days < 90", "0.20"),
    ("mismatch AND domain_age_days > 0 AND domain_age_days < 60", "0.15"), ("mismatch AND biz_reports >= 25", "0.15"),
)
_LINK = {
    "suspicious_tld": ("suspicious_host", "0.20"), "shortened_link": ("shortened_link", "0.16"), "phishing_link_flow": (f"len(urls) > 0 AND {_PRESSED}", "0.28"), "payment_link_flow": ("len(urls) > 0 AND n_payment_demand > 0", "0.24"),
    "obscured_link_pressure": (f"shortened_link AND {some('account_threat', 'urgency')}", "0.24"), "payment_qr_risk": (f"(has_qr OR qr_payment) AND ({some('payment_demand', 'account_threat')} OR demands_amount)", "0.26"),
    "offbrand_link": ("mismatch AND official_domain <> '' AND len(list_filter(domains, lambda x: NOT contains(x, official_domain))) > 0", "0.10"),
}
_WINDFALL = some("windfall", "refund_bait", "prize")
_DEMANDED = "(n_payment_demand > 0 OR demands_amount)"
_SCAM = add(
    ("n_credential > 0 AND NOT advisory", "(CASE WHEN n_credential = 1 THEN 0.62 ELSE 0.74 END)"), ("n_account_threat > 0 AND NOT advisory", "(0.34 + 0.08 * least(2, n_account_threat - 1))"),
    (f"n_impersonation > 0 AND NOT advisory AND {_PRESSED}", "0.14"), (_DEMANDED, f"(0.34 + CASE WHEN {_PRESSED} THEN 0.14 ELSE 0.0 END + CASE WHEN {_WINDFALL} THEN 0.30 ELSE 0.0 END)"),
    ("n_translit_risk > 0", "(0.34 + 0.12 * least(2, n_translit_risk - 1))"), ("n_refund_bait > 0", f"(0.20 + CASE WHEN {some('credential', 'payment_demand')} THEN 0.30 ELSE 0.0 END)"),
    ("n_prize > 0", "0.62"), ("n_investment > 0", "(0.58 + CASE WHEN n_investment > 1 THEN 0.12 ELSE 0.0 END)"), ("link_risk > 0", "link_risk"), ("impersonation >= 0.4", "0.18"),
)
_SPAM = add(
    ("n_promo > 0", "0.34 * least(1.0, n_promo / 4.0)"), ("opt_out_footer", "0.16"), ("has_biz AND NOT has_rel", "0.22"), ("has_biz AND opted_out", "0.34"), ("has_biz AND rel_ignored", "0.20"),
    ("has_biz AND biz_reports >= 8", "0.12"), ("has_biz AND biz_sent >= 2000", "0.06"), (f"forwarded_count >= 3 AND {some('promo', 'forward')}", "0.18"), ("forwarded_count >= 12", "0.22"),
)
_THREATS = [
    ("credential_request", "n_credential > 0 AND NOT advisory"), ("account_threat_pressure", "n_account_threat > 0 AND NOT advisory"), ("fake_support_identity", f"n_impersonation > 0 AND NOT advisory AND {_PRESSED}"),
    ("advance_fee_pattern", f"{_DEMANDED} AND {_WINDFALL}"), ("payment_demand", _DEMANDED), ("transliterated_fraud_language", "n_translit_risk > 0"), ("refund_bait", "n_refund_bait > 0"), ("prize_bait", "n_prize > 0"),
    ("investment_fraud", "n_investment > 0"), *[(k, c) for k, (c, _) in _LINK.items()], ("brand_impersonation", "impersonation >= 0.4"), ("first_contact_sender", "scam_base > 0 AND is_cold"), ("router_prompt_injection", "n_injection > 0"),
]
_SIGNALS = [
    ("safety_advisory", "advisory", "1.0"), ("credential", "n_credential > 0 AND NOT advisory", "CASE WHEN n_credential = 1 THEN 0.62 ELSE 0.74 END"), ("account_threat", "n_account_threat > 0 AND NOT advisory", "0.34 + 0.08 * least(2, n_account_threat - 1)"),
    ("fake_support", f"n_impersonation > 0 AND NOT advisory AND {_PRESSED}", "0.14"), ("payment_demand", _DEMANDED, f"0.34 + CASE WHEN {_PRESSED} THEN 0.14 ELSE 0.0 END + CASE WHEN {_WINDFALL} THEN 0.30 ELSE 0.0 END"),
    ("translit_risk", "n_translit_risk > 0", "0.34 + 0.12 * least(2, n_translit_risk - 1)"), ("refund_bait", "n_refund_bait > 0", f"0.20 + CASE WHEN {some('credential', 'payment_demand')} THEN 0.30 ELSE 0.0 END"), ("prize", "n_prize > 0", "0.62"),
    ("investment", "n_investment > 0", "0.58 + CASE WHEN n_investment > 1 THEN 0.12 ELSE 0.0 END"), ("link_risk", "link_risk > 0", "link_risk"), ("impersonation", "impersonation >= 0.4", "impersonation"), ("cold_sender", "scam_base > 0 AND is_cold", "0.12"), ("injection", "n_injection > 0", "injection"),
]
#: What each part adds, over ``safety``, as text in order of the parts' names.
SIGNALS = "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}=' || printf('%.3f', round({doubles(v)}, 3)) END" for k, c, v in _SIGNALS) + "], lambda x: x IS NOT NULL)), '|')"
SAFETY_CTE = f"""
imposed AS (SELECT *, {doubles(f"round(least(1.0, (CASE WHEN mismatch AND biz_verified AND account_age_days > 730 AND NOT lookalike THEN least({_UNDER}, 0.12) ELSE {_UNDER} END) + CASE WHEN has_biz AND NOT biz_verified AND biz_reports >= 5 THEN 0.10 ELSE 0.0 END + CASE WHEN len(list_filter(domains, lambda x: regexp_matches(x, '@BAIT@'))) > 0 AND ({_PRESSED} OR n_payment_demand > 0 OR demands_amount) THEN 0.45 ELSE 0.0 END + CASE WHEN @BRANDS@ AND @HOSTLIKE@ AND NOT has_biz THEN 0.45 WHEN @HOSTLIKE@ AND {_PRESSED} THEN 0.30 ELSE 0.0 END + CASE WHEN @SALUTATION@ AND {_PRESSED} THEN 0.10 ELSE 0.0 END), 3)").replace('@BAIT@', BAIT).replace('@BRANDS@', _BRANDS).replace('@HOSTLIKE@', _HOSTLIKE).replace('@SALUTATION@', matches('combined', SALUTATION))} AS impersonation,
  {doubles(f"least(0.5, {add(*_LINK.values())})")} AS link_risk, {doubles(f"round(least(1.0, {_SPAM}), 3)")} AS spam FROM known),
based AS (SELECT *, {doubles(_SCAM)} AS scam_base FROM imposed),
injected_scores AS (SELECT *, {doubles("CASE WHEN n_injection > 0 THEN least(1.0, 0.62 + 0.12 * (n_injection - 1)) ELSE 0.0 END")} AS injection,
  {doubles("scam_base + CASE WHEN scam_base > 0 AND is_cold THEN 0.12 ELSE 0.0 END")} AS warm,
  list_filter([{", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _THREATS)}], lambda x: x IS NOT NULL) AS threats FROM based),
scams AS (SELECT *, {doubles("round(least(1.0, CASE WHEN n_injection > 0 THEN greatest(warm, 0.60) ELSE warm END), 3)")} AS scam FROM injected_scores),
safety AS MATERIALIZED (SELECT *, risk >= 0.55 AS is_scam, spam >= 0.62 AND risk < 0.55 AS is_spam FROM (SELECT *, greatest(scam, injection, impersonation) AS risk FROM scams))"""

_DAMP = "(CASE WHEN n_deescalation > 0 THEN least(0.85, 0.35 * n_deescalation) ELSE 0.0 END)"
_URGENCY = add(
    ("n_urgency > 0", "least(0.34, 0.16 * n_urgency)"), ("n_translit_urgency > 0", "least(0.24, 0.12 * n_translit_urgency)"), ("n_time > 0", "(CASE WHEN same_day THEN 0.26 ELSE 0.12 END)"), ("mentions_user", "0.14"),
    ("modality = 'voice' AND wpm >= 165", "0.16"), ("modality = 'voice' AND duration_s > 0 AND duration_s <= 12 AND n_urgency > 0", "0.10"), ("modality = 'voice' AND duration_s >= 30", "-0.12"),
    (f"group_type IN {names(WORK_GROUPS)}", "0.10"), (f"group_type IN {names(SCHOOL_GROUPS)}", "0.12"), (f"group_type IN {names(OPERATIONAL_GROUPS)}", "0.06"), ("sender_admin", "0.10"), ("n_promo >= 2", "-0.22"),
    ("n_greeting > 0 AND NOT direct_request", "-0.16"), ("forwarded_count >= 3", "-0.14"),
)
_ACTION = add(("direct_request AND n_feedback = 0", "0.42"), ("n_feedback > 0", "0.05"), ("question", "0.14"), ("mentions_user", "0.34"))
_BIZ = "(has_biz OR conversation_type = 'business')"
_DIRECT = "(conversation_type = 'personal' OR sender_user_id <> '')"
_TYPE = f"""CASE WHEN injection >= 0.5 OR is_scam THEN 'scam'
  WHEN is_spam AND ((modality = 'voice' AND duration_s >= 20) OR regexp_matches(why, '^(ignored|cold|unknown)')) THEN 'spam' WHEN is_spam THEN 'promotion'
  WHEN n_greeting > 0 AND word_count < 45 AND (NOT direct_request OR n_deescalation > 0) THEN 'greeting' WHEN forwarded_count >= 3 AND (n_forward > 0 OR NOT direct_request) THEN 'forward'
  WHEN conversation_type <> 'business' AND (n_caption_marketplace > 0 OR (n_caption_promo > 0 AND n_commerce > 0 AND media_text = '')) THEN 'promotion'
  WHEN n_caption_promo >= 2 OR (n_caption_promo >= 1 AND opt_out_footer) THEN 'promotion' WHEN layout = 'promotional_poster' AND n_caption_business_update = 0 THEN 'promotion'
  WHEN n_caption_payment >= 2 OR (n_caption_payment >= 1 AND regexp_matches(low, 'due|pay by|outstanding|bill|emi|challan')) THEN 'payment'
  WHEN group_type IN {names(SCHOOL_GROUPS)} AND (n_caption_event > 0 OR n_time > 0) THEN 'event' WHEN group_type IN {names(OPERATIONAL_GROUPS)} AND sender_admin AND n_time > 0 AND urgency >= 0.35 THEN 'urgent'
  WHEN urgency >= 0.55 AND (direct_request OR n_urgency > 0) THEN 'urgent' WHEN n_caption_event >= 1 AND (n_time > 0 OR n_caption_event >= 2) THEN 'event'
  WHEN {_BIZ} AND n_caption_business_update > 0 THEN 'business_update' WHEN {_BIZ} AND n_caption_promo >= 1 THEN 'promotion' WHEN {_BIZ} THEN 'business_update'
  WHEN {_DIRECT} AND direct_request AND urgency >= 0.45 THEN 'urgent' WHEN {_DIRECT} AND is_empty THEN 'unknown' WHEN conversation_type = 'personal' AND is_stranger THEN 'unknown' WHEN {_DIRECT} THEN 'personal' ELSE 'unknown' END"""
_TRUST = "0.5 + " + add(
    ("has_biz AND biz_verified", "0.22"), ("has_biz AND NOT biz_verified", "-0.12"), ("mismatch", "-0.34"), ("has_biz AND account_age_days >= 730", "0.08"), ("has_biz AND account_age_days < 120", "-0.10"), ("has_biz AND biz_reports >= 10", "-0.14"),
    ("has_biz AND rel_active", "0.16"), ("sender_admin", "0.14"), ("group_id <> '' AND sender_user_id <> '' AND NOT snd_member", "-0.08"), ("sender_user_id <> '' AND sender_seen >= 2", "0.18 * sender_affinity"),
)
_GROUPED = "conversation_type = 'group' AND group_id <> ''"
_RELATION = "0.5 + " + add(
    (f"{_GROUPED} AND is_member AND mem_muted", "-0.20"), (f"{_GROUPED} AND is_member", "0.24 * ((mem_read + 1.5) / (greatest(mem_read + mem_dismissed, 1) + 3.0) - 0.5) * 2"), (f"{_GROUPED} AND is_member AND mem_replies >= 3", "0.10"),
    (f"{_GROUPED} AND is_member AND mem_dismissed >= 5 AND mem_replies = 0", "-0.14"), (f"{_GROUPED} AND is_member AND mem_role = 'admin'", "0.04"), (f"{_GROUPED} AND group_seen > 0", "0.18 * group_affinity"),
    (_GROUPED, f"({case_of(GROUP_PRIOR, 'group_type', '0.0')})"), ("sender_user_id <> '' AND sender_seen > 0", "0.30 * sender_affinity"), ("sender_user_id <> '' AND sender_seen = 0", "-0.06"), ("business_id <> '' AND rel_active", "0.18"),
    ("business_id <> '' AND opted_out AND topic IN ('promotion', 'greeting')", "-0.26"), ("business_id <> '' AND rel_ignored", "-0.18"), ("business_id <> '' AND rel_replied >= 1", "0.10"), ("business_id <> '' AND NOT has_rel", "-0.12"),
    ("business_id <> '' AND business_seen > 0", "0.16 * business_affinity"), ("topic_seen >= 2", "0.12 * topic_affinity"),
)
_LIVE = "business_id <> '' AND kind IN ('business_update', 'event', 'payment') AND rel_active"
_IMPORTANCE = f"({case_of(IMPORTANCE, 'kind', '0.35')}) + " + add((f"group_type IN {names(SCHOOL_GROUPS + OPERATIONAL_GROUPS)}", "0.06"), (_LIVE, "0.24"), (f"{_LIVE} AND {some('business_update', 'event')}", "0.08"))

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) > 1 AND x NOT IN " + names(t.STOP_WORDS) + "))"
SIMILAR_CTE = f"""
hist_texts AS (SELECT h.message_id, h.user_id, CASE WHEN h.media_id = '' THEN h.message_text ELSE trim(h.message_text || chr(10) || coalesce(x.media_text, ''), ' ' || chr(10)) END AS text FROM history h LEFT JOIN media x ON h.media_type = x.media_type AND h.media_id = x.media_id),
hist_tokens AS (SELECT message_id AS hist_id, user_id, unnest({_TOKENS}) AS token FROM hist_texts),
query_tokens AS (SELECT message_id, user_id, unnest({_TOKENS}) AS token FROM (SELECT message_id, user_id, CASE WHEN combined <> '' THEN combined ELSE message_text END AS text FROM joined_texts)),
idf AS (SELECT token, count(*) AS df, ln(1 + (SELECT greatest(count(*), 1) FROM hist_texts) / (1 + count(*))) AS idf FROM hist_tokens GROUP BY token),
q AS (SELECT message_id, user_id, token, coalesce(idf, 1.0) AS w FROM query_tokens LEFT JOIN idf USING (token)),
h AS (SELECT hist_id, user_id, token, idf AS w FROM hist_tokens JOIN idf USING (token)),
lexical AS (SELECT message_id, hist_id, shared / sqrt(q_sum * h_sum) AS lexical FROM (SELECT q.message_id, h.hist_id, sum(q.w) AS shared FROM q JOIN h ON q.user_id = h.user_id AND q.token = h.token GROUP BY ALL)
  JOIN (SELECT message_id, sum(w) AS q_sum FROM q GROUP BY ALL) USING (message_id) JOIN (SELECT hist_id, sum(w) AS h_sum FROM h GROUP BY ALL) USING (hist_id)),
pairs AS MATERIALIZED (SELECT m.message_id, m.user_id, p.message_id AS hist_id, p.seq AS hist_seq, coalesce(list_cosine_similarity(CAST(qv.vector AS DOUBLE[]), CAST(hv.vector AS DOUBLE[])), lexical, 0.0) AS semantic,
  least(1.0, {doubles(add(("m.business_id <> '' AND m.business_id = p.business_id", "0.62"), ("m.sender_user_id <> '' AND m.sender_user_id = p.sender_user_id", "0.58"), ("m.group_id <> '' AND m.group_id = p.group_id", "0.30"), ("m.conversation_type = p.conversation_type", "0.12"), ("m.media_type <> '' AND m.media_type = p.media_type", "0.06"), ("m.forwarded_count >= 3 AND p.forwarded_count >= 3", "0.08")))}) AS structural,
  CASE WHEN e.message_id IS NULL THEN 'unknown' WHEN notification_dismissed OR muted_after OR reported THEN 'negative' WHEN message_opened OR message_replied THEN 'positive' ELSE 'neutral' END AS outcome
  FROM messages m JOIN history p ON m.user_id = p.user_id AND m.message_id <> p.message_id LEFT JOIN lexical l ON l.message_id = m.message_id AND l.hist_id = p.message_id LEFT JOIN vectors qv ON qv.message_id = m.message_id LEFT JOIN vectors hv ON hv.message_id = p.message_id LEFT JOIN message_events e ON e.user_id = m.user_id AND e.message_id = p.message_id),
similar_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, hist_seq) AS rank FROM (SELECT *, round(0.65::DOUBLE * greatest(0, semantic) + 0.35::DOUBLE * structural, 4) AS score FROM pairs)) WHERE rank <= 40),
repeated AS (SELECT message_id, rejected, engaged, CASE WHEN rejected + engaged > 0 THEN round(rejected / (rejected + engaged), 3) ELSE 0.0 END AS repetition FROM (
  SELECT message_id, count(*) FILTER (WHERE score >= 0.3 AND outcome = 'negative') AS rejected, count(*) FILTER (WHERE score >= 0.3 AND outcome = 'positive') AS engaged FROM similar_rows GROUP BY message_id))"""

SCORE_CTE = f"""
pressing AS (SELECT *, round(greatest(0.0, least(1.0, ({doubles(_URGENCY)}) * (1 - {doubles(_DAMP)}))), 3) AS urgency, round(greatest(0.0, least(1.0, ({doubles(_ACTION)}) * (1 - {doubles(_DAMP)} * 0.6::DOUBLE))), 3) AS actionability FROM safety),
typed AS (SELECT *, {_TYPE} AS kind FROM pressing),
topical AS (SELECT *, {case_of(TOPIC_OF_TYPE, 'kind', "'other'")} AS topic FROM typed),
stats AS (SELECT t.*, {", ".join(f"coalesce({g}.seen, 0) AS {g}_seen, coalesce({g}.affinity, 0.0) AS {g}_affinity" for g in ('sender', 'grp', 'business', 'top'))}, coalesce(repetition, 0.0) AS repetition, coalesce(rejected, 0) AS rejected, coalesce(fatigue, 0.0) AS fatigue
  FROM topical t LEFT JOIN profile sender ON sender.grain = 'sender' AND sender.user_id = t.user_id AND sender.key = t.sender_user_id LEFT JOIN profile grp ON grp.grain = 'group' AND grp.user_id = t.user_id AND grp.key = t.group_id
  LEFT JOIN profile business ON business.grain = 'business' AND business.user_id = t.user_id AND business.key = t.business_id LEFT JOIN profile top ON top.grain = 'topic' AND top.user_id = t.user_id AND top.key = t.topic
  LEFT JOIN repeated USING (message_id) LEFT JOIN ({FATIGUE_SQL}) f ON f.user_id = t.user_id),
renamed AS (SELECT *, grp_seen AS group_seen, grp_affinity AS group_affinity, top_seen AS topic_seen, top_affinity AS topic_affinity FROM stats),
rated AS (SELECT *, round(greatest(0.0, least(1.0, {doubles(_TRUST)} - 0.45::DOUBLE * risk)), 3) AS trust, round(greatest(0.0, least(1.0, {doubles(_RELATION)})), 3) AS relationship, round(least(1.0, {doubles(_IMPORTANCE)}), 3) AS importance,
  kind IN ('business_update', 'payment', 'event') AND business_id <> '' AND rel_active AND {some('business_update', 'payment', 'event')} AS transactional, least(1.0, n_promo / 4.0::DOUBLE) AS promo_pressure FROM renamed),
scored AS MATERIALIZED (SELECT *, round(greatest(0.0, least(1.0, {doubles("0.34 * urgency + 0.18 * trust + 0.20 * relationship + 0.16 * actionability + 0.12 * importance - 0.28 * repetition - 0.10 * fatigue - 0.22 * promo_pressure - CASE WHEN quiet THEN 0.06 ELSE 0.0 END - CASE WHEN forwarded_count >= 8 THEN 0.14 * least(1.0, forwarded_count / 20.0) ELSE 0.0 END")})), 4) AS priority FROM rated)"""

_RULES = " ".join(f"WHEN {{a}} = '{r.action}' AND ({r.condition})" + (f" AND {{k}} IN {names(r.kinds.split())}" if r.kinds else "") + f" THEN '{r.key}'" for r in ORDERED)
_SUPPORT = "CASE intent WHEN 'suppress' THEN CASE outcome WHEN 'negative' THEN 1.0 WHEN 'neutral' THEN 0.45 WHEN 'unknown' THEN 0.3 ELSE 0.05 END WHEN 'promote' THEN CASE outcome WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.45 WHEN 'unknown' THEN 0.3 ELSE 0.05 END ELSE CASE outcome WHEN 'neutral' THEN 0.5 WHEN 'unknown' THEN 0.35 ELSE 0.6 END END"


def rule_for(action: str, kind: str) -> str:
    return "CASE " + _RULES.format(a=action, k=kind) + " END"


def value_of(field: str, key: str) -> str:
    def shown(value) -> str:
        return lit(value) if isinstance(value, str) else repr(value)

    return f"CASE {key} " + " ".join(f"WHEN '{r.key}' THEN {shown(getattr(r, field))}" for r in ORDERED) + " END"


_BAND = "CASE {a} WHEN 'notify' THEN {n} WHEN 'digest' THEN {d} ELSE {m} END"
_LOW, _HIGH = _BAND.format(a="{a}", n="0.85", d="0.78", m="0.81"), _BAND.format(a="{a}", n="0.91", d="0.84", m="0.87")
_CONFIDENCE = doubles(f"round(greatest({_LOW.format(a='action0')}, least({_HIGH.format(a='action0')}, ({value_of('confidence', 'rule0')}) + greatest(-0.02, least(0.02, ((CASE action0 WHEN 'notify' THEN priority - 0.42 WHEN 'mute' THEN greatest(scam, injection, spam, 0.08 - priority) ELSE least(abs(priority - 0.42), abs(priority - 0.08)) END) - 0.12) * 0.12)))), 2)")


def _decide_cte(after_choice: str, choice: str) -> str:
    return _DECIDE.replace("FROM confident)", f"FROM {choice})").replace("FROM confident c ", f"FROM {choice} c ").replace("{after_choice}", after_choice)


_DECIDE = f"""
decided AS (SELECT *, CASE WHEN hostile OR bulk THEN 'mute' WHEN wanted AND risk >= 0.35 THEN 'digest' WHEN wanted THEN 'notify' WHEN priority <= 0.08 THEN 'mute' ELSE 'digest' END AS action0, CASE WHEN hostile THEN 'scam' ELSE kind END AS type0,
  NOT is_scam AND injection < 0.5 AND least(abs(priority - 0.42::DOUBLE), abs(priority - 0.08::DOUBLE)) <= 0.08::DOUBLE AS gray_zone
  FROM (SELECT *, injection >= 0.5 OR scam >= 0.55 AS hostile, spam >= 0.62 AND kind IN ('promotion', 'spam', 'business_update') AS bulk, priority >= 0.42 AND (urgency >= 0.20 OR actionability >= 0.40 OR transactional) AS wanted FROM scored)),
flagged AS (SELECT *, conversation_type = 'group' AS is_group, conversation_type = 'business' AS is_business, has_biz AND biz_verified AND NOT mismatch AS verified_business,
  rel_active AND regexp_matches(why, 'order|delivery|grocery|purchase|shopping') AS order_history, rel_active AND regexp_matches(why, 'booking|appointment|reservation|ticket|travel|health') AS booking_history,
  (business_id <> '' AND rel_ignored) OR repetition >= 0.5 AS dismissed_similar, rejected >= 2 OR repetition >= 0.6 AS repeated_pattern, sender_user_id <> '' AND sender_seen >= 1 AND sender_affinity >= 0.2 AS trusted_sender,
  sender_user_id <> '' AND sender_seen = 0 AS unknown_sender, list_contains(threats, 'first_contact_sender') AS first_contact, n_time > 0 AND same_day AND n_deescalation = 0 AS same_day_deadline,
  group_type IN {names(WORK_GROUPS)} OR shares_work AS work_context, group_type IN {names(SCHOOL_GROUPS)} AS school_context, len(urls) > 0 AS has_link, n_translit_urgency > 0 AS local_language_urgency,
  mentions_user OR direct_request OR modality = 'voice' AS directed, n_impersonation > 0 OR regexp_matches(low, 'support alert|helpdesk|support team|customer care') AS support_framing, injection >= 0.5 AS injected,
  list_contains(threats, 'credential_request') AS credential_request, list_contains(threats, 'account_threat_pressure') AS account_pressure, list_contains(threats, 'payment_demand') OR list_contains(threats, 'payment_qr_risk') AS payment_risk,
  (rel_active AND NOT opted_out) OR (sender_user_id <> '' AND sender_seen >= 2 AND sender_affinity >= 0.5) AS interest_match, forwarded_count >= 3 AS forwarded_chain, list_contains(threats, 'brand_impersonation') AS impersonating FROM decided),
ruled AS (SELECT *, {rule_for('action0', 'type0')} AS rule0 FROM flagged),
confident AS (SELECT *, {value_of('want', 'rule0')} AS want, CASE WHEN action0 = 'notify' THEN 'promote' WHEN action0 = 'mute' AND type0 NOT IN ('scam', 'spam') THEN 'suppress' ELSE 'neutral' END AS intent,
  {_CONFIDENCE} AS confidence0 FROM ruled){{after_choice}},
ranked_evidence AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY total DESC, hist_id) AS erank FROM (SELECT p.*, c.want, round({doubles(f"0.45 * greatest(0.0, least(1.0, semantic)) + 0.30 * structural + 0.25 * ({_SUPPORT})")}, 4) AS total
  FROM pairs p JOIN (SELECT message_id, intent, want FROM confident) c USING (message_id) WHERE NOT (structural < 0.12::DOUBLE AND semantic < 0.45)) WHERE total >= 0.18),
cited AS (SELECT message_id, list(hist_id ORDER BY erank) AS evidence0, list(outcome ORDER BY erank) AS outcomes FROM ranked_evidence WHERE erank <= want GROUP BY message_id),
r1 AS (SELECT c.*, coalesce(evidence0, []) AS evidence1, coalesce(outcomes, []) AS outcomes1, (is_scam OR injection >= 0.5) AND action0 <> 'mute' AS v1 FROM confident c LEFT JOIN cited USING (message_id)),
r2 AS (SELECT *, CASE WHEN v1 THEN 'mute' ELSE action0 END AS a1, CASE WHEN v1 THEN 'scam' ELSE type0 END AS t1 FROM r1),
r3 AS (SELECT *, CASE WHEN t1 = 'scam' OR (t1 = 'spam' AND a1 = 'notify') THEN 'mute' ELSE a1 END AS a3, t1 = 'scam' AND a1 <> 'mute' AS v2, t1 = 'spam' AND a1 = 'notify' AS v3 FROM r2),
r4 AS (SELECT *, CASE WHEN a3 = 'notify' AND risk >= 0.35 THEN 'digest' ELSE a3 END AS a4, a3 = 'notify' AND risk >= 0.35 AS v4 FROM r3),
r5 AS (SELECT *, a4 = 'mute' AND risk < 0.25 AND t1 <> 'spam' AND (mentions_user OR direct_request) AND urgency >= 0.5 AND relationship >= 0.5 AS v5 FROM r4),
r6 AS (SELECT *, CASE WHEN v5 THEN CASE WHEN urgency >= 0.65 THEN 'notify' ELSE 'digest' END ELSE a4 END AS action, is_empty AND t1 NOT IN ('unknown', 'scam', 'spam') AS v6 FROM r5),
r7 AS (SELECT *, CASE WHEN v6 THEN 'unknown' ELSE t1 END AS message_type FROM r6),
r8 AS (SELECT *, ({value_of('action', 'rule0')}) <> action AS v7, {rule_for('action', 'message_type')} AS rule1 FROM r7),
r9 AS (SELECT *, CASE WHEN v7 THEN rule1 ELSE rule0 END AS rationale, CASE WHEN v7 THEN {value_of('confidence', 'rule1')} ELSE confidence0 END AS confidence1,
  CASE WHEN action IN ('mute', 'notify') AND message_type NOT IN ('scam', 'spam') THEN list_filter(list_zip(evidence1, outcomes1), lambda x: x[2] <> CASE action WHEN 'mute' THEN 'positive' ELSE 'negative' END) ELSE list_zip(evidence1, outcomes1) END AS kept FROM r8),
routed AS MATERIALIZED (SELECT *, CASE WHEN len(kept) = 0 THEN evidence1 ELSE list_transform(kept, lambda x: x[1]) END AS evidence, round(least({_HIGH.format(a='action')}, greatest({_LOW.format(a='action')}, confidence1)), 2)::DOUBLE AS confidence,
  confidence1 < {_LOW.format(a='action')} OR confidence1 > {_HIGH.format(a='action')} AS v8, {value_of('text', 'rationale')} AS reason FROM r9),
decisions AS MATERIALIZED (SELECT *, list_filter([CASE WHEN v1 THEN 'scam_not_muted' END, CASE WHEN v2 THEN 'scam_type_action_mismatch' END, CASE WHEN v3 THEN 'spam_notified' END, CASE WHEN v4 THEN 'risky_notify' END, CASE WHEN v5 THEN 'urgent_muted' END,
  CASE WHEN v6 THEN 'empty_content_typed' END, CASE WHEN v7 THEN 'reason_action_mismatch' END, CASE WHEN v8 THEN 'confidence_out_of_band' END, CASE WHEN evidence <> evidence1 THEN 'contradictory_evidence' END], lambda x: x IS NOT NULL) AS violations FROM routed)"""

SAFETY_CTES = ",".join((CONTENT_CTE, KNOWN_CTE, SAFETY_CTE))
SCORE_CTES = ",".join((SAFETY_CTES, PROFILE_CTE, SIMILAR_CTE, SCORE_CTE))
ROUTE_CTES = ",".join((SCORE_CTES, _decide_cte("", "confident")))

#: Second opinions by the number of a message, and what becomes of those on the first 140 close decisions.
VERDICTS = "SELECT message_id, CASE seq % 3 WHEN 0 THEN 'notify' WHEN 1 THEN 'digest' ELSE 'mute' END AS action, CASE WHEN seq % 2 = 0 THEN '' ELSE 'personal' END AS message_type FROM messages"
_STEP = "CASE {a} WHEN 'notify' THEN 0 WHEN 'digest' THEN 1 ELSE 2 END"
_OPINIONS = f""",
asked AS (SELECT y.message_id, y.action AS v_action, y.message_type AS v_type FROM ({VERDICTS}) y JOIN (SELECT message_id FROM decided WHERE gray_zone ORDER BY seq LIMIT 140) z USING (message_id)),
told AS (SELECT c.*, v_action, v_type, CASE WHEN v_action IS NULL THEN 'none' WHEN v_action = action0 THEN 'agrees' WHEN abs(({_STEP.format(a='v_action')}) - ({_STEP.format(a='action0')})) > 1 THEN 'refused_jump'
  WHEN v_action = 'notify' AND risk >= 0.35 THEN 'refused_risk' ELSE 'override' END AS second_opinion FROM confident c LEFT JOIN asked USING (message_id)),
moved AS (SELECT * REPLACE (CASE WHEN second_opinion = 'override' THEN v_action ELSE action0 END AS action0, CASE WHEN second_opinion = 'override' AND v_type <> '' THEN v_type ELSE type0 END AS type0) FROM told),
reruled AS (SELECT * REPLACE (CASE WHEN second_opinion = 'override' THEN {rule_for('action0', 'type0')} ELSE rule0 END AS rule0) FROM moved),
settled AS (SELECT * REPLACE ({value_of('want', 'rule0')} AS want, CASE WHEN action0 = 'notify' THEN 'promote' WHEN action0 = 'mute' AND type0 NOT IN ('scam', 'spam') THEN 'suppress' ELSE 'neutral' END AS intent,
  CASE WHEN second_opinion = 'override' THEN {_CONFIDENCE} ELSE confidence0 END AS confidence0) FROM reruled)"""
OPINION_CTES = ",".join((SCORE_CTES, _decide_cte(_OPINIONS, "settled")))
