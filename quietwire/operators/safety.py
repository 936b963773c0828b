"""Risk of a message, whoever reads it. Sums keep their order, since thresholds are compared with sums of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwire.functions.lexicons import BRAND_TOKENS
from quietwire.functions.text import has

# Hosts and salutations of impersonators.
LOOKALIKE = (
    r"^([a-z0-9]*(?:amazon|paytm|phonepe|hdfc|icici|sbi|axis|netflix|swiggy|zomato|irctc|jio|airtel"
    r"|paypal|apple|microsoft|whatsapp|flipkart|myntra|kotak|account|secure|verify|login|wallet|kyc|pay)"
    r"[a-z0-9\-]*)\.(?:[a-z]{2,24})\b"
)
BAIT = "(verify|secure|kyc|login|alert|otp|update|refund|reward)"
SALUTATION = r"\b(dear (?:customer|user|sir/madam|member)|hi customer|hello user|dear valued)\b"


def add(*parts: tuple[Column, Column | float], start: Column | float = 0.0) -> Column:
    """Sum from ``start``, in order, of the values whose conditions hold; a null condition does not hold."""
    total = start if isinstance(start, Column) else F.lit(start)
    for condition, value in parts:
        total = total + F.when(condition, value).otherwise(0.0)
    return total


def any_hit(*lexicons: str) -> Column:
    found = F.lit(False)
    for name in lexicons:
        found = found | (F.col(f"n_{name}") > 0)
    return found


def link_parts() -> dict[str, tuple[Column, float]]:
    """contributions by threat."""
    links, pressed = F.size("urls") > 0, any_hit("credential", "account_threat")
    qr = F.col("has_qr") | F.col("qr_payment")
    off_brand = F.col("mismatch") & (F.col("biz_official_domain") != "") & F.exists("domains", lambda x: F.instr(x, F.col("biz_official_domain")) == 0)
    return {
        "suspicious_tld": (F.col("suspicious_host"), 0.20),
        "shortened_link": (F.col("shortened_link"), 0.16),
        "phishing_link_flow": (links & pressed, 0.28),
        "payment_link_flow": (links & any_hit("payment_demand"), 0.24),
        "obscured_link_pressure": (F.col("shortened_link") & any_hit("account_threat", "urgency"), 0.24),
        "payment_qr_risk": (qr & (any_hit("payment_demand", "account_threat") | F.col("demands_amount")), 0.26),
        "offbrand_link": (off_brand, 0.10),
    }


def text_threats() -> dict[str, Column]:
    """What F03 reads off a text alone: columns of the content, worked out once for each different text."""
    claims = F.lit(False)
    for brand in BRAND_TOKENS:
        claims = claims | F.col("low").contains(brand)
    return {
        "claims_brand": claims,
        "lookalike_host": F.exists("domains", lambda x: has(x, LOOKALIKE)),
        "bait_host": F.exists("domains", lambda x: x.rlike(BAIT)),
        "salutation": has(F.col("combined"), SALUTATION),
    }


def impersonation_score() -> Column:
    """F03."""
    verified, mismatch = F.col("biz_verified"), F.col("mismatch")
    under = add(
        (mismatch & F.col("lookalike"), 0.72),
        (mismatch & ~F.col("lookalike") & ~verified, 0.18),
        (mismatch & ~verified, 0.10),
        (mismatch & (F.col("biz_account_age_days") < 90), 0.20),
        (mismatch & (F.col("biz_domain_age_days") > 0) & (F.col("biz_domain_age_days") < 60), 0.15),
        (mismatch & (F.col("biz_reports_30d") >= 25), 0.15),
    )
    established = mismatch & verified & (F.col("biz_account_age_days") > 730) & ~F.col("lookalike")
    score = F.when(established, F.least(under, F.lit(0.12))).otherwise(under)
    pressed = any_hit("credential", "account_threat")
    bait = F.col("bait_host") & (pressed | any_hit("payment_demand") | F.col("demands_amount"))
    host = F.when(F.col("claims_brand") & F.col("lookalike_host") & ~F.col("has_biz"), 0.45).when(F.col("lookalike_host") & pressed, 0.30).otherwise(0.0)
    score = score + F.when(F.col("has_biz") & ~verified & (F.col("biz_reports_30d") >= 5), 0.10).otherwise(0.0)
    score = score + F.when(bait, 0.45).otherwise(0.0) + host + F.when(F.col("salutation") & pressed, 0.10).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 3)


def spam_score() -> Column:
    """F04."""
    promo = F.least(F.lit(1.0), F.col("n_promo") / 4.0)
    biz = F.col("has_biz")
    return F.round(
        F.least(
            F.lit(1.0),
            add(
                (promo > 0, 0.34 * promo),
                (F.col("opt_out_footer"), 0.16),
                (biz & ~F.col("has_rel"), 0.22),
                (biz & F.col("opted_out"), 0.34),
                (biz & F.col("rel_ignored"), 0.20),
                (biz & (F.col("biz_reports_30d") >= 8), 0.12),
                (biz & (F.col("biz_sent_30d") >= 2000), 0.06),
                ((F.col("forwarded_count") >= 3) & any_hit("promo", "forward"), 0.18),
                (F.col("forwarded_count") >= 12, 0.22),
            ),
        ),
        3,
    )


def assess(df: DataFrame) -> DataFrame:
    """Scores, the risk they make, ordered threats and the map of contributions.

    Expects content columns (with ``text_threats``), the business and relationship joins, is_cold, and optionally intent and intent_margin.
    """
    if "intent" not in df.columns:
        df = df.withColumns({"intent": F.lit(""), "intent_margin": F.lit(0.0)})
    df = df.withColumns({"impersonation": impersonation_score(), "spam": spam_score()})
    told = ~F.col("advisory")
    pressed = any_hit("credential", "account_threat")
    extra = lambda name: F.least(F.lit(2), F.col(f"n_{name}") - 1)
    demanded = any_hit("payment_demand") | F.col("demands_amount")
    windfall = any_hit("windfall", "refund_bait", "prize")
    link = link_parts()
    link_risk = F.least(F.lit(0.5), add(*link.values()))
    payment = F.lit(0.34) + F.when(pressed, 0.14).otherwise(0.0) + F.when(windfall, 0.30).otherwise(0.0)
    refund = F.lit(0.20) + F.when(any_hit("credential", "payment_demand"), 0.30).otherwise(0.0)
    parts = {
        "credential": (any_hit("credential") & told, F.when(F.col("n_credential") == 1, 0.62).otherwise(0.74)),
        "account_threat": (any_hit("account_threat") & told, 0.34 + 0.08 * extra("account_threat")),
        "fake_support": (any_hit("impersonation") & told & pressed, F.lit(0.14)),
        "payment_demand": (demanded, payment),
        "translit_risk": (any_hit("translit_risk"), 0.34 + 0.12 * extra("translit_risk")),
        "refund_bait": (any_hit("refund_bait"), refund),
        "prize": (any_hit("prize"), F.lit(0.62)),
        "investment": (any_hit("investment"), 0.58 + F.when(F.col("n_investment") > 1, 0.12).otherwise(0.0)),
        "semantic_fraud": (F.col("intent") == "fraud", 0.58 + F.least(F.lit(0.14), F.col("intent_margin"))),
        "link_risk": (link_risk > 0, link_risk),
        "brand_impersonation": (F.col("impersonation") >= 0.4, F.lit(0.18)),
    }
    df = df.withColumn("scam_base", add(*parts.values()))
    cold = (F.col("scam_base") > 0) & F.col("is_cold")
    warm = F.col("scam_base") + F.when(cold, 0.12).otherwise(0.0)
    injected = F.col("n_injection") > 0
    scam = F.round(F.least(F.lit(1.0), F.when(injected, F.greatest(warm, F.lit(0.60))).otherwise(warm)), 3)
    injection = F.when(injected, F.least(F.lit(1.0), 0.62 + 0.12 * (F.col("n_injection") - 1))).otherwise(0.0)
    # Threats in the order in which they are listed.
    threats = [
        ("credential_request", parts["credential"][0]), ("account_threat_pressure", parts["account_threat"][0]), ("fake_support_identity", parts["fake_support"][0]),
        ("advance_fee_pattern", demanded & windfall), ("payment_demand", demanded), ("transliterated_fraud_language", parts["translit_risk"][0]),
        ("refund_bait", parts["refund_bait"][0]), ("prize_bait", parts["prize"][0]), ("investment_fraud", parts["investment"][0]),
        ("multilingual_fraud_similarity", parts["semantic_fraud"][0]), *[(k, c) for k, (c, _) in link.items()],
        ("brand_impersonation", parts["brand_impersonation"][0]), ("first_contact_sender", cold), ("router_prompt_injection", injected),
    ]
    told_parts = {k: part for k, part in parts.items() if k != "brand_impersonation"}
    shown = {"safety_advisory": (F.col("advisory"), F.lit(1.0))} | told_parts | {"impersonation": (F.col("impersonation") >= 0.4, F.col("impersonation")), "cold_sender": (cold, F.lit(0.12)), "injection": (injected, injection)}
    signals = F.map_filter(F.create_map(*[x for k, (c, v) in shown.items() for x in (F.lit(k), F.when(c, F.round(v, 3)))]), lambda _, v: v.isNotNull())
    df = df.withColumns({"scam": scam, "injection": injection, "threats": F.array_compact(F.array(*[F.when(c, k) for k, c in threats])), "signals": signals})
    df = df.withColumn("risk", F.greatest("scam", "injection", "impersonation"))
    return df.withColumns({"is_scam": F.col("risk") >= 0.55, "is_spam": (F.col("spam") >= 0.62) & (F.col("risk") < 0.55), "primary_threat": F.coalesce(F.get("threats", F.lit(0)), F.lit(""))}).drop("scam_base")
