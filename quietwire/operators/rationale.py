"""Why a message went where it went: the rules, as data."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    key: str
    action: str
    kinds: str  # message types, or blank for any
    confidence: float
    want: int  # history rows to cite
    priority: int
    condition: str  # over the flags of the decision, in SQL
    text: str


# Rules by action.
RULES: tuple[Rule, ...] = (
    Rule("admin_time_sensitive", "notify", "urgent event", 0.89, 1, 95, "sender_admin and same_day_deadline and group_type <> 'school_group'",
         "A trusted group admin sent a time-sensitive update that should interrupt the user."),
    Rule("school_same_day", "notify", "event urgent", 0.87, 1, 94, "school_context",
         "A school admin sent a same-day operational update that the user is likely to need immediately."),
    Rule("work_deadline", "notify", "urgent event", 0.85, 1, 92, "work_context",
         "The message is from a work context and contains a direct deadline or meeting dependency."),
    Rule("business_order_update", "notify", "business_update payment", 0.91, 1, 90, "verified_business and order_history",
         "A verified business is sending an update that matches the user's recent order history."),
    Rule("business_booking_reminder", "notify", "event business_update", 0.89, 1, 89, "verified_business and booking_history",
         "A verified business is sending a reminder that matches the user's recent booking history."),
    Rule("close_contact_urgent", "notify", "urgent personal", 0.87, 1, 88, "trusted_sender and same_day_deadline",
         "A close contact sent a short urgent request that should interrupt the user."),
    Rule("direct_ask", "notify", "personal urgent event", 0.87, 1, 84, "direct_request or mentions_user",
         "The sender directly asks this user for a response or action."),
    Rule("payment_due_soon", "notify", "payment", 0.87, 1, 82, "not payment_risk",
         "A legitimate payment reminder from a known account is close to its due date."),
    Rule("service_status_change", "notify", "business_update event", 0.87, 1, 70, "is_business and rel_active",
         "A service the user is currently using has changed status and needs checking now."),
    Rule("local_language_urgent", "notify", "", 0.85, 1, 62, "local_language_urgency",
         "The message carries a same-day deadline that the user needs to act on now."),
    Rule("time_critical_generic", "notify", "", 0.85, 1, 60, "same_day_deadline",
         "The message carries a same-day deadline that the user needs to act on now."),
    Rule("notify_fallback", "notify", "", 0.85, 1, 10, "true",
         "The message is relevant to this user and needs attention soon."),
    Rule("verified_business_non_urgent", "digest", "business_update payment", 0.78, 1, 86, "verified_business and rel_active and not order_history",
         "A verified business is sending a legitimate but non-urgent update."),
    Rule("verified_business_legit", "digest", "business_update payment event", 0.84, 1, 85, "verified_business",
         "The verified business message is legitimate but does not require immediate attention."),
    Rule("promo_opted_in", "digest", "promotion", 0.78, 1, 84, "not opted_out and is_business",
         "The message is promotional but matches a topic or business the user has opted into."),
    Rule("promo_interest_match", "digest", "promotion event", 0.84, 1, 83, "interest_match",
         "The message matches the user's known interests but is still low priority."),
    Rule("offer_relevant", "digest", "promotion", 0.84, 1, 80, "true",
         "The offer is potentially relevant, but it does not need immediate attention."),
    Rule("useful_group_info", "digest", "event business_update payment forward", 0.84, 1, 78, "is_group",
         "The message is useful group information, but it is not urgent enough to interrupt the user."),
    Rule("harmless_greeting", "digest", "greeting", 0.82, 1, 76, "true",
         "The message is a harmless greeting that can be read later."),
    Rule("group_casual_chat", "digest", "personal greeting", 0.8, 1, 75, "is_group and not directed",
         "The message is safe casual chat with no urgent action required."),
    Rule("trusted_no_action", "digest", "personal unknown", 0.82, 1, 74, "trusted_sender",
         "The sender is trusted, but the message has no urgent action or safety relevance."),
    Rule("unfamiliar_but_safe", "digest", "unknown personal", 0.82, 1, 72, "unknown_sender or first_contact",
         "The sender is unfamiliar, but the message does not show urgency, payment pressure, or safety risk."),
    Rule("safe_casual_chat", "digest", "personal greeting", 0.8, 1, 70, "true",
         "The message is safe casual chat with no urgent action required."),
    Rule("forward_harmless", "digest", "forward", 0.8, 1, 68, "true",
         "The forwarded content is harmless but not personally relevant enough to interrupt."),
    Rule("unfamiliar_business_low_priority", "digest", "business_update promotion event payment", 0.8, 1, 66, "is_business",
         "The business message is safe but the user has no active relationship that makes it urgent."),
    Rule("scheduled_not_urgent", "digest", "event", 0.82, 1, 64, "true",
         "The message describes a scheduled item that the user can review later."),
    Rule("digest_fallback", "digest", "", 0.8, 1, 10, "true",
         "The message is safe and useful, but it can wait for a later summary."),
    Rule("router_injection", "mute", "scam spam", 0.85, 1, 99, "injected",
         "The message tries to instruct the router, but the routing decision should be based on the actual content and risk."),
    Rule("otp_verification_flow", "mute", "scam", 0.81, 1, 98, "credential_request and has_link",
         "The message asks for urgent OTP or account verification through a suspicious flow."),
    Rule("fake_support_pressure", "mute", "scam", 0.87, 1, 97, "account_pressure and support_framing",
         "The message uses fake support language and account-blocking pressure to push the user into action."),
    Rule("first_contact_sensitive_ask", "mute", "scam", 0.87, 0, 96, "first_contact and (credential_request or payment_risk) and not support_framing and not has_link",
         "This is the first message from the sender and it asks for sensitive verification or payment."),
    Rule("brand_impersonation", "mute", "scam", 0.87, 1, 95, "impersonating",
         "The sender is impersonating a known brand from an unofficial domain to look legitimate."),
    Rule("fake_support_generic", "mute", "scam", 0.87, 1, 94, "account_pressure",
         "The message uses fake support language and account-blocking pressure to push the user into action."),
    Rule("otp_verification_generic", "mute", "scam", 0.81, 1, 93, "credential_request",
         "The message asks for urgent OTP or account verification through a suspicious flow."),
    Rule("payment_risk_unknown", "mute", "scam payment", 0.85, 1, 93, "payment_risk",
         "The message pressures the user into an unverified payment, which is a common fraud pattern."),
    Rule("scam_generic", "mute", "scam", 0.85, 1, 60, "true",
         "The message shows clear fraud signals and should not reach the user as a notification."),
    Rule("repeated_forward_pattern", "mute", "greeting forward", 0.84, 2, 90, "repeated_pattern or forwarded_chain",
         "The sender has a pattern of repeated forwards or greetings that the user usually ignores."),
    Rule("marketing_opted_out", "mute", "promotion spam business_update", 0.81, 2, 88, "is_business and (opted_out or dismissed_similar)",
         "The user has opted out of or repeatedly dismissed similar marketing messages."),
    Rule("similar_ignored", "mute", "", 0.85, 1, 80, "repeated_pattern or dismissed_similar",
         "Similar historical messages were ignored, dismissed, or muted by this user."),
    Rule("bulk_unsolicited", "mute", "spam promotion", 0.83, 1, 70, "true",
         "The message is unsolicited bulk marketing from an account the user has no relationship with."),
    Rule("mute_fallback", "mute", "", 0.82, 1, 10, "true",
         "The message is low value for this user and does not justify a notification."),
)

FALLBACK = {action: f"{action}_fallback" for action in ("notify", "digest", "mute")}
BY_KEY = {rule.key: rule for rule in RULES}
#: The order in which rules are tried: the first that fits is the one of the highest priority, ties by key.
ORDERED = tuple(sorted(RULES, key=lambda rule: (-rule.priority, rule.key)))
