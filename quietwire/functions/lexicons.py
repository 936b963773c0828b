"""Word lists and patterns that content features are made of."""

from __future__ import annotations

# Terms by lexicon, in the order in which hits are listed.
LEXICONS: dict[str, tuple[str, ...]] = {
    "credential": (
        "otp", "one time password", "one-time password", "login code", "verification code", "security code", "6 digit", "six digit", "cvv",
        "card number", "card details", "atm pin", "upi pin", "mpin", "password", "net banking password", "seed phrase", "private key", "wallet pin",
        "wallet details", "bank details", "account details", "confirm your pin", "share the otp", "share otp", "enter otp", "confirm password",
        "login credentials", "account number", "sharing your account", "share your account", "ifsc", "aadhaar number", "send details",
        "send your details",
    ),
    "account_threat": (
        "will be blocked", "will be suspended", "account blocked", "account suspended", "profile will be blocked", "temporarily blocked",
        "access will expire", "expire today", "deactivated", "will be deactivated", "kyc pending", "kyc incomplete", "complete kyc", "verify now",
        "verify immediately", "reactivate", "restore access", "keep access active", "may be blocked", "failed verification", "verification failed",
        "suspicious login", "service stops", "service will stop", "will be stopped", "will be cancelled", "will be disconnected",
        "processing will close", "will lapse", "final notice", "last warning", "before midnight", "or your connection", "avoid disconnection",
        "account closure", "avoid account closure", "account may get locked", "account check", "pending verification", "complete verification",
        "unless you login", "login now", "account lock", "avoid account lock", "service reactivation", "reactivation", "sim blocked",
        "sim will be blocked", "number blocked", "connection blocked", "card blocked", "will be barred", "access blocked", "be blocked",
        "approval window closes", "window closes today",
    ),
    "windfall": (
        "loan approved", "amount will be released", "credit approved", "sanctioned", "you are approved", "claim approved", "payout approved",
        "funds are ready", "you have been selected", "you are selected", "selected for the role", "pre-approved", "your claim is approved",
        "eligible to receive",
    ),
    "payment_demand": (
        "pay now", "small fee", "reattempt fee", "delivery fee", "processing fee", "clearance fee", "customs fee", "release payment",
        "transfer amount", "send money", "pay to release", "pay a refundable", "convenience fee", "penalty amount", "outstanding amount pay",
        "scan and pay", "scan the qr", "scan this qr", "pay pending", "pending charge", "clearance amount", "pay immediately", "pay to continue",
        "complete the payment", "settle the amount", "pay the balance", "recharge now", "reactivation fee", "activation fee", "fee pending",
        "fee is pending", "send screenshot", "send the screenshot", "share screenshot", "pay today",
    ),
    "refund_bait": (
        "refund approved", "refund initiated", "claim your refund", "refund processing", "refund pending", "eligible for refund", "cashback credited",
        "amount will be reversed",
    ),
    "advisory": (
        "safety advisory", "fraud awareness", "scam alert", "fraud alert", "beware of", "stay alert", "report fraud", "cyber safety", "security tips",
        "awareness campaign", "never ask for", "never share", "do not share", "protect yourself", "stay safe online", "get bowled by scammers",
        "how to stay safe",
    ),
    "translit_risk": (
        "khata band", "khata block", "account band", "band ho jayega", "block ho jayega", "paisa bhejo", "paise bhejo", "turant bhejo", "abhi bhejo",
        "jaldi karo", "otp batao", "otp bhejo", "code batao", "link kholo", "link open karo", "verify karo", "payment karo", "transfer karo", "raqam",
        "jaldi",
    ),
    "translit_urgency": (
        "abhi", "turant", "jaldi", "foran", "emergency hai", "hospital mein", "call karo", "phone karo", "aajao", "aa jao",
    ),
    "prize": (
        "you have won", "congratulations you", "lucky winner", "lottery", "prize money", "claim your reward", "cash prize", "selected winner",
        "gift card worth", "free iphone",
    ),
    "investment": (
        "guaranteed return", "guaranteed profit", "assured returns", "double your money", "multibagger", "sure shot", "jackpot call", "intraday tips",
        "profit booked", "join vip group", "premium tips", "target hit", "no risk", "risk free profit",
    ),
    "impersonation": (
        "support team", "customer support", "official support", "helpdesk", "security team", "bank official", "verification department",
        "compliance team", "we are calling from",
    ),
    "urgency": (
        "urgent", "urgently", "immediately", "right now", "asap", "as soon as possible", "emergency", "critical", "escalation", "escalate", "act now",
        "hurry", "last chance", "deadline", "eod", "end of day", "before it", "time sensitive", "quick help", "need help", "come online", "call now",
        "please call", "reach by", "pick up",
    ),
    "deescalation": (
        "nothing urgent", "not urgent", "no rush", "no hurry", "no pressure", "no need to reply", "no need to respond", "no need to answer",
        "whenever you get time", "whenever you can", "when you get a chance", "at your convenience", "just fyi", "just informing", "for your info",
        "don't call", "dont call", "no action needed", "nothing to do", "just sharing", "will update later", "we can talk tomorrow", "take your time",
        "if you are free", "only if", "join only if", "no need to", "nothing dramatic", "no reply needed", "nothing blocking", "not blocking",
        "nothing critical", "if you get time", "if you get a chance", "read it before", "no hurry at all", "not blocking anything",
    ),
    "feedback": (
        "fill a quick review", "quick review", "share your feedback", "give your feedback", "rate your experience", "how was your experience",
        "hear about your experience", "take a short survey", "valuable feedback", "rate us", "review your order", "tell us how",
        "your opinion matters",
    ),
    "marketplace": (
        "selling", "for sale", "up for sale", "dm if interested", "message me if", "pickup near", "pickup is", "pick up near", "barely used",
        "no damage", "bought last year", "size m", "medium size", "brand new", "negotiable", "best price", "interested people", "kept aside",
        "share pics", "photos are attached", "photos for the", "warehouse pickup", "buyer cancelled", "clear it fast", "only if serious",
        "kept aside", "still want it", "price is final", "first come first", "resale", "reselling",
    ),
    "commerce": (
        "pickup", "pick up", "cash or upi", "upi", "cash", "price", "rs.", "rs ", "₹", "buyer", "seller", "delivery charge", "shipping", "in stock",
        "available", "booking amount",
    ),
    "promo": (
        "% off", "discount", "flat off", "sale", "offer", "coupon", "promo code", "cashback", "buy now", "shop now", "order now", "book now",
        "limited time", "hurry", "deal", "free delivery", "lowest price", "unbeatable price", "starting at", "upto", "up to", "exclusive",
        "t&c apply", "terms and conditions", "unsubscribe", "reply stop", "new arrivals", "mega sale", "best price", "special price", "save big",
    ),
    "greeting": (
        "good morning", "good night", "good evening", "have a blessed", "stay positive", "keep smiling", "god bless", "have a nice day",
        "happy sunday", "warm wishes", "hope today is", "good vibes", "blessings", "stay happy", "shubh",
    ),
    "forward": (
        "fwd", "forwarded as received", "fwd as received", "as received", "pls forward", "please forward", "share with", "forward to", "sharing here",
        "received on whatsapp", "copy paste", "must read", "very useful", "share maximum",
    ),
    "event": (
        "meeting", "appointment", "booking", "reservation", "schedule", "scheduled", "rsvp", "venue", "circular", "field trip", "seminar", "webinar",
        "workshop", "reminder", "ceremony", "rehearsal", "assembly", "parents meeting", "consent", "form is open", "register by", "check-in",
        "itinerary", "cultural night", "annual day", "sports day", "last date", "deadline to submit", "submit by", "timing", "agenda",
    ),
    "payment": (
        "bill", "due date", "statement", "invoice", "emi", "premium due", "payment received", "transaction", "debited", "credited", "receipt",
        "maintenance", "dues", "outstanding", "recharge", "balance", "auto-pay", "autopay", "installment", "challan", "fee payment",
    ),
    "business_update": (
        "order", "delivery", "shipped", "dispatched", "out for delivery", "tracking", "arriving", "your package", "service request", "ticket",
        "complaint", "refund processed", "appointment confirmed", "booking confirmed", "policy", "renewal", "account statement", "update is ready",
        "status", "confirmed",
    ),
}

# Text that is aimed at the router instead of the reader.
INJECTION_PATTERNS: tuple[str, ...] = (
    r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instruction|rule|routing|prompt)",
    r"disregard\s+(?:all\s+)?(?:previous|prior|above|earlier)",
    r"system\s+(?:note|prompt|message|instruction)\s*(?:for|to)?\s*(?:the\s+)?(?:notification\s+)?router",
    r"(?:always\s+)?mark\s+this\s+(?:message\s+)?as\s+(?:notify|urgent|important|high\s+priority)",
    r"(?:routing|notification)\s+rules?",
    r"you\s+are\s+an?\s+(?:ai|assistant|language\s+model|router)",
    r"override\s+(?:the\s+)?(?:filter|rule|setting|decision)",
    r"do\s+not\s+(?:mute|filter|block)\s+this",
    r"treat\s+this\s+as\s+(?:notify|urgent|priority)",
    r"new\s+instructions?\s*:",
    '[\\"\\\']?\\b(?:action|confidence|user_priority|verified_business|sender_risk)\\b[\\"\\\']?\\s*[=:]\\s*[\\"\\\']?\\w',
    r"internal\s+(?:router|system|engine)\s+metadata",
    r"(?:assistant|system|model)\s+instruction",
    r"routing\s+override",
    r"classify\s+(?:this\s+)?(?:as|to)\s+(?:notify|urgent|priority|important)",
    r"set\s+action\s*[=:]",
    r"ignore\s+(?:the\s+)?sender\s+risk",
)

# Brands, host endings and link shorteners.
BRAND_TOKENS: tuple[str, ...] = (
    "amazon", "flipkart", "paytm", "phonepe", "gpay", "google pay", "hdfc", "icici", "sbi", "axis", "kotak", "bank of america", "chase", "paypal",
    "netflix", "swiggy", "zomato", "uber", "ola", "irctc", "jio", "airtel", "vodafone", "vi ", "myntra", "ajio", "nykaa", "whatsapp", "meta",
    "instagram", "microsoft", "apple", "dbs", "citi", "yes bank",
)
SUSPICIOUS_TLDS: tuple[str, ...] = (
    ".xyz", ".top", ".click", ".link", ".buzz", ".icu", ".rest", ".online", ".site",
)
URL_SHORTENERS: tuple[str, ...] = (
    "bit.ly", "tinyurl", "t.co", "rb.gy", "cutt.ly", "is.gd", "shorturl", "rebrand.ly",
)

# Words that say nothing about the topic.
STOP_WORDS: tuple[str, ...] = tuple(
    "a an the and or but if then than that this these those is are was were be been being am to of in on at by for with from as it its "
    "it's you your yours we our us they them their he she his her i me my will would can could should shall may might must do does did done have has had not no so just now also very please pls thanks thank ok okay".split()
)
