"""Dimension tables: scan rules, keyword rules, policy rules and the taxonomy.

A scan rule is (before, payload, after): three regular expressions that match in
a row, of which the middle one is the span.  All are case-insensitive and
Unicode-aware.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanRule:
    id: str
    pii_type: str
    confidence: float
    payload: str
    before: str = r"\b"
    after: str = r"\b"
    validator: str | None = None
    keywords: tuple[str, ...] = ()
    priority: int = 100


@dataclass(frozen=True)
class KeywordRule:
    """``number`` set: its matches near a keyword; else the keyword and ``right`` characters after it."""

    id: str
    pii_type: str
    score: float
    keywords: tuple[str, ...]
    number: str | None = None
    fold_case: bool = False
    right: int = 16
    window: int = 64
    priority: int = 100


def _w(text: str) -> tuple[str, ...]:
    return tuple(text.split("|"))


_CARD = _w("amex|card|cc|credit|debit|maestro|mastercard|pan|visa")
_PLATE = r"[a-z]\d{2}\s?[a-z0-9]{4}"
_PHONE = r"\+?\d[\d\-\s()]{%d,}\d"


def _grouped(*sizes: int) -> str:
    return "[ -]?".join(r"\d{%d}" % n for n in sizes)


SCAN_RULES: tuple[ScanRule, ...] = tuple(sorted((
    ScanRule("connection_string_secret", "CREDENTIAL", 0.93, r"[a-z][\-+.a-z0-9]*://[^\s@:]+:[^\s@]+@[^\n\r\t ]+", after="", priority=4),
    ScanRule("card_number_grouped", "CARD_NUMBER", 0.95, f"{_grouped(4, 4, 4, 4)}|{_grouped(4, 6, 5)}", priority=5),
    ScanRule("email_standard", "EMAIL", 0.9, r"[-+%_.a-z0-9]+@[-.a-z0-9]+\.[a-z]{2,24}", validator="email_safe", priority=5),
    ScanRule("gb_iban", "IBAN", 0.95, r"gb\d{2}[a-z]{4}[a-z0-9]{14}", validator="gb_iban", priority=5),
    ScanRule("nhs_number", "NHS_NUMBER", 0.9, r"\s?".join((r"\d{3}", r"\d{3}", r"\d{4}")), validator="nhs_number", priority=5),
    ScanRule("nino", "NI_NUMBER", 0.9, r"[a-ceghj-pr-tw-zq]{2}" + r"\s?\d{2}" * 3 + r"\s?[a-d]", validator="nino", priority=5),
    ScanRule("credential_env_value", "CREDENTIAL", 0.93, r"""[^'"]{6,}""", before=r"""\b[_a-z0-9]{3,32}\s*=\s*['"]""", after="""['"]""", priority=6),
    ScanRule("gb_iban_spaced", "IBAN", 0.9, r"gb\d{2}\s?[a-z]{4}" + r"\s?\d{2}" * 7, validator="gb_iban", priority=6),
    ScanRule("secret_assignment", "CREDENTIAL", 0.9, r"""[^'"\s]{6,}""", before=r"""\b(?:token|secret|pwd|passcode|password|jwt[-_]?secret|api[-_]?key)\s*[=:]\s*['"]?""", after="""['"]?""", validator="password", priority=8),
    ScanRule("account_number_keyworded", "BANK_ACCOUNT", 0.92, r"\d{8}", before=r"\b(?:acct|account|a/c)\s*(?:no\.?|number)?\s*(?:is\s*)?[-:]?\s*", validator="account_number", priority=10),
    ScanRule("ip_v4", "IP_ADDRESS", 0.9, r"\.".join([r"\d{1,3}"] * 4), validator="ipv4", priority=10),
    ScanRule("sort_code_keyworded", "SORT_CODE", 0.95, r"\d{2}[ -]?\d{2}[ -]?\d{2}", before=r"\bsort\s*code\s*(?:is|[-:])?\s*", validator="sort_code", priority=10),
    ScanRule("api_key_stripe_like", "API_KEY", 0.92, r"sk_(?:test|live)_[a-z0-9]{10,}", priority=12),
    ScanRule("full_name_json", "PERSON", 0.9, r'[^"]+', before=r'"full_name"\s*:\s*"', after='"', priority=12),
    ScanRule("ip_v6", "IPV6_ADDRESS", 0.86, r"[a-f0-9]{0,4}(?::[a-f0-9]{0,4}){2,7}", validator="ipv6", priority=15),
    ScanRule("sort_code_compact_keyworded", "SORT_CODE", 0.9, r"\d{6}", before=r"\bsort\s*code\s*(?:is|[-:])?\s*", validator="sort_code", priority=15),
    ScanRule("de_tax_id", "GOV_ID", 0.9, r"[ 0-9]{11,}", before=r"\b(?:steuer[ -]?id|tax\s*id)[-:]?\s*", priority=16),
    ScanRule("api_key_env_style", "API_KEY", 0.86, r"[-_a-z0-9]{8,}", before=r'\b[_a-z0-9]*?(?:ACCESS_KEY|API_KEY|PASSWORD|SECRET|TOKEN)\s*=\s*"?', after='"?', priority=18),
    ScanRule("phone_international", "PHONE", 0.86, _PHONE % 9, before=r"(?<!\w)", after="", validator="phone_len", priority=18),
    ScanRule("postcode_keyvalue", "POSTCODE", 0.9, _PLATE, before=r'\b(?:billing_|shipping_)?postcode\s*=\s*"?', after='"?', priority=19),
    ScanRule("api_key_prefixed", "API_KEY", 0.88, r"api-[a-z0-9]{12,64}", priority=20),
    ScanRule("card_number_contiguous", "CARD_NUMBER", 0.75, r"[2-6]\d{12,18}", validator="card_luhn", keywords=_CARD, priority=20),
    ScanRule("driving_license_keyworded", "DRIVING_LICENSE", 0.82, r"[a-z]{5}\d{6}[a-z]{2}\d[a-z]{2}", validator="driving_license", keywords=_w("driver|licence|license"), priority=20),
    ScanRule("mac_address", "MAC_ADDRESS", 0.88, ":".join(["[a-f0-9]{2}"] * 6), validator="mac_address", priority=20),
    ScanRule("postcode_uk", "POSTCODE", 0.86, r"[a-z]{1,2}\d[a-z\d]?\s?\d[abd-hjln-uw-z]{2}", validator="postcode", priority=20),
    ScanRule("postcode_ie", "POSTCODE", 0.86, _PLATE, priority=21),
    ScanRule("card_number_keyworded_generic", "CARD_NUMBER", 0.7, r"(?:\d[ -]?){12,18}\d", validator="card_luhn", keywords=_CARD, priority=25),
    ScanRule("credential_prefixed", "CREDENTIAL", 0.86, r"cred-[a-z0-9]{6,40}", priority=25),
    ScanRule("phone_keyworded", "PHONE", 0.82, _PHONE % 8, before=r"(?<!\w)", validator="phone_len", keywords=_w("call|mobile|number|phone|tel|telephone"), priority=25),
    ScanRule("passport_alphanum_keyworded", "PASSPORT_NUMBER", 0.84, r"[a-z]{1,2}\d{7,9}", validator="passport", keywords=("passport",), priority=28),
    ScanRule("building_society_roll", "CUSTOMER_ID", 0.9, r"[a-z0-9][-/.a-z0-9]{5,18}[a-z0-9]", before=r"\broll\s*(?:no|number)?[-:]?\s*", validator="roll_number", keywords=("roll",), priority=30),
    ScanRule("device_id_prefixed", "DEVICE_ID", 0.85, r"dev-[a-f0-9]{10,32}", priority=30),
    ScanRule("driving_license_alt", "DRIVING_LICENSE", 0.8, r"\d{9,12}", before=r"\bdl[\s-]?", priority=30),
    ScanRule("gps_coordinates", "GEO_COORDINATES", 0.8, r"-?\d{1,2}\.\d{4,},\s*-?\d{1,3}\.\d{4,}", validator="gps", priority=30),
    ScanRule("passport_keyworded", "PASSPORT_NUMBER", 0.82, r"\d{9}", validator="passport", keywords=_w("passport|passport_number|passportno|pp#"), priority=30),
    ScanRule("password_keyworded", "PASSWORD", 0.82, r"[*&^%$#@!a-z0-9]{6,64}", before=r"\b(?:pwd|passcode|password)[=:]?\s*", validator="password", priority=30),
    ScanRule("pin_keyworded", "PIN", 0.8, r"\d{4,6}", before=r"\bpin[=:]?\s*", validator="pin", keywords=("pin",), priority=30),
    ScanRule("url_basic", "URL", 0.75, r"""https?://[^'"<>\s]+""", validator="url", priority=30),
    ScanRule("health_condition_terms", "MEDICAL_INFO", 0.88, r"anxiety|(?:chronic\s+)?(?:asthma|migraine)|depression|mental\s+health|panic\s+attack", priority=35),
    ScanRule("address_uk_simple", "ADDRESS", 0.8, r"\d{1,4}\s+[a-z]{2,}(?:\s+(?:Avenue|Ave|Close|Cl|Lane|Ln|Road|Rd\.?|Street|St\.?))", keywords=_w("address|billing|deliver|send|ship|to"), priority=40),
    ScanRule("money_currency", "MONEY", 0.8, r"[$£€]\s?\d{1,6}(?:[,.]\d{2})?", before="", validator="money", priority=40),
    ScanRule("student_id_prefixed", "STUDENT_ID", 0.82, r"sid\d{3,12}", priority=40),
    ScanRule("address_apartment", "ADDRESS", 0.8, r"(?:Apartment|Apt\.?|Flat|Wohnung)\s+\d+", priority=42),
    ScanRule("date_dob_kv_iso", "DATE", 0.85, "-".join((r"\d{4}", r"\d{2}", r"\d{2}")), before=r'\b(?:date[-_]of[-_]birth|dob)\s*[=:]\s*"?', after='"?', validator="date", priority=44),
    ScanRule("address_postcode_city", "ADDRESS", 0.8, r"\d{4,5}\s+[a-z][a-z]+", priority=45),
    ScanRule("date_dob_keyword", "DATE", 0.8, r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", before=r"\b(?:date of birth|dob)[\s:]+", validator="date", priority=46),
    ScanRule("date_iso", "DATE", 0.72, r"\d{4}[-/]\d{2}[-/]\d{2}", validator="date", keywords=_w("birth|date of birth|dob|dob:|dob="), priority=48),
    ScanRule("customer_id_prefixed", "CUSTOMER_ID", 0.8, r"cust-?\d{4,12}", priority=50),
    ScanRule("date_simple", "DATE", 0.7, r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", validator="date", keywords=_w("birth|date|dob|due|event|on"), priority=50),
    ScanRule("loyalty_id_prefixed", "CUSTOMER_ID", 0.8, r"loy-\d{4}-\d{4}", priority=52),
), key=lambda r: (r.priority, r.id)))

_ND, _NW = r"(?<!\d)", r"(?<!\w)"

KEYWORD_RULES: tuple[KeywordRule, ...] = tuple(sorted((
    KeywordRule("sort_code", "SORT_CODE", 0.75, _w("sort code|sort-code"), _ND + r"[\s-]?".join([r"\d{2}"] * 3) + r"(?!\d)", priority=10),
    KeywordRule("account_number", "BANK_ACCOUNT", 0.72, _w("account number|account no|acct no|iban"), _ND + r"\d{8,18}(?!\d)", priority=15),
    KeywordRule("credential_connection_string", "CREDENTIAL", 0.9, _w("connection string|postgres://|mysql://|mongodb://"), right=64, priority=18),
    KeywordRule("card_number", "CARD_NUMBER", 0.78, _w("card number|debit card|credit card|pan"), _ND + r"(?:\d[ -]?){13,19}(?!\d)", priority=20),
    KeywordRule("contact_phone", "PHONE", 0.68, _w("phone|mobile|cell|whatsapp"), _ND + _PHONE % 6 + r"(?!\d)", priority=20),
    KeywordRule("credential_password", "CREDENTIAL", 0.85, _w("password|passcode|pass code|pwd|passphrase"), right=24, priority=20),
    KeywordRule("credential_otp", "CREDENTIAL", 0.8, _w("otp|one-time passcode|one time password|verification code"), _ND + r"\d{4,8}(?!\d)", priority=22),
    KeywordRule("credential_pin", "CREDENTIAL", 0.76, _w("pin|security number"), _ND + r"\d{4,6}(?!\d)", priority=22),
    KeywordRule("credential_token", "CREDENTIAL", 0.83, _w("secret|token|api key|api-key|bearer token"), right=32, priority=25),
    KeywordRule("nhs_number_heuristic", "NHS_NUMBER", 0.85, _w("nhs number|nhs"), _ND + r"[\s-]?".join((r"\d{3}", r"\d{3}", r"\d{4}")) + r"(?!\d)", priority=25),
    KeywordRule("health_condition_terms", "MEDICAL_INFO", 0.9, _w("asthma|depression|anxiety|panic attack|mental health"), priority=27),
    KeywordRule("biometric_context", "BIOMETRIC", 0.72, _w("fingerprint|face id|voiceprint|iris scan|retina"), right=24, priority=30),
    KeywordRule("gov_identity", "GOV_ID", 0.7, _w("ssn|social security|passport|driver|license|aadhaar|pan"), _ND + r"\d{6,12}(?!\d)", priority=30),
    KeywordRule("swift_routing", "BANK_ACCOUNT", 0.62, _w("swift|routing|sort code|ifsc"), r"\b(?:[a-z]{4}\w{7}|\d{6,12})\b", True, priority=30),
    KeywordRule("device_id", "DEVICE_ID", 0.64, _w("device id|imei|udid|android id"), _NW + r"[0-9A-Fa-f]{8,}(?!\w)", priority=35),
    KeywordRule("medical_context", "MEDICAL_INFO", 0.7, _w("diagnosis|diagnosed|treatment|symptom|medical condition|allergy"), right=32, priority=35),
    KeywordRule("medication_context", "MEDICATION", 0.65, _w("medication|medicine|prescription|rx|tablet|pill"), right=32, priority=36),
    KeywordRule("hospital_context", "HOSPITAL", 0.62, _w("hospital|clinic|nhs trust"), right=32, priority=38),
    KeywordRule("contact_address", "ADDRESS", 0.65, _w("home address|residence|shipping address|billing address"), right=32, priority=40),
    KeywordRule("employment_id", "EMPLOYMENT_ID", 0.65, _w("employee id|staff id|payroll id"), _NW + r"[a-z]?\d{4,10}(?!\w)", True, priority=45),
    KeywordRule("employment_employer", "EMPLOYER_NAME", 0.6, _w("employer|company|works at|employed by"), right=48, priority=50),
    KeywordRule("job_title", "JOB_TITLE", 0.55, _w("job title|role|position"), right=48, priority=60),
    KeywordRule("travel_plan", "TRAVEL_PLAN", 0.55, _w("itinerary|flight|train|hotel booking|check-in"), right=48, priority=65),
), key=lambda r: (r.priority, r.id)))

SAFE_DOMAINS = _w("example.com|localhost|noreply.example.com|noreply.example.co.uk|support.example.com")
ALLOWED = ("order-12345678", "ticket-00000000")
BUSINESS_TERMS = ("inv-", "invoice", "order id", "product id", "ref ", "reference", "sku", "ticket")
BUSINESS_TYPES = _w("BANK_ACCOUNT|CARD_NUMBER|CUSTOMER_ID|IBAN|SORT_CODE")

#: In the order of their results.
DETECTORS = ("regex", "ner", "ml_ner", "embedding", "domain_heuristic", "ml_token")
WEIGHTS = dict(zip(DETECTORS, (1.0, 0.9, 0.9, 0.7, 0.8, 0.85)))

LABELS = _w("LOW|MEDIUM|HIGH|VERY_HIGH")
#: (label, lowest, highest), both inclusive, the lower label first.
THRESHOLDS = (("LOW", 0.0, 0.25), ("MEDIUM", 0.25, 0.6), ("HIGH", 0.6, 0.85), ("VERY_HIGH", 0.85, 1.0))


def _rule(line: str) -> dict:
    rid, prio, least, types, shown = line.split()
    out = {"id": rid, "priority": int(prio), "pii_types": types.split(","), "enabled": True}
    out |= {"severity_in": [least[3:]]} if least.startswith("in:") else {"severity_at_least": least}
    out["action"] = {"decision": "ALLOW"} if shown == "-" else {"decision": "MASK", "mask_strategy": "placeholder", "mask_args": {"placeholder": f"<{shown}>"}}
    return out


POLICY_RULES: tuple[dict, ...] = tuple(map(_rule, """\
credentials_any 100 LOW CREDENTIAL,PASSWORD,PIN,TOKEN,API_KEY,SESSION_ID CREDENTIAL
financial_any 95 LOW BANK_ACCOUNT,IBAN,CARD_NUMBER,SORT_CODE,TRANSACTION_ID FINANCIAL
customer_identifiers 94 LOW CUSTOMER_ID CUSTOMER_ID
government_ids 93 LOW NI_NUMBER,NHS_NUMBER,PASSPORT_NUMBER,DRIVING_LICENSE,GOV_ID GOV_ID
person_identity_mask 92 LOW PERSON,PERSON_NAME PERSON
health_mask 92 LOW MEDICAL_INFO,MEDICATION,DIAGNOSIS,HOSPITAL,HEALTH_CONTEXT MEDICAL_INFO
online_identifiers 91 LOW IP_ADDRESS,IPV6_ADDRESS,MAC_ADDRESS,DEVICE_ID,COOKIE_ID,TRACKING_ID ONLINE_ID
url_mask_low 90 LOW URL URL
dob_and_dates 85 HIGH DATE DATE
contact_medium_plus 70 MEDIUM EMAIL,PHONE,SOCIAL_HANDLE CONTACT
address_location_mask 65 MEDIUM ADDRESS,POSTCODE ADDRESS
employment_mask 64 MEDIUM EMPLOYER_NAME,JOB_TITLE,EMPLOYMENT_ID,STUDENT_ID,DEGREE EMPLOYMENT
location_activity_mask 63 LOW GEO_COORDINATES,TRAVEL_PLAN,EVENT_CHECKIN,ACTIVITY_PATTERN LOCATION
contact_low_explicit_allow 25 in:LOW EMAIL,PHONE -
allow_low_generic_number 20 in:LOW GENERIC_NUMBER -""".splitlines()))

# category: types with their priority
_TAXONOMY = """\
AUTHENTICATION PASSWORD:98 API_KEY:96 TOKEN:96 SESSION_ID:95 PIN:94 CREDENTIAL:90
FINANCIAL CARD_NUMBER:92 IBAN:91 BANK_ACCOUNT:90 SORT_CODE:89 CUSTOMER_ID:88 TRANSACTION_ID:87
HEALTH MEDICAL_INFO:88 DIAGNOSIS:86 MEDICATION:86 HOSPITAL:80 HEALTH_CONTEXT:78
GOVERNMENT_ID NI_NUMBER:86 DRIVING_LICENSE:85 NHS_NUMBER:85 PASSPORT_NUMBER:85 GOV_ID:83
CONTACT EMAIL:80 PHONE:79 SOCIAL_HANDLE:68
ADDRESS_LOCATION ADDRESS:78 POSTCODE:77
EMPLOYMENT_EDUCATION EMPLOYMENT_ID:75 EMPLOYER_NAME:70 STUDENT_ID:70 DEGREE:60 JOB_TITLE:60
LOCATION_ACTIVITY GEO_COORDINATES:72 TRAVEL_PLAN:68 ACTIVITY_PATTERN:65 EVENT_CHECKIN:65
PERSON_IDENTITY PERSON:72 PERSON_NAME:72
URL_RESOURCE URL:70
ONLINE_DEVICE IPV6_ADDRESS:66 IP_ADDRESS:66 DEVICE_ID:64 MAC_ADDRESS:64 COOKIE_ID:62 TRACKING_ID:62
- ORGANIZATION:50 DATE:40 MONEY:38 GENERIC_NUMBER:15"""
PRIORITY: dict[str, int] = {}
CATEGORY: dict[str, str] = {}
for _line in _TAXONOMY.splitlines():
    _c, *_types = _line.split()
    for _t in _types:
        _t, _p = _t.split(":")
        PRIORITY[_t] = int(_p)
        if _c != "-":
            CATEGORY[_t] = _c
PLACEHOLDER = {t: f"<{t}>" for t in (*CATEGORY, "DATE")} | {
    "EMAIL": "<EMAIL_ADDRESS>", "PHONE": "<PHONE_NUMBER>", "NI_NUMBER": "<UK_NI_NUMBER>", "NHS_NUMBER": "<UK_NHS_NUMBER>", "DRIVING_LICENSE": "<DRIVING_LICENSE_NUMBER>", "PERSON_NAME": "<PERSON>",
}

FAMILIES = (
    frozenset(_w("ADDRESS|GPE|LOC|LOCATION|POSTCODE")),
    frozenset(_w("BANK_ACCOUNT|CARD_NUMBER|CUSTOMER_ID|GENERIC_NUMBER|GOV_ID|PHONE|SORT_CODE")),
)
FINANCIAL = frozenset(_w("BANK_ACCOUNT|CARD_NUMBER|CUSTOMER_ID|IBAN|SORT_CODE|TRANSACTION_ID"))
CREDENTIALS = frozenset(_w("API_KEY|CREDENTIAL|PASSWORD|PIN|SESSION_ID|TOKEN"))
CONTACTS = frozenset(_w("ADDRESS|EMAIL|PHONE|POSTCODE|SOCIAL_HANDLE|URL"))
PLACES = frozenset(_w("ACTIVITY_PATTERN|ADDRESS|EVENT_CHECKIN|GEO_COORDINATES|POSTCODE|TRAVEL_PLAN"))

#: Edges of spans lose these characters.
TRIM = " \t\r\n\"'`“”‘’[](){}<>….,;:!?|/"


def policy_label(score: float) -> str:
    return next((name for name, low, high in THRESHOLDS if low <= score <= high), LABELS[-1])
