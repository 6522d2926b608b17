"""Plain Python of what the detectors, the policy and the redaction are to give; written from the description, not from the engine."""

import ipaddress
import re

from veilspark.functions.rules import ALLOWED, BUSINESS_TERMS, KEYWORD_RULES, SAFE_DOMAINS, SCAN_RULES, TRIM


def luhn(t):
    n = [int(c) for c in re.sub("[ -]", "", t)]
    return len(n) >= 12 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(n[::-1])) % 10 == 0


def date(t):
    p = re.split("[/-]", t.strip())
    if len(p) != 3:
        return False
    d, m, y = map(int, p[::-1] if len(p[0]) == 4 else p)
    y = y + 2000 if y < 50 else y
    return 1 <= d <= 31 and 1 <= m <= 12 and 1800 <= y <= 2100


def nhs(t):
    n = [int(c) for c in re.sub(r"\s", "", t)]
    c = 11 - sum(w * d for w, d in zip(range(10, 1, -1), n)) % 11
    return c != 10 and c % 11 == n[9]


def iban(t):
    t = re.sub(r"\s", "", t).upper()
    return len(t) == 22 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def address(kind):
    def f(t):
        try:
            return bool(kind(t))
        except ValueError:
            return False

    return f


def gps(t):
    a, b = t.split(",")
    return abs(float(a)) <= 90 and abs(float(b)) <= 180


CHECKS = {
    "card_luhn": luhn, "date": date, "nhs_number": nhs, "gb_iban": iban, "gps": gps, "ipv4": address(ipaddress.IPv4Address), "ipv6": address(ipaddress.IPv6Address),
    "sort_code": lambda t: re.sub("[- ]", "", t) != "000000", "nino": lambda t: True, "email_safe": lambda t: t.split("@", 1)[1].lower() not in SAFE_DOMAINS, "pin": lambda t: len(set(t)) > 1,
    "password": lambda t: t.lower() not in ("password", "passcode", "pwd") and not t.isdigit(), "money": lambda t: 1 <= sum(c.isdigit() for c in t) <= 8, "phone_len": lambda t: 10 <= sum(c.isdigit() for c in t) <= 15,
    "roll_number": lambda t: any(map(str.isdigit, t)) and any(map(str.isalpha, t)),
}
BUSINESS = {"BANK_ACCOUNT", "CARD_NUMBER", "CUSTOMER_ID", "IBAN", "SORT_CODE"}


def once(found):
    seen, out = set(), []
    for d in found:
        if (k := (d[2], d[0], d[1])) not in seen:
            seen.add(k)
            out.append(d)
    return sorted(out, key=lambda d: d[:2])


def scan(text):
    low, out = text.lower(), []
    for r in SCAN_RULES:
        for m in re.finditer(f"(?:{r.before})(?P<span>{r.payload})(?:{r.after})", text, re.I):
            t, a, b = m["span"], m.start("span"), m.end("span")
            near = low[max(0, a - 32) : b + 32]
            if b - a > 128 or any(x in t.lower() for x in ALLOWED) or r.keywords and not any(k in low[max(0, a - 48) : b + 48] for k in r.keywords):
                continue
            if not CHECKS.get(r.validator, lambda t: True)(t):
                continue
            if r.pii_type in BUSINESS and (r.confidence < 0.75 and sum(x in near for x in BUSINESS_TERMS) >= 2 or r.pii_type == "CARD_NUMBER" and "product" in near):
                continue
            out.append((a, b, r.pii_type, t, r.confidence, "regex", r.id))
    return once(out)


def heading(t):
    letters = [c for c in t if c.isalpha()]
    return bool(letters) and sum(map(str.isupper, letters)) / len(letters) >= 0.7 and len(t.split()) <= 8


def trim(text, a, b):
    while a < b and text[a] in TRIM:
        a += 1
    while b > a and text[b - 1] in TRIM:
        b -= 1
    return a, b


def keywords(text):
    out = []
    for r in KEYWORD_RULES:
        for k in re.finditer(r"\b(" + "|".join(map(re.escape, r.keywords)) + r")\b", text, re.I):
            if r.number is not None:
                a = max(0, k.start() - 64)
                w = text[a : k.end() + 64]
                if not heading(w):
                    out += [(a + m.start(), a + m.end(), r.pii_type, m[0], r.score, "domain_heuristic", None) for m in re.finditer(r.number, w, re.I if r.fold_case else 0) if 3 <= len(m[0]) <= 64]
            else:
                end = min(len(text), k.end() + r.right)
                cut = text.find("\n\n", k.end(), end)
                a, b = trim(text, k.start(), end if cut < 0 else cut)
                if 3 <= b - a <= 64 and not heading(text[a:b]):
                    out.append((a, b, r.pii_type, text[a:b], r.score, "domain_heuristic", None))
    return once(out)


def detect(text):
    return scan(text or "") + keywords(text or "")


def splice(text, spans):
    out, at = [], 0
    for s in spans:
        d = s["decision"]
        if d["action"] in ("MASK", "BLOCK"):
            out += [text[at : s["start"]], d["masked_text"] or d["placeholder"] or f"<{s['pii_type']}>"]
            at = s["end"]
    return "".join([*out, text[at:]])
