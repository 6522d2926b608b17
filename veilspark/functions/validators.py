"""Validators: column functions string -> boolean, by name in VALIDATORS."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from .expr import Sql, X
from .rules import SAFE_DOMAINS
from .text import let


def digits_of(text: Sql) -> Sql:
    return X.regexp_replace(text, r"(?U)\D", "")


OTHER_DIGITS = [chr(c) for c in range(128, 0x1FC00) if unicodedata.category(chr(c)) == "Nd"]


def plain_digits(text: Sql) -> Sql:
    """``text`` with decimal digits of all scripts as ASCII ones."""
    return X.when(X.octet_length(text) > X.length(text), X.translate(text, X.lit("".join(OTHER_DIGITS)), X.lit("".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)))).otherwise(text)


def card_luhn(text: Sql) -> Sql:
    n = X.regexp_replace(plain_digits(text), "[ -]", "")
    return n.rlike("^[0-9]{12,}$") & X.luhn_check(n)


def sort_code(text: Sql) -> Sql:
    n = X.regexp_replace(plain_digits(text), "[- ]", "")
    return n.rlike("^[0-9]{6}$") & (n != "000000")


def gb_iban(text: Sql) -> Sql:
    """Mod 97 of the rotated number; letters count 10 to 35, one character at a time, so no large integer is needed."""
    n = X.upper(X.regexp_replace(plain_digits(text), r"(?U)\s", ""))

    def step(rest: Sql, c: Sql) -> Sql:
        v = X.instr(X.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return X.when(v < 10, (rest * 10 + v) % 97).otherwise((rest * 100 + v) % 97)

    turned = X.concat(X.substring(n, 5, 18), X.substring(n, 1, 4))
    return n.rlike("^GB[0-9A-Z]{20}$") & (X.aggregate(X.filter(X.split(turned, ""), lambda c: c != ""), X.lit(0), step) == 1)


def nino(text: Sql) -> Sql:
    return X.upper(X.regexp_replace(plain_digits(text), r"(?U)\s", "")).rlike("^[A-Z]{2}[0-9]{6}[A-D]$")


def nhs_number(text: Sql) -> Sql:
    """Weights 10 to 2, mod 11; 11 stands for 0 and 10 is invalid."""
    n = X.regexp_replace(plain_digits(text), r"(?U)\s", "")
    total = X.aggregate(X.sequence(X.lit(1), X.lit(9)), X.lit(0), lambda a, i: a + (11 - i) * X.substring(n, i, X.lit(1)).try_cast("int"))
    check = 11 - total % 11
    return n.rlike("^[0-9]{10}$") & X.coalesce((check != 10) & (check % 11 == X.substring(n, 10, 1).try_cast("int")), X.lit(False))


def email_safe(text: Sql) -> Sql:
    domain = X.lower(X.substring(text, X.instr(text, "@") + 1, X.length(text)))
    return (X.instr(text, "@") > 0) & ~domain.isin(*SAFE_DOMAINS)


def ipv4(text: Sql) -> Sql:
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return text.rlike(rf"^(?:{byte}\.){{3}}{byte}$")


def ipv6(text: Sql) -> Sql:
    """Eight groups of one to four hex digits, or at most seven and one ``::``."""
    full = text.rlike(r"(?i)^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$")
    groups = X.size(X.filter(X.split(text, ":", -1), lambda g: g != ""))
    short = (X.regexp_count(text, X.lit("::")) == 1) & ~text.contains(":::") & ~text.rlike("^:[^:]") & ~text.rlike("[^:]:$") & (groups <= 7)
    return text.rlike(r"(?i)^(?:[0-9a-f]{0,4}:){2,}[0-9a-f]{0,4}$") & (full | short)


def pin(text: Sql) -> Sql:
    return text.rlike(r"(?U)^(?!(\d)\1*$)\d{4,6}$")


def password(text: Sql) -> Sql:
    return (X.length(text) >= 6) & ~X.lower(text).isin("password", "passcode", "pwd") & ~text.rlike(r"(?U)^\d+$")


def date(text: Sql) -> Sql:
    """D/M/Y, or Y/M/D where the first part has four digits; a year below 50 is of this century."""

    def check(p: Sql) -> Sql:
        n = X.transform(p, lambda x: plain_digits(x).try_cast("int"))
        iso = X.length(p[0]) == 4
        day, month, year = X.when(iso, n[2]).otherwise(n[0]), n[1], X.when(iso, n[0]).otherwise(n[2])
        full = X.when(year < 50, year + 2000).otherwise(year)
        return X.coalesce((X.size(p) == 3) & day.between(1, 31) & month.between(1, 12) & full.between(1800, 2100), X.lit(False))

    return let(X.concat(X.split(X.trim(text), "[/-]", -1), X.array(X.lit(""), X.lit(""), X.lit(""))), lambda p: let(X.slice(p, 1, X.size(p) - 3), lambda own: X.when(X.size(own) == 3, check(own)).otherwise(X.lit(False))))


def money(text: Sql) -> Sql:
    return X.length(digits_of(text)).between(1, 8)


def phone_len(text: Sql) -> Sql:
    return X.length(digits_of(text)).between(10, 15)


def roll_number(text: Sql) -> Sql:
    return X.length(text).between(7, 20) & text.rlike(r"(?U)\d") & text.rlike(r"\p{L}")


def gps(text: Sql) -> Sql:
    text = plain_digits(text)
    lat, lon = X.regexp_substr(text, X.lit(r"^[^,]+")), X.trim(X.regexp_replace(text, r"(?U)^[^,]*,\s*", ""))
    return X.coalesce(lat.try_cast("double").between(-90, 90) & lon.try_cast("double").between(-180, 180), X.lit(False))


def always(text: Sql) -> Sql:
    return X.lit(True)


VALIDATORS: dict[str, Callable[[Sql], Sql]] = {f.__name__: f for f in (card_luhn, sort_code, gb_iban, nino, nhs_number, email_safe, ipv4, ipv6, pin, password, date, money, phone_len, roll_number, gps)}
VALIDATORS |= dict.fromkeys(("account_number", "postcode", "passport", "driving_license", "mac_address", "url"), always)
