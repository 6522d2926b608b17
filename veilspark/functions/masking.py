"""Mask strategies: column functions (text, args) -> text, by name in STRATEGIES."""

from __future__ import annotations

from collections.abc import Callable

from .expr import Sql, X


def full(text: Sql, char: str = "*") -> Sql:
    return X.repeat(X.lit(char), X.length(text))


def preserve_last_n(text: Sql, char: str = "*", n: int = 4, strict_compat: bool = False) -> Sql:
    """The last ``n`` characters stay.

    n = 0, or n not below the length, would show the whole text; unless
    ``strict_compat``, both hide it all.
    """
    n = max(0, n)
    whole = text if strict_compat else full(text, char)
    if n == 0:
        return whole
    return X.when(X.length(text) <= n, whole).otherwise(X.concat(X.repeat(X.lit(char), X.length(text) - n), X.right(text, X.lit(n))))


def partial_email(text: Sql, char: str = "*", keep_domain: bool = True) -> Sql:
    at = X.instr(text, "@")
    domain = X.substring(text, at + 1, X.length(text))
    return X.when(at <= 1, full(text, char)).otherwise(X.concat(X.substring(text, 1, 1), X.repeat(X.lit(char), at - 2), X.lit("@"), domain if keep_domain else full(domain, char)))


def _replacement(char: str) -> str:
    return "".join("\\" + c if c in "\\$" else c for c in char)


def preserve_format(text: Sql, char: str = "*") -> Sql:
    return X.regexp_replace(text, r"[\p{L}\p{Nd}]", _replacement(char))


def semantic_mask(text: Sql, replacement: str = "[REDACTED]") -> Sql:
    return X.when(text.isNotNull(), X.lit(replacement))


def mask_credential(text: Sql, char: str = "#") -> Sql:
    return full(text, char)


def numeric_token(text: Sql, char: str = "*") -> Sql:
    return X.regexp_replace(text, r"(?U)\d", _replacement(char))


def placeholder(text: Sql, shown: str | None = "[REDACTED]") -> Sql:
    return X.when(text.isNotNull(), X.lit(shown))


STRATEGIES: dict[str, Callable[..., Sql]] = {
    "full": lambda t, a: full(t, a.get("mask_char", "*")),
    "preserve_last_n": lambda t, a: preserve_last_n(t, a.get("mask_char", "*"), int(a.get("last_n", a.get("visible_count", 4))), bool(a.get("strict_compat", False))),
    "partial_email": lambda t, a: partial_email(t, a.get("mask_char", "*"), bool(a.get("keep_domain", True))),
    "preserve_format": lambda t, a: preserve_format(t, a.get("mask_char", "*")),
    "semantic_mask": lambda t, a: semantic_mask(t, a.get("replacement", "[REDACTED]")),
    "mask_credential": lambda t, a: mask_credential(t, a.get("mask_char", "#")),
    "numeric_token": lambda t, a: numeric_token(t, a.get("mask_char", "*")),
    "placeholder": lambda t, a: placeholder(t, a.get("placeholder", "[REDACTED]")),
}
STRATEGIES["preserve_lastn"] = STRATEGIES["preserve_last_n"]


def apply_mask(strategy: str | None, text: Sql, args: dict | None = None) -> Sql:
    """By name, in any case; an unknown or failing strategy hides the whole text."""
    args = args or {}
    f = STRATEGIES.get((strategy or "full").lower(), STRATEGIES["full"])
    try:
        return f(text, args)
    except (TypeError, ValueError):
        return full(text, args.get("mask_char", "*"))
