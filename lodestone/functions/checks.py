"""Checks of identifiers on columns, and patterns of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: kinds in order of precedence, pattern, mask ------------------------------
IBAN = r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b"
CARD = r"\b(?:\d{4}[ -]?){3}\d{4}\b"
TCKN = r"\b[1-9]\d{10}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+90|0)?[ ]?\(?5\d{2}\)?[ ]?\d{3}[ -]?\d{2}[ -]?\d{2}\b"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
KINDS = (
    ("iban", IBAN, "[IBAN-MASKELENDI]"),
    ("card", CARD, "[KART-MASKELENDI]"),
    ("tckn", TCKN, "[TCKN-MASKELENDI]"),
    ("email", EMAIL, "[EPOSTA-MASKELENDI]"),
    ("phone", PHONE, "[TELEFON-MASKELENDI]"),
    ("ip", IP, "[IP-MASKELENDI]"),
)
# ---------------------------------------------------------------------------------------------


def _digits(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.cast("int"))


def tckn_ok(c: Column) -> Column:
    """11 digits: the tenth from weighted sums of the odd and even ones, the last from all."""
    d = _digits(c)
    at = lambda i: F.get(d, F.lit(i))
    odd, even = at(0) + at(2) + at(4) + at(6) + at(8), at(1) + at(3) + at(5) + at(7)
    ok = (at(9) == F.pmod(odd * 7 - even, F.lit(10))) & (at(10) == F.pmod(odd + even + at(9), F.lit(10)))
    return F.when(c.rlike(r"^[1-9][0-9]{10}$"), ok).otherwise(False)


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits, whatever stands between, that pass Luhn's check."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False)


def iban_ok(c: Column) -> Column:
    s = F.regexp_replace(c, r"\s", "")
    moved = F.upper(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4)))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), lambda r, x: ((r * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97).cast("int"))
    return F.when(s.rlike(r"^[A-Za-z0-9]{15,34}$"), rest == 1).otherwise(False)


def ip_ok(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


CHECKS = {"iban": iban_ok, "card": luhn_ok, "tckn": tckn_ok, "email": lambda c: F.lit(True), "phone": lambda c: F.lit(True), "ip": ip_ok}


def matches(c: Column, kind: str) -> Column:
    """All valid matches of one kind."""
    pattern = next(p for k, p, _ in KINDS if k == kind)
    return F.filter(F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(0)), CHECKS[kind])
