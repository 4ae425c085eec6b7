"""Masks for personal data. Each leaves only the characters named here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def mask_phone(c: Column) -> Column:
    """The last four digits, if there are nine or more."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(_blank(c), None).when(F.length(digits) >= 9, F.concat(F.lit("+256-XXX-XX"), F.right(digits, F.lit(4)))).otherwise("+256-XXX-XXXX")


def mask_name(c: Column) -> Column:
    """The first letters of the first two words."""
    words = F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+")
    short = lambda w: F.concat(F.substring(w, 1, 1), F.lit("***"))
    two = F.concat(short(F.get(words, F.lit(0))), F.lit(" "), F.substring(F.get(words, F.lit(1)), 1, 1), F.lit("**"))
    return F.when(_blank(c), None).when(F.size(words) < 2, short(F.get(words, F.lit(0)))).otherwise(two)


def mask_email(c: Column) -> Column:
    """The first letter and the domain."""
    s = F.trim(c)
    at = F.instr(s, "@")
    return F.when(_blank(c) | (at == 0), None).otherwise(F.concat(F.substring(s, 1, 1), F.lit("***"), F.substring(s, at, F.length(s))))


def mask_payment_ref(c: Column) -> Column:
    """Two characters at either end of more than four."""
    s = F.trim(c)
    return F.when(_blank(c), None).when(F.length(s) <= 4, "****").otherwise(F.concat(F.left(s, F.lit(2)), F.repeat(F.lit("*"), F.length(s) - 4), F.right(s, F.lit(2))))
