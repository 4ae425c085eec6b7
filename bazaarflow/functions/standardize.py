"""Standardizers: a Column of raw text to a struct (value, status). Raw nulls count as empty text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reference_data import CATEGORIES, CONVERTED, DISTRICT_ALIASES, DISTRICTS, MOBILE_MONEY, PAYMENTS, UNITS, spellings

# Texts that stand for nothing; phones and prices know one more.
NULL_TOKENS = ["", "nan", "none", "null"]
NULL_TOKENS_NA = [*NULL_TOKENS, "n/a"]
# Formats.
E164 = r"^\+2567\d{8}$"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
SPACES = " \t\n\x0b\x0c\r"
SKU = r"^[A-Z0-9]{3,10}$"
TRANSACTION = r"^TXN\d{6,12}$"
DATE_FORMATS = (("yyyy-M-d", "%Y-%m-%d"), ("d/M/yyyy", "%d/%m/%Y"), ("d-M-yyyy", "%d-%m-%Y"))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def stripped(c: Column) -> Column:
    return F.btrim(text(c), F.lit(SPACES))


def is_null_token(c: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    return F.lower(stripped(c)).isin(tokens)


def result(value: Column, status: Column | str) -> Column:
    return F.struct(value.alias("value"), (F.lit(status) if isinstance(status, str) else status).alias("status"))


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def phone(c: Column) -> Column:
    digits = F.regexp_replace(stripped(c), r"\D", "")
    national = (
        F.when((F.length(digits) == 12) & digits.startswith("256"), F.concat(F.lit("0"), F.substring(digits, 4, 9)))
        .when((F.length(digits) == 9) & digits.startswith("7"), F.concat(F.lit("0"), digits))
        .otherwise(digits)
    )
    return (
        F.when(is_null_token(c, NULL_TOKENS_NA), result(F.lit(""), "missing"))
        .when(national.rlike(r"^07\d{8}$"), result(F.concat(F.lit("+256"), F.substring(national, 2, 9)), "valid"))
        .otherwise(result(stripped(c), "invalid"))
    )


def phone_format(c: Column) -> Column:
    s = stripped(c)
    return (
        F.when(s.isin("", "nan", "None"), "missing")
        .when(s.rlike(E164), "e164")
        .when(s.rlike(r"^07\d{8}$"), "national")
        .when(s.rlike(r"^2567\d{8}$"), "no_plus")
        .when(s.rlike(r"^7\d{8}$"), "no_zero")
        .when(s.rlike(r"^[\d\s-]+$") & s.rlike(r"[\s-]"), "spaced")
        .otherwise("other")
    )


def _coded(c: Column, table: dict[str, list[str]], mapped: Column) -> Column:
    key = F.lower(stripped(c))
    value = lookup(spellings(table))[key]
    return F.when(is_null_token(c), result(F.lit(""), "missing")).when(value.isNotNull(), result(value, mapped)).otherwise(result(stripped(c), "unresolved"))


def unit(c: Column) -> Column:
    return _coded(c, UNITS, F.when(F.lower(stripped(c)).isin(CONVERTED), "converted").otherwise("mapped"))


def category(c: Column) -> Column:
    """Exact labels; `unknown` maps to nothing. Near spellings are a step of its own, cleanse.with_near_labels."""
    key = F.lower(stripped(c))
    value = lookup(spellings(CATEGORIES))[key]
    return (
        F.when(key == "", result(F.lit(""), "missing")).when(key == "unknown", result(F.lit(""), "mapped")).when(value.isNotNull(), result(value, F.lit("mapped"))).otherwise(result(stripped(c), "unresolved"))
    )


def district(c: Column) -> Column:
    """Aliases first, then official names. An official name that is another's alias is told apart as exact_remapped.

    Near spellings are a step of its own, cleanse.with_near_labels.
    """
    key = F.lower(stripped(c))
    alias = lookup(spellings(DISTRICT_ALIASES))[key]
    official = lookup({d.lower(): d for d in DISTRICTS})[key]
    status = F.when(official.isNull(), "variant_mapped").when(official == alias, "exact").otherwise("exact_remapped")
    return (
        F.when(is_null_token(c), result(F.lit(""), "missing")).when(alias.isNotNull(), result(alias, status)).when(official.isNotNull(), result(official, F.lit("exact"))).otherwise(result(stripped(c), "unresolved"))
    )


def date(c: Column) -> Column:
    out = None
    s = stripped(c)
    out = F.when(is_null_token(c), result(F.lit(""), "missing"))
    for pattern, name in DATE_FORMATS:
        shape = {"%Y-%m-%d": r"^\d{4}-\d{1,2}-\d{1,2}$", "%d/%m/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$", "%d-%m-%Y": r"^\d{1,2}-\d{1,2}-\d{4}$"}[name]
        parsed = F.to_date(F.try_to_timestamp(F.when(s.rlike(shape), s), F.lit(pattern)))
        out = out.when(parsed.isNotNull(), result(F.date_format(parsed, "yyyy-MM-dd"), name))
    return out.otherwise(result(s, "unparseable"))


def gender(c: Column) -> Column:
    key = F.lower(stripped(c))
    return F.when(is_null_token(c), result(F.lit(""), "missing")).when(key.isin("male", "m"), result(F.lit("M"), "mapped")).when(key.isin("female", "f"), result(F.lit("F"), "mapped")).otherwise(result(stripped(c), "unresolved"))


def price(c: Column) -> Column:
    """value is DECIMAL(14,2) or null."""
    bare = F.regexp_replace(stripped(c), r"(?i)ugx|[,\s]", "")
    value = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), bare.try_cast("decimal(14,2)"))
    none = F.lit(None).cast("decimal(14,2)")
    return F.when(is_null_token(c, NULL_TOKENS_NA), result(none, "missing")).when(value.isNotNull(), result(value, "valid")).otherwise(result(none, "invalid"))


def name_key(c: Column) -> Column:
    """For matching: lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9 ]", " "), " +", " "))


def full_name(c: Column) -> Column:
    return F.regexp_replace(stripped(c), r"\s+", " ")


def email(c: Column) -> Column:
    return F.lower(stripped(c))


def payment(c: Column) -> Column:
    return lookup(spellings(PAYMENTS))[F.upper(stripped(c))]


def is_mobile_money(c: Column) -> Column:
    return c.isin(MOBILE_MONEY)
