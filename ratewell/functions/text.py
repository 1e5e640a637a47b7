"""Cleaning and parsing of untyped text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewell import settings as S


def is_missing(x: Column) -> Column:
    """Blank or one of the tokens that stand for a missing cell."""
    return x.isNull() | F.lower(F.trim(x)).isin(*S.MISSING_TOKENS)


def is_unset(x: Column) -> Column:
    """Blank or a token that a universe merge replaces; unlike :func:`is_missing` it goes by case."""
    return x.isNull() | F.trim(x).isin(*S.UNSET_TOKENS)


_NUMBER = "^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)$"


def number_sql(cell: str) -> str:
    """SQL of a lenient number parse: '₹ 1,234.5 Cr' -> 1234.5; missing tokens, NaN, infinities, bad text -> null."""
    return f"try_cast(regexp_extract(trim(regexp_replace({cell}, '[,%₹]|Cr', '')), '{_NUMBER}', 1) as double)"


def parse_number(x: Column | str) -> Column:
    """Number of a text column, see :func:`number_sql`."""
    if isinstance(x, str):
        return F.expr(number_sql(f"`{x}`"))
    return F.regexp_extract(F.trim(F.regexp_replace(x, "[,%₹]|Cr", "")), _NUMBER, 1).try_cast("double")


def parse_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "y", "t"), F.lit(False))


def parse_events(x: Column) -> Column:
    """Split on ';' when present, else on ','; trims items and drops blanks."""
    items = F.when(x.contains(";"), F.split(x, ";")).otherwise(F.split(x, ","))
    return F.coalesce(F.filter(F.transform(items, lambda e: F.trim(e)), lambda e: e != ""), F.array().cast("array<string>"))


def clean_symbol(x: Column) -> Column:
    """Trimmed upper-case symbol without the exchange suffix; missing tokens become ''."""
    symbol = F.upper(F.trim(x))
    return F.when(symbol.isNull() | symbol.isin("", "NAN", "NONE", "-"), F.lit("")).otherwise(
        F.replace(symbol, F.lit(".NS"), F.lit(""))
    )


def normal_label(x: Column) -> Column:
    """Lower case with whitespace runs collapsed to one blank."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"\s+", " ")


def parse_date(x: Column, formats: Sequence[str] = ("yyyyMMdd", "ddMMMyyyy", "ddMMyyyy", "yyyy-MM-dd")) -> Column:
    """First format that fits; month names in any case."""
    token = F.initcap(F.lower(F.regexp_replace(F.trim(x), r"(\d)([A-Za-z]{3})(\d)", "$1 $2 $3")))
    tries = []
    for fmt in formats:
        text = token if "MMM" in fmt else F.trim(x)
        tries.append(F.try_to_timestamp(text, F.lit(fmt.replace("ddMMMyyyy", "dd MMM yyyy"))).cast("date"))
    return F.coalesce(*tries)


def parse_stage(x: Column) -> Column:
    """'Stage 2' -> 2; anything unreadable -> 1."""
    return F.coalesce(F.trim(F.replace(F.trim(x), F.lit("Stage"), F.lit(""))).try_cast("int"), F.lit(1))


def mapped(x: Column, table: Mapping, default: Column | None = None) -> Column:
    """Value of a small fixed table."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    hit = F.try_element_at(F.create_map(*pairs), x)
    return hit if default is None else F.coalesce(hit, default)


def normal_recommendation(x: Column) -> Column:
    text = F.trim(F.coalesce(x, F.lit("")))
    return mapped(F.lower(text), S.RECOMMENDATION_ALIASES, text)


def metric_name(x: Column) -> Column:
    return mapped(x, S.METRIC_NAMES, F.replace(x, F.lit("_"), F.lit(" ")))


def is_fund_like(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(S.FUND_NAME_PATTERN), F.lit(False))


def delivery_pct(given: Column, delivered: Column, traded: Column) -> Column:
    """Stated delivery percentage, else delivered / traded."""
    return F.coalesce(
        parse_number(given),
        F.when(parse_number(traded) > 0, parse_number(delivered) / parse_number(traded) * 100.0),
    )


def holder_column(category: Column) -> Column:
    """Holding column a shareholder category belongs to (first rule that fits)."""
    c = F.lower(category)
    return (
        F.when(c.contains("promoter") & c.contains("group"), "promoter_holding_pct")
        .when(c.contains("mutual fund"), "mf_holding_pct")
        .when(c.contains("foreign") & (c.contains("institutional") | c.contains("fpi")), "fii_holding_pct")
        .when(c.contains("insurance"), "insurance_holding_pct")
    )
