"""Routing of an entity to a scoring template by its classification labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.functions.text import mapped, normal_label


def template_code(macro_sector: Column, sector: Column, industry: Column, basic_industry: Column) -> Column:
    """'A' general, 'B' bank, 'C' lender; the first rule that fits wins."""
    macro, sec, ind, basic = (normal_label(c) for c in (macro_sector, sector, industry, basic_industry))
    has_token = reduce(lambda a, b: a | b, [ind.contains(token) for token in S.NBFC_TOKENS])
    return (
        F.when(ind.isin(*S.NBFC_INDUSTRY) | has_token, "C")
        .when(basic.isin(*S.BANK_BASIC) | ind.isin(*S.BANK_INDUSTRY) | ind.contains("bank"), "B")
        .when((sec == "financial services") & (basic == "finance") & (ind == "other financial services"), "C")
        .when((sec == "financial services") & (macro == "financial services") & basic.contains("bank"), "B")
        .otherwise("A")
    )


def template_name(code: Column) -> Column:
    return mapped(code, S.TEMPLATE_NAMES, code)
