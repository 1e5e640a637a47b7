"""Header and value alias resolution, and the column surgery around wide exports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell import columns as H
from ratewell import settings as S
from ratewell.functions.text import is_unset, number_sql, parse_bool, parse_events

PREFIX = "fund__"


def normal_header(name: str) -> str:
    return "".join(ch for ch in str(name).lower() if ch.isalnum())


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def find_column(columns: Iterable[str], aliases: Iterable[str]) -> str | None:
    """First alias that some header matches, ignoring case and punctuation."""
    known = {normal_header(c): c for c in columns}
    return next((known[normal_header(a)] for a in aliases if normal_header(a) in known), None)


def first_value_sql(columns: Sequence[str], aliases: Iterable[str]) -> str | None:
    """SQL of the first non-blank cell among the aliases, each tried plain and then prefixed; None if no header fits."""
    known = {normal_header(c): c for c in columns}
    hits = dict.fromkeys(
        known[k] for a in aliases for k in (normal_header(a), normal_header(PREFIX + a)) if k in known)
    cells = [f"if(trim(`{c}`) != '', string(`{c}`), null)" for c in hits]
    return f"coalesce({', '.join(cells)})" if cells else None


def first_value(columns: Sequence[str], aliases: Iterable[str]) -> Column:
    return F.expr(first_value_sql(columns, aliases) or "string(null)")


def _number(columns: Sequence[str], aliases: Iterable[str]) -> Column:
    cell = first_value_sql(columns, aliases)
    return F.expr(number_sql(cell) if cell else "double(null)")


def metric_columns(columns: Sequence[str], metrics: Iterable[str] | None = None) -> dict[str, Column]:
    """Parsed metric columns of a text export (by default those some card weighs)."""
    wanted = list(S.configured_metrics() if metrics is None else metrics)
    return {m: _number(columns, H.METRIC_HEADERS.get(m, [])) for m in wanted}


def input_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Parsed raw inputs: stages as int (0 if unreadable), flags, event lists, numbers."""
    out: dict[str, Column] = {}
    for name, aliases in H.INPUT_HEADERS.items():
        if name == "is_t2t":
            out[name] = parse_bool(first_value(columns, aliases))
        elif name == "governance_events":
            out[name] = parse_events(first_value(columns, aliases))
        elif name in ("asm_stage", "gsm_stage"):
            out[name] = F.coalesce(_number(columns, aliases).cast("int"), F.lit(0))
        else:
            out[name] = _number(columns, aliases)
    return out


def taxonomy_columns(columns: Sequence[str]) -> dict[str, Column]:
    """The four labels; 'Diversified' where missing, basic industry falling back to industry."""
    label = {level: F.coalesce(F.trim(first_value(columns, a)), F.lit("Diversified"))
             for level, a in H.TAXONOMY_HEADERS.items()}
    basic = F.trim(first_value(columns, H.TAXONOMY_HEADERS["basic_industry"]))
    label["basic_industry"] = F.when(
        basic.isNull() | F.lower(basic).isin("", "diversified"), label["industry"]).otherwise(basic)
    return label


def prefixed(df: DataFrame, key: str, prefix: str = PREFIX) -> DataFrame:
    """Prefix every column but the key, once however often it is applied; the first of equal names stays."""
    out: dict[str, str] = {}
    for c in df.columns:
        base = c
        while base.startswith(prefix):
            base = base[len(prefix):]
        out.setdefault(c if c == key else prefix + base, c)
    return df.select(*[quoted(old).alias(new) for new, old in out.items()])


def fill_missing(df: DataFrame, columns: Iterable[str], prefix: str = PREFIX) -> DataFrame:
    """Keep a cell unless it is unset, else take the prefixed twin; creates absent columns."""
    have = set(df.columns)
    changes = {}
    for c in columns:
        if prefix + c not in have:
            continue
        own = quoted(c) if c in have else F.lit("")
        changes[c] = F.when(~is_unset(own), own).otherwise(quoted(prefix + c))
    return df.withColumns(changes) if changes else df


def in_template_order(df: DataFrame, template: Sequence[str]) -> DataFrame:
    """Template columns first (blank where absent), extra columns after."""
    have = set(df.columns)
    return df.select(
        *[(quoted(c) if c in have else F.lit("")).alias(c) for c in template],
        *[quoted(c) for c in df.columns if c not in template])
