"""A vendor-style text export per supplier, computed from lineitem.

Every cell is an arithmetic expression over integer aggregates of the supplier's lines, in SQL both
Spark and other engines evaluate alike; ``supplier_export`` renders the cells as the untyped text a
vendor file holds (thousands separators, percent signs, assorted missing tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.sources.tables import supplier_ticker, suppliers, table

_CENTS = "cast(round(l_extendedprice * 1e2) as bigint)"
AGGREGATES = {
    "n": "count(*)",
    "qty": "sum(cast(l_quantity as bigint))",
    "rev": f"sum({_CENTS})",
    **{f"rev{y}": f"sum(case when year(l_shipdate) = 19{y} then {_CENTS} else 0 end)" for y in (95, 96, 97, 98, 99)},
    "rev00": f"sum(case when year(l_shipdate) = 2000 then {_CENTS} else 0 end)",
    "qty98": "sum(case when year(l_shipdate) = 1998 then cast(l_quantity as bigint) else 0 end)",
    "qty99": "sum(case when year(l_shipdate) = 1999 then cast(l_quantity as bigint) else 0 end)",
    "qty00": "sum(case when year(l_shipdate) = 2000 then cast(l_quantity as bigint) else 0 end)",
    "returned": f"sum(case when l_returnflag = 'R' then {_CENTS} else 0 end)",
    "open_": f"sum(case when l_linestatus = 'O' then {_CENTS} else 0 end)",
}

# header, expression over the aggregates and the key k, cell missing for every m-th key (0 = never), style
CELLS = [
    ("P/E", "(500 + rev % 4000) / 1e2", 11, "plain"),
    ("Price to Book value", "(50 + qty % 600) / 1e2", 13, "plain"),
    ("EV / EBITDA", "(300 + rev98 % 2500) / 1e2", 0, "plain"),
    ("FCF Yield", "(rev97 % 2000 - 500) / 1e2", 9, "pct"),
    ("Historical PB Band", "(6000 + rev96 % 9000) / 1e2", 6, "plain"),
    ("Sales growth 3Years", "floor((rev00 - rev97) * 1e3 / (rev97 + 1)) / 1e1", 7, "pct"),
    ("Profit growth 3Years", "floor((qty00 - qty98) * 1e3 / (qty98 + 1)) / 1e1", 8, "pct"),
    ("Sales growth", "floor((rev00 - rev99) * 1e3 / (rev99 + 1)) / 1e1", 0, "pct"),
    ("Profit growth", "floor((qty00 - qty99) * 1e3 / (qty99 + 1)) / 1e1", 12, "pct"),
    ("Peer Growth Rank", "(rev95 % 10000) / 1e2", 5, "plain"),
    ("Growth Stability", "(qty98 % 1000) / 1e1", 10, "plain"),
    ("Deposit Growth", "(rev99 % 6000 - 2000) / 1e2", 0, "pct"),
    ("AUM Growth", "(rev98 % 7000 - 2500) / 1e2", 0, "pct"),
    ("ROCE 3Years", "(rev % 3500) / 1e2", 14, "pct"),
    ("OPM", "(rev99 % 4500) / 1e2", 15, "pct"),
    ("CFO/PAT", "(rev98 % 250) / 1e2", 9, "plain"),
    ("Margin Trend", "(rev97 % 900 - 400) / 1e2", 11, "plain"),
    ("ROA", "(rev96 % 1800) / 1e2", 0, "pct"),
    ("FCF Consistency", "(qty99 % 6) * 2e1", 13, "plain"),
    ("ROE", "(qty00 % 3000 - 200) / 1e2", 10, "pct"),
    ("NIM", "(rev95 % 800) / 1e2", 0, "pct"),
    ("Cost to Income", "(3000 + rev00 % 5000) / 1e2", 0, "pct"),
    ("Provision Coverage", "(4000 + rev99 % 6000) / 1e2", 16, "pct"),
    ("Credit Cost", "(rev98 % 400) / 1e2", 0, "pct"),
    ("Relative Strength", "(rev00 % 10000) / 1e2", 6, "plain"),
    ("Delivery Score", "(2000 + qty % 6000) / 1e2", 9, "plain"),
    ("RS Turn", "(qty99 % 200 - 100) / 1e3", 7, "plain"),
    ("Pledged percentage", "(returned % 7000) / 1e2", 5, "pct"),
    ("Intrinsic Value", "(100000 + rev99 % 900000) / 1e2", 4, "comma"),
    ("Book Value Per Share", "(5000 + rev97 % 90000) / 1e2", 6, "comma"),
    ("EPS TTM", "(rev00 % 30000 - 2000) / 1e2", 5, "plain"),
    ("EPS FY0", "(rev99 % 30000 - 2000) / 1e2", 7, "plain"),
    ("EPS FY1", "(rev98 % 30000 - 2000) / 1e2", 8, "plain"),
    ("EPS FY2", "(rev97 % 30000 - 2000) / 1e2", 9, "plain"),
    ("Debt to equity", "(open_ % 600) / 1e2", 6, "plain"),
    ("Interest Coverage", "(95 + returned % 800) / 1e2", 7, "plain"),
    ("Credit Rating Grade", "1e0 + rev % 7", 3, "plain"),
    ("GNPA %", "(rev96 % 1200) / 1e2", 4, "pct"),
    ("NNPA %", "(rev95 % 600) / 1e2", 4, "pct"),
    ("CAR %", "(1050 + qty % 900) / 1e2", 5, "pct"),
    ("PCR %", "(3500 + rev97 % 6000) / 1e2", 0, "pct"),
    ("ALM ST %", "(rev98 % 4800) / 1e2", 3, "pct"),
    ("ASM Stage", "case when rev % 9 = 0 then 3e0 when rev % 7 = 0 then 1e0 else 0e0 end", 0, "int"),
    ("GSM Stage", "case when qty % 41 = 0 then 1e0 else 0e0 end", 0, "int"),
    ("Beneish M Score", "(rev00 % 300 - 350) / 1e2", 6, "plain"),
    ("Current Ratio", "(50 + rev97 % 250) / 1e2", 8, "plain"),
    ("Current Ratio Prev Year", "(50 + rev96 % 250) / 1e2", 0, "plain"),
    ("Dividend Yield", "(qty98 % 600) / 1e2", 9, "pct"),
    ("Promoter Holding %", "(3000 + rev98 % 4000) / 1e2", 4, "pct"),
    ("Promoter Holding Prev %", "(3000 + rev98 % 4000 + rev97 % 500 - 250) / 1e2", 5, "pct"),
    ("Gross Block", "(10000 + rev99 % 90000) / 1e2", 7, "comma"),
    ("Gross Block 3Y Ago", "(10000 + rev96 % 60000) / 1e2", 0, "comma"),
    ("Asset Turnover", "(5 + qty99 % 250) / 1e2", 6, "plain"),
    ("Asset Turnover Prev Year", "(5 + qty98 % 250) / 1e2", 0, "plain"),
    ("OPM FY1", "(rev98 % 4500) / 1e2", 8, "pct"),
    ("OPM FY2", "(rev97 % 4500) / 1e2", 3, "pct"),
    ("ROA Prev Year", "(rev95 % 1800) / 1e2", 5, "pct"),
    ("D/E Prev Year", "(open_ % 700) / 1e2", 6, "plain"),
    ("Cash from Operations", "(rev99 % 500000 - 100000) / 1e2", 7, "comma"),
]
EVENTS = [("sebi_penalty_minor", 17), ("auditor_resignation", 23), ("agm_delayed", 7)]


def cell_sql(expression: str, every: int) -> str:
    return f"case when k % {every} = 0 then null else {expression} end" if every else expression


def supplier_export(spark: SparkSession, folder: str) -> DataFrame:
    sums = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        *[F.expr(sql).alias(name) for name, sql in AGGREGATES.items()])
    rows = suppliers(spark, folder).join(sums, F.col("suppkey") == F.col("k"))
    token = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "nan").otherwise("-")

    def text(sql: str, every: int, style: str):
        value = F.expr(cell_sql(sql, every))
        shown = {
            "plain": F.format_string("%.3f", value),
            "pct": F.concat(F.format_string("%.2f", value), F.lit("%")),
            "comma": F.format_number(value, 2),
            "int": F.format_string("%.0f", value),
        }[style]
        return F.when(value.isNull(), token).otherwise(shown)

    events = F.array_join(F.array_compact(F.array(*[
        F.when(F.col("qty") % m == 0, F.lit(e)) for e, m in EVENTS])), "; ")
    return rows.select(
        supplier_ticker(F.col("k")).alias("NSE Symbol"), F.col("name").alias("Name"),
        F.col("macro_sector").alias("Macro Sector"), F.col("sector").alias("Sector"),
        F.col("industry").alias("Industry"), F.col("basic_industry").alias("Basic Industry"),
        *[text(sql, every, style).alias(header) for header, sql, every, style in CELLS],
        F.when(F.col("rev") % 19 == 0, "Yes").otherwise("no").alias("T2T"), events.alias("Governance Events"))
