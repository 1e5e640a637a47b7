"""Queries over table digests, configuration, source health and biases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell import settings as S
from ratewell.catalog import sql as Q
from ratewell.catalog.base import query
from ratewell.catalog.history import _LIFE, _PERIOD, _RUNS, _SEV, _SURV, _active_and_gone, _runs
from ratewell.catalog.sql import with_
from ratewell.operators import asof as P
from ratewell.operators import audit as A
from ratewell.operators import quality as K
from ratewell.sources import tables as T

#: Key and columns of every table; f: fractions, t: times, a: lists of fractions, others as they are.
TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal:f c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:f", "part": "p_partkey p_name p_brand p_type p_size p_retailprice:f",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:f o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag l_linestatus l_shipdate:t",
    "events": "event_id ts:t user_id event_type value:f props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:a label",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text"}


def _cell(column: str) -> str:
    name, _, kind = column.partition(":")
    plain = {"f": "floor({}::double * 1e6 + 0.5)::bigint::varchar", "t": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')",
             "a": "array_to_string(list_transform({}, lambda x: coalesce(floor(x::double * 1e6 + 0.5)::bigint::varchar, '\\N')), ',')", "": "{}::varchar"}
    return f"coalesce({plain[kind].format(name)}, '\\N')"


def _digest_sql(columns: str, source: str) -> str:
    cells = " || chr(31) || ".join(map(_cell, columns.split()))
    return f"coalesce(sum(('0x' || left(md5({cells}), 15))::bigint::hugeint), 0) from {source}"


def _table_sql(name: str) -> str:
    key = TABLES[name].split()[0]
    digest, source = _digest_sql(TABLES[name], name).rsplit(" from ", 1)
    return f"select '{name}' as table_name, count(*) as n_rows, {digest}::varchar as digest, min({key})::varchar as first_key, max({key})::varchar as last_key from {source}"


@query("input_manifest", " union all ".join(map(_table_sql, TABLES)))
def input_manifest(spark, sf):
    """Row count, key range and order-free content digest of every input table."""
    return reduce(DataFrame.unionByName, [A.table_digest(T.table(spark, sf, name).select(*[c.partition(":")[0] for c in columns.split()]), name, columns.split()[0])
                                          for name, columns in TABLES.items()])


# --- configuration ---------------------------------------------------------------------------
_CONFIG = "digest as (select " + _digest_sql("template card metric weight:f", "weights").replace(" from weights", "::varchar as digest from weights") + ")"
_LOG = """changes as (select strftime(cast(ts as date) + cast(user_id as integer), '%Y-%m-%d') || 'T' || lpad(event_id::varchar, 12, '0') as t, event_id % 3 = 0 as ours from events where event_type = 'signup'),
 approved as (select case when arg_max(ours, t) then (select digest from digest) else 'b' end as h from changes)"""


def _weights(spark):
    return spark.createDataFrame(S.weight_rows(), "template string, card string, metric string, pos int, weight double")


def _changes(spark, sf):
    """A change log: an entry per signup; each third gives the present weights as the approved ones."""
    day = F.date_add(F.col("ts").cast("date"), F.col("user_id").cast("int")).cast("string")
    digest = A.weights_digest(_weights(spark)).scalar()
    return T.table(spark, sf, "events").where(F.col("event_type") == "signup").select(
        F.concat(day, F.lit("T"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("timestamp"),
        F.when(F.col("event_id") % 3 == 0, digest).otherwise("b").alias("new_config_hash"))


_CHECKED = """case when (select h from approved) = (select digest from digest) then 'Config matches last approved state (' || (select h from approved) || ').'
 else 'CONFIG MISMATCH: Current config hash (' || (select digest from digest) || ') != last approved (' || (select h from approved) || ').' end"""


@query("config_check", with_([Q._WEIGHTS, _CONFIG, _LOG], f"select (select h from approved) = (select digest from digest) as ok, {_CHECKED} as message"))
def config_check(spark, sf):
    """Are the weights those of the newest entry of the change log?"""
    return A.config_check(_weights(spark), _changes(spark, sf))


_FAULTY = """w as (select n_name as template, case c_mktsegment when 'BUILDING' then 'valuation' when 'MACHINERY' then 'growth' when 'AUTOMOBILE' then 'profitability' when 'HOUSEHOLD' then 'entry_point' else 'red_flags' end as card,
 abs(cast(round(c_acctbal * 100) as bigint)) as c, case when n_nationkey % 3 = 0 then 1.01e0 else 1e0 end as f from customer join nation on n_nationkey = c_nationkey),
 t as (select template, card, sum(c / total * f) as total from (select *, sum(c) over (partition by template, card) as total from w) group by template, card)"""


@query("weight_sums", with_([_FAULTY], f"""select template, card, 'weights sum to ' || printf('%.6f', total) as problem from t where abs(total - 1) > 1e-6
 union all select template, card, 'card missing' from (select distinct template from w), (select unnest({list(S.CARDS)}) as card) where (template, card) not in (select (template, card) from w)"""))
def weight_sums(spark, sf):
    """Weights by nation and segment, some of them off by a hundredth, some segments without a card."""
    c = T.table(spark, sf, "customer").join(F.broadcast(T.table(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    cards = {"BUILDING": "valuation", "MACHINERY": "growth", "AUTOMOBILE": "profitability", "HOUSEHOLD": "entry_point"}
    card = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in cards.items() for x in kv]), F.col("c_mktsegment")), F.lit("red_flags"))
    rows = c.select(F.col("n_name").alias("template"), card.alias("card"), F.abs(T.cents("c_acctbal")).alias("c"), F.when(F.col("n_nationkey") % 3 == 0, 1.01).otherwise(1.0).alias("f"))
    totals = rows.groupBy("template", "card").agg(F.sum("c").alias("total"))
    return K.check_weights(rows.join(totals, ["template", "card"]).select("template", "card", (F.col("c") / F.col("total") * F.col("f")).alias("weight")))


@query("metric_references", """select p_type as metric, count(*) as n_uses, case when p_type not in (select p_type from part where p_size > 25) and p_type not in (select p_type from part where p_retailprice > 1500) then 'direction, source'
 when p_type not in (select p_type from part where p_size > 25) then 'direction' else 'source' end as lacks from part
 where p_type not in (select p_type from part where p_size > 25) or p_type not in (select p_type from part where p_retailprice > 1500) group by p_type
 union all select p_brand || '-' || p_size, count(*), 'direction, source' from part where p_size > 45 group by all""")
def metric_references(spark, sf):
    """Weighed names that lack a direction or a source; part types and brands stand for metrics."""
    p = T.table(spark, sf, "part")
    own = p.where("p_size > 45").select(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("metric"))
    weights = p.select(F.col("p_type").alias("metric")).unionByName(own)
    return A.metric_references(weights, p.where("p_size > 25").select(F.col("p_type").alias("metric")), p.where("p_retailprice > 1500").select(F.col("p_type").alias("metric")))


# --- sources ---------------------------------------------------------------------------------
_HEALTH = """health as (select source, coalesce(f, 0) as n_files, coalesce(n, 0) as n_rows, d as latest_date, cast(date '2024-01-31' - d as integer) as age_days,
 case when f is null then 'missing' when n = 0 then 'empty' when date '2024-01-31' - d <= lim then 'ok' else 'stale' end as status, need from
 (values ('events', 3, true), ('orders', 7, true), ('lineitem', 9999, false), ('returned', 7, false), ('delivery', 7, false)) e(source, lim, need) left join (
 select 'events' as source, 1 as f, count(*) as n, cast(max(ts) as date) as d from events union all select 'orders', 1, count(*), cast(max(o_orderdate) as date) from orders
 union all select 'lineitem', 1, count(*), cast(max(l_shipdate) as date) from lineitem union all select 'returned', 1, 0, null) x using (source)),
 levels as (select *, case when status = 'ok' then 'ok' when need then 'error' else 'warning' end as level from health)"""


def _health(spark, sf):
    def state(name, column, where="true"):
        rows = T.table(spark, sf, name).select("_metadata.file_path", F.col(column).alias("day"), F.expr(where).alias("counts"))
        return rows.agg(F.size(F.collect_set("file_path")).cast("long").alias("n_files"), F.count_if("counts").alias("n_rows"), F.max(F.when(F.col("counts"), F.col("day"))).cast("date").alias("latest_date"))

    found = [state("events", "ts"), state("orders", "o_orderdate"), state("lineitem", "l_shipdate"), state("lineitem", "l_shipdate", "l_quantity < 0")]
    rows = reduce(DataFrame.unionByName, [f.withColumn("source", F.lit(n)) for n, f in zip(("events", "orders", "lineitem", "returned"), found)])
    return A.source_health(rows, "2024-01-31", {"events": (3, True), "orders": (7, True), "lineitem": (9999, False), "returned": (7, False), "delivery": (7, False)})


@query("source_health", with_([_HEALTH], "select source, cast(n_files as bigint) as n_files, n_rows, latest_date, age_days, status, level from levels"))
def source_health(spark, sf):
    return _health(spark, sf)


@query("overall_health", with_([_HEALTH], "select case when bool_or(level = 'error') then 'error' when bool_or(level = 'warning') then 'warning' else 'ok' end as overall_status, " + ", ".join(
    f"count(*) filter (where status = '{s}') as n_{s}" for s in ("ok", "stale", "empty", "missing")) + " from levels"))
def overall_health(spark, sf):
    return A.overall_health(_health(spark, sf))


# --- biases ----------------------------------------------------------------------------------
@query("survivorship_series", with_(_LIFE + ["""months as (select last_day(m) as month_end from (select unnest(generate_series(date_trunc('month', a)::date, date_trunc('month', b)::date, interval 1 month))::date as m
  from (select min(a) as a, greatest(max(a), max(b) filter (where b < date '2001-01-01')) as b from life))),
 s as (select month_end, count(*) filter (where b >= date '2001-01-01' and last_day(a) <= month_end) as n_surviving, count(*) filter (where b < date '2001-01-01' and last_day(a) <= month_end and last_day(b) > month_end) as n_later_failed from months, life group by month_end),
 p as (select *, n_surviving + n_later_failed as total_universe, case when n_surviving + n_later_failed > 0 then """ + Q.r("n_later_failed / (n_surviving + n_later_failed) * 100.0", 1) + " else 0e0 end as pct_missing from s)"], f"select *, {_SEV} as bias_severity from p"))
def survivorship_series(spark, sf):
    """How many names of every month's universe were gone later."""
    active, gone = _active_and_gone(spark, sf)
    life = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.min("o_orderdate").cast("date").alias("list_date"))
    listed = active.join(life, "ticker").select("list_date", F.lit(None).cast("date").alias("delist_date"))
    return A.survivorship_series(listed.unionByName(gone.select("list_date", "delist_date")))


def _audit_sql(mode: str) -> str:
    period = ("select 'period', 'ok', 'LIVE MODE: holdout/date-range snooping guard skipped.'" if mode == "live" else
              f"select 'period:' || p, case p when 'holdout' then 'blocker' when 'validation' then 'warning' else 'ok' end, count(*) || ' runs end in the ' || p || ' period.' from (select {_PERIOD} as p from runs) group by p")
    return with_(_LIFE + [_SURV, _RUNS, Q._WEIGHTS, _CONFIG, _LOG, f"""log as (select count(*) as n, count(*) filter (where left(t, 10) >= '2024-04-01') as held from changes),
 findings as (select 'survivorship' as "check", case when {_SEV} in ('High', 'Severe') then 'blocker' when {_SEV} = 'Moderate' then 'warning' else 'ok' end as level,
 'SURVIVORSHIP [' || {_SEV} || ']: ' || n_later_failed || ' delisted names (' || printf('%.1f', pct_missing) || '% of the 1997-06-30 universe) missing.' as message from surv
 union all {period} union all select 'config', case when h = digest then 'ok' else 'blocker' end, case when h = digest then '' else 'CONFIG INTEGRITY: ' end || {_CHECKED} from approved, digest
 union all select 'weight_log', case when held > 0 then 'warning' else 'ok' end, n || ' weight changes, ' || held || ' of them in the holdout period, ' || greatest(0, 5 - (n - held)) || ' of 5 left.' from log)"""],
        "select * from findings union all select 'all_clear', case when count(*) filter (where level = 'blocker') = 0 then 'ok' else 'blocker' end, count(*) filter (where level = 'blocker') || ' blockers' from findings")


def _audit(spark, sf, mode):
    return A.bias_audit(P.survivorship(*_active_and_gone(spark, sf), "1997-06-30"), _runs(spark, sf), _weights(spark), _changes(spark, sf), mode)


@query("bias_audit", _audit_sql("backtest"))
def bias_audit(spark, sf):
    """All guards before a backtest, and whether they are clear."""
    return _audit(spark, sf, "backtest")


@query("bias_audit_live", _audit_sql("live"))
def bias_audit_live(spark, sf):
    """The same before a live run, which no holdout period binds."""
    return _audit(spark, sf, "live")
