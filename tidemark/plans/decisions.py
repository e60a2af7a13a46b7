"""The daily decision: gates, entries, exits, the ledger and its replay."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import asof, returns, signals
from . import fixtures as fx
from .registry import register

TODAY = date(1998, 6, 1)
LEAST = 200_000  # filings here are smaller than the real ones

_GAPS = "gp as (select f.*, r.d as last_result, date_diff('day', r.d, f.filed) as gap from fx_filings f asof left join fx_results r on f.ticker = r.ticker and f.filed >= r.d)"
_GATED = f"""gt as (select *, case when consideration is null or consideration < {LEAST} then 'SIZE' when date_diff('day', filed, date '{TODAY}') > 400 then 'STALE' when gap is null then 'NO_RESULTS' when gap <= 30 then 'NOT_CLEAN' end as reason from gp where filed <= date '{TODAY}')"""
GATES = (fx.ANNOUNCEMENTS, fx.FILINGS, fx.RESULTS, _GAPS, _GATED)


def _gated(spark, d):
    filings = fx.filings(spark, d).where(F.col("filed") <= F.lit(TODAY))
    return signals.gated(filings, fx.results_dates(spark, d), F.lit(TODAY), least=LEAST, stale=400)


def _open(spark):
    return spark.createDataFrame([("BUILDING", "Director 1", date(1998, 1, 5)), ("MACHINERY", "Director 2", date(1997, 2, 3))], "ticker string, director string, entry_date date")


def _recent(spark):
    return spark.createDataFrame([("HOUSEHOLD", "director 3", date(1998, 2, 1))], "ticker string, director string, last_filed date")


@register("gates_per_row", fx.oracle(*GATES, body="select coalesce(reason, 'PASS') as verdict, count(*) as n from gt group by all"))
def gates_per_row(spark, d):
    return _gated(spark, d).groupBy(F.coalesce("reason", F.lit("PASS")).alias("verdict")).agg(F.count("*").alias("n"))


@register("results_distances", fx.oracle(fx.ANNOUNCEMENTS, fx.FILINGS, fx.RESULTS, "af as (select f.*, n.d as nxt from fx_filings f asof left join fx_results n on f.ticker = n.ticker and f.filed < n.d)", body="select a.ticker, filed, date_diff('day', r.d, filed) as since, date_diff('day', filed, nxt) as until, count(*) as n from af a asof left join fx_results r on a.ticker = r.ticker and a.filed >= r.d group by all"))
def results_distances(spark, d):
    """How far trades are from the results before and after them, by which blackouts are judged."""
    found = asof.distances(fx.filings(spark, d), fx.results_dates(spark, d), ["ticker"], "filed", "d")
    return found.groupBy("ticker", "filed", F.col("since").cast("long").alias("since"), F.col("until").cast("long").alias("until")).agg(F.count("*").alias("n"))


#: The oracle walks entry by entry with the whole state: what is open or was entered, by key, and the slots left.
_WALK = """
ps as (select *, upper(ticker) || '|' || lower(trim(director)) as key, row_number() over (order by filed, upper(ticker), director, consideration) as i from gt where reason is null),
walk as (
  select 0::bigint as i, 10 as slots, [{'key': 'BUILDING|director 1', 'filed': null, 'open': true}, {'key': 'MACHINERY|director 2', 'filed': null, 'open': true}, {'key': 'HOUSEHOLD|director 3', 'filed': date '1998-02-01', 'open': false}]::struct(key varchar, filed date, open boolean)[] as book
  union all
  select ps.i, s.slots - 1, list_append(s.book, {'key': ps.key, 'filed': ps.filed, 'open': true}) from (
    select min(ps.i) as i, any_value(w.slots) as slots, any_value(w.book) as book from walk w join ps on ps.i > w.i
    where w.slots > 0 and len(list_filter(w.book, lambda x: x.key = ps.key and (x.open or ps.filed - x.filed <= 30))) = 0) s join ps using (i)),
decided as (select ps.*, case when w.i = ps.i then 'ENTER'
    when len(list_filter(w.book, lambda x: x.key = ps.key and ps.filed - x.filed <= 30)) > 0 then 'SKIP_DUPLICATE'
    when len(list_filter(w.book, lambda x: x.key = ps.key and x.open)) > 0 then 'SKIP_ALREADY_OPEN'
    else 'SKIP_CAP' end as action from ps asof join walk w on ps.i >= w.i)"""


@register("entry_selection", fx.oracle(*GATES, _WALK.strip(), body="select ticker, director, filed, consideration, gap, action from decided union all select ticker, director, filed, consideration, gap, 'SKIP_' || reason from gt where reason is not null", recursive=True))
def entry_selection(spark, d):
    found = signals.select_entries(_gated(spark, d), _open(spark), _recent(spark))
    return found.withColumn("gap", F.col("gap").cast("long"))


_CAL = "cl as (select date, row_number() over (order by date) - 1 as o from (select distinct cast(l_shipdate as date) as date from lineitem))"
_OPEN = "op as (select distinct 'T' || l_suppkey as ticker, 'Director ' || l_linenumber as director, cast(l_shipdate as date) + 1 as entry_date from lineitem where l_returnflag = 'A' and l_quantity > 48)"


@register("exits_due", fx.oracle(_CAL, _OPEN, f"rl as (select op.*, cl.o from op asof join cl on op.entry_date <= cl.date)", body=f"select ticker, director, entry_date from rl where (select min(o) from cl where date >= date '{TODAY}') - o >= 63"))  # noqa: F541
def exits_due(spark, d):
    line = fx.table(spark, d, "lineitem")
    days = returns.calendar(line.select(F.to_date("l_shipdate").alias("date")))
    opened = line.where("l_returnflag = 'A' and l_quantity > 48").select(F.concat(F.lit("T"), "l_suppkey").alias("ticker"), F.concat(F.lit("Director "), "l_linenumber").alias("director"), F.date_add("l_shipdate", 1).alias("entry_date")).distinct()
    return signals.exits_due(opened, days, TODAY).select("ticker", "director", "entry_date")


_LEDGER = "lg as (select case when l_orderkey % 10 = 0 then 'paper' else 'dry' end as mode, case l_returnflag when 'A' then 'DRY_ENTER' when 'R' then 'DRY_EXIT' else 'SKIP_SIZE' end as action, 'T' || (l_suppkey % 9) as ticker, 'Director ' || (l_partkey % 5) as director, cast(l_shipdate as date) as filed_date, case when l_orderkey % 41 <> 0 then date_trunc('month', l_shipdate)::date end as entry_date from lineitem)"


def _ledger(spark, d):
    line = fx.table(spark, d, "lineitem")
    return line.select(
        F.when(F.col("l_orderkey") % 10 == 0, "paper").otherwise("dry").alias("mode"),
        F.when(F.col("l_returnflag") == "A", "DRY_ENTER").when(F.col("l_returnflag") == "R", "DRY_EXIT").otherwise("SKIP_SIZE").alias("action"),
        F.concat(F.lit("T"), F.col("l_suppkey") % 9).alias("ticker"), F.concat(F.lit("Director "), F.col("l_partkey") % 5).alias("director"),
        F.to_date("l_shipdate").alias("filed_date"), F.when(F.col("l_orderkey") % 41 != 0, F.to_date(F.trunc("l_shipdate", "month"))).alias("entry_date"),
    )


@register("ledger_open_positions", fx.oracle(_LEDGER, body="select ticker, lower(director) as director, entry_date from lg where mode = 'dry' and action = 'DRY_ENTER' and entry_date is not null except select ticker, lower(director), entry_date from lg where mode = 'dry' and action = 'DRY_EXIT'"))
def ledger_open_positions(spark, d):
    return signals.replay(_ledger(spark, d), "dry")[0]


@register("ledger_recent_entries", fx.oracle(_LEDGER, body="select ticker, lower(director) as director, max(filed_date) as last_filed from lg where mode = 'dry' and action = 'DRY_ENTER' group by all"))
def ledger_recent_entries(spark, d):
    return signals.replay(_ledger(spark, d), "dry")[1]


@register("ledger_append", fx.oracle(*GATES, _WALK.strip(), _CAL, f"ex as (select e from (values (date '1998-01-05'), (date '1997-02-03')) v(e) asof join cl on e <= cl.date where (select min(o) from cl where date >= date '{TODAY}') - o >= 63)", body="select 'dry' as mode, case action when 'ENTER' then 'DRY_ENTER' else action end as action, count(*) as n from (select action from decided union all select 'SKIP_' || reason from gt where reason is not null union all select 'DRY_EXIT' from ex) group by all", recursive=True))
def ledger_append(spark, d):
    decided = signals.select_entries(_gated(spark, d), _open(spark), _recent(spark))
    days = returns.calendar(fx.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")))
    rows = signals.ledger_rows(decided, signals.exits_due(_open(spark), days, TODAY), F.lit("1998-06-01").cast("timestamp"), "dry")
    return rows.groupBy("mode", "action").agg(F.count("*").alias("n"))


@register("hedge_orders", "select s_suppkey, case when abs(floor(s_suppkey % 12 * 10000 / (s_acctbal + 2000)) - s_suppkey % 40) * (s_acctbal + 2000) > 5000 then floor(s_suppkey % 12 * 10000 / (s_acctbal + 2000)) - s_suppkey % 40 else 0 end::bigint as shares from supplier")
def hedge_orders(spark, d):
    shares = signals.hedge_order(F.col("s_suppkey") % 12, F.col("s_suppkey") % 40, F.col("s_acctbal") + 2000)
    return fx.table(spark, d, "supplier").select("s_suppkey", shares.alias("shares"))
