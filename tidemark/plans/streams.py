"""Streaming queries over the event table as it arrives week by week, against the same in batch.

Each week's rows are written, the stream runs over what is new and stops; the next run goes on from its checkpoint, so
state is carried from batch to batch. Some queries take events late: up to four days after their time, by the event's
number. A row counts unless its window had closed by the watermark of the batches before, and only closed windows come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import returns, signals
from ..streaming import positions, streams
from . import fixtures as fx
from .decisions import LEAST
from .files import scratch
from .registry import register

#: Weeks from here; the number of an event tells how many days it comes late.
EPOCH, MOST_LATE = "2024-01-01", 5


def _arrivals(rows, late: bool):
    """Rows with the week in which they arrive."""
    delay = F.make_dt_interval((F.col("event_id") % MOST_LATE).cast("int")) if late else F.make_dt_interval(F.lit(0))
    return rows.withColumn("week", F.floor(F.datediff(F.col("ts") + delay, F.lit(EPOCH).cast("date")) / 7).cast("int"))


def _run(spark, d, make, late: bool = False):
    """What ``make`` (a stream to a stream) gives over the weeks, one run each."""
    rows = _arrivals(fx.table(spark, d, "events"), late)
    folder, path, state = scratch(spark, "events"), scratch(spark, "stream"), scratch(spark, "state")
    found = None
    for (week,) in sorted(rows.select("week").distinct().collect()):  # as many as weeks
        rows.where(F.col("week") == week).drop("week").write.mode("append").parquet(folder)
        found = streams.run_available(make(streams.read_events(spark, folder, files_per_batch=100_000)), spark, path, state)
    return found


#: Rows with the watermark (two days behind the newest row of the weeks before) that they meet, and the last watermark.
_LATE = f"""
arrived as (select *, floor(date_diff('day', date '{EPOCH}', cast(ts + to_days((event_id % {MOST_LATE})::int) as date)) / 7) as week from events),
weeks as (select week, max(ts) as newest from arrived group by week),
marks as (select week, max(newest) over (order by week rows between unbounded preceding and 1 preceding) - interval 2 day as mark from weeks),
met as (select a.*, mark from arrived a join marks using (week)),
final as (select max(ts) - interval 2 day as mark from events)"""


@register("stream_tumbling", fx.oracle(_LATE, body="select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as value from met, final where (met.mark is null or date_trunc('day', ts) + interval 1 day > met.mark) and date_trunc('day', ts) + interval 1 day <= final.mark group by 1, 2"))
def stream_tumbling(spark, d):
    found = _run(spark, d, streams.tumbling, late=True)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@register("stream_deduplicated", "select distinct user_id from events")
def stream_deduplicated(spark, d):
    return _run(spark, d, lambda events: streams.first_sightings(events.select("user_id", "ts"), "user_id", late="60 days"), late=True).select("user_id")


@register(
    "stream_greedy_gate",
    """with recursive days as (select distinct user_id, cast(ts as date) as filed from events),
kept as (select user_id, min(filed) as filed from days group by user_id
  union all select k.user_id, (select min(filed) from days where days.user_id = k.user_id and filed > k.filed + 5) from kept k where k.filed is not null)
select cast(user_id as varchar) as key, filed from kept where filed is not null""",
)
def stream_greedy_gate(spark, d):
    return _run(spark, d, lambda events: streams.greedy_gate(events.select(F.col("user_id").cast("string").alias("key"), F.to_date("ts").alias("filed")), days=5))


@register(
    "stream_sessions",
    """with marked as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end as first from events),
numbered as (select *, sum(first) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from marked),
found as (select user_id, min(ts) as start, max(ts) + interval 12 hour as "end", count(*) as n from numbered group by user_id, k)
select user_id, start::timestamp as start, "end"::timestamp as "end", n from found where "end" <= (select max(ts) - interval 2 day from events)""",
)
def stream_sessions(spark, d):
    found = _run(spark, d, streams.sessions)
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@register(
    "stream_sliding",
    fx.oracle(
        _LATE, "slid as (select event_type, mark, unnest(generate_series(date_trunc('day', ts) - interval 6 day, date_trunc('day', ts), interval 1 day)) as start from met)",
        body="select start::timestamp as start, event_type, count(*) as n from slid, final where (slid.mark is null or start + interval 7 day > slid.mark) and start + interval 7 day <= final.mark group by 1, 2",
    ),
)
def stream_sliding(spark, d):
    return _run(spark, d, streams.sliding, late=True).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


#: Filings that pass the gates of their row, but for staleness, and the days of runs.
_PASSED = (
    fx.ANNOUNCEMENTS, fx.FILINGS, fx.RESULTS,
    "cl as (select date, row_number() over (order by date) - 1 as o from (select distinct cast(l_shipdate as date) as date from lineitem))",
    f"ps as (select upper(ticker) || '|' || lower(trim(director)) as key, upper(ticker) as t, director, filed, consideration from (select f.*, date_diff('day', r.d, f.filed) as gap from fx_filings f asof left join fx_results r on f.ticker = r.ticker and f.filed >= r.d) where consideration >= {LEAST} and gap > 30)",
)

#: The walk, entry by entry: the next filing in the order of runs whose slot and key are free, given the last twelve
#: entries, newest first (the twelfth holds the slot that is freed next; older ones are closed and no longer bar their key).
_POSITIONS = """
seen as (select o, date, key, filed, t, director, min(consideration) as c from ps join cl on cl.date between filed and filed + 5 group by all),
cd as (select *, row_number() over (order by o, filed, t, director, c) as i from seen),
walk as (
  select 0::bigint as i, []::struct(o bigint, key varchar, filed date)[] as latest
  union all
  select cd.i, list_prepend({'o': cd.o, 'key': cd.key, 'filed': cd.filed}, s.latest)[1:12] from (
    select min(cd.i) as i, any_value(w.latest) as latest from walk w join cd on cd.i > w.i
    where (len(w.latest) < 12 or cd.o > w.latest[12].o + 63)
      and len(list_filter(w.latest, lambda x: x.key = cd.key and (cd.o <= x.o + 63 or cd.filed - x.filed <= 30))) = 0) s join cd using (i)),
ent as (select cd.* from walk join cd using (i))"""


def _passed(spark, d):
    rows = signals.gated(fx.filings(spark, d), fx.results_dates(spark, d), F.col("filed"), least=LEAST)
    return rows.where("reason is null")


def _run_days(spark, d):
    return returns.calendar(fx.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")))


def _book(spark, d):
    """Entries and exits of the runs, delivered two years at a time; each stream goes on from the checkpoint of the one before."""
    rows = positions.runs(_passed(spark, d), _run_days(spark, d))
    folder, path, state, whole = (scratch(spark, name) for name in ("runs", "book", "state", "days"))
    rows.withColumn("part", F.floor(F.year("date") / 2)).write.partitionBy("part").parquet(whole)
    days = spark.read.parquet(whole)
    saved = {key: spark.conf.get(key, None) for key in positions.STORE}
    found = None
    try:
        for key, value in positions.STORE.items():
            spark.conf.set(key, value)
        for (part,) in sorted(days.select("part").distinct().collect()):  # as many as parts
            days.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
            found = streams.run_available(positions.book_events(positions.read_runs(spark, folder)), spark, path, state)
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return found


@register("stream_positions", fx.oracle(*_PASSED, _POSITIONS.strip(), body="select e.t as ticker, director, filed, c as consideration, e.date as entry_date, x.date as exit_date from ent e left join cl x on x.o = e.o + 63", recursive=True))
def stream_positions(spark, d):
    return positions.positions(_book(spark, d)).drop("book", "key")


@register(
    "stream_run_decisions",
    fx.oracle(
        *_PASSED, _POSITIONS.strip(),
        """al as (select key, t, director, filed, consideration, count(*) as n from ps group by all),
rs as (select al.*, cd.i, cd.o, cd.date, cd.c from al join cd using (key, t, director, filed)),
jn as (select rs.i, rs.date, rs.t, rs.director, rs.filed, rs.consideration, rs.n, any_value(rs.o) as o,
  coalesce(bool_or(e.i = rs.i and consideration = rs.c), false) as enters, max(e.filed) as prior, coalesce(bool_or(rs.o <= e.o + 63), false) as held
  from rs left join ent e on e.key = rs.key and e.i <= rs.i group by all),
told as (select *, case when filed - prior <= 30 then 'SKIP_DUPLICATE' when held then 'SKIP_ALREADY_OPEN' else 'SKIP_CAP' end as skip from jn)""",
        body="""select date, t as ticker, action, sum(n)::bigint as n from (
select date, t, case when enters then 'ENTER' else skip end as action, case when enters then 1 else n end as n from told
union all select date, t, 'SKIP_DUPLICATE', n - 1 from told where enters and n > 1) group by all""",
        recursive=True,
    ),
)
def stream_run_decisions(spark, d):
    filings, days = _passed(spark, d), _run_days(spark, d)
    found = positions.told(filings, days, positions.positions(_book(spark, d)))
    return found.groupBy("date", "ticker", "action").agg(F.sum("n").alias("n"))
