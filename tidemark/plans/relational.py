"""Scans, projections, filters, joins, sets, sorts and plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..operators import asof, dedupe, returns, stats
from ..sources import readers
from . import fixtures as fx
from .registry import register


@register("scan_project", "select o_orderkey, o_totalprice from orders")
def scan_project(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")


@register("scan_parameterised", "select o_orderkey, o_orderpriority from orders where o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '1996-06-01'")
def scan_parameterised(spark, d):
    fx.table(spark, d, "orders").createOrReplaceTempView("orders_scan")
    return readers.parameterised(spark, "select o_orderkey, o_orderpriority from orders_scan where o_orderpriority = :priority and o_orderdate >= cast(:since as timestamp_ntz)", priority="1-URGENT", since="1996-06-01")


@register("project_except", "select * exclude (p_retailprice, p_size) from part")
def project_except(spark, d):
    return fx.table(spark, d, "part").drop("p_retailprice", "p_size")


@register("project_computed_key", "select l_orderkey || '#' || l_linenumber as event_id, l_quantity from lineitem")
def project_computed_key(spark, d):
    return fx.table(spark, d, "lineitem").select(F.concat_ws("#", "l_orderkey", "l_linenumber").alias("event_id"), "l_quantity")


@register("filter_equality_and", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '5-LOW'")
def filter_equality_and(spark, d):
    return fx.table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '5-LOW'").select("o_orderkey")


@register("filter_flag", fx.oracle(fx.ANNOUNCEMENTS, body="select ann_id, ticker from fx_announcements where price_sensitive"))
def filter_flag(spark, d):
    return fx.announcements(spark, d).where("price_sensitive").select("ann_id", "ticker")


@register("filter_cohort_substring", fx.oracle(fx.TRADES, body="select ann_id, l_linenumber from fx_trades where trade_type = 'disposal' and lower(nature) like '%on-market%'"))
def filter_cohort_substring(spark, d):
    return fx.trades(spark, d).where((F.col("trade_type") == "disposal") & F.lower("nature").contains("on-market")).select("ann_id", "l_linenumber")


@register("filter_like_family", "select p_partkey, p_brand from part where p_brand like 'Brand_1%'")
def filter_like_family(spark, d):
    return fx.table(spark, d, "part").where(F.col("p_brand").like("Brand_1%")).select("p_partkey", "p_brand")


@register("filter_date_window", fx.oracle(fx.ANNOUNCEMENTS, body=f"select ann_id from fx_announcements where cast({fx.LOCAL} as date) >= date '2001-07-01' - interval 40 day"))
def filter_date_window(spark, d):
    day = F.date_sub(F.lit("2001-07-01").cast("date"), 40)
    return fx.announcements(spark, d).where(scalar.local_date(F.col("announced_at")) >= day).select("ann_id")


@register("filter_prefix", "select l_orderkey, l_linenumber from lineitem where starts_with(cast(l_orderkey as varchar), '12')")
def filter_prefix(spark, d):
    return fx.table(spark, d, "lineitem").where(F.startswith(F.col("l_orderkey").cast("string"), F.lit("12"))).select("l_orderkey", "l_linenumber")


@register("filter_cutoff_counted", "select count(*) filter (o_orderdate < timestamp '1998-01-01') as before_cutoff, count(*) filter (o_orderdate >= timestamp '1998-01-01') as kept from orders")
def filter_cutoff_counted(spark, d):
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return fx.table(spark, d, "orders").agg(F.count_if(old).alias("before_cutoff"), F.count_if(~old).alias("kept"))


@register("join_inner_using", "select l_orderkey, l_linenumber, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey")
def join_inner_using(spark, d):
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey")


@register("join_anti_pending", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def join_anti_pending(spark, d):
    return dedupe.pending(fx.table(spark, d, "orders").select("o_orderkey"), fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@register("join_anti_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def join_anti_not_in(spark, d):
    urgent = fx.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return fx.table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@register("join_semi_done", "select count(*) as already_done from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def join_semi_done(spark, d):
    done = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return fx.table(spark, d, "orders").join(done, "o_orderkey", "left_semi").agg(F.count("*").alias("already_done"))


@register("join_left_skip_count", "select count(*) filter (l_orderkey is not null) as n_scored, count(*) filter (l_orderkey is null) as n_skipped from orders left join (select distinct l_orderkey from lineitem) on l_orderkey = o_orderkey")
def join_left_skip_count(spark, d):
    lines = fx.table(spark, d, "lineitem").select("l_orderkey").distinct()
    both = fx.table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return both.agg(F.count_if(F.col("l_orderkey").isNotNull()).alias("n_scored"), F.count_if(F.col("l_orderkey").isNull()).alias("n_skipped"))


@register(
    "join_asof_backward",
    fx.oracle(fx.ANNOUNCEMENTS, fx.FILINGS, fx.RESULTS, body="select f.ticker, director, filed, consideration, r.d as last_result, date_diff('day', r.d, filed) as gap from fx_filings f asof left join fx_results r on f.ticker = r.ticker and f.filed >= r.d"),
)
def join_asof_backward(spark, d):
    found = asof.asof(fx.filings(spark, d), fx.results_dates(spark, d), ["ticker"], "filed", "d", name="last_result")
    return found.withColumn("gap", F.datediff("filed", "last_result").cast("long"))


@register(
    "join_asof_forward",
    fx.oracle(fx.ANNOUNCEMENTS, fx.FILINGS, fx.RESULTS, body="select f.ticker, director, filed, consideration, r.d as next_result from fx_filings f asof left join fx_results r on f.ticker = r.ticker and f.filed <= r.d"),
)
def join_asof_forward(spark, d):
    return asof.asof(fx.filings(spark, d), fx.results_dates(spark, d), ["ticker"], "filed", "d", forward=True, name="next_result")


@register(
    "join_existence_within_91_days",
    fx.oracle(fx.ANNOUNCEMENTS, fx.FILINGS, fx.RESULTS, body="select ticker, director, filed from fx_filings f where exists (select 1 from fx_results r where r.ticker = f.ticker and r.d > f.filed and r.d <= f.filed + 91)"),
)
def join_existence(spark, d):
    after = fx.filings(spark, d).withColumn("next_day", F.date_add("filed", 1))
    found = asof.asof(after, fx.results_dates(spark, d), ["ticker"], "next_day", "d", forward=True, name="next_result")
    return found.where(F.datediff("next_result", "filed") <= 91).select("ticker", "director", "filed")


@register(
    "agg_global_tripwires",
    fx.oracle(
        fx.ANNOUNCEMENTS, fx.TRADES,
        body=f"""select count(*) as events, count(distinct ann_id) as documents, count(distinct ticker) as tickers, min(cast(announced_at as date)) as earliest, max(cast(announced_at as date)) as latest,
  count(*) filter (date_diff('day', try_cast(trade_date as date), cast({fx.LOCAL} as date)) < 0) as negative_lags, count(*) filter (try_cast(trade_date as date) is null) as null_trade_dates
from fx_trades join fx_announcements using (ann_id)""",
    ),
)
def agg_global_tripwires(spark, d):
    rows = fx.trades(spark, d).join(fx.announcements(spark, d), "ann_id").withColumn("day", scalar.date_or_null(F.col("trade_date")))
    lag = F.datediff(scalar.local_date(F.col("announced_at")), F.col("day"))
    at = F.to_date("announced_at")
    return rows.agg(F.count("*").alias("events"), F.count_distinct("ann_id").alias("documents"), F.count_distinct("ticker").alias("tickers"), F.min(at).alias("earliest"), F.max(at).alias("latest"), F.count_if(lag < 0).alias("negative_lags"), F.count_if(F.col("day").isNull()).alias("null_trade_dates"))


@register("agg_grouped_count", fx.oracle(fx.BARS, body="select ticker, count(*) as n from fx_bars group by ticker"))
def agg_grouped_count(spark, d):
    return fx.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"))


@register(
    "agg_coverage_buckets",
    fx.oracle(
        "u as (select distinct p_brand as ticker from part)", "b as (select distinct p_brand as ticker, cast(l_shipdate as date) as date from lineitem join part on l_partkey = p_partkey)",
        "i as (select count(distinct cast(l_shipdate as date)) as n from lineitem)", "c as (select ticker, count(*) as rows from b group by ticker)",
        body="select ticker, coalesce(rows, 0) as rows, case when coalesce(rows, 0) = 0 then 'empty' when rows < floor(0.5 * i.n) then 'short' else 'ok' end as status from u left join c using (ticker), i",
    ),
)
def agg_coverage_buckets(spark, d):
    line, part = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    own = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("ticker", F.to_date("l_shipdate").alias("date")).distinct()
    index = line.select(F.lit(fx.INDEX).alias("ticker"), F.to_date("l_shipdate").alias("date")).distinct()
    return returns.coverage(own.union(index), part.select("ticker"), fx.INDEX, share=0.5)


@register("agg_max_per_key", "select l_suppkey, l_returnflag, max(cast(l_shipdate as date)) as last_filed from lineitem group by all")
def agg_max_per_key(spark, d):
    return fx.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max(F.to_date("l_shipdate")).alias("last_filed"))


@register("agg_date_list", fx.oracle(fx.ANNOUNCEMENTS, fx.RESULTS, body="select ticker, array_to_string(list_sort(list(distinct d))::varchar[], ',') as dates from fx_results group by ticker"))
def agg_date_list(spark, d):
    return fx.results_dates(spark, d).groupBy("ticker").agg(F.array_join(F.transform(F.sort_array(F.collect_set("d")), lambda x: x.cast("string")), ",").alias("dates"))


@register(
    "agg_distinct_collapse_total",
    """with calls as (select distinct o_orderpriority as vertical, o_custkey, o_orderstatus, cast(floor(o_totalprice) as bigint) as tokens from orders)
select vertical, count(*) as calls, count(distinct o_custkey) as documents, sum(tokens)::bigint as tokens from calls group by vertical
union all select 'TOTAL', sum(calls)::bigint, sum(documents)::bigint, sum(tokens)::bigint from (select count(*) as calls, count(distinct o_custkey) as documents, sum(tokens) as tokens from calls group by vertical)""",
)
def agg_distinct_collapse_total(spark, d):
    tokens = F.floor("o_totalprice").alias("tokens")
    calls = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("vertical"), "o_custkey", "o_orderstatus", tokens).distinct()
    own = calls.groupBy("vertical").agg(F.count("*").alias("calls"), F.count_distinct("o_custkey").alias("documents"), F.sum("tokens").alias("tokens"))
    # the total sums the verticals' documents: one that is in two of them counts twice
    return own.rollup("vertical").agg(*[F.sum(c).alias(c) for c in ("calls", "documents", "tokens")]).withColumn("vertical", F.coalesce("vertical", F.lit("TOTAL")))


@register("agg_argmax", "select c_nationkey, c_custkey as richest, c_acctbal as balance from customer where c_acctbal is not null qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) = 1")
def agg_argmax(spark, d):
    """Of equal balances the least key wins."""
    best = F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k")))
    return fx.table(spark, d, "customer").where("c_acctbal is not null").groupBy("c_nationkey").agg(best.alias("best")).select("c_nationkey", (-F.col("best.k")).alias("richest"), F.col("best.c_acctbal").alias("balance"))


@register("agg_quantile_median", "select l_returnflag, round(median(l_extendedprice), 6) as median, round(quantile_cont(l_extendedprice, 0.333), 6) as lower_tercile from lineitem group by l_returnflag")
def agg_quantile_median(spark, d):
    found = stats.percentiles_by(fx.table(spark, d, "lineitem"), "l_extendedprice", [0.5, 0.333], ["l_returnflag"])
    return found.select("l_returnflag", F.round("p0", 6).alias("median"), F.round("p1", 6).alias("lower_tercile"))


@register("sort_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50")
def sort_limit(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@register("sort_nulls_last", "with r as (select o_orderkey, nullif(o_totalprice, 0) as a, case when o_orderkey % 3 = 0 then null else o_totalprice end as accuracy from orders) select o_orderkey, accuracy, row_number() over (order by accuracy asc nulls last, o_orderkey) as place from r order by place limit 100")
def sort_nulls_last(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("accuracy"))
    first = rows.orderBy(F.asc_nulls_last("accuracy"), "o_orderkey").limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("accuracy"), "o_orderkey")).cast("long"))  # a hundred rows


@register("limit_per_group", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders where o_orderpriority <> '5-LOW') where k <= 2")
def limit_per_group(spark, d):
    rows = fx.table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    return dedupe.first_per_group(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@register("set_distinct", "select distinct c_mktsegment, year(o_orderdate) as y from orders join customer on o_custkey = c_custkey")
def set_distinct(spark, d):
    return fx.announcements_with_year(spark, d)


@register("set_difference", "select l_suppkey as k from lineitem where l_returnflag = 'N' except select l_suppkey from lineitem where l_returnflag = 'A' and l_quantity > 49")
def set_difference(spark, d):
    line = fx.table(spark, d, "lineitem")
    return line.where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("k")).subtract(line.where("l_returnflag = 'A' and l_quantity > 49").select("l_suppkey"))


@register("set_intersection", "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def set_intersection(spark, d):
    orders = fx.table(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(orders.where("o_orderstatus = 'O'").select("o_custkey"))


@register("set_concat", "select 'c' as kind, c_custkey as k, c_acctbal as balance from customer union all select 's', s_suppkey, s_acctbal from supplier")
def set_concat(spark, d):
    customers = fx.table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return customers.unionByName(fx.table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")))


@register("unpivot_long", "unpivot (select p_partkey, cast(p_size as double) as size, p_retailprice as price from part) on size, price into name field value v")
def unpivot_long(spark, d):
    rows = fx.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "field", "v")


@register("pivot_report", "select l_linestatus, round(sum(l_quantity) filter (l_returnflag = 'A'), 4) as \"A\", round(sum(l_quantity) filter (l_returnflag = 'N'), 4) as \"N\", round(sum(l_quantity) filter (l_returnflag = 'R'), 4) as \"R\" from lineitem group by l_linestatus")
def pivot_report(spark, d):
    rows = fx.table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return rows.select("l_linestatus", *[F.round(c, 4).alias(c) for c in ("A", "N", "R")])


@register("dedupe_within_run", "select user_id, min(event_id) as event_id from events group by user_id")
def dedupe_within_run(spark, d):
    return dedupe.first_per_group(fx.table(spark, d, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")], 1)


@register("dry_run_counters", fx.oracle(fx.ANNOUNCEMENTS, body="select count(*) filter (announced_at < timestamp '1997-01-01') as before_cutoff, count(*) filter (announced_at >= timestamp '1997-01-01' and not price_sensitive) as filtered, count(*) filter (announced_at >= timestamp '1997-01-01' and price_sensitive and l_orderkey is not null) as already_there, count(*) filter (announced_at >= timestamp '1997-01-01' and price_sensitive and l_orderkey is null) as would_ingest from fx_announcements left join (select distinct l_orderkey from lineitem where l_linenumber > 3) on ann_id = l_orderkey"))
def dry_run_counters(spark, d):
    there = fx.table(spark, d, "lineitem").where("l_linenumber > 3").select("l_orderkey").distinct()
    rows = fx.announcements(spark, d).join(there, F.col("ann_id") == F.col("l_orderkey"), "left")
    old, flagged, known = F.col("announced_at") < F.lit("1997-01-01").cast("timestamp_ntz"), F.col("price_sensitive"), F.col("l_orderkey").isNotNull()
    return rows.agg(F.count_if(old).alias("before_cutoff"), F.count_if(~old & ~flagged).alias("filtered"), F.count_if(~old & flagged & known).alias("already_there"), F.count_if(~old & flagged & ~known).alias("would_ingest"))


@register("latest_version_wins", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by o_custkey")
def latest_version_wins(spark, d):
    return dedupe.latest(fx.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@register("latest_version_by_aggregate", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by o_custkey")
def latest_version_by_aggregate(spark, d):
    return dedupe.latest_by_aggregate(fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


@register(
    "anchor_greedy_dedup",
    """with recursive days as (select distinct l_suppkey, cast(l_shipdate as date) as filed from lineitem where l_returnflag = 'R'),
kept as (select l_suppkey, min(filed) as filed from days group by l_suppkey
  union all select k.l_suppkey, (select min(filed) from days where days.l_suppkey = k.l_suppkey and filed > k.filed + 30) from kept k where k.filed is not null)
select l_suppkey, filed from kept where filed is not null""",
)
def anchor_greedy_dedup(spark, d):
    rows = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", F.to_date("l_shipdate").alias("filed"))
    return dedupe.anchor_greedy(rows, ["l_suppkey"], "filed", 30)


@register("carry_forward", "with days as (select distinct cast(ts as date) as day, event_type from events), v as (select cast(ts as date) as day, event_type, round(avg(value), 6) as v from events where user_id % 5 = 0 group by all) select day, event_type, coalesce(last_value(v ignore nulls) over (partition by event_type order by day rows unbounded preceding), 0) as v from days left join v using (day, event_type)")
def carry_forward(spark, d):
    events = fx.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = events.select("day", "event_type").distinct()
    own = events.where("user_id % 5 = 0").groupBy("day", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return asof.carry_forward(days.join(own, ["day", "event_type"], "left"), ["event_type"], "day", "v", 0.0)
