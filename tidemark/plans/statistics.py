"""Tests, ranks, quantiles, regressions and models over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, stats
from . import fixtures as fx
from .registry import register


@register("welch_t", "with v as (select l_linestatus, l_extendedprice as x, l_returnflag = 'A' as a from lineitem), s as (select l_linestatus, count(x) filter (a) as n1, count(x) filter (not a) as n2, avg(x) filter (a) as m1, avg(x) filter (not a) as m2, var_samp(x) filter (a) as v1, var_samp(x) filter (not a) as v2 from v group by 1) select l_linestatus, n1, n2, round(m1 - m2, 6) as difference, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t from s")
def welch_t(spark, d):
    found = stats.welch_t(fx.table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "A", ["l_linestatus"])
    return found.select("l_linestatus", "n1", "n2", F.round("difference", 6).alias("difference"), F.round("t", 6).alias("t"))


@register("paired_t", "with v as (select l_returnflag, l_discount - l_tax as x from lineitem) select l_returnflag, count(x) as n, round(avg(x), 9) as mean, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 5) as t from v group by 1")
def paired_t(spark, d):
    return stats.paired_t(fx.table(spark, d, "lineitem"), "l_discount", "l_tax", ["l_returnflag"]).select("l_returnflag", "n", F.round("mean", 9).alias("mean"), F.round("t", 5).alias("t"))


@register("spearman_rank_ic", "with r as (select l_suppkey, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as a, rank() over (partition by l_suppkey order by l_discount) + (count(*) over (partition by l_suppkey, l_discount) - 1) / 2 as b from lineitem) select l_suppkey, count(*) as n, round(corr(a, b), 8) as rho from r group by 1")
def spearman_rank_ic(spark, d):
    return stats.spearman(fx.table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_suppkey"]).select("l_suppkey", "n", F.round("rho", 8).alias("rho"))


@register("global_mean_ranks", "with r as (select l_quantity as v, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as mean_rank from lineitem) select v, count(*) as n, min(mean_rank) as mean_rank from r group by v")
def global_mean_ranks(spark, d):
    return stats.binned_ranks(fx.table(spark, d, "lineitem"), "l_quantity")


@register("auc_rank_sum", "with r as (select l_returnflag = 'R' as y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as k from lineitem) select count(*) as n, count(*) filter (y) as pos, round((sum(k) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / (count(*) filter (y) * count(*) filter (not y)), 9) as auc from r")
def auc_rank_sum(spark, d):
    return stats.auc(fx.table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").select("n", "pos", F.round("auc", 9).alias("auc"))


@register("incidence_z", "with v as (select l_returnflag = 'R' as y, 0.1 + l_discount * 2 as p from lineitem) select count(*) filter (y) as observed, round(sum(p), 4) as expected, round((count(*) filter (y) - sum(p)) / sqrt(sum(p * (1 - p))), 6) as z from v")
def incidence_z(spark, d):
    rows = fx.table(spark, d, "lineitem").withColumn("p", 0.1 + F.col("l_discount") * 2)
    return stats.incidence(rows, F.col("l_returnflag") == "R", "p").select("observed", F.round("expected", 4).alias("expected"), F.round("z", 6).alias("z"))


@register(
    "regression_multivariate",
    """with v as (select l_extendedprice as y, l_quantity as x1, l_discount as x2 from lineitem),
m as (select count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2, var_pop(y) * count(*) as syy, var_pop(x1) * count(*) as s11, var_pop(x2) * count(*) as s22, covar_pop(x1, x2) * count(*) as s12, covar_pop(x1, y) * count(*) as s1, covar_pop(x2, y) * count(*) as s2 from v),
b as (select *, s11 * s22 - s12 * s12 as det, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) as b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) as b2 from m),
e as (select *, my - b1 * m1 - b2 * m2 as b0, (syy - b1 * s1 - b2 * s2) / (n - 3) as error from b)
select 'const' as term, round(b0, 3) as coefficient, round(b0 / sqrt(error * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)), 3) as t from e
union all select 'l_quantity', round(b1, 3), round(b1 / sqrt(error * s22 / det), 3) from e
union all select 'l_discount', round(b2, 3), round(b2 / sqrt(error * s11 / det), 3) from e""",
)
def regression_multivariate(spark, d):
    found = stats.ols(fx.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return found.select("term", F.round("coefficient", 3).alias("coefficient"), F.round("t", 3).alias("t"))


@register("late_filing_histogram", "select case when g <= 5 then 'on time' when g <= 30 then 'late' else 'very late' end as bin, count(*) as n from (select date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as g from lineitem join orders on l_orderkey = o_orderkey) group by 1")
def late_filing_histogram(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    gap = F.datediff("l_shipdate", "o_orderdate")
    label = F.when(gap <= 5, "on time").when(gap <= 30, "late").otherwise("very late")
    return fx.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


@register("business_days_late", "with cal as (select date, row_number() over (order by date) as o from (select unnest(generate_series(date '1994-12-01', date '2002-01-31', interval 1 day))::date as date) where isodow(date) <= 5), r as (select l_orderkey, l_linenumber, a.o as oa, b.o as ob from lineitem join orders on l_orderkey = o_orderkey asof join cal a on cast(o_orderdate as date) <= a.date asof join cal b on cast(l_shipdate as date) <= b.date) select l_orderkey, l_linenumber, ob - oa as lag from r")
def business_days_late(spark, d):
    from ..operators.asof import next_on_calendar

    days = spark.sql("select explode(sequence(date '1994-12-01', date '2002-01-31', interval 1 day)) as date").where("weekday(date) < 5")
    cal = days.withColumn("o", F.row_number().over(_by_date()))
    orders = fx.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("b")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ordinals = lambda c: next_on_calendar(rows.select(c), days, c, "__r").join(cal, F.col("__r") == F.col("date")).select(c, F.col("o").alias(f"o_{c}"))
    both = rows.join(F.broadcast(ordinals("a")), "a").join(F.broadcast(ordinals("b")), "b")  # one row per calendar day
    return both.select("l_orderkey", "l_linenumber", (F.col("o_b") - F.col("o_a")).cast("long").alias("lag"))


def _by_date():
    from pyspark.sql.window import Window

    return Window.orderBy("date")


@register("quintile_buckets", "select p_brand, bucket, count(*) as n, min(p_retailprice) as lowest from (select *, ntile(5) over (partition by p_brand order by p_retailprice, p_partkey) as bucket from part) group by all")
def quintile_buckets(spark, d):
    rows = fx.table(spark, d, "part").withColumn("order", F.struct("p_retailprice", "p_partkey"))
    return models.quintiles(rows, "order", ["p_brand"]).groupBy("p_brand", F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("lowest"))


#: A customer's orders are snapshots, its urgent orders the events; the label is one within 63 days.
HORIZON, LAST_TRAINED = 63, 1998
_PERIODS = f"""
od as (select o_custkey as k, cast(o_orderdate as date) as d, o_totalprice / 1000 as amount, o_orderpriority = '1-URGENT' as urgent from orders),
ev as (select distinct k, d from od where urgent),
sn as (select *, row_number() over () as i from od where d + {HORIZON} <= (select max(d) from od)),
pp as (select sn.i, any_value(sn.d) as d, any_value(sn.amount) as x1, count(ev.d) filter (ev.d <= sn.d) as x2, coalesce(bool_or(ev.d > sn.d and ev.d <= sn.d + {HORIZON}), false)::int as y from sn left join ev using (k) group by sn.i),
ms as (select avg(x1) as m1, stddev_samp(x1) as s1, avg(x2) as m2, stddev_samp(x2) as s2 from pp where year(d) <= {LAST_TRAINED}),
zs as (select year(d) <= {LAST_TRAINED} as train, y, (x1 - m1) / s1 as z1, (x2 - m2) / s2 as z2 from pp, ms)"""

#: Newton's steps, each from sums of weighted products, with the inverse of a symmetric matrix of three terms written out.
_NEWTON = """
nw as (
  select 0 as step, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2, 0.0::double as v0, 0.0::double as v1, 0.0::double as v2
  union all
  select step + 1, b0 + (i00 * g0 + i01 * g1 + i02 * g2) / det, b1 + (i01 * g0 + i11 * g1 + i12 * g2) / det, b2 + (i02 * g0 + i12 * g1 + i22 * g2) / det, i00 / det, i11 / det, i22 / det from (
    select *, h11 * h22 - h12 * h12 as i00, h02 * h12 - h01 * h22 as i01, h01 * h12 - h02 * h11 as i02, h00 * h22 - h02 * h02 as i11, h01 * h02 - h00 * h12 as i12, h00 * h11 - h01 * h01 as i22,
      h00 * (h11 * h22 - h12 * h12) + h01 * (h02 * h12 - h01 * h22) + h02 * (h01 * h12 - h02 * h11) as det from (
      select step, b0, b1, b2, sum(p * (1 - p)) as h00, sum(p * (1 - p) * z1) as h01, sum(p * (1 - p) * z2) as h02, sum(p * (1 - p) * z1 * z1) as h11, sum(p * (1 - p) * z1 * z2) as h12, sum(p * (1 - p) * z2 * z2) as h22,
        sum(y - p) as g0, sum((y - p) * z1) as g1, sum((y - p) * z2) as g2
      from (select nw.*, y, z1, z2, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) as p from nw, zs where train and step < 12) group by step, b0, b1, b2))),
fin as (select * from nw where step = 12),
hz as (select y, round(1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))), 9) as hazard from zs, fin where not train)"""


def _hazard_rows(spark, d):
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), (F.col("o_totalprice") / 1000).alias("x1"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    until = orders.agg(F.max("d")).first()[0]
    found = models.person_periods(orders.drop("urgent"), orders.where("urgent"), ["k"], "d", HORIZON, until)
    return found.withColumn("x2", F.col("past").cast("double"))


def _hazards(spark, d):
    found = models.logistic_hazard(_hazard_rows(spark, d), "label", ["x1", "x2"], F.year("d") <= LAST_TRAINED)
    return found.withColumn("hazard", F.round("hazard", 9))


@register("person_periods", fx.oracle(_PERIODS, body="select d, x2 as past, y::bigint as label, count(*) as n, round(sum(x1), 5) as amount from pp group by all"))
def person_periods(spark, d):
    found = _hazard_rows(spark, d).withColumn("label", F.col("label").cast("long"))
    return found.groupBy("d", "past", "label").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 5).alias("amount"))


@register(
    "logistic_terms",
    fx.oracle(
        _PERIODS, _NEWTON,
        body="""select 'const' as term, round(b0, 6) as coefficient, round(sqrt(v0), 6) as se, round(b0 / sqrt(v0), 4) as z from fin
union all select 'x1', round(b1, 6), round(sqrt(v1), 6), round(b1 / sqrt(v1), 4) from fin
union all select 'x2', round(b2, 6), round(sqrt(v2), 6), round(b2 / sqrt(v2), 4) from fin""",
        recursive=True,
    ),
)
def logistic_terms(spark, d):
    found = models.logistic_terms(_hazard_rows(spark, d).where(F.year("d") <= LAST_TRAINED), "label", ["x1", "x2"])
    return found.select("term", F.round("coefficient", 6).alias("coefficient"), F.round("se", 6).alias("se"), F.round("z", 4).alias("z"))


@register("logistic_hazard_auc", fx.oracle(_PERIODS, _NEWTON, "rk as (select y = 1 as y, rank() over (order by hazard) + (count(*) over (partition by hazard) - 1) / 2 as k from hz)", body="select count(*) as n, count(*) filter (y) as pos, round((sum(k) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / (count(*) filter (y) * count(*) filter (not y)), 6) as auc from rk", recursive=True))
def logistic_hazard_auc(spark, d):
    found = stats.auc(_hazards(spark, d), "hazard", F.col("label") == 1)
    return found.select("n", "pos", F.round("auc", 6).alias("auc"))


@register("logistic_decile_lift", fx.oracle(_PERIODS, _NEWTON, "ct as (select quantile_cont(hazard, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts, avg(y) as base from hz)", body="select 10 - len(list_filter(cuts, lambda c: hazard > c)) as decile, count(*) as n, round(avg(y), 9) as rate, round(avg(y) / any_value(base), 6) as lift from hz, ct group by 1", recursive=True))
def logistic_decile_lift(spark, d):
    found = models.decile_lift(_hazards(spark, d), "hazard", "label")
    return found.select(F.col("decile").cast("long").alias("decile"), "n", F.round("rate", 9).alias("rate"), F.round("lift", 6).alias("lift"))


@register("auc_rank_sum_of_prices", "with r as (select l_returnflag = 'R' as y, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as k from lineitem) select count(*) as n, count(*) filter (y) as pos, round((sum(k) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / (count(*) filter (y) * count(*) filter (not y)), 9) as auc from r")
def auc_rank_sum_of_prices(spark, d):
    """As auc_rank_sum, over a score with nearly as many values as rows."""
    return stats.auc(fx.table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R").select("n", "pos", F.round("auc", 9).alias("auc"))


@register("percentiles_of_prices", "select unnest([0.0, 0.1, 0.5, 0.9, 1.0]) as share, round(unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.9, 1.0])), 6) as value from lineitem")
def percentiles_of_prices(spark, d):
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = stats.percentiles(fx.table(spark, d, "lineitem"), "l_extendedprice", shares)
    return spark.createDataFrame(list(zip(shares, found, strict=True)), "share double, value double").withColumn("value", F.round("value", 6))


def _late_rows(spark, d):
    """A label that both engines can make: lines that were dear for their quantity."""
    line = fx.table(spark, d, "lineitem")
    return line.select(F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.year("l_shipdate").alias("y"), (F.col("l_extendedprice") / 1000 + F.col("l_discount") * 100).alias("label"))


@register(
    "ridge_composite_spread",
    """with v as (select l_extendedprice / 1000 + l_discount * 100 as y, l_quantity as x1, l_discount as x2, year(l_shipdate) <= 1999 as train from lineitem),
m as (select count(*) as n, avg(y) as my, avg(x1) as m1, avg(x2) as m2, var_pop(x1) * count(*) + 10 as s11, var_pop(x2) * count(*) + 10 as s22, covar_pop(x1, x2) * count(*) as s12, covar_pop(x1, y) * count(*) as s1, covar_pop(x2, y) * count(*) as s2 from v where train),
b as (select *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) as b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) as b2 from m),
c as (select y, my + b1 * (x1 - m1) + b2 * (x2 - m2) as composite from v, b where not train),
q as (select quantile_cont(composite, 0.2) as low, quantile_cont(composite, 0.8) as high from c),
s as (select count(y) filter (composite > high) as n1, count(y) filter (composite <= low) as n2, avg(y) filter (composite > high) as a1, avg(y) filter (composite <= low) as a2, var_samp(y) filter (composite > high) as v1, var_samp(y) filter (composite <= low) as v2 from c, q)
select n1, n2, round(a1 - a2, 3) as difference, round((a1 - a2) / sqrt(v1 / n1 + v2 / n2), 2) as t from s""",
)
def ridge_composite_spread(spark, d):
    found = models.ridge_composite(_late_rows(spark, d), "label", ["x1", "x2"], F.col("y") <= 1999)
    cuts = stats.percentiles(found, "composite", [0.2, 0.4, 0.6, 0.8])
    found = models.spread(found.withColumn("bucket", sum((F.col("composite") > c).cast("int") for c in cuts) + 1), "label")
    return found.select("n1", "n2", F.round("difference", 3).alias("difference"), F.round("t", 2).alias("t"))
