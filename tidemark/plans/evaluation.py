"""Scoring of extractions: scalar documents, aligned lists, runs, champions, calibration and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, linking, stats
from ..operators.evaluate import Field
from . import fixtures as fx
from .registry import register

FIELDS = (
    Field("director_name", text=True, identity=True, strong=True), Field("trade_type", text=True, identity=True), Field("security_class", text=True, identity=True),
    Field("quantity"), Field("total_consideration"), Field("trade_date", identity=True, strong=True),
)
NAMES = [f.name for f in FIELDS]
REPORT = [evaluate.DETECTION, *NAMES]


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def _out(f: Field, g: str = "g", p: str = "p") -> str:
    a, b = f"{g}.{f.name}", f"{p}.{f.name}"
    same = f"{_norm(a)} = {_norm(b)}" if f.text else f"{a} = {b}"
    return f"case when {a} is null and {b} is null then 'correct' when {a} is null then 'hallucinated' when {b} is null then 'missed' when {same} then 'correct' else 'wrong' end"


_STATED = lambda f: f"({f.name}_g is not null and {f.name}_p is not null and o_{f.name} = 'correct')::int"
#: Greedy matching in rounds: the best pair of each document among those left, as many rounds as a document has pairs.
_PAIRS = "pr as (select g.ann_id, g.idx as g, p.idx as p, " + ", ".join(f"{_out(f)} as o_{f.name}, g.{f.name} as {f.name}_g, p.{f.name} as {f.name}_p" for f in FIELDS) + " from fx_golden g join fx_pred p using (ann_id))"
_SCORED = (
    "sc as (select *, " + " + ".join(f"(o_{f.name} = 'correct')::int" for f in FIELDS) + " as agreement, " + " + ".join(_STATED(f) for f in FIELDS if f.identity) + " as identity, " + " + ".join(_STATED(f) for f in FIELDS if f.strong) + " as strong from pr)"
)
_RANKED = "rk as (select ann_id, g, p, row_number() over (partition by ann_id order by agreement desc, identity desc, g, p) as k from sc where identity >= 2 and strong >= 1)"
_FOLD = """fold as (
  select ann_id, list_reduce(list_prepend([]::struct(g int, p int)[], list([{'g': g::int, 'p': p::int}] order by k)),
    lambda a, x: case when len(list_filter(a, lambda m: m.g = x[1].g or m.p = x[1].p)) > 0 then a else list_concat(a, x) end) as ms
  from rk group by ann_id),
mt as (select ann_id, m.g as g, m.p as p from (select ann_id, unnest(ms) as m from fold))"""
LISTS = (fx.GOLDEN, fx.PREDICTED, _PAIRS, _SCORED, _RANKED, _FOLD)
_OUTCOMES = (
    "known as (select distinct ann_id from fx_pred)",
    "outs as (select ann_id, 'trade_detection' as field, 'correct' as outcome from mt"
    + "".join(f" union all select mt.ann_id, '{f.name}', o_{f.name} from mt join pr using (ann_id, g, p)" for f in FIELDS)
    + " union all select ann_id, 'trade_detection', 'missed' from fx_golden semi join known using (ann_id) where not exists (select 1 from mt where mt.ann_id = fx_golden.ann_id and mt.g = fx_golden.idx)"
    + " union all select ann_id, 'trade_detection', 'hallucinated' from fx_pred where not exists (select 1 from mt where mt.ann_id = fx_pred.ann_id and mt.p = fx_pred.idx))",
)


def _totals(spark, d):
    return evaluate.total_lists(fx.lists(spark, d), None, "ann_id", FIELDS)


@register("match_greedy", fx.oracle(*LISTS, body="select ann_id, g, p from mt"))
def match_greedy(spark, d):
    return evaluate.match(fx.lists(spark, d), None, "ann_id", FIELDS)


@register("score_lists", fx.oracle(*LISTS, *_OUTCOMES, body="select ann_id, field, outcome, count(*) as n from outs group by all"))
def score_lists(spark, d):
    return evaluate.count_lists(fx.lists(spark, d), None, "ann_id", FIELDS)


def _counts(source: str) -> str:
    return f"tl as (select field, count(*) filter (outcome = 'correct') as correct, count(*) filter (outcome = 'wrong') as wrong, count(*) filter (outcome = 'missed') as missed, count(*) filter (outcome = 'hallucinated') as hallucinated, count(*) as total from {source} group by field)"


@register("score_tally", fx.oracle(*LISTS, *_OUTCOMES, _counts("outs"), body="select list_position(" + str(REPORT) + ", field) - 1 as position, *, round(correct / total, 9) as accuracy from tl"))
def score_tally(spark, d):
    return evaluate.tally(_totals(spark, d), REPORT).withColumn("position", F.col("position").cast("int")).withColumn("accuracy", F.round("accuracy", 9))


@register("score_run_overall", fx.oracle(*LISTS, *_OUTCOMES, _counts("outs"), body="select round(sum(correct) / sum(total), 9) as overall_accuracy, count(*) as n_fields from tl"))
def score_run_overall(spark, d):
    run = evaluate.evaluation_run(evaluate.tally(_totals(spark, d), REPORT))
    return run.select(F.round("overall_accuracy", 9).alias("overall_accuracy"), F.size("field_scores").cast("long").alias("n_fields"))


@register("score_run_nested", fx.oracle(*LISTS, *_OUTCOMES, _counts("outs"), body="select (select round(sum(correct) / sum(total), 9) from tl) as overall_accuracy, list_position(" + str(REPORT) + ", field) - 1 as position, *, round(correct / total, 9) as accuracy from tl"))
def score_run_nested(spark, d):
    """The run's nested scores, laid out again in their order."""
    run = evaluate.evaluation_run(evaluate.tally(_totals(spark, d), REPORT))
    rows = run.select(F.round("overall_accuracy", 9).alias("overall_accuracy"), F.posexplode("field_scores").alias("position", "s"))
    return rows.select("overall_accuracy", "position", "s.*").withColumn("accuracy", F.round("accuracy", 9))


@register("score_scalar_documents", fx.oracle(fx.GOLDEN, fx.PREDICTED, "g as (select * from fx_golden where idx = 1)", "p as (select * from fx_pred where idx = 1)", "o as (" + " union all ".join(f"select '{f.name}' as field, {_out(f)} as outcome from g join p using (ann_id)" for f in FIELDS) + ")", body="select field, outcome, count(*) as n from o group by all"))
def score_scalar_documents(spark, d):
    first = lambda rows: rows.where("idx = 1")
    return evaluate.score_fields(first(fx.golden(spark, d)), first(fx.predicted(spark, d)), ["ann_id"], FIELDS).groupBy("field", "outcome").agg(F.count("*").alias("n"))


@register("score_skipped", fx.oracle(fx.GOLDEN, fx.PREDICTED, body="select count(*) filter (p.ann_id is not null) as n_documents, count(*) filter (p.ann_id is null) as n_skipped from (select distinct ann_id from fx_golden) g left join (select distinct ann_id from fx_pred) p using (ann_id)"))
def score_skipped(spark, d):
    return evaluate.skipped(fx.golden(spark, d), fx.predicted(spark, d), ["ann_id"])


_RUNS = "runs as (select o_orderpriority as model, (o_orderkey % 9)::int as version, round(avg((o_orderkey % 7 > 1)::int), 9) as accuracy, max(o_orderkey) as run_id from orders where not (o_orderpriority = '5-LOW' and o_orderkey % 9 = 4) group by all)"


def _runs(spark, d):
    rows = fx.table(spark, d, "orders").where("not (o_orderpriority = '5-LOW' and o_orderkey % 9 = 4)")
    return rows.groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 9).cast("int").alias("version")).agg(F.round(F.avg((F.col("o_orderkey") % 7 > 1).cast("int")), 9).alias("accuracy"), F.max("o_orderkey").alias("run_id"))


@register("run_champions", fx.oracle(_RUNS, body="select model, version, accuracy, run_id from runs qualify row_number() over (partition by model order by accuracy desc, version desc) = 1"))
def run_champions(spark, d):
    return evaluate.champions(_runs(spark, d), ["model"])


@register("run_version_moves", fx.oracle(_RUNS, "l as (select *, case when lag(version) over w = version - 1 then lag(accuracy) over w end as before from runs window w as (partition by model order by version))", body="select model, version, accuracy, run_id, round(accuracy - before, 9) as change, case when before is null then 'first' when abs(accuracy - before) < 0.02 then 'flat' when accuracy > before then 'up' else 'down' end as move from l"))
def run_version_moves(spark, d):
    return evaluate.version_moves(_runs(spark, d), ["model"]).withColumn("change", F.round("change", 9))


_CONF = "cf as (select l_orderkey, 0.5 + (l_orderkey * 7 + l_linenumber) % 50 / 100.0 as confidence, l_orderkey % 5 > 0 as ok from lineitem)"
_BINS = "bins as (select ((confidence >= 0.80)::int + (confidence >= 0.90)::int + (confidence >= 0.95)::int + (confidence >= 0.98)::int) as bin, count(*) as n, avg(confidence) as mean_confidence, avg(ok::int) as accuracy from cf group by 1)"


def _bins(spark, d):
    rows = fx.table(spark, d, "lineitem").select(((F.lit(50) + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 50) / 100).alias("confidence"), (F.col("l_orderkey") % 5 > 0).alias("ok"))
    return stats.calibration(rows, "confidence", F.col("ok"))


@register("calibration_bins", fx.oracle(_CONF.replace("0.5 + (l_orderkey * 7 + l_linenumber) % 50 / 100.0", "(50 + (l_orderkey * 7 + l_linenumber) % 50) / 100::double"), _BINS, body="select bin, n, round(mean_confidence, 8) as mean_confidence, round(accuracy, 8) as accuracy from bins"))
def calibration_bins(spark, d):
    return _bins(spark, d).select("bin", "n", F.round("mean_confidence", 8).alias("mean_confidence"), F.round("accuracy", 8).alias("accuracy"))


@register("calibration_error", fx.oracle(_CONF.replace("0.5 + (l_orderkey * 7 + l_linenumber) % 50 / 100.0", "(50 + (l_orderkey * 7 + l_linenumber) % 50) / 100::double"), _BINS, body="select round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 8) as ece from bins"))
def calibration_error(spark, d):
    return stats.expected_calibration_error(_bins(spark, d)).select(F.round("ece", 8).alias("ece"))


#: Lines as documents that state an event of a supplier; links are of at most ten days and one per cent of the amount.
LINK_DAYS = 10
_LINKED = f"""
nd as (select distinct l_suppkey as k, cast(l_shipdate as date) as d, l_extendedprice as v from lineitem),
lk as (select a.k, a.d, a.v, b.d as d2, b.v as v2 from nd a join nd b on a.k = b.k and b.d between a.d - {LINK_DAYS} and a.d + {LINK_DAYS} and abs(a.v - b.v) <= 0.01 * greatest(a.v, b.v)),
rc as (select k, d, v, d2, v2 from lk union select rc.k, rc.d, rc.v, lk.d2, lk.v2 from rc join lk on rc.k = lk.k and rc.d2 = lk.d and rc.v2 = lk.v),
cs as (select k, d, v, min({{'d': d2, 'v': v2}}) as root from rc group by all)"""


@register("linked_events", fx.oracle(_LINKED, body="select l_suppkey, cast(l_shipdate as date) as shipped, l_extendedprice, root.d as event_date, root.v as event_value, count(*) as n from lineitem join cs on l_suppkey = k and cast(l_shipdate as date) = d and l_extendedprice = v group by all", recursive=True))
def linked_events(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("shipped"), "l_extendedprice")
    found = linking.linked_events(rows, ["l_suppkey"], "shipped", "l_extendedprice", LINK_DAYS)
    return found.groupBy(*found.columns).agg(F.count("*").alias("n"))


@register(
    "contested_lift",
    """with st as (select l_partkey as e, l_quantity as truth, case when (l_orderkey * 7 + l_linenumber) % 17 = 0 then l_quantity + 1 when (l_orderkey + l_linenumber) % 5 = 0 then l_quantity * 1.004 else l_quantity end as v from lineitem),
en as (select e, truth as q, min(v) as lo, max(v) as hi, count(*) as n from st group by all having count(*) > 1),
jd as (select st.*, case when v - lo <= 0.01 * greatest(v, lo) and hi - v <= 0.01 * greatest(v, hi) then 'corroborated' else 'contested' end as verdict, exists (select 1 from st o where o.e = st.e and o.truth = st.truth and o.v = st.truth) as found from st join en on st.e = en.e and st.truth = en.q),
ag as (select verdict, count(*) as n, count(*) filter (v <> truth) as errors, count(*) filter (v <> truth and found) as elsewhere from jd group by 1)
select verdict, n, errors, elsewhere, round(errors / n, 9) as error_rate, round((errors / n) / nullif((select errors / n from ag where verdict = 'corroborated'), 0), 6) as lift from ag""",
)
def contested_lift(spark, d):
    """Lines of a part and quantity are statements of one quantity, some altered by one and some rounded."""
    q = F.col("l_quantity")
    stated = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 17 == 0, q + 1).when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0, q * 1.004).otherwise(q)
    rows = fx.table(spark, d, "lineitem").select("l_partkey", q.alias("quantity"), q.alias("truth"), stated.alias("stated"))
    found = linking.contested_lift(rows, ["l_partkey", "quantity"], "stated", "truth")
    return found.withColumn("error_rate", F.round("error_rate", 9)).withColumn("lift", F.round("lift", 6))


@register(
    "cross_document_agreement",
    "with v as (select l_partkey, l_suppkey, min(l_extendedprice / l_quantity) as a, max(l_extendedprice / l_quantity) as b, count(*) as n from lineitem group by all having count(*) > 1) select case when a = b then 'exact' when (b - a) / b <= 0.01 then 'within 1%' else 'disagree' end as verdict, count(*) as n from v group by all",
)
def cross_document_agreement(spark, d):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = fx.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(price).alias("a"), F.max(price).alias("b"), F.count("*").alias("n")).where("n > 1")
    verdict = F.when(F.col("a") == F.col("b"), "exact").when((F.col("b") - F.col("a")) / F.col("b") <= 0.01, "within 1%").otherwise("disagree")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
