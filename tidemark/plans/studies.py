"""The event store, returns, day 0, market models and the tests of an event study."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar, udfs
from ..operators import dedupe, portfolio, resample, returns, stats, study
from ..sources import schemas
from . import fixtures as fx
from .registry import register

# The oracle's side of returns, day 0 and windows.
RETURNS = """
cal as (select date, row_number() over (order by date) as o from (select distinct date from fx_bars)),
lagged as (select ticker, date, adj_close, o, lag(adj_close) over w as p0, lag(o) over w as o0 from fx_bars join cal using (date) window w as (partition by ticker order by date)),
rets as (select ticker, date, ln(adj_close / p0) as ret from lagged where o - o0 = 1),
panel as (select s.ticker, s.date, s.ret as stock, m.ret as market, row_number() over (partition by s.ticker order by s.date) - 1 as idx
  from rets s join rets m on m.ticker = 'INDEX' and m.date = s.date where s.ticker <> 'INDEX')"""
DAY0 = f"""
mcal as (select date from rets where ticker = 'INDEX'),
dated as (select *, cast({fx.LOCAL} as date) + case when hour({fx.LOCAL}) >= 16 then 1 else 0 end as td from fx_announcements),
day0s as (select d.*, m.date as day0 from dated d asof left join mcal m on d.td <= m.date)"""
WINDOWS = """
placed as (select a.ann_id, a.ticker, a.day0, p.idx as pos, l.last, case when l.last is null then 'no_prices' when p.idx is null then 'no_day0' when p.idx - 120 < 0 or p.idx + 20 > l.last then 'window' end as reason
  from day0s a left join (select ticker, max(idx) as last from panel group by ticker) l using (ticker) left join panel p on p.ticker = a.ticker and p.date = a.day0),
uniq as (select ticker, day0, pos, count(*) as weight from placed where reason is null group by all),
days as (select u.ticker, u.day0, u.weight, p.idx - u.pos as rel_day, p.stock, p.market from uniq u join panel p on p.ticker = u.ticker and p.idx between u.pos - 120 and u.pos + 20 and (p.idx <= u.pos - 21 or p.idx >= u.pos - 5)),
model as (select ticker, day0, regr_slope(stock, market) as beta, regr_intercept(stock, market) as alpha, avg(market) as mm, regr_sxx(stock, market) as ss, count(*) as n from days where rel_day <= -21 group by all),
fitted as (select m.*, sqrt(r.rss / (n - 2)) as sd from model m join (select ticker, day0, sum((stock - alpha - beta * market) ^ 2) as rss from days join model using (ticker, day0) where rel_day <= -21 group by all) r using (ticker, day0)),
ab as (select ticker, day0, weight, rel_day, stock - alpha - beta * market as ar, case when rel_day >= -5 then (stock - alpha - beta * market) / (sd * sqrt(1 + 1.0 / n + (market - mm) ^ 2 / ss)) end as sar from days join fitted using (ticker, day0)),
ranked as (select *, row_number() over (partition by ticker, day0 order by ar, rel_day) as rank from ab)"""
STUDY = (fx.BARS, fx.ANNOUNCEMENTS, RETURNS, DAY0, WINDOWS)


def panel(spark, d):
    """Aligned returns and the index's calendar. Returns and their alignment are one row per ticker and week, read several
    times by each study, so they are kept; an executor that is lost takes only its part, which is computed again."""
    rets = returns.calendar_returns(fx.bars(spark, d)).persist()
    index = rets.where(F.col("ticker") == fx.INDEX).select("date").distinct()
    return returns.aligned(rets, fx.INDEX).persist(), index


def studied(spark, d):
    """Abnormal returns of all announcements."""
    prices, index = panel(spark, d)
    return study.study(fx.announcements(spark, d), prices, index)


@register(
    "event_store",
    fx.oracle(
        fx.ANNOUNCEMENTS, fx.TRADES,
        body=f"""select ann_id || '#' || (row_number() over (partition by ann_id order by {fx.TRADE_ORDER}) - 1) as event_id, ticker, headline, price_sensitive, director_name, trade_type, nature,
  try_cast(quantity as decimal(38,9)) as quantity, try_cast(total_consideration as decimal(38,9)) as total_consideration, try_cast(trade_date as date) as trade_date,
  date_diff('day', try_cast(trade_date as date), cast({fx.LOCAL} as date)) as disclosure_lag_days
from fx_trades join fx_announcements using (ann_id)""",
    ),
)
def event_store(spark, d):
    """Versioned extractions to one row per trade: latest version, typed JSON, positions, announcements, disclosure lag."""
    rows = fx.extractions(spark, d).where("prompt_version = 'trades_v3' and model = 'bulk'")
    latest = dedupe.latest(rows.select("ann_id", "extracted_at", "payload"), ["ann_id"], [F.desc("extracted_at"), F.desc(F.xxhash64("payload"))])
    parsed, _ = schemas.parse_payload(latest, "payload", schemas.TRADES_PAYLOAD)
    trades = parsed.select("ann_id", F.posexplode("parsed.trades").alias("idx", "t"))
    value = lambda f: F.col(f"t.{f}.value")
    day = scalar.date_or_null(value("trade_date"))
    both = trades.join(fx.announcements(spark, d), "ann_id")
    return both.select(
        F.concat_ws("#", "ann_id", "idx").alias("event_id"), "ticker", "headline", "price_sensitive", value("director_name").alias("director_name"), value("trade_type").alias("trade_type"), value("nature").alias("nature"),
        scalar.numeric(value("quantity")).alias("quantity"), scalar.numeric(value("total_consideration")).alias("total_consideration"), day.alias("trade_date"),
        F.datediff(scalar.local_date(F.col("announced_at")), day).cast("long").alias("disclosure_lag_days"),
    )


@register("returns_calendar_adjacent", fx.oracle(fx.BARS, RETURNS, body="select ticker, date, round(ret, 9) as ret from rets"))
def returns_calendar_adjacent(spark, d):
    return returns.calendar_returns(fx.bars(spark, d)).select("ticker", "date", F.round("ret", 9).alias("ret"))


@register("returns_aligned", fx.oracle(fx.BARS, RETURNS, body="select ticker, date, round(stock, 9) as stock, round(market, 9) as market, idx from panel"))
def returns_aligned(spark, d):
    return panel(spark, d)[0].select("ticker", "date", F.round("stock", 9).alias("stock"), F.round("market", 9).alias("market"), F.col("idx").cast("long").alias("idx"))


@register("event_day_zero", fx.oracle(fx.BARS, fx.ANNOUNCEMENTS, RETURNS, DAY0, body="select ann_id, day0 from day0s"))
def event_day_zero(spark, d):
    return study.day_zero(fx.announcements(spark, d), panel(spark, d)[1]).select("ann_id", "day0")


@register("event_skip_report", fx.oracle(*STUDY, body="select coalesce(reason, 'studied') as status, count(*) as n from placed group by all"))
def event_skip_report(spark, d):
    prices, index = panel(spark, d)
    return study.report(study.events(study.day_zero(fx.announcements(spark, d), index), prices))


@register("event_windows", fx.oracle(*STUDY, body="select ticker, day0, rel_day, weight, round(stock, 9) as stock, round(market, 9) as market from days"))
def event_windows(spark, d):
    prices, index = panel(spark, d)
    rows = study.windows(study.events(study.day_zero(fx.announcements(spark, d), index), prices), prices)
    return rows.select("ticker", "day0", F.col("rel_day").cast("long").alias("rel_day"), "weight", F.round("stock", 9).alias("stock"), F.round("market", 9).alias("market"))


@register("market_model", fx.oracle(*STUDY, body="select ticker, day0, round(alpha, 7) as alpha, round(beta, 6) as beta, round(sd, 7) as residual_std, n as n_obs from fitted"))
def market_model(spark, d):
    prices, index = panel(spark, d)
    rows = study.windows(study.events(study.day_zero(fx.announcements(spark, d), index), prices), prices)
    return study.market_model(rows).select("ticker", "day0", F.round("alpha", 7).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("residual_std", 7).alias("residual_std"), "n_obs")


@register("abnormal_returns", fx.oracle(*STUDY, body="select ticker, day0, rel_day, round(ar, 7) as ar, round(sar, 5) as sar, rank from ranked where rel_day >= -5"))
def abnormal_returns(spark, d):
    rows = studied(spark, d).where("rel_day >= -5")
    return rows.select("ticker", "day0", F.col("rel_day").cast("long").alias("rel_day"), F.round("ar", 7).alias("ar"), F.round("sar", 5).alias("sar"), F.col("rank").cast("long").alias("rank"))


@register("event_study_caar", fx.oracle(*STUDY, "m as (select rel_day, sum(weight)::bigint as n, sum(ar * weight) / sum(weight) as mean_ar from ab where rel_day >= -5 group by rel_day)", body="select rel_day, n, round(mean_ar, 8) as mean_ar, round(sum(mean_ar) over (order by rel_day), 8) as caar from m"))
def event_study_caar(spark, d):
    """Flagship: orders to event store to returns, market models, abnormal returns and their cumulated mean."""
    return study.caar(studied(spark, d)).select(F.col("rel_day").cast("long").alias("rel_day"), "n", F.round("mean_ar", 8).alias("mean_ar"), F.round("caar", 8).alias("caar"))


_SCAR = "scars as (select ticker, day0, weight, sum(sar) / sqrt(26) as scar from ab where rel_day >= -5 group by all)"


@register("event_study_bmp", fx.oracle(*STUDY, _SCAR, "every as (select scar from scars, range(weight))", body="select count(*) as n, round(avg(scar), 6) as mean_scar, round(avg(scar) / (stddev_samp(scar) / sqrt(count(*))), 5) as z from every"))
def event_study_bmp(spark, d):
    return study.bmp(studied(spark, d)).select("n", F.round("mean_scar", 6).alias("mean_scar"), F.round("z", 5).alias("z"))


@register("event_study_corrado", fx.oracle(*STUDY, body="select rel_day, round(sum((rank - 63.5) * weight) / sum(weight), 6) as mean_rank, round(sum((rank - 63.5) * weight) / sum(weight) / sqrt((126 * 126 - 1) / 12.0 / sum(weight)), 5) as z from ranked where rel_day >= -5 group by rel_day"))
def event_study_corrado(spark, d):
    return study.corrado(studied(spark, d)).select(F.col("rel_day").cast("long").alias("rel_day"), F.round("mean_rank", 6).alias("mean_rank"), F.round("z", 5).alias("z"))


#: The error function by its series without cancellation; enough terms for any z here.
_ERF = "(select 2 / sqrt(pi()) * exp(-x * x) * sum(pow(4, n) * gamma(n + 1) / gamma(2 * n + 2) * pow(x, 2 * n + 1)) from range(0, 80) as terms(n))"


@register("event_study_p_values", fx.oracle(*STUDY, "zs as (select rel_day, sum((rank - 63.5) * weight) / sum(weight) / sqrt((126 * 126 - 1) / 12.0 / sum(weight)) as z from ranked where rel_day >= -5 group by rel_day)", "xs as (select *, abs(z) / sqrt(2) as x from zs)", body=f"select rel_day, round(z, 5) as z, round(1 - {_ERF}, 6) as p from xs"))
def event_study_p_values(spark, d):
    found = study.corrado(studied(spark, d)).withColumn("p", udfs.z_to_p("z"))
    return found.select(F.col("rel_day").cast("long").alias("rel_day"), F.round("z", 5).alias("z"), F.round("p", 6).alias("p"))


FORWARD = "fwd as (select ticker, date, idx, sum(stock - market) over w as car, count(*) over w as n from panel window w as (partition by ticker order by idx rows between 1 following and 21 following))"


@register("forward_car", fx.oracle(fx.BARS, RETURNS, FORWARD, body="select ticker, date, round(car, 8) as car from fwd where n = 21"))
def forward_car(spark, d):
    return returns.forward_car(panel(spark, d)[0], 21).select("ticker", "date", F.round("car", 8).alias("car"))


#: Frames of weekly bars.
WEEKLY = {"momentum": 26, "volatility": 13, "high": 52, "moves": 12}

FEATURES = """levels as (select *, sum(stock) over (partition by ticker order by idx) as level from panel),
feats as (select ticker, date, idx, sum(stock - market) over (partition by ticker order by idx rows between 26 preceding and 1 preceding) as momentum,
  stddev_samp(stock) over (partition by ticker order by idx rows between 12 preceding and current row) as volatility,
  level - max(level) over (partition by ticker order by idx rows between 51 preceding and current row) as from_high,
  avg(abs(stock)) over (partition by ticker order by idx rows between 12 preceding and 1 preceding) as mean_abs from levels)"""


@register("trailing_features", fx.oracle(fx.BARS, RETURNS, FEATURES, body="select ticker, date, round(momentum, 8) as momentum, round(volatility, 8) as volatility, round(from_high, 8) as from_high, round(mean_abs, 8) as mean_abs from feats"))
def trailing_features(spark, d):
    rows = returns.trailing_features(panel(spark, d)[0], **WEEKLY)
    return rows.select("ticker", "date", *[F.round(c, 8).alias(c) for c in ("momentum", "volatility", "from_high", "mean_abs")])


DAILY_FEATURES = FEATURES.replace("26 preceding", "126 preceding").replace("12 preceding and current", "62 preceding and current").replace("51 preceding", "251 preceding").replace("12 preceding and 1", "63 preceding and 1")


@register("trailing_features_daily", fx.oracle(fx.DAILY_BARS, RETURNS, DAILY_FEATURES, body="select ticker, date, round(momentum, 7) as momentum, round(volatility, 7) as volatility, round(from_high, 7) as from_high, round(mean_abs, 7) as mean_abs from feats"))
def trailing_features_daily(spark, d):
    rows = returns.trailing_features(returns.aligned(returns.calendar_returns(fx.bars(spark, d, "day")), fx.INDEX))
    return rows.select("ticker", "date", *[F.round(c, 7).alias(c) for c in ("momentum", "volatility", "from_high", "mean_abs")])


@register("forward_coverage", fx.oracle(fx.BARS, RETURNS, FORWARD, body="select ticker, count(*) as n, count(*) filter (n < 21) as left_out from fwd group by ticker"))
def forward_coverage(spark, d):
    return returns.forward_coverage(panel(spark, d)[0], 21)


@register("peer_basket_excess", fx.oracle(fx.BARS, RETURNS, body="select ticker, date, round(ret - (sum(ret) over w - ret) / (count(*) over w - 1), 8) as excess from rets where ticker <> 'INDEX' window w as (partition by date) qualify count(*) over w >= 3"))
def peer_basket_excess(spark, d):
    rows = returns.calendar_returns(fx.bars(spark, d)).where(F.col("ticker") != fx.INDEX).withColumn("sector", F.lit("all"))
    return returns.peer_excess(rows, "sector").where("excess is not null").select("ticker", "date", F.round("excess", 8).alias("excess"))


@register("cross_section_top_decile", fx.oracle(fx.BARS, RETURNS, body="select ticker, date from (select *, percent_rank() over (partition by date order by stock) as r from panel) where r >= 0.9"))
def cross_section_top_decile(spark, d):
    rank = F.percent_rank().over(Window.partitionBy("date").orderBy("stock"))
    return panel(spark, d)[0].withColumn("r", rank).where("r >= 0.9").select("ticker", "date")


@register(
    "portfolio_calendar_time",
    fx.oracle(fx.BARS, RETURNS, "pos as (select ticker, idx as pos from panel where idx % 9 = 0)", "held as (select p.date, p.stock - p.market - case when p.idx - pos = 1 then 0.002 else 0 end - case when p.idx - pos = 13 then 0.002 else 0 end as r from pos join panel p on p.ticker = pos.ticker and p.idx between pos + 1 and pos + 13)",
              body="select date, count(*) as n_open, round(avg(r), 8) as ret from held group by date"),
)
def portfolio_calendar_time(spark, d):
    prices = panel(spark, d)[0]
    positions = prices.where("idx % 9 = 0").select("ticker", F.col("idx").alias("pos"))
    return portfolio.daily(positions, prices, hold=13).select("date", "n_open", F.round("ret", 8).alias("ret"))


_INDEX = "idx as (select date, ret from rets where ticker = 'INDEX')"


@register("portfolio_drawdown", fx.oracle(fx.BARS, RETURNS, _INDEX, "eq as (select date, sum(ret) over (order by date) as equity from idx)", body="select date, round(equity, 8) as equity, round(equity - greatest(max(equity) over (order by date), 0), 8) as drawdown from eq"))
def portfolio_drawdown(spark, d):
    index = returns.calendar_returns(fx.bars(spark, d)).where(F.col("ticker") == fx.INDEX)
    return portfolio.drawdown(index).select("date", F.round("equity", 8).alias("equity"), F.round("drawdown", 8).alias("drawdown"))


@register("portfolio_summary", fx.oracle(fx.BARS, RETURNS, body="select ticker, year(date) as y, count(*) as n, round(avg(ret), 8) as mean, round(avg(ret) / stddev_samp(ret) * sqrt(52), 5) as sharpe, round(avg((ret > 0)::int), 8) as hit_rate from rets group by all"))
def portfolio_summary(spark, d):
    rows = returns.calendar_returns(fx.bars(spark, d)).withColumn("y", F.year("date").cast("long"))
    return portfolio.summary(rows, periods=52, by=["ticker", "y"]).select("ticker", "y", "n", F.round("mean", 8).alias("mean"), F.round("sharpe", 5).alias("sharpe"), F.round("hit_rate", 8).alias("hit_rate"))


def _bits(digits: int, *seed: str) -> str:
    """What ``resample.random_bits`` gives, in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(seed)})), 1, {digits}))::bigint"


@register("placebo_draws", fx.oracle(fx.BARS, RETURNS, FORWARD, fx.ANNOUNCEMENTS, "vals as (select ticker, idx, car from fwd where n = 21)", "sizes as (select ticker, count(*) as n from vals group by ticker)",
    f"drawn as (select a.ticker, draw, ({_bits(8, '1', 'draw', 'ann_id')} * n) >> 32 as i from fx_announcements a join sizes using (ticker), range(1, 101) r(draw) where price_sensitive)",
    body="select cast(draw as int) as draw, round(avg(car), 8) as mean from drawn join vals on drawn.ticker = vals.ticker and drawn.i = vals.idx group by draw"))
def placebo_draws(spark, d):
    prices = panel(spark, d)[0]
    values = returns.forward_car(prices, 21).select("ticker", F.col("idx").alias("i"), F.col("car").alias("value"))
    found = resample.placebo(fx.announcements(spark, d).where("price_sensitive").select("ticker", F.col("ann_id").alias("event_id")), values, draws=100)
    return found.select("draw", F.round("mean", 8).alias("mean"))


_EDGES = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
_BOOT = (
    f"drawn as (select draw, car, {_bits(8, '1', 'draw', 'ticker', 'idx')} / 4294967296.0 as u from fwd, range(1, 201) r(draw) where n = 21)",
    "times as (select draw, car, " + " + ".join(f"(u >= {e}::double)::int" for e in _EDGES) + " as w from drawn)",
    "boot as (select cast(draw as int) as draw, sum(w * car) / sum(w) as mean from times group by draw)",
)


def _bootstrap(cars):
    return resample.poisson_bootstrap(cars, "car", F.concat_ws(":", "ticker", "idx"), draws=200)


@register("bootstrap_means", fx.oracle(fx.BARS, RETURNS, FORWARD, *_BOOT, body="select draw, round(mean, 8) as mean from boot"))
def bootstrap_means(spark, d):
    return _bootstrap(returns.forward_car(panel(spark, d)[0], 21)).select("draw", F.round("mean", 8).alias("mean"))


@register("bootstrap_interval", fx.oracle(fx.BARS, RETURNS, FORWARD, *_BOOT, "truth as (select avg(car) as mean from fwd where n = 21)", "ranked as (select mean, row_number() over (order by mean) as k from boot)",
    body="select count(*) as draws, round(max(case when k = 5 then ranked.mean end), 8) as lower, round(max(case when k = 195 then ranked.mean end), 8) as upper, round(avg((ranked.mean <= truth.mean)::int), 8) as percentile from ranked, truth"))
def bootstrap_interval(spark, d):
    cars = returns.forward_car(panel(spark, d)[0], 21)
    found = resample.interval(_bootstrap(cars), cars.agg(F.avg("car")).first()[0])
    return found.select("draws", *[F.round(c, 8).alias(c) for c in ("lower", "upper", "percentile")])


@register("permutation_differences", fx.oracle(fx.BARS, RETURNS,
    f"drawn as (select cast(draw as int) as draw, stock, {_bits(15, '1', 'draw', 'ticker', 'idx')} as h, ticker || ':' || idx as key from panel, range(1, 201) r(draw))",
    "ranked as (select draw, stock, row_number() over (partition by draw order by h, key) as k from drawn)", "many as (select count(*) as n from panel where ticker = 'BUILDING')",
    body="select draw, round(avg(stock) filter (k <= n) - avg(stock) filter (k > n), 8) as difference from ranked, many group by draw"))
def permutation_differences(spark, d):
    found = resample.permutation(panel(spark, d)[0], "stock", F.col("ticker") == "BUILDING", F.concat_ws(":", "ticker", "idx"), draws=200)
    return found.select("draw", F.round("difference", 8).alias("difference"))


#: Trailing excess that a regime control has to have, and its length in weekly bars (a quarter, as 63 daily bars are).
GATE, AHEAD = 0.02, 13
_CONTROLS = (
    f"win as (select ticker, date, idx, lead(date, 1) over w as s, lead(date, {AHEAD}) over w as e, sum(stock - market) over (w rows between 1 following and {AHEAD} following) as car from panel window w as (partition by ticker order by idx))",
    "ev as (select ticker, d from fx_results where year(d) % 3 = 0)",
    f"ok as (select win.* from win join feats using (ticker, idx) where idx >= 26 and round(momentum, 9) >= {GATE} and e is not null and not exists (select 1 from ev where ev.ticker = win.ticker and abs(date_diff('day', ev.d, win.date)) <= 91))",
    "nx as (select a.ticker, a.date, min(b.date) as then_date from ok a join ok b on a.ticker = b.ticker and a.e < b.s group by all)",
    "chain as (select ticker, min(date) as date from ok group by ticker union all select c.ticker, nx.then_date from chain c join nx on nx.ticker = c.ticker and nx.date = c.date)",
)


@register("regime_controls", fx.oracle(fx.BARS, RETURNS, FEATURES, fx.ANNOUNCEMENTS, fx.RESULTS, *_CONTROLS, body='select ticker, date, s as start, e as "end", round(car, 8) as car from chain join ok using (ticker, date)').replace("with ", "with recursive ", 1))
def regime_controls(spark, d):
    prices = panel(spark, d)[0]
    window = Window.partitionBy("ticker").orderBy("idx")
    ahead = F.sum(F.col("stock") - F.col("market")).over(window.rowsBetween(1, AHEAD))
    windows = prices.select("ticker", "idx", F.lead("date", 1).over(window).alias("start"), F.lead("date", AHEAD).over(window).alias("end"), ahead.alias("car"))
    gate = returns.trailing_features(prices, **WEEKLY).where((F.col("idx") >= 26) & (F.round("momentum", 9) >= GATE)).select("ticker", "date", "idx")
    events = fx.results_dates(spark, d).where(F.year("d") % 3 == 0)
    free = resample.clear_of_events(gate.join(windows, ["ticker", "idx"]).where(F.col("end").isNotNull()), events, ["ticker"], "date", "d")
    return resample.disjoint(free, ["ticker"], "start", "end").select("ticker", "date", "start", "end", F.round("car", 8).alias("car"))


@register("matched_controls", fx.oracle(fx.BARS, RETURNS, FEATURES, "f as (select ticker, date, round(momentum, 9) as momentum from feats where idx >= 26)",
    "pairs as (select t.ticker, t.date, t.momentum, c.ticker as match, row_number() over (partition by t.ticker, t.date order by abs(c.momentum - t.momentum), c.ticker) as k from f t join f c on c.date = t.date and c.ticker <> 'BUILDING' where t.ticker = 'BUILDING')",
    body="select date, momentum, match from pairs where k = 1"))
def matched_controls(spark, d):
    rows = returns.trailing_features(panel(spark, d)[0], **WEEKLY).where("idx >= 26").select("ticker", "date", F.round("momentum", 9).alias("momentum"))
    treated, pool = rows.where("ticker = 'BUILDING'").drop("ticker"), rows.where("ticker <> 'BUILDING'")
    return resample.nearest_match(treated, pool, ["date"], "momentum", "ticker").select("date", "momentum", "match")


@register("event_t_tests", fx.oracle(fx.BARS, RETURNS, FORWARD, body="select ticker, count(*) as n, round(avg(car), 8) as mean, round(avg(car) / (stddev_samp(car) / sqrt(count(*))), 5) as t from fwd where n = 21 group by ticker"))
def event_t_tests(spark, d):
    return stats.one_sample_t(returns.forward_car(panel(spark, d)[0], 21), "car", ["ticker"]).select("ticker", "n", F.round("mean", 8).alias("mean"), F.round("t", 5).alias("t"))
