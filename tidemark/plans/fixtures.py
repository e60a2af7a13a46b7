"""The domain's tables as views over the given ones, in Spark and, as common table expressions, in DuckDB.

Tickers are market segments, bars are weekly average prices, announcements are orders, and extracted trades are lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INDEX = "INDEX"
ZONE = "Australia/Sydney"

#: Headlines by o_orderkey modulo their number: some for each classifier, and some that only look alike.
HEADLINES = (
    "Appendix 4E Preliminary Final Report", "Half Year Results Announcement", "Appendix 3Y Change of Director's Interest Notice", "Results of Annual General Meeting", "Trading Update and Guidance",
    "FY24 audited results", "Notice of Annual General Meeting", "Appointment of Chief Executive", "Resignation of Auditor", "Final Directors Interest Notice", "Cleansing Notice under Section 708A",
    "Annual Report to Shareholders", "Quarterly Activities Report", "Profit Warning", "Change of Registered Office", "CEO succession announced",
)

TRADE_TYPES = {"A": "acquisition", "R": "disposal", "N": "transfer"}
NATURES = {"O": "On-market trade", "F": "Off-market transfer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """ticker, date, adj_close: one aggregation gives each segment's weeks (or days) and, by grouping sets, the pooled index."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    start = F.to_date(F.date_trunc(unit, "l_shipdate"))
    sums = rows.groupBy("c_mktsegment", start.alias("date")).agg(F.sum("p").alias("s"), F.count("p").alias("n"))
    own = sums.select(F.col("c_mktsegment").alias("ticker"), "date", F.round(F.col("s") / F.col("n"), 6).alias("adj_close"))
    pooled = sums.groupBy("date").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("adj_close"))
    return own.unionByName(pooled.select(F.lit(INDEX).alias("ticker"), "date", "adj_close"))


BARS = f"""
fx_prices as (
  select c_mktsegment as ticker, cast(date_trunc('week', l_shipdate) as date) as date, l_extendedprice / l_quantity as p
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
fx_bars as (
  select ticker, date, round(avg(p), 6) as adj_close from fx_prices group by all
  union all select '{INDEX}', date, round(avg(p), 6) from fx_prices group by date)"""

DAILY_BARS = BARS.replace("'week'", "'day'")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id, ticker, announced_at (UTC wall time), headline, price_sensitive."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    headline = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("o_orderkey") % len(HEADLINES) + 1).cast("int"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ann_id"),
        F.col("c_mktsegment").alias("ticker"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))).alias("announced_at"),
        headline.alias("headline"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("price_sensitive"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ANNOUNCEMENTS = f"""
fx_announcements as (
  select o_orderkey as ann_id, c_mktsegment as ticker, o_orderdate + to_hours(cast(o_orderkey % 24 as int)) as announced_at,
    ({_sql_list(HEADLINES)})[cast(o_orderkey % {len(HEADLINES)} as int) + 1] as headline,
    o_orderpriority in ('1-URGENT', '2-HIGH') as price_sensitive
  from orders join customer on o_custkey = c_custkey)"""

#: Sydney wall time of a UTC wall time.
LOCAL = f"((announced_at at time zone 'UTC') at time zone '{ZONE}')"


def _mapped(column: str, names: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col(column)]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line as the trade that an extraction would state: strings, some of them no number or date."""
    line = table(spark, sf_dir, "lineitem")
    bad = F.col("l_orderkey") % 29 == 3
    return line.select(
        F.col("l_orderkey").alias("ann_id"),
        "l_linenumber",
        F.concat(F.lit("Director "), F.col("l_suppkey")).alias("director_name"),
        _mapped("l_returnflag", TRADE_TYPES).alias("trade_type"),
        _mapped("l_linestatus", NATURES).alias("nature"),
        F.when(bad, F.lit("n/a")).otherwise(F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("total_consideration"),
        F.when(F.col("l_orderkey") % 31 == 5, F.lit("2001-02-30")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("trade_date"),
    )


TRADE_FIELDS = ("director_name", "trade_type", "nature", "quantity", "total_consideration", "trade_date")

#: Line numbers repeat within an order, so ties are broken by the fields.
TRADE_ORDER = ", ".join(("l_linenumber", *TRADE_FIELDS))

TRADES = """
fx_trades as (
  select l_orderkey as ann_id, l_linenumber, 'Director ' || l_suppkey as director_name,
    case l_returnflag when 'A' then 'acquisition' when 'R' then 'disposal' when 'N' then 'transfer' end as trade_type,
    case l_linestatus when 'O' then 'On-market trade' when 'F' then 'Off-market transfer' end as nature,
    case when l_orderkey % 29 = 3 then 'n/a' else cast(cast(l_quantity as decimal(18,2)) as varchar) end as quantity,
    cast(cast(l_extendedprice as decimal(18,2)) as varchar) as total_consideration,
    case when l_orderkey % 31 = 5 then '2001-02-30' else strftime(l_shipdate, '%Y-%m-%d') end as trade_date
  from lineitem)"""


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id, model, prompt_version, extracted_at, payload (JSON). Every seventh order was extracted twice: the first
    try found only its first trade. Orders without lines have an empty list."""
    sourced = [F.struct(F.col(f).alias("value"), F.lit(0.9).alias("confidence")).alias(f) for f in TRADE_FIELDS]
    lists = trades(spark, sf_dir).groupBy("ann_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.struct(*sourced).alias("t")))).alias("rows"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ann_id"), F.col("o_orderdate").alias("at"))
    both = orders.join(lists, "ann_id", "left").withColumn("rows", F.transform(F.coalesce("rows", F.array()), lambda x: x["t"]))
    version = lambda days, rows: F.struct(F.expr(f"at + interval {days} days").alias("extracted_at"), F.to_json(F.struct(rows.alias("trades"))).alias("payload"))
    versions = F.array(version(2, F.col("rows")), F.when(F.col("ann_id") % 7 == 0, version(1, F.slice("rows", 1, 1))))
    return both.select("ann_id", F.lit("bulk").alias("model"), F.lit("trades_v3").alias("prompt_version"), F.inline(versions)).where("extracted_at is not null")


#: Line numbers repeat within an order; rows that agree in all of these are the same to every score.
GOLDEN_ORDER = ("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ann_id, idx and the typed fields of hand-labelled trades."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", *GOLDEN_ORDER)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*GOLDEN_ORDER))
    # places first: the sort then carries what is read, and the rows stay dealt by order, which a renamed key below it would hide
    return line.withColumn("idx", place).select(
        F.col("l_orderkey").alias("ann_id"),
        "idx",
        F.concat(F.lit("Director "), F.col("l_suppkey")).alias("director_name"),
        F.col("l_returnflag").alias("trade_type"),
        F.lit("ordinary").alias("security_class"),
        F.col("l_quantity").cast("decimal(18,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total_consideration"),
        F.to_date("l_shipdate").alias("trade_date"),
    )


GOLDEN = f"""
fx_golden as (
  select l_orderkey as ann_id, row_number() over (partition by l_orderkey order by {', '.join(GOLDEN_ORDER)})::int as idx, 'Director ' || l_suppkey as director_name, l_returnflag as trade_type, 'ordinary' as security_class,
    cast(l_quantity as decimal(18,2)) as quantity, cast(l_extendedprice as decimal(18,2)) as total_consideration, cast(l_shipdate as date) as trade_date
  from lineitem)"""


def _predictions() -> tuple[Column, Column]:
    """Of a golden trade: what a model states of it and what it invents, or null, by modulus of a mixed key."""
    k = F.col("ann_id") * 7 + F.col("idx")
    stated = F.struct(
        "idx", F.when(k % 5 == 1, F.concat(F.lit("  "), F.upper("director_name"))).when(k % 23 == 2, F.lit("Somebody Else")).otherwise(F.col("director_name")).alias("director_name"), "trade_type", "security_class",
        F.when(k % 13 != 0, F.col("quantity")).alias("quantity"), F.when(k % 17 == 0, F.col("total_consideration") + 1).otherwise(F.col("total_consideration")).cast("decimal(18,2)").alias("total_consideration"), "trade_date",
    )
    invented = F.struct((F.col("idx") + 100).alias("idx"), F.lit("Nobody").alias("director_name"), "trade_type", "security_class", "quantity", "total_consideration", F.lit("1990-01-01").cast("date").alias("trade_date"))
    return F.when(k % 11 != 0, stated), F.when(k % 19 == 0, invented)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden trades as a model might state them: some dropped, nulled, altered or invented."""
    return golden(spark, sf_dir).select("ann_id", F.inline(F.array(*_predictions()))).where("idx is not null")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden trades (side 0) and the predicted ones (side 1), from one pass over the lines; dealt by order, as places are."""
    rows = golden(spark, sf_dir)
    own = F.struct(*[c for c in rows.columns if c != "ann_id"])
    on = lambda side, row: F.struct(F.lit(side).alias("side"), row.alias("row"))
    stated, invented = _predictions()
    return rows.select("ann_id", F.inline(F.array(on(0, own), on(1, stated), on(1, invented)))).where("row is not null").select("ann_id", "side", "row.*")

PREDICTED = """
fx_mixed as (select *, ann_id * 7 + idx as k from fx_golden),
fx_pred as (
  select ann_id, idx, case when k % 5 = 1 then '  ' || upper(director_name) when k % 23 = 2 then 'Somebody Else' else director_name end as director_name,
    trade_type, security_class, case when k % 13 <> 0 then quantity end as quantity,
    cast(case when k % 17 = 0 then total_consideration + 1 else total_consideration end as decimal(18,2)) as total_consideration, trade_date
  from fx_mixed where k % 11 <> 0
  union all
  select ann_id, idx + 100, 'Nobody', trade_type, security_class, quantity, total_consideration, date '1990-01-01' from fx_mixed where k % 19 = 0)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, director, filed, consideration: returned lines as sale filings."""
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    tickers = announcements(spark, sf_dir).select("ann_id", "ticker")
    return line.join(tickers, F.col("l_orderkey") == F.col("ann_id")).select(
        "ticker",
        F.concat(F.lit("Director "), F.col("l_suppkey") % 40).alias("director"),
        F.to_date("l_shipdate").alias("filed"),
        F.when(F.col("l_orderkey") % 37 != 0, F.col("l_extendedprice").cast("decimal(18,2)") * 20).cast("decimal(18,2)").alias("consideration"),
    )


FILINGS = """
fx_filings as (
  select ticker, 'Director ' || (l_suppkey % 40) as director, cast(l_shipdate as date) as filed,
    cast(case when l_orderkey % 37 <> 0 then cast(l_extendedprice as decimal(18,2)) * 20 end as decimal(18,2)) as consideration
  from lineitem join fx_announcements on l_orderkey = ann_id where l_returnflag = 'R')"""


def results_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, d: the day of each ticker's first flagged announcement of a half-year, as companies report twice a year."""
    day = F.to_date(F.from_utc_timestamp("announced_at", ZONE))
    days = announcements(spark, sf_dir).where("price_sensitive").select("ticker", day.alias("d"))
    return days.groupBy("ticker", F.year("d").alias("y"), (F.month("d") > 6).alias("second")).agg(F.min("d").alias("d")).select("ticker", "d")


RESULTS = f"""
fx_result_days as (select ticker, cast({LOCAL} as date) as d from fx_announcements where price_sensitive),
fx_results as (select ticker, min(d) as d from fx_result_days group by ticker, year(d), month(d) > 6)"""


def oracle(*parts: str, body: str, recursive: bool = False) -> str:
    """A DuckDB statement over the views that the parts define, each part once and in order."""
    return ("with recursive " if recursive else "with ") + ",".join(dict.fromkeys(parts)) + "\n" + body


def announcements_with_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (segment, order year), the pairs that a crawl asks for."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.year("o_orderdate").cast("long").alias("y")).distinct()
