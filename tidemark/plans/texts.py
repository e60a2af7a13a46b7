"""Classifiers, normalisation, JSON and other scalar functions, over headlines and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, text, udfs
from ..sources import schemas
from . import fixtures as fx
from .registry import register

#: The classifiers in DuckDB's dialect, by name.
_LOOK = lambda p: f"regexp_matches(headline, '(?i){p}')".replace("\\", "\\")
_SQL = {
    "3y": _LOOK(text.DIRECTOR_INTEREST),
    "broad": f"not {_LOOK(text.ADMIN_NOISE)}",
    "p0": f"case when {_LOOK(text.FALSE_RESULTS)} then false when price_sensitive and {_LOOK(text.RESULTS_CRAWL)} then true else {_LOOK(text.APPOINTMENT)} end",
    "guidance": _LOOK(text.GUIDANCE),
    "earnings": f"price_sensitive and {_LOOK(text.RESULTS_MANUAL)}",
    "results_extraction": f"price_sensitive and {_LOOK(text.RESULTS_EXTRACTION)} and not {_LOOK(text.FALSE_RESULTS)}",
    "results_trading": f"price_sensitive and {_LOOK(text.RESULTS_EXTRACTION)} and not {_LOOK(text.FALSE_RESULTS_TRADING)}",
    "appointment": _LOOK(text.APPOINTMENT),
}


def _classifier(name: str):
    @register(f"classify_{name}", fx.oracle(fx.ANNOUNCEMENTS, body=f"select ann_id, headline from fx_announcements where {_SQL[name]}"))
    def run(spark, d):
        rows = fx.announcements(spark, d)
        return rows.where(text.FILTERS[name](F.col("headline"), F.col("price_sensitive"))).select("ann_id", "headline")

    return run


for _name in text.FILTERS:
    _classifier(_name)


_KEYWORDS = """contains(lower(headline), 'appendix 3y') or contains(lower(headline), 'change in director') or contains(lower(headline), 'director''s interest') or contains(lower(headline), 'directors interest')"""


@register("classify_keywords", fx.oracle(fx.ANNOUNCEMENTS, body=f"select ann_id from fx_announcements where {_KEYWORDS}"))
def classify_keywords(spark, d):
    return fx.announcements(spark, d).where(text.has_keyword(F.col("headline"))).select("ann_id")


_SPACE = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]"


@register("text_normalize", rf"select doc_id, md5(replace(lower(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))), 'ß', 'ss')) as digest from documents")
def text_normalize(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


@register("text_collapse_space", rf"select doc_id, length(regexp_replace(text, '{_SPACE}+', ' ', 'g')) as n from documents")
def text_collapse_space(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.char_length(text.collapse_space(F.col("text"))).cast("long").alias("n"))


@register("text_case_and_strip", "select c_custkey, upper(trim('  ' || c_name || ' ')) as up, lower(c_name) as low from customer")
def text_case_and_strip(spark, d):
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    return fx.table(spark, d, "customer").select("c_custkey", F.upper(F.trim(padded)).alias("up"), F.lower("c_name").alias("low"))


_PAGES = "fx_pages as (select conv_id, list(text order by turn) as pages from conversations group by conv_id)"


def _pages(spark, d):
    rows = fx.table(spark, d, "conversations")
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))


@register("pages_marked_text", fx.oracle(_PAGES, body="select conv_id, md5(array_to_string(list_transform(range(1, len(pages) + 1), lambda i: '[page ' || i || ']' || chr(10) || pages[i]), chr(10) || chr(10))) as digest from fx_pages"))
def pages_marked_text(spark, d):
    return _pages(spark, d).select("conv_id", F.md5(text.marked_pages(F.col("pages"))).alias("digest"))


@register(
    "pages_statistics",
    fx.oracle(
        _PAGES, f"s as (select conv_id, len(pages) as page_count, len(list_filter(pages, lambda p: length(regexp_replace(p, '^{_SPACE}+|{_SPACE}+$', '', 'g')) < 60)) as empty_page_count, list_sum(list_transform(pages, lambda p: length(p)))::bigint as total_chars from fx_pages)",
        body="select *, case when empty_page_count = page_count then 'empty' when empty_page_count > 0 then 'partial' else 'good' end as quality from s",
    ),
)
def pages_statistics(spark, d):
    return _pages(spark, d).select("conv_id", F.inline(F.array(text.page_statistics(F.col("pages"), blank_below=60))))


@register(
    "pages_quote_audit",
    fx.oracle(
        _PAGES, f"q as (select conv_id, pages, substr(pages[1], 5, 25) || case when conv_id % 5 = 0 then '§' else '' end as quote, conv_id % 3 as page from fx_pages)", f"n as (select conv_id, page, regexp_replace(quote, '{_SPACE}+', ' ', 'g') as quote, list_transform(pages, lambda p: regexp_replace(p, '{_SPACE}+', ' ', 'g')) as pages from q)",
        body="select conv_id, case when len(list_filter(pages, lambda p: contains(p, quote))) = 0 then 'MISSING' when page >= 1 and page <= len(pages) and contains(pages[page], quote) then 'OK' else 'WRONG PAGE' end as verdict from n",
    ),
)
def pages_quote_audit(spark, d):
    quote = F.concat(F.substring(F.get("pages", F.lit(0)), 5, 25), F.when(F.col("conv_id") % 5 == 0, "§").otherwise(""))
    return _pages(spark, d).select("conv_id", text.quote_audit(quote, F.col("conv_id") % 3, F.col("pages")).alias("verdict"))


@register("pages_quote_in_documents", "select item_id, count(*) as n_documents from benchmark b join documents d on contains(d.text, b.text) group by item_id")
def pages_quote_in_documents(spark, d):
    """Whole benchmark texts inside whole documents."""
    found = text.items_within(fx.table(spark, d, "documents"), fx.table(spark, d, "benchmark").withColumnRenamed("text", "item"), "doc_id", "text", "item_id", "item")
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


@register("role_in_document", "select doc_id, case when contains(lower(text), 'with') then 'with' end as role from documents")
def role_in_document(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.when(F.contains(F.lower("text"), F.lit("with")), "with").alias("role"))


@register("lexicon_density", r"select doc_id, round(len(regexp_extract_all(text, '(?i)\b(the|and|with)\b')) / nullif(len(regexp_extract_all(text, '[^\s]+')), 0), 9) as density from documents")
def lexicon_density(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.round(text.lexicon_density(F.col("text"), ["the", "and", "with"]), 9).alias("density"))


@register("json_scalar_path", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none') as absent from events")
def json_scalar_path(spark, d):
    parsed = F.from_json("props", "k string, none string")
    return fx.table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["none"].alias("absent"))


@register("json_array_offsets", fx.oracle(fx.TRADES, body=f"select ann_id, row_number() over (partition by ann_id order by {fx.TRADE_ORDER}) - 1 as idx, director_name from fx_trades"))
def json_array_offsets(spark, d):
    rows = fx.extractions(spark, d).where("extracted_at is not null")
    full = rows.withColumn("n", F.row_number().over(_latest())).where("n = 1")
    parsed = F.from_json("payload", schemas.TRADES_PAYLOAD)["trades"]
    return full.select("ann_id", F.posexplode(parsed).alias("idx", "t")).select("ann_id", F.col("idx").cast("long").alias("idx"), F.col("t.director_name.value").alias("director_name"))


def _latest():
    from pyspark.sql.window import Window

    return Window.partitionBy("ann_id").orderBy(F.desc("extracted_at"))


@register("json_serialize", "select c_custkey, to_json({'key': c_custkey, 'name': c_name, 'segment': c_mktsegment})::varchar as payload from customer")
def json_serialize(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("payload"))


@register("json_migrate", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as revenue_current, null::bigint as revenue_prior, 'AUD' as currency from events")
def json_migrate(spark, d):
    """A payload's key renamed and nested, and a default struct added."""
    old = F.from_json("props", "k bigint")
    new = F.struct(old["k"].alias("value")).withField("currency", F.lit("AUD"))
    moved = F.struct(F.struct(new["value"].alias("current"), F.lit(None).cast("bigint").alias("prior")).alias("revenue"), new["currency"].alias("currency"))
    back = F.from_json(F.to_json(moved), "revenue struct<current: bigint, prior: bigint>, currency string")
    return fx.table(spark, d, "events").select("event_id", back["revenue"]["current"].alias("revenue_current"), back["revenue"]["prior"].alias("revenue_prior"), back["currency"].alias("currency"))


@register("safe_casts", fx.oracle(fx.TRADES, body="select ann_id, l_linenumber, try_cast(quantity as decimal(38,9)) as quantity, try_cast(trade_date as date) as trade_date from fx_trades"))
def safe_casts(spark, d):
    rows = fx.trades(spark, d)
    return rows.select("ann_id", "l_linenumber", scalar.numeric(F.col("quantity")).alias("quantity"), scalar.date_or_null(F.col("trade_date")).alias("trade_date"))


@register("local_dates", fx.oracle(fx.ANNOUNCEMENTS, body=f"select ann_id, cast({fx.LOCAL} as date) as day, hour({fx.LOCAL}) as h, cast({fx.LOCAL} as date) + case when hour({fx.LOCAL}) >= 16 then 1 else 0 end as tradeable from fx_announcements"))
def local_dates(spark, d):
    at = F.col("announced_at")
    return fx.announcements(spark, d).select("ann_id", scalar.local_date(at).alias("day"), F.hour(scalar.local(at)).cast("long").alias("h"), scalar.tradeable_date(at).alias("tradeable"))


@register("local_time_to_utc", f"select o_orderkey, (((strptime(strftime(o_orderdate, '%d/%m/%Y') || ' ' || (4 + o_orderkey % 8) || ':30 AM', '%d/%m/%Y %I:%M %p')) at time zone '{fx.ZONE}') at time zone 'UTC') as at from orders")
def local_time_to_utc(spark, d):
    words = F.concat(F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" "), (4 + F.col("o_orderkey") % 8).cast("string"), F.lit(":30 AM"))
    return fx.table(spark, d, "orders").select("o_orderkey", scalar.utc_from_local(words).cast("timestamp_ntz").alias("at"))


@register("date_differences", "select l_orderkey, l_linenumber, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as lag, cast(l_shipdate as date) - 40 as since from lineitem join orders on l_orderkey = o_orderkey")
def date_differences(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = fx.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("lag"), F.date_sub(F.to_date("l_shipdate"), 40).alias("since"))


@register("years_covering", "select o_orderkey, unnest(range(year(o_orderdate), 2002))::bigint as y from orders")
def years_covering(spark, d):
    years = fx.table(spark, d, "orders").select("o_orderkey", F.explode(scalar.years_covering(F.col("o_orderdate"), F.lit("2001-12-31").cast("date"))).alias("y"))
    return years.select("o_orderkey", F.col("y").cast("long").alias("y"))


@register("numeric_functions", "select l_orderkey, l_linenumber, round(ln(l_extendedprice), 9) as l, round(sqrt(l_quantity), 9) as r, abs(25 - l_quantity) as a, round(l_discount * l_discount, 9) as s from lineitem")
def numeric_functions(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.ln("l_extendedprice"), 9).alias("l"), F.round(F.sqrt("l_quantity"), 9).alias("r"), F.abs(25 - F.col("l_quantity")).alias("a"), F.round(F.col("l_discount") * F.col("l_discount"), 9).alias("s"))


@register("share_sizes", "select l_orderkey, l_linenumber, greatest(1, floor(10000 / l_extendedprice))::bigint as qty from lineitem")
def share_sizes(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.share_size(F.lit(10000.0), F.col("l_extendedprice")).alias("qty"))


@register("version_suffix", r"select p_partkey, try_cast(regexp_extract(p_name || '_v' || (p_partkey % 12), '_v(\d+)$', 1) as int) as version from part")
def version_suffix(spark, d):
    name = F.concat("p_name", F.lit("_v"), (F.col("p_partkey") % 12).cast("string"))
    return fx.table(spark, d, "part").select("p_partkey", scalar.version_of(name).alias("version"))


@register("content_hash", "select doc_id, sha256(text) as content_hash from documents")
def content_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@register("null_out_by_membership", "select c_custkey, case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then null else c_acctbal end as revenue from customer")
def null_out_by_membership(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", F.when(~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), F.col("c_acctbal")).alias("revenue"))


@register("defaults", "select doc_id, coalesce(nullif(case when doc_id % 4 = 0 then '' else source end, ''), '?') as source from documents")
def defaults(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("source")), F.lit("")), F.lit("?")).alias("source"))


@register("map_lookup", fx.oracle(fx.TRADES, body="select trade_type, nature, count(*) as n from fx_trades group by all"))
def map_lookup(spark, d):
    return fx.trades(spark, d).groupBy("trade_type", "nature").agg(F.count("*").alias("n"))


@register("percent_format", "select l_returnflag, case when sum(l_discount) = 0 then '—' else printf('%.1f%%', 100 * sum(l_discount * 100) / sum(l_quantity * 100)) end as share from lineitem group by l_returnflag")
def percent_format(spark, d):
    share = F.try_divide(F.sum(F.col("l_discount") * 100), F.nullif(F.sum(F.col("l_quantity") * 100), F.lit(0.0)))
    return fx.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.coalesce(F.format_string("%.1f%%", 100 * share), F.lit("—")).alias("share"))


@register("payload_validation", "select count(*) filter (json_extract_string(props, '$.k')::int between 10 and 90) as valid, count(*) filter (not json_extract_string(props, '$.k')::int between 10 and 90) as quarantined from events")
def payload_validation(spark, d):
    rows = fx.table(spark, d, "events").withColumn("parsed", F.from_json("props", "k int"))
    good, bad = schemas.split_valid(rows, {"range": F.col("parsed.k").between(10, 90)})
    both = good.select(F.lit(1).alias("v")).unionByName(bad.select(F.lit(0).alias("v")))
    return both.agg(F.count_if(F.col("v") == 1).alias("valid"), F.count_if(F.col("v") == 0).alias("quarantined"))


@register("status_counts", "select o_orderstatus as status, count(*) as n from orders group by all")
def status_counts(spark, d):
    return fx.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@register("parsed_pages", fx.oracle(_PAGES, body="select sha256(conv_id::varchar) as content_hash, len(pages) as page_count, list_sum(list_transform(pages, lambda p: length(p)))::bigint as total_chars from fx_pages"))
def parsed_pages(spark, d):
    """Blobs to pages by the parser that is passed in; here texts whose pages form feeds part."""
    pages = _pages(spark, d).select(F.sha2(F.col("conv_id").cast("string"), 256).alias("content_hash"), F.encode(F.array_join("pages", "\f"), "UTF-8").alias("content"))
    found = udfs.parse_pages(pages).where("error is null").select("content_hash", text.page_statistics(F.col("pages")).alias("s"))
    return found.select("content_hash", "s.page_count", "s.total_chars")


@register("html_page_facts")
def html_page_facts(spark, d):
    facts = fx.table(spark, d, "pages").select("page_id", udfs.page_facts("html").alias("f"))
    return facts.select("page_id", "f.*")


@register("extraction_stub")
def extraction_stub(spark, d):
    return udfs.extract(fx.table(spark, d, "conversations").select(F.concat_ws("#", "conv_id", "turn").alias("content_hash"), "text"))
