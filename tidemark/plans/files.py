"""Reads and writes of files: what a query writes goes to the shared scratch folder and is read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources import readers, sinks
from . import fixtures as fx
from .registry import register

#: Documents in a file of blobs.
BLOBS = 1000
#: Symbols in a wide frame of prices.
SYMBOLS = 250
#: Objects in a file of JSON, rows of a page, items of a feed.
OBJECTS, PAGE_ROWS, FEED_ITEMS = 1000, 100, 5


def scratch(spark, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in a temporary one only where that is unset and the session is local."""
    root, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if root is None and not re.match(r"local(\[|$)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


@register("sink_append_pinned", "select c_custkey, c_acctbal from customer")
def sink_append_pinned(spark, d):
    rows, path = fx.table(spark, d, "customer").select("c_custkey", "c_acctbal"), scratch(spark, "append")
    sinks.append(rows.where("c_custkey % 2 = 0"), path, rows.schema)
    sinks.append(rows.where("c_custkey % 2 = 1"), path, rows.schema)
    return spark.read.schema(rows.schema).parquet(path)


@register("sink_rebuild", "select s_suppkey, s_name from supplier")
def sink_rebuild(spark, d):
    rows, path = fx.table(spark, d, "supplier").select("s_suppkey", "s_name"), scratch(spark, "rebuild")
    sinks.rebuild(rows.limit(3), path)
    sinks.rebuild(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@register("sink_write_absent", "select distinct l_partkey from lineitem")
def sink_write_absent(spark, d):
    rows, path = fx.table(spark, d, "lineitem").select("l_partkey"), scratch(spark, "absent")
    sinks.write_absent(rows.where("l_partkey % 3 = 0"), path, ["l_partkey"])
    return sinks.write_absent(rows, path, ["l_partkey"])


@register("sink_rebuild_table", "select n_nationkey, n_name from nation where n_regionkey > 0")
def sink_rebuild_table(spark, d):
    rows, name = fx.table(spark, d, "nation"), f"tidemark_{uuid.uuid4().hex}"
    sinks.rebuild_table(rows.select("n_nationkey"), name)
    sinks.rebuild_table(rows.where("n_regionkey > 0").select("n_nationkey", "n_name"), name)
    return spark.table(name)


@register("sink_create_if_absent", "select r_regionkey, r_name, true as made, false as made_again from region")
def sink_create_if_absent(spark, d):
    rows, name = fx.table(spark, d, "region"), f"tidemark_{uuid.uuid4().hex}"
    made = sinks.create_if_absent(spark, name, rows.schema)
    rows.write.insertInto(name)
    again = sinks.create_if_absent(spark, name, rows.schema)
    return spark.table(name).select("r_regionkey", "r_name", F.lit(made).alias("made"), F.lit(again).alias("made_again"))


def _buckets(rows, size: int):
    """Numbers that deal rows to groups of about ``size``."""
    return F.pmod(F.xxhash64(*rows.columns), F.lit(-(-rows.count() // size) or 1)).alias("bucket")


def _write_objects(rows, path: str) -> None:
    """JSON arrays of up to about OBJECTS objects, a file each, as JSON with line feeds is read file by file."""
    shown = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ",\n"), F.lit("]"))
    rows.groupBy(_buckets(rows, OBJECTS)).agg(shown.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


@register("source_json_labels", "select doc_id, 'v1' as dataset_version from labels where quality = 1 and toxic = 0")
def source_json_labels(spark, d):
    path = scratch(spark, "labels")
    status, version = F.when(F.col("quality") == 1, "labeled").otherwise("excluded"), F.when(F.col("toxic") == 0, "v1").otherwise("v2")
    _write_objects(fx.table(spark, d, "labels").select("doc_id", status.alias("status"), version.alias("dataset_version")), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("dataset_version", T.StringType())])
    return readers.labels(spark, path, schema, "v1").select("doc_id", "dataset_version")


@register("source_json_map", "select n_name as key, n_name as ticker, 'Name of ' || n_name as name, 'exec' as bucket, null::varchar as role from nation")
def source_json_map(spark, d):
    """One object used as a map, of the nations, which are few at any scale."""
    path, value = scratch(spark, "map"), F.struct(F.col("n_name").alias("ticker"), F.concat(F.lit("Name of "), "n_name").alias("name"), F.lit("exec").alias("bucket"))
    whole = fx.table(spark, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", value)))).alias("value"))
    whole.coalesce(1).write.text(path)
    return readers.object_map(spark, path)


@register("source_parsed_documents", "select sha256(conv_id::varchar) as content_hash, 'v1' as parser_version, count(*) as page_count, sum(length(text))::bigint as total_chars from conversations group by conv_id")
def source_parsed_documents(spark, d):
    path = scratch(spark, "parsed")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = fx.table(spark, d, "conversations").groupBy("conv_id").agg(pages.alias("pages"))
    _write_objects(rows.select(F.sha2(F.col("conv_id").cast("string"), 256).alias("content_hash"), F.lit("v1").alias("parser_version"), "pages"), path)
    facts = readers.parsed_documents(spark, path).select("content_hash", "parser_version", text.page_statistics(F.col("pages")).alias("s"))
    return facts.select("content_hash", "parser_version", "s.page_count", "s.total_chars")


@register("source_blobs", "select sha256(n_name || chr(10)) as content_hash, length(n_name) + 1 as length from nation")
def source_blobs(spark, d):
    """A file for each nation, which are few at any scale."""
    path = scratch(spark, "blobs")
    fx.table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    return readers.blobs(spark, f"{path}/*").select("content_hash", "length")


_LISTED = f"((strptime(strftime(o_orderdate, '%d/%m/%Y') || ' ' || (4 + o_orderkey % 8) || ':30 AM', '%d/%m/%Y %I:%M %p')) at time zone '{fx.ZONE}') at time zone 'UTC'"


@register("source_listing", f"select o_orderkey::varchar as ids_id, {_LISTED} as announced_at, o_orderpriority in ('1-URGENT', '2-HIGH') as price_sensitive, 'Notes & ' || o_orderstatus as headline, case when o_orderkey % 3 > 0 then (o_orderkey % 3)::int end as pages, (o_orderkey % 90) || 'KB' as file_size from orders")
def source_listing(spark, d):
    """Pages of a listing as HTML, of up to about PAGE_ROWS rows each."""
    orders = fx.table(spark, d, "orders")
    key = F.col("o_orderkey")
    cells = (
        F.lit("<tr><td> "), F.date_format("o_orderdate", "d/MM/yyyy"), F.lit('<br> <span class="dates-time">'), 4 + key % 8, F.lit(":30 am</span> </td><td>"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), '<img title="price sensitive">').otherwise(""), F.lit('</td><td><a href="/x.do?display=pdf&idsId='), key, F.lit('"> Notes &amp; '), F.col("o_orderstatus"),
        F.lit('<br> <span class="page">'), F.when(key % 3 > 0, F.concat(key % 3, F.lit(" pages"))).otherwise("page"), F.lit('</span><span class="filesize"> '), key % 90, F.lit("KB </span></a></td></tr>"),
    )
    pages = orders.groupBy(_buckets(orders, PAGE_ROWS)).agg(F.concat(F.lit("<table><tr><th>Date</th></tr>"), F.array_join(F.collect_list(F.concat(*cells)), "\n"), F.lit("</table>")).alias("html"))
    return readers.listings(pages.select("html")).withColumn("announced_at", F.col("announced_at").cast("timestamp_ntz"))


@register("source_json_feed", "select o_orderkey::varchar as document_key, o_orderstatus as headline, o_orderdate::timestamp as announced_at, o_orderpriority in ('1-URGENT', '2-HIGH') as price_sensitive, case when o_orderkey % 4 > 0 then 'u' || o_orderkey else '' end as url from orders")
def source_json_feed(spark, d):
    """Feeds of about FEED_ITEMS items each; some items lack an address, and all have a key that readers do not know."""
    path, orders, key = scratch(spark, "feeds"), fx.table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    item = F.struct(
        key.alias("documentKey"), F.col("o_orderstatus").alias("headline"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("isPriceSensitive"),
        F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("u"), key)).alias("url"), F.lit(1).alias("more"),
    )
    feeds = orders.groupBy(_buckets(orders, FEED_ITEMS)).agg(F.collect_list(item).alias("items")).select(F.struct("items").alias("data"))
    _write_objects(feeds, path)
    found = readers.recent_announcements(spark, path)
    return found.withColumn("announced_at", F.col("announced_at").cast("timestamp_ntz"))


_CODE = "translate(lpad(s_suppkey::varchar, greatest(4, length(s_suppkey::varchar))::int, '0'), '0123456789', 'ABCDEFGHIJ')"


@register("source_html_constituents", f"select {_CODE} as ticker, s_name as company, case when s_suppkey % 5 > 0 then 'Sector ' || s_nationkey else '' end as sector from supplier where length({_CODE}) <= 5")
def source_html_constituents(spark, d):
    """Pages with a table of constituents of up to about PAGE_ROWS rows each, between tables of other kinds."""
    rows, key = fx.table(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    code = F.translate(F.lpad(key, F.greatest(F.lit(4), F.char_length(key)), F.lit("0")), "0123456789", "ABCDEFGHIJ")
    row = F.concat(F.lit("<tr><td><a>"), code, F.lit("</a></td><td> "), F.col("s_name"), F.lit("</td>"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("<td>Sector "), F.col("s_nationkey"), F.lit("</td>"))).otherwise(""), F.lit("</tr>"))
    table = F.concat(F.lit('<table class="infobox"><tr><th>Code</th></tr><tr><td>NOPE</td><td>x</td></tr></table><table class="wikitable sortable"><tr><th>Code</th><th>Company</th></tr>'), F.array_join(F.collect_list(row), "\n"), F.lit("</table>"))
    return readers.wiki_constituents(rows.groupBy(_buckets(rows, PAGE_ROWS)).agg(table.alias("html")).select("html"))


@register("source_csv_universe", "select distinct upper(trim(c_mktsegment)) as ticker from customer")
def source_csv_universe(spark, d):
    path = scratch(spark, "universe")
    rows = fx.table(spark, d, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("ticker"), F.lit("Company, Ltd").alias("company"), F.lit("s").alias("sector")).distinct()
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return readers.universe(spark, path).select("ticker").distinct()


@register("source_binary_hash", "select sha256(text) as content_hash from documents")
def source_binary_hash(spark, d):
    """Every document's blob: one base64 line each, in files of up to BLOBS lines, since a file for each would not scale."""
    path = scratch(spark, "blobs")
    line = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    fx.table(spark, d, "documents").select(F.coalesce(line, F.lit("-")).alias("value")).write.option("maxRecordsPerFile", BLOBS).text(path)
    body = F.decode("content", "UTF-8")
    lines = spark.read.format("binaryFile").load(path).where("length > 0").select(F.explode(F.split(F.left(body, F.char_length(body) - 1), "\n")).alias("line"))
    return lines.select(F.when(F.col("line") != "-", F.sha2(F.unbase64("line"), 256)).alias("content_hash"))


@register("source_price_frame", "select 'S' || s_suppkey as ticker, s_acctbal as close from supplier where s_acctbal > 0")
def source_price_frame(spark, d):
    """Every supplier, in wide frames of about SYMBOLS symbols each, a file a frame."""
    path, rows = scratch(spark, "frames"), fx.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("v"))
    cells = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("S"), "s_suppkey", F.lit(".AX|Close")).alias("f"), F.coalesce(F.col("v").cast("string"), F.lit("")).alias("v"))))
    frames = rows.where("s_suppkey is not null").groupBy(F.floor(F.col("s_suppkey") / SYMBOLS).alias("frame")).agg(cells.alias("cells"))
    line = lambda first, field: F.concat(F.lit(first), F.array_join(F.transform("cells", lambda x: x[field]), ","))
    shown = F.concat(line("date,", "f"), F.lit("\n"), line("2024-01-02,", "v"))
    frames.select(shown.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.price_frames(spark, path).select("ticker", "close")


@register("source_usage_log", "select c_custkey % 100 as input_tokens, count(*) as n from customer group by 1")
def source_usage_log(spark, d):
    path = scratch(spark, "logs")
    line = F.concat(F.lit("2024-01-01 extract.stored   content_hash="), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 12), F.lit(" input_tokens="), F.col("c_custkey") % 100, F.lit(" npat=1 output_tokens=7"))
    fx.table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return readers.usage(spark, path).groupBy("input_tokens").agg(F.count("*").alias("n"))
