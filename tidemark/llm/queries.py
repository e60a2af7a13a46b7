"""The registered queries of this subpackage: thin, one per operator, over whole tables."""

from __future__ import annotations

from public_tokenizers import PATTERN
from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, dominance, fingerprints, hard_negatives, line_dedup, packing, pii, quality_model, quality_rules, rank_bpe, shard_store, simhash, token_store, warc

#: How many arrivals the documents come in, for the shard store.
ARRIVALS = 8


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "tokens")
    token_store.write(common.documents(spark, sf_dir), path, vocabulary_path("byte_bpe_50k.json"), end_id=2)
    return token_store.digests(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(common.documents(spark, sf_dir), carry=["doc_id"])
    return found.select("doc_id", "rules.*", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def op3_shard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    store = shard_store.ShardStore(spark, common.scratch_path(spark, "shards"), docs.schema)
    store.append(docs, arrival=F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    encoded = rank_bpe.encode_documents(common.documents(spark, sf_dir), vocabulary, PATTERN)
    return rank_bpe.decode_documents(encoded, vocabulary, PATTERN).select("doc_id", "n_tokens", "ids_sha256", F.sha2("content", 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedupe(common.documents(spark, sf_dir), min_docs=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.documents(spark, sf_dir), k=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), end_id=0, most_tokens=2048)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(common.documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "warc")
    archives = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/monolithic")
    found = warc.read(warc.normalise(archives, f"{folder}/by-record"), payloads=False)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_key").alias("refers_to"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("id") % 100 == 0, positives=5, negatives=10, least=30, most=90)


def op13_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    kind = sales.schema["sold_at"].dataType.typeName()
    hours = F.floor(F.unix_seconds("sold_at") / 3600) if kind == "timestamp" else F.datediff(F.col("sold_at").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("sold_at")
    crc = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(0).cast("long"))
    rows = sales.select("sale_id", hours.alias("slot"), F.floor(F.floor(100 * F.col("total") + 0.5) / 100).alias("level"), (1 + crc % 2).alias("stands_for"))
    return dominance.above(rows, weight="stands_for", names=("n_sales", "n_rows")).drop("stands_for")


QUERIES = {f.__name__: f for f in (op1_token_store, op2_quality_rules, op3_shard_store, op4_rank_bpe, op5_pii, op6_line_dedup, op7_quality_model, op8_simhash, op9_packing, op10_fingerprints, op11_warc, op12_hard_negatives, op13_dominance)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""
with texts as (select doc_id, source, coalesce(text, '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts),
wins as (
  select doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from wins) where c > 1),
covered as (select doc_id, count(distinct i + k) as n from dup, (values (0), (1), (2)) as o(k) group by doc_id),
lines as (select doc_id, x, count(*) as c from (select doc_id, unnest(string_split(t, chr(10))) as x from texts) where regexp_matches(x, '[^\x20\x09-\x0D]') group by all),
dup_lines as (select doc_id, sum(c - 1) as n from lines group by doc_id),
rules as (
  select words.doc_id, source, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup_lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from words left join covered using (doc_id) left join dup_lines using (doc_id)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from rules),
hosts as (select source, count(*) as n, sum(base_failed::int) as k from failed where source is not null group by source),
sums as (select sum(n) as n, sum(k) / sum(n) as m, count(*) as h, sum(k * k / n) as kk from hosts),
prior as (select m, least(greatest(m * (1 - m) / greatest(kk / n - m * m - m * (1 - m) * h / n, 1e-12) - 1, 1.0), 1e6) as w from sums),
shrunk as (select source, n, w, m, (k + m * w) / (n + m * w + (1 - m) * w) as rate from hosts, prior),
rates as (select source, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (n + m * w + (1 - m) * w + 1)) as least, 8 * m / (8 * m + 1 - m) as cut from shrunk)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(least <= cut, true) as kept, round(rate, 9) as host_rate
from failed left join rates using (source)""",
    "op3_shard_store": "select doc_id, lang, source, n_chars, sha256(coalesce(text, '')) as text_sha256 from documents",
    "op6_line_dedup": r"""
with lines as (
  select doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(l) as x, unnest(range(len(l))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
frequent as (select k from lines where k <> '' group by k having count(distinct doc_id) >= 10),
kept as (select doc_id, i, x, k in (select k from frequent) as gone from lines)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(x, chr(10) order by i) filter (not gone), '')) as kept_sha256
from kept group by doc_id""",
    "op11_warc": """
with rows as (select page_id, coalesce(html, '') as t from pages),
firsts as (select t, min(page_id) as first from rows group by t),
bits as (
  select page_id, t, first, list_transform(range(40), lambda i: strpos('0123456789abcdef', sha1(t)[i + 1]) - 1) as x
  from rows join firsts using (t))
select page_id, cast(strlen(t) as bigint) as payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((list_sum(list_transform(range(5), lambda k: x[5 * g + k + 1] << (4 * (4 - k)))) >> (15 - 5 * j)) & 31 as int), 1)), '')), '') as payload_digest,
  if(page_id = first, 'response', 'revisit') as record_type, if(page_id = first, null, first) as refers_to
from bits""",
    "op12_hard_negatives": """
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from sound a join sound b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
ranked as (
  select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other) as rank, other as negative_id, positive_score, score as negative_score
  from positives join scored using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from ranked where rank <= 10""",
    "op13_dominance": r"""
with steps as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t),
rows as (
  select sale_id, cast(floor(floor(epoch(sold_at)) / 3600) as bigint) as slot, cast(floor(floor(100 * total + 0.5) / 100) as bigint) as level,
    1 + (xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(sale_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) & 1) as w
  from sales, steps),
cells as (select slot, level, count(*) as n, sum(w) as w from rows where slot is not null and level is not null group by all),
over as (
  select a.slot, a.level, cast(coalesce(sum(b.n), 0) as bigint) as n_sales, cast(coalesce(sum(b.w), 0) as bigint) as n_rows
  from cells a left join cells b on b.slot <= a.slot and b.level > a.level group by all)
select sale_id, slot, level, n_sales, n_rows from rows left join over using (slot, level)""",
}
