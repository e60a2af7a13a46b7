"""Operator 1: token ids in a binary format with one shared zstandard dictionary.

Format: Parquet rows are blocks of about ``BLOCK_BYTES``. A block's ``frames`` are zstandard frames end to end, one
per document, each compressed on its own with the shared dictionary, so a short document is read alone. Its index
holds doc_ids, the end offset of each frame, and token counts. ``shard``, ``block`` order the blocks; documents ascend
by doc_id through blocks and shards (null ids first, equal ids by a hash of text and row), and first_id, last_id bound the ids of a
block (null where all of its ids are). ``dictionary`` is a table of one row.
Ids are unsigned little-endian integers of ``width`` bytes (2 where the vocabulary fits, else 4).

Spark's commit protocol writes the blocks, so a lost executor's tasks just run again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, tokens

BLOCK_BYTES = 1 << 20
#: The dictionary: its size, and how many texts (spread by hash over all documents, none longer than this) it is fitted on.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 1 << 16, 1000, 1 << 16
LEVEL = 3

FRAME_SCHEMA = "shard int, doc_id long, tie long, n_tokens long, frame binary"
BLOCK_SCHEMA = "shard int, block long, first_id long, last_id long, first_token long, n_tokens long, dictionary_hash string, width int, doc_ids array<long>, ends array<long>, counts array<long>, frames binary"
DIGEST_SCHEMA = "shard int, first long, doc_id long, n_tokens long, ids_crc32 long"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on serialized id arrays; the arrays themselves where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compression_dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS) -> list[str]:
    """About ``n`` texts, chosen by the hash of their doc_id over the whole table."""
    total = docs.count()
    limit = min(1.0, n / max(total, 1)) * 2.0**64 - 2.0**63
    chosen = docs.where(F.xxhash64("doc_id").cast("double") <= F.lit(limit)).where(F.char_length("text") <= SAMPLE_CHARS)
    return [r[0] for r in chosen.select("text").limit(4 * n).collect()]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int | None) -> None:
    """Write the ids of ``docs`` (doc_id, text; a null text is empty; other columns are left out) to ``path``.

    Each document's ids end with ``end_id`` unless that is None. Empty texts, repeated rows and empty tables are kept as they are.
    """
    spark = docs.sparkSession
    docs = common.with_row(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "row")
    encoder, width = tokens.library_encoder(vocabulary)
    tail = b"" if end_id is None else end_id.to_bytes(width, "little")
    raw = train_dictionary([x + tail for x in encoder.encode(sample_texts(docs))])
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, width, bytearray(raw))], "dictionary_hash string, width int, content binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches):
        import zstandard

        encoder, _ = tokens.library_encoder(vocabulary)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_compression_dictionary(raw), write_content_size=True)

        def rows():
            for part in tokens.in_batches(common.batch_rows(batches), 3, tokens.LIBRARY_BATCH_CHARS):
                for (shard, doc_id, tie, _), ids in zip(part, encoder.encode([r[3] for r in part]), strict=True):
                    yield shard, doc_id, tie, len(ids + tail) // width, press.compress(ids + tail)

        yield from common.record_batches(rows(), FRAME_SCHEMA, 1024)

    ranges = common.IdRanges(docs, "doc_id", common.shuffle_partitions(spark))
    tie = common.row_hash("text", "row")
    (
        docs.select(ranges.of(tie).alias("shard"), "doc_id", tie.alias("tie"), "text")
        .mapInArrow(frames, FRAME_SCHEMA)
        .repartitionById(ranges.count, F.col("shard"))
        .sortWithinPartitions("doc_id", "tie")
        .mapInArrow(lambda batches: common.record_batches(_blocks(common.batch_rows(batches), digest, width), BLOCK_SCHEMA, 1), BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )


def _blocks(rows, digest: str, width: int) -> Iterator[tuple]:
    """Blocks of the frames of one shard, which come sorted."""
    ids, ends, counts, parts, size, start, block, shard = [], [], [], [], 0, 0, 0, None

    def made():
        known = [i for i in ids if i is not None]
        return shard, block, known[0] if known else None, known[-1] if known else None, start, sum(counts), digest, width, ids, ends, counts, b"".join(parts)

    for shard, doc_id, _, count, frame in rows:
        if parts and size + len(frame) > BLOCK_BYTES:
            yield made()
            start, block, size = start + sum(counts), block + 1, 0
            ids, ends, counts, parts = [], [], [], []
        size += len(frame)
        ids.append(doc_id), ends.append(size), counts.append(count), parts.append(frame)
    if parts:
        yield made()


def dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The store's dictionary by hash: one row of at most ``DICTIONARY_BYTES``."""
    return {r["dictionary_hash"]: bytes(r["content"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def _documents(batches, raw: dict[str, bytes]) -> Iterator[tuple]:
    """(shard, start in shard, doc_id, count, width, ids as stored) of every document in blocks."""
    import zstandard

    open_with = {h: zstandard.ZstdDecompressor(dict_data=_compression_dictionary(c)) for h, c in raw.items()}
    for batch in batches:
        for row in batch.to_pylist():
            begin, start, frames = 0, row["first_token"], memoryview(row["frames"])
            for doc_id, end, count in zip(row["doc_ids"], row["ends"], row["counts"], strict=True):
                yield row["shard"], start, doc_id, count, row["width"], open_with[row["dictionary_hash"]].decompress(frames[begin:end])
                begin, start = end, start + count


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: one row a shard, of which there are as many as tasks wrote."""
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the stored ids."""
    raw = dictionaries(spark, path)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")

    def read(batches):
        import numpy as np

        def rows():
            for shard, start, doc_id, _, width, ids in _documents(batches, raw):
                values = np.frombuffer(ids, f"<u{width}")
                yield shard, start, doc_id, len(values), zlib.crc32(values.astype("<u4").tobytes())

        yield from common.record_batches(rows(), DIGEST_SCHEMA)

    found = blocks.mapInArrow(read, DIGEST_SCHEMA)
    return found.join(F.broadcast(shard_starts(blocks)), "shard").select("doc_id", (F.col("shard_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one doc_id. The blocks' first and last ids prune what is read, by Parquet's statistics
    too; of the blocks left, only the document's own frames come to the driver."""
    import numpy as np
    import zstandard

    raw = dictionaries(spark, path)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    index = F.arrays_zip("doc_ids", "ends", F.array_insert("ends", 1, F.lit(0).cast("long")).alias("begins"))
    found = blocks.select("shard", "block", "dictionary_hash", "width", "frames", F.posexplode(F.filter(index, lambda x: x["doc_ids"] == doc_id)).alias("at", "x"))
    frame = F.substring("frames", (F.col("x.begins") + 1).cast("int"), (F.col("x.ends") - F.col("x.begins")).cast("int"))
    rows = found.select("shard", "block", "at", "dictionary_hash", "width", frame.alias("frame")).orderBy("shard", "block", "at").collect()
    open_with = {h: zstandard.ZstdDecompressor(dict_data=_compression_dictionary(c)) for h, c in raw.items()}
    return [np.frombuffer(open_with[r["dictionary_hash"]].decompress(bytes(r["frame"])), f"<u{r['width']}").tolist() for r in rows]
