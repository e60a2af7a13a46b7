"""Operator 8: near-duplicates by 64-bit SimHash and anchor-point covering.

Anchors are the words of a covering code: the 64 bits are dealt to blocks of odd length, and each block is all zeros
or all ones (a repetition code, whose words cover a block of 2r + 1 bits within radius r). A fingerprint's home is its
nearest anchor: the majority of each block. If y differs from x in at most k bits, then y's distance from x's home
exceeds the blocks' radii by at most k in sum; so y is replicated to every anchor within radius plus k so counted, and
meets x there. Homes and visitors are compared per anchor. Only distinct fingerprints take part, so copies cost nothing,
and the number of blocks grows with their count, which keeps an anchor's homes few.

Fingerprints: A-Z lower-cased, words split at ASCII white space, word shingles joined by a space (fewer words: the whole
sequence), XXH64 with seed 42; a bit is set where over half of the hashes set it. No words (null or empty text): zero,
and linked like any other. Rows of equal or null doc_id are rows like others; an empty table gives an empty result.
Very long texts are hashed whole. Only the key and the text are read, so other columns may have any names;
``keep_first`` returns them as they are.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

BITS, SEED = 64, 42
#: Homes an anchor has on average, and the least and most blocks.
HOMES, LEAST_BLOCKS, MOST_BLOCKS = 256, 8, 40


def fingerprint(text: str, words: int = 3) -> int:
    import numpy as np
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    ahead = [parts[i:] for i in range(words)]
    hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*ahead, strict=False)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def run(batches):
        rows = ((doc_id, (f := fingerprint(body or "", words)) - (f >> 63 << 64)) for doc_id, body in common.batch_rows(batches))
        return common.record_batches(rows, "doc_id long, fp long")

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_lengths(blocks: int, bits: int = BITS) -> list[int]:
    """Odd lengths, as equal as may be, that sum to ``bits``; ``blocks`` is even."""
    small = bits // blocks - (bits // blocks + 1) % 2
    longer = (bits - small * blocks) // 2
    return [small + 2] * longer + [small] * (blocks - longer)


def blocks_for(n: int) -> int:
    """How many blocks ``n`` distinct fingerprints call for."""
    wanted = math.ceil(math.log2(max(n, 1) / HOMES)) if n > HOMES else 0
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, wanted + wanted % 2))


def anchors(values, lengths: list[int], k: int):
    """(home, row, anchor): the home of each 64-bit value, and the rows of values with each anchor that they visit."""
    import numpy as np

    values = np.asarray(values, np.uint64)
    home = np.zeros(len(values), np.int64)
    costs, at = [], 0
    for b, length in enumerate(lengths):
        weight = np.bitwise_count((values >> np.uint64(at)) & np.uint64((1 << length) - 1)).astype(np.int64)
        one = weight > length // 2
        home |= one.astype(np.int64) << b
        costs.append(np.where(one, weight, length - weight) - length // 2)  # of visiting the block's other word
        at += length
    rows, found = [np.arange(len(values))], [home]

    def visit(flips: tuple[int, ...], start: int, rest, own):
        """All sets of flipped blocks whose costs sum to k at most."""
        for b in range(start, len(lengths)):
            left = rest - costs[b][own]
            if (ok := left >= 0).any():
                mine = own[ok]
                rows.append(mine)
                found.append(home[mine] ^ sum(1 << f for f in (*flips, b)))
                visit((*flips, b), b + 1, left[ok], mine)

    visit((), 0, np.full(len(values), k), np.arange(len(values)))
    return home, np.concatenate(rows), np.concatenate(found)


def links(distinct: DataFrame, k: int = 2, n: int | None = None) -> DataFrame:
    """Pairs a < b (as longs) of distinct fingerprints ``fp`` that differ in 1 to ``k`` bits, each at least once.

    Each fingerprint is at home with one anchor only and visits others, and the homes and visitors of an anchor are
    compared as they meet in the join, in the JVM; only true links come out. The visitors are many rows a fingerprint, which
    Spark does not see when it sizes them, so neither side is ever broadcast.
    """
    lengths = block_lengths(blocks_for(distinct.count() if n is None else n))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            home, rows, found = anchors(values.view(np.uint64), lengths, k)
            for at in range(0, len(rows), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(values[rows[part]]), pa.array(found[part])], ["fp", "anchor"])

    homes = F.expr(_home_sql(lengths))
    visitors = distinct.mapInArrow(run, "fp long, anchor long").select(F.col("fp").alias("b"), "anchor")
    at_home = distinct.select(F.col("fp").alias("a"), homes.alias("anchor"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k)
    return at_home.join(visitors.hint("merge"), (at_home["anchor"] == visitors["anchor"]) & near).select("a", "b")


def _home_sql(lengths: list[int]) -> str:
    """The home of ``fp`` as SQL: the majority of each block."""
    parts, at = [], 0
    for b, length in enumerate(lengths):
        parts.append(f"if(bit_count(shiftrightunsigned(fp, {at}) & {(1 << length) - 1}L) > {length // 2}, {1 << b}L, 0L)")
        at += length
    return " | ".join(parts)


def near_duplicates(docs: DataFrame, k: int = 2, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that chains of links reach, itself included.

    Components are found over distinct fingerprints that have links; all others are components of their own. Joins are merges,
    as files are sized by their compressed bytes.
    """
    prints = common.written(with_fingerprints(docs, key, text, words), "simhash")
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = connected_components(links(classes.select("fp"), k).select("a", "b"))  # node, component (of fingerprints)
    linked = classes.join(found.hint("merge"), F.col("fp") == F.col("node")).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least.hint("merge"), "component").select(F.col("fp").alias("linked_fp"), "component_id")
    classes = classes.join(linked.hint("merge"), F.col("fp") == F.col("linked_fp"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, k: int = 2, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row of each component with its columns: that with the least doc_id, null ids last, and of rows that share it the
    first of the table's files. Rows, not ids, are linked and dropped."""
    (own,) = common.fresh(docs.columns, "row")
    rows = common.with_number(docs, own)
    return common.first_of_components(rows, near_duplicates(rows, k, own, text, words), key, own)
