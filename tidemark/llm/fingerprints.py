"""Operator 10: document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle of five words (A-Z lower-cased, split at ASCII white space; fewer words: the whole sequence) is hashed
once. The top bits of the hash choose a bin, and a bin keeps the least of its hashes. An empty bin takes the value of a
full one, chosen by a hash of (bin, attempt) that is the same for every document, with attempts until a full bin is
met. Of each bin the lowest bits are stored. Two fingerprints' share of equal bins, less what chance gives, estimates
the Jaccard likeness of the shingle sets.

A null text is empty. A text without words has the fingerprint ``EMPTY``: likeness 1 to itself and 0 to any other.
Equal texts have equal fingerprints. Rows of equal doc_id follow each other by text hash; null ids come first; an
empty table gives an empty result; a single document is its own next.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BIN_BITS, STORED_BITS, WORDS = 8, 8, 5
EMPTY = ""
#: Attempts tabled per bin; a document with one full bin of 256 is met by then with all but one in 10^13 chance, else the next full bin serves.
ATTEMPTS = 8192

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x):
    """A 64-bit finalizer, vectorised."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _probes():
    import numpy as np

    bins = 1 << BIN_BITS
    seeds = np.arange(bins * ATTEMPTS, dtype=np.uint64) + np.uint64(1)
    return (_mix(seeds) >> np.uint64(64 - BIN_BITS)).astype(np.int16).reshape(ATTEMPTS, bins)


class WordHashes:
    """64-bit hashes of words, looked up; bounded by starting anew."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]):
        import numpy as np
        import xxhash

        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words):
    """Hashes of the runs of ``WORDS`` words, from the words' hashes: order counts."""
    import numpy as np

    n = len(words)
    width = min(WORDS, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x100000001B3) + _mix(words[i : n - width + 1 + i] + np.uint64(i))
    return _mix(total + np.uint64(width))


def fingerprint(text: str, word_hashes: WordHashes) -> str:
    """Hexadecimal: for each bin the lowest bits of its value."""
    import numpy as np

    words = text.encode().lower().split()
    if not words:
        return EMPTY
    hashes = np.sort(shingle_hashes(word_hashes(words)))
    own = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    values = np.zeros(1 << BIN_BITS, np.uint64)
    full = np.zeros(1 << BIN_BITS, bool)
    values[own[starts]] = hashes[starts]
    full[own[starts]] = True
    source = np.arange(1 << BIN_BITS)
    empty = np.flatnonzero(~full)
    probes = _probes()
    for attempt in range(ATTEMPTS):
        if not len(empty):
            break
        tried = probes[attempt, empty]
        met = full[tried]
        source[empty[met]] = tried[met]
        empty = empty[~met]
    source[empty] = own[0]
    return (values[source] & np.uint64((1 << STORED_BITS) - 1)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness, from 0 to 1, corrected for bins that agree by chance."""
    import numpy as np

    if a == EMPTY or b == EMPTY:
        return float(a == b)
    equal = np.mean(np.frombuffer(bytes.fromhex(a), np.uint8) == np.frombuffer(bytes.fromhex(b), np.uint8))
    chance = 2.0**-STORED_BITS
    return float(min(1.0, max(0.0, (equal - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, replaced by the first as many of the next document, or by all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(rows) -> Iterator[tuple]:
    """Of a part in order: (doc_id, text, is it the next part's first document)."""
    word_hashes, held = WordHashes(), None
    for doc_id, text, ahead in rows:
        own = fingerprint(text, word_hashes)
        if held is not None:
            before_id, before, print_before = held
            changed = edited(before, text)
            print_changed = print_before if changed == before else fingerprint(changed, word_hashes)
            yield before_id, len(before), hashlib.sha256(changed.encode()).hexdigest(), print_before, print_changed, likeness(print_before, print_changed), likeness(print_before, own)
        if ahead:
            return
        held = doc_id, text, own


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(part, doc_id, text, tie, ahead; number of parts): documents in ranges of doc_id, each range with the first of the
    next one (ahead) at its end.

    Texts move once. Ranges and their first documents are found from the ids alone, and from the texts' hashes where a
    key is split; there are as many as partitions.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    ranges = common.IdRanges(docs, "doc_id", common.shuffle_partitions(docs.sparkSession))
    tie = F.xxhash64("text") if ranges.split else F.lit(0).cast("long")
    part = ranges.of(tie)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", tie.alias("tie")))
    firsts = sorted((r["part"], r["least"]["doc_id"], r["least"]["tie"]) for r in docs.select(part.alias("part"), "doc_id", *(["text"] if ranges.split else [])).groupBy("part").agg(least.alias("least")).collect())
    before = [(doc_id, t, firsts[i - 1][0]) for i, (_, doc_id, t) in enumerate(firsts)]  # first of a part, and the part before it, going round
    table = F.create_map(*[F.lit(x) for x in itertools.chain(*((f"{i},{t}", p) for i, t, p in before))]) if before else None
    name = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), tie.cast("string"))
    ids = {i for i, _, _ in before}
    known = F.when(F.col("doc_id").isNull(), F.lit(None in ids)).otherwise(F.col("doc_id").isin([i for i in ids if i is not None]))
    ahead = F.when(known, F.try_element_at(table, name)) if before else F.lit(None).cast("int")
    places = F.filter(F.array(F.struct(part.alias("part"), F.lit(False).alias("ahead")), F.struct(ahead.cast("int").alias("part"), F.lit(True).alias("ahead"))), lambda x: x["part"].isNotNull())
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.inline(places)), ranges.count


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likeness to that and to the next document."""
    dealt, parts = neighbours(docs, key, text)
    return (
        dealt.repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "tie")
        .select("doc_id", "text", "ahead")
        .mapInArrow(lambda batches: common.record_batches(_rows(common.batch_rows(batches)), SCHEMA), SCHEMA)
    )
