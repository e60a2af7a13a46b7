"""Operator 4: byte-level BPE by merge ranks, with a hierarchical-bitmap rank queue, and decoding.

The adjacent pairs of a pre-token wait in buckets, one per merge rank, which hold positions of a linked list of parts.
A two-level bitmap marks the buckets in use; two find-first-set steps give the lowest rank. A pair that a merge has
changed stays in its old bucket and is skipped when its turn comes. A merge takes constant time but for the bucket's
heap, so a pre-token of n bytes takes about n log n, however long it is.

A null or empty text has no ids; a very long text is encoded whole. Rows that repeat or share an id are encoded each on
its own, and an empty table gives an empty result. Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens


#: Pre-tokens that an encoder remembers at most, none longer than so many characters: the same word stands before many marks.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


class RankEncoder:
    """Ids of pre-tokens and texts by mergeable ranks (bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import pyarrow as pa
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.shift = max(1, ((max(ranks.values())).bit_length() + 1) // 2)
        self.words = [0] * ((max(ranks.values()) >> self.shift) + 1)  # bit r of word w: bucket w << shift | r is in use
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")  # as the machine has it: workers are little-endian
        self.known: dict[str, bytes] = {}
        self.single = [ranks[bytes((a,))] for a in range(256)]
        self.first = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]  # of pairs of bytes
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.bytes_of[rank] = text
        self.table = pa.array(self.bytes_of, pa.large_binary())

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue is written out in place, as calls would cost more than its steps. All words are
        zero again at the end."""
        ranks = self.ranks
        get, n = ranks.get, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        shift, words, top = self.shift, self.words, 0
        low = (1 << shift) - 1
        buckets: dict[int, list[int]] = {}  # heaps of positions
        find = buckets.get
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part before it starts
        first = self.first
        pair = [first[a][b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of the part and the next one
        pair.append(-1)
        single = self.single
        own = [single[a] for a in piece]  # rank of the part that starts here
        for i, rank in enumerate(pair):
            if rank >= 0:
                bucket = find(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    word = rank >> shift
                    words[word] |= 1 << (rank & low)
                    top |= 1 << word
                else:
                    bucket.append(i)  # ascending, so it is a heap
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            lowest = bits & -bits
            rank = word << shift | lowest.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits ^ lowest
                if not bits:
                    top &= top - 1
            else:
                i = heappop(bucket)
            if pair[i] != rank:
                continue  # stale
            own[i] = rank
            j = end[i]
            k = end[i] = end[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                rank = pair[i] = get(piece[i : end[k]], -1)
                if rank >= 0:
                    bucket = find(rank)
                    if bucket is None:
                        buckets[rank] = [i]
                        word = rank >> shift
                        words[word] |= 1 << (rank & low)
                        top |= 1 << word
                    else:
                        heappush(bucket, i)
            else:
                pair[i] = -1
            if i:
                p = before[i]
                rank = pair[p] = get(piece[p:k], -1)
                if rank >= 0:
                    bucket = find(rank)
                    if bucket is None:
                        buckets[rank] = [p]
                        word = rank >> shift
                        words[word] |= 1 << (rank & low)
                        top |= 1 << word
                    else:
                        heappush(bucket, p)
        ids, i = [], 0
        while i < n:
            ids.append(own[i])
            i = end[i]
        return ids

    def encode(self, text: str) -> list[int]:
        return [x for match in self.find(text) for x in self.encode_piece(match.encode())]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        known, code = self.known, self.kind.char
        found = []
        for text in texts:
            parts = []
            for match in self.find(text):
                ids = known.get(match)
                if ids is None:
                    ids = array(code, self.encode_piece(match.encode())).tobytes()
                    if len(match) <= REMEMBERED_CHARS:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[match] = ids
                parts.append(ids)
            found.append(b"".join(parts))
        return found

    def decode(self, ids) -> bytes:
        """The bytes that ids (a list, or an array of unsigned integers) stand for, put together column-wise."""
        import pyarrow as pa

        taken = self.table.take(pa.array(ids, None if len(ids) else pa.uint32()))
        _, ends, content = taken.buffers()
        last = int.from_bytes(ends[8 * len(taken) : 8 * len(taken) + 8].to_pybytes(), "little") if len(taken) else 0
        return content[:last].to_pybytes() if last else b""


@functools.lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> tuple[RankEncoder, tokens.PieceEncoder]:
    """One per worker process for a file of base64 bytes and ranks."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(text): int(rank) for text, rank in map(bytes.split, file)}
    encoder = RankEncoder(ranks, pattern)
    return encoder, tokens.PieceEncoder(encoder.encode_many)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each row; a null or empty text has no ids."""

    def run(batches):
        encoder, pieces = rank_encoder(vocabulary, pattern)

        def rows():
            import numpy as np

            for part in tokens.in_batches(common.batch_rows(batches), 1):
                for (doc_id, _), ids in zip(part, pieces.encode([r[1] for r in part]), strict=True):
                    yield doc_id, np.frombuffer(ids, encoder.kind).astype("<u4").tobytes()

        return common.record_batches(rows(), "doc_id long, ids binary", 256)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, content: the bytes that the ids stand for."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, content binary"

    def run(batches):
        import numpy as np

        encoder, _ = rank_encoder(vocabulary, pattern)
        rows = ((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), encoder.decode(np.frombuffer(ids, "<u4"))) for doc_id, ids in common.batch_rows(batches))
        return common.record_batches(rows, schema, 256)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
