"""Operator 9: packing of documents into sequences by vector best-fit.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths). Pieces come in
descending length. Each goes to the open bin that satisfies every constraint and whose residual vector, each part
divided by its capacity, has the least weighted norm; if none does, a new bin opens. Bins are kept by residual tokens
and, within equal residual tokens, sorted by the rest of the norm, so the best one is found without scanning bins.

Pieces are dealt by hash to groups of about ``GROUP_DOCS`` documents which are packed side by side; a group costs at most
a few bins more than packing it with all others. Null and empty texts are documents that hold the end id only; rows that
share a doc_id, or repeat whole, are packed each on its own, and are dealt apart by their place in the table's files. A very
long text is cut into as many pieces as it needs. An empty table gives an empty result. Only the key and the text are read,
so other columns may have any names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

GROUP_DOCS = 40_000
#: Weights of the residual norm: tokens, documents, attention cost.
WEIGHTS = (1.0, 0.5, 0.5)
#: Documents in a sequence at most, which bounds what a loader keeps for a block-diagonal mask.
MOST_DOCUMENTS = 64

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"
PLACED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class VectorBins:
    """Open bins under capacities (tokens, documents, attention cost)."""

    def __init__(self, tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = WEIGHTS):
        self.capacity, self.weights = (tokens, documents, attention), weights
        self.by_tokens: dict[int, list[tuple[float, int]]] = {}  # residual tokens -> bins sorted by the rest of the norm
        self.present = 0  # bit t: some open bin has t residual tokens
        self.residual: list[tuple[int, int, int]] = []

    def _rest(self, documents: int, attention: int) -> float:
        _, d, a = self.capacity
        return self.weights[1] * (documents / d) ** 2 + self.weights[2] * (attention / a) ** 2

    def _file(self, b: int) -> None:
        t, d, a = self.residual[b]
        if t > 0 and d > 0 and a > 0:
            bisect.insort(self.by_tokens.setdefault(t, []), (self._rest(d, a), b))
            self.present |= 1 << t

    def _best(self, length: int, cost: int) -> tuple[int, int] | None:
        """(residual tokens, place among the bins with as many) of the feasible bin of least norm."""
        best, found, ahead = float("inf"), None, self.present >> length
        while ahead:
            t = length + (ahead & -ahead).bit_length() - 1
            own = self.weights[0] * (t / self.capacity[0]) ** 2
            if own >= best:
                break
            for at, (rest, b) in enumerate(self.by_tokens[t]):
                if own + rest >= best:
                    break
                if self.residual[b][2] >= cost:
                    best, found = own + rest, (t, at)
                    break
            ahead &= ahead - 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        cost = length * length
        if length > self.capacity[0] or cost > self.capacity[2] or self.capacity[1] < 1:
            raise ValueError(f"a piece of {length} tokens fits no bin")
        if (found := self._best(length, cost)) is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
        else:
            t, at = found
            _, b = self.by_tokens[t].pop(at)
            if not self.by_tokens[t]:
                del self.by_tokens[t]
                self.present &= ~(1 << t)
        t, d, a = self.residual[b]
        self.residual[b] = (t - length, d - 1, a - cost)
        self._file(b)
        return b, self.capacity[0] - t


def cut(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all have ``most``, but the first may be shorter."""
    first = n % most or most
    yield 0, min(first, n)
    for start in range(first, n, most):
        yield start, most


def pieces(docs: DataFrame, vocabulary: str, end_id: int, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: its ids and then ``end_id``."""

    def run(batches):
        import numpy as np

        encoder, width = tokens.library_encoder(vocabulary)
        tail = end_id.to_bytes(width, "little")

        def rows():
            for part in tokens.in_batches(common.batch_rows(batches), 1, tokens.LIBRARY_BATCH_CHARS):
                for (doc_id, _, tie), ids in zip(part, encoder.encode([r[1] for r in part]), strict=True):
                    values = np.frombuffer(ids + tail, f"<u{width}").astype("<u4")
                    for i, (start, length) in enumerate(cut(len(values), most)):
                        yield doc_id, i, start, length, zlib.crc32(values[start : start + length].tobytes()), tie

        return common.record_batches(rows(), PIECE_SCHEMA)

    k, t = common.columns([key, text])
    rows = common.with_row(docs.select(k.cast("long").alias("doc_id"), F.coalesce(t, F.lit("")).alias("text")), "row")
    return rows.select("doc_id", "text", common.row_hash("doc_id", "text", "row").alias("tie")).mapInArrow(run, PIECE_SCHEMA)


def place_group(rows: Iterable[tuple], group: int, limits: tuple[int, int, int]) -> Iterator[tuple]:
    """Rows of pieces with the sequence and offset of each; the group's number leads its sequences' ids."""
    bins = VectorBins(*limits)
    for doc_id, piece, start, length, crc, _ in sorted(rows, key=lambda r: (-r[3], r[5], r[1], r[4])):
        b, offset = bins.place(length)
        yield doc_id, piece, start, length, crc, group << 40 | b, offset


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, most_tokens: int = 2048, most_documents: int = MOST_DOCUMENTS, most_attention: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its place. The limit on attention cost is by default that of one full piece, the least that
    leaves pieces of ``most_tokens`` uncut: it then binds for such pieces alone, and decides among bins by the norm."""
    limits = (most_tokens, most_documents, most_attention or most_tokens**2)
    groups = -(-docs.count() // GROUP_DOCS) or 1
    found = pieces(docs, vocabulary, end_id, min(most_tokens, int(limits[2] ** 0.5)), key, text)
    found = found.withColumn("group", F.pmod(F.xxhash64("tie", "piece"), F.lit(groups)).cast("int"))

    def run(keys, table):
        import pyarrow as pa

        rows = common.batch_rows([table.select([f.split()[0] for f in PIECE_SCHEMA.split(", ")])])
        made = list(common.record_batches(place_group(rows, keys[0].as_py(), limits), PLACED_SCHEMA, 1 << 16))
        return pa.Table.from_batches(made)

    return found.groupBy("group").applyInArrow(run, PLACED_SCHEMA)
