"""Operator 12: hard negatives from inverted lists of k-means clusters with stored centroids and radii.

**Index.** Clusters are fitted by Lloyd's algorithm on at most about ``SAMPLE`` rows, chosen by hash; every row is then
assigned. A cluster of more than ``LIST_ROWS`` rows is dealt to several lists, so a hot cluster is many lists. A list stores
its rows as one matrix, its centroid (their mean) and its radius (the largest distance of a row from it). Lists are dealt to
groups of a bounded size.

**Search.** By Cauchy-Schwarz the inner product of an anchor q with a row of a list is within |q| radius of q.centroid. An
anchor visits a group's lists by descending upper bound, skips lists whose bounds lie outside the window, and stops when
the bound falls strictly below its kth score. The first ``k`` of a group hold all of the first ``k`` overall that are in it, so
results are exact. Anchors go to every group in blocks; a task holds one block and one group. The first search finds each
anchor's positives, the second the negatives within the windows that their scores set.

Vectors are floor(scale * x), as doubles; scores are exact while sums of products stay below 2**53. Rows without a label, or
with a null vector or any null or non-finite component, take no part. Vectors shorter than the longest are padded with zeros.
Higher scores come first, then smaller ids, null ids last; rows with the same id are rows of their own, in a fixed order. A row
is never its own positive, an equal row can be. Other columns are left out. Anchors without a positive, or without a negative
in the window, give no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Rows that the clusters are fitted on, and the most clusters; rows a list has; values (rows x width) in a group of lists, at
#: least and at most; anchors in a block.
SAMPLE, MOST_CLUSTERS, LIST_ROWS, GROUP_VALUES, ANCHOR_BLOCK = 1 << 14, 256, 512, (1 << 18, 1 << 22), 4096

INDEX = "list int, group int, centroid binary, radius double, ids binary, known binary, rows binary, labels binary, matrix binary"
POSITIVES = "row long, positive long, positive_id long, score double"
NEGATIVES = "row long, anchor_id long, positive long, positive_id long, positive_score double, negative long, negative_id long, score double"


def fit_clusters(sample, count: int, rounds: int = 8):
    """Centroids (count x width) of ``sample`` by Lloyd's algorithm from evenly spaced rows."""
    import numpy as np

    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].copy() if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if len(sample) else 0):
        nearest = _nearest(sample, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, sample)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def _nearest(vectors, centres):
    return ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)


def _matrix(column, width: int, scale: float):
    """floor(scale * x) of an Arrow list column, padded to ``width``."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(starts, lengths)] = np.floor(values * scale)
    return out


def _assign(batches, centres, width: int, scale: float, kind: str) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        vectors = _matrix(batch.column("vector"), width, scale)
        packed = pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary())
        nearest = pa.array(_nearest(vectors, centres).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), nearest, packed], ["id", "label", "cluster", "vector"])


def _ids(column):
    """(ids, whether there is one) of a column with nulls."""
    import numpy as np

    return column.fill_null(0).to_numpy().astype(np.int64), ~column.is_null().to_numpy(zero_copy_only=False)


def _vectors(column, width: int, kind: str):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float64)


def _pack(table, width: int, kind: str):
    """One list: its rows, centroid and radius."""
    import numpy as np
    import pyarrow as pa

    vectors = _vectors(table.column("vector"), width, kind)
    ids, known = _ids(table.column("id").combine_chunks())
    centre = vectors.mean(0)
    radius = float(np.sqrt(((vectors - centre) ** 2).sum(1)).max())
    row = [table.column("list")[0].as_py(), table.column("group")[0].as_py(), centre.tobytes(), radius, ids.tobytes(), known.tobytes()]
    row += [table.column("row").to_numpy().tobytes(), table.column("label").to_numpy().astype(np.int64).tobytes(), vectors.astype(kind).tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), *[pa.binary()] * 5]
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["list", "group", "centroid", "radius", "ids", "known", "rows", "labels", "matrix"])


class Lists:
    """The inverted lists of one group, in memory."""

    def __init__(self, table, width: int, kind: str):
        import numpy as np

        each = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        self.rows, self.ids, self.known, self.labels = each("rows", np.int64), each("ids", np.int64), each("known", bool), each("labels", np.int64)
        self.matrix = [m.reshape(-1, width).astype(np.float64) for m in each("matrix", kind)]
        self.centres, self.radii = np.array(each("centroid", np.float64)).reshape(-1, width), table.column("radius").to_numpy()

    def bounds(self, vectors):
        """(lower, upper) of the scores of each vector with each list; wide enough for the rounding of floats."""
        import numpy as np

        middle = vectors @ self.centres.T
        reach = np.sqrt((vectors**2).sum(1))[:, None] * self.radii
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach, middle + reach


class Best:
    """The first ``k`` of what was added, by score descending, id (none last) and row."""

    def __init__(self, k: int):
        self.k, self.parts, self.kth = k, None, float("-inf")

    def add(self, score, ids, known, rows) -> None:
        import numpy as np

        if self.parts is not None:
            score, ids, known, rows = (np.concatenate(x) for x in zip(self.parts, (score, ids, known, rows), strict=True))
        if len(score) > self.k:
            near = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, known, rows = score[near], ids[near], known[near], rows[near]
        order = np.lexsort((rows, ids, ~known, -score))[: self.k]
        self.parts = score[order], ids[order], known[order], rows[order]
        if len(order) == self.k:
            self.kth = self.parts[0][-1]

    def found(self):
        return zip(*(x.tolist() for x in self.parts), strict=True) if self.parts is not None else ()


def find_positives(vectors, labels, own, lists: Lists, k: int):
    """For each anchor its ``k`` best rows of its label, other than itself."""
    lower, upper = lists.bounds(vectors)
    for vector, label, row, bound in zip(vectors, labels, own, upper, strict=True):
        best = Best(k)
        for at in (-bound).argsort(kind="stable"):
            if bound[at] < best.kth:
                break
            same = (lists.labels[at] == label) & (lists.rows[at] != row)
            if same.any():
                score = lists.matrix[at][same] @ vector
                best.add(score, lists.ids[at][same], lists.known[at][same], lists.rows[at][same])
        yield best


def find_negatives(vectors, labels, windows, lists: Lists, k: int, least: int, most: int):
    """For each anchor, and each score of ``windows``, its ``k`` best rows of other labels with least * score <= 100 * theirs <= most * score."""
    lower, upper = lists.bounds(vectors)
    for vector, label, scores, low, high in zip(vectors, labels, windows, lower, upper, strict=True):
        best = [Best(k) for _ in scores]
        for at in (-high).argsort(kind="stable"):
            open_ = [i for i, s in enumerate(scores) if high[at] >= best[i].kth and 100 * high[at] >= least * s]
            if not open_:  # no list after this one has a higher bound
                break
            open_ = [i for i in open_ if 100 * low[at] <= most * scores[i]]
            if not open_:
                continue
            other = lists.labels[at] != label
            score = lists.matrix[at] @ vector
            for i in open_:
                inside = other & (score >= best[i].kth) & (100 * score >= least * scores[i]) & (100 * score <= most * scores[i])
                if inside.any():
                    best[i].add(score[inside], lists.ids[at][inside], lists.known[at][inside], lists.rows[at][inside])
        yield best


def _rows(found, schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    columns = list(zip(*found, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _positives(anchors, lists, width: int, kind: str, k: int):
    vectors = _vectors(anchors.column("vector"), width, kind)
    own = anchors.column("row").to_pylist()
    each = find_positives(vectors, anchors.column("label").to_pylist(), own, Lists(lists, width, kind), k) if lists.num_rows else ()
    return _rows([(row, r, i if known else None, s) for row, best in zip(own, each, strict=False) for s, i, known, r in best.found()], POSITIVES)


def _negatives(anchors, lists, width: int, kind: str, k: int, least: int, most: int):
    vectors = _vectors(anchors.column("vector"), width, kind)
    own, ids, positives = (anchors.column(c).to_pylist() for c in ("row", "id", "positives"))
    each = find_negatives(vectors, anchors.column("label").to_pylist(), [[p["score"] for p in ps] for ps in positives], Lists(lists, width, kind), k, least, most) if lists.num_rows else ()
    found = []
    for row, anchor, ps, bests in zip(own, ids, positives, each, strict=False):
        for p, best in zip(ps, bests, strict=True):
            found += [(row, anchor, p["positive"], p["positive_id"], p["score"], r, i if known else None, s) for s, i, known, r in best.found()]
    return _rows(found, NEGATIVES)


class ListIndex:
    """Inverted lists over the rows of ``table`` (id, label, vector) that can take part, written to the shared folder."""

    def __init__(self, table: DataFrame, scale: float = 256.0):
        spark = table.sparkSession
        vector = F.col("vector")
        sound = F.col("label").isNotNull() & vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
        table = table.where(sound).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector)
        size = table.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width"), F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))).alias("most")).first()
        self.count, self.width = size["n"], max(1, size["width"] or 0)
        self.kind = "<i2" if scale * (size["most"] or 0) < 32766 else "<f8"
        share = min(1.0, SAMPLE / max(1, self.count)) * 2.0**64 - 2.0**63
        sample = table.where(F.xxhash64("id", "vector").cast("double") <= F.lit(share)).select("vector").limit(2 * SAMPLE).toArrow()
        centres = fit_clusters(_matrix(sample.column("vector"), self.width, scale), max(1, min(MOST_CLUSTERS, self.count // LIST_ROWS)))
        made = table.mapInArrow(partial(_assign, centres=centres, width=self.width, scale=scale, kind=self.kind), "id long, label long, cluster int, vector binary")
        self.rows = common.written(made.withColumn("row", F.monotonically_increasing_id()), "vectors")

        sizes = dict(self.rows.groupBy("cluster").count().collect())  # at most MOST_CLUSTERS
        lists = [-(-sizes.get(c, 0) // LIST_ROWS) for c in range(len(centres))]
        least, most = GROUP_VALUES
        self.groups = max(1, -(-self.count * self.width // min(most, max(least, self.count * self.width // 64))))
        firsts = [sum(lists[:c]) for c in range(len(centres))]
        at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
        placed = self.rows.withColumn("list", (at(firsts) + F.pmod(F.xxhash64("row"), at([max(1, n) for n in lists]))).cast("int")).withColumn("group", F.col("list") % self.groups)
        width, kind = self.width, self.kind
        self.lists = common.written(placed.groupBy("list").applyInArrow(lambda table: _pack(table, width, kind), INDEX), "lists")

    def _search(self, anchors: DataFrame, count: int, search, schema: str) -> DataFrame:
        """``search`` of every block of anchors in every group of lists."""
        blocks = max(1, -(-count // ANCHOR_BLOCK))
        sent = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        lists = self.lists.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return sent.groupBy("block", "group").cogroup(lists.groupBy("block", "group")).applyInArrow(partial(search, width=self.width, kind=self.kind), schema)

    def negatives(self, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that ``anchors``, a condition
        on id and label, picks."""
        chosen = self.rows.where(anchors).drop("cluster")
        count = chosen.count()
        near = self._search(chosen, count, partial(_positives, k=positives), POSITIVES)
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("positive_id"), "positive"))
        near = near.withColumn("place", place).where(F.col("place") <= positives).groupBy("row").agg(F.collect_list(F.struct("positive", "positive_id", "score")).alias("positives"))
        asked = common.written(chosen.join(near, "row"), "positives")
        found = self._search(asked, count, partial(_negatives, k=negatives, least=least, most=most), NEGATIVES)
        rank = F.row_number().over(Window.partitionBy("row", "positive").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"), "negative"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
        return found.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))


def mine(table: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", **how) -> DataFrame:
    """Hard negatives of the rows that ``anchors``, a condition on the columns id and label, picks."""
    i, lb, v = common.columns([id, label, vector])
    return ListIndex(table.select(i.alias("id"), lb.alias("label"), v.alias("vector"))).negatives(anchors, **how)
