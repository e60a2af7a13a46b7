"""Operator 13: for each row, how many rows lie above it: at the same slot or an earlier one, and at a strictly higher level.

Rows are first summed up to cells (level, slot), so no cell is larger than a row. Cells are range-partitioned by descending
level, and by slot within a level, so that a level of any size is spread over parts. Each part is swept from its highest
level down with a Fenwick tree over its slots; equal levels are inserted only after all of them have been queried. The tree
starts with the cumulative slot histogram of all higher parts. Where the order cuts a level, what earlier parts hold of it has
smaller slots, so all of it is in that histogram, and one subtraction takes it off.

Parts have about ``CELLS`` cells, and at least four times as many as there are slots, so that the histograms (parts x slots)
stay smaller than the cells. A task holds one part and one histogram. What reaches the driver are three counts (and the
bounds of the ranges, which Spark samples itself).

Slots and levels are longs. Rows with a null slot or level are above none and get null counts. A null weight counts as 0.
Equal rows count as often as they are there. Ties in slot count, ties in level do not. Other columns are kept, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: About how many cells a part has, and how many cells a part has for every slot, at least.
CELLS, CELLS_A_SLOT = 1 << 14, 4

SWEPT = "level long, slot long, n long, above long, above_weight long"


def _fenwick(counts):
    """The tree (from 1 on) of an array of counts, as a list."""
    import numpy as np

    sums = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(1, len(sums))
    return [0, *(sums[at] - sums[at - (at & -at)]).tolist()]


def sweep(level, slot, n, weight, slots_before, n_before, weight_before, n_held, weight_held):
    """(order, n above, weight above) of the cells of one part, in descending order of level.

    ``*_before`` is the histogram of the higher parts, ``*_held`` what they hold of this part's highest level."""
    import numpy as np

    order = np.lexsort((slot, ~level))  # ~ descends and cannot overflow
    level, slot, n, weight = level[order], slot[order], n[order].tolist(), weight[order].tolist()
    own = np.unique(slot)
    to = np.searchsorted(own, slots_before)  # the first slot here that they count for
    trees = []
    for values in (n_before, weight_before):
        start = np.zeros(len(own), np.int64)
        np.add.at(start, to[to < len(own)], values[to < len(own)])
        trees.append(_fenwick(start))
    tree, heavy, size = *trees, len(own)
    places = (np.searchsorted(own, slot) + 1).tolist()
    ends = [*(np.flatnonzero(np.diff(level)) + 1).tolist(), len(level)]
    above, above_weight, start = [], [], 0
    for end in ends:
        for place in places[start:end]:
            a, b = (-n_held, -weight_held) if start == 0 else (0, 0)
            while place:
                a += tree[place]
                b += heavy[place]
                place &= place - 1
            above.append(a)
            above_weight.append(b)
        for i in range(start, end):
            place, x, y = places[i], n[i], weight[i]
            while place <= size:
                tree[place] += x
                heavy[place] += y
                place += place & -place
        start = end
    return order, np.array(above, np.int64), np.array(above_weight, np.int64)


def _sweep_part(cells, before):
    import numpy as np
    import pyarrow as pa

    kinds = [(name, pa.int64()) for name in ("level", "slot", "n", "above", "above_weight")]
    if not cells.num_rows:
        return pa.schema(kinds).empty_table()
    level, slot, n, weight = (cells.column(c).to_numpy() for c in ("level", "slot", "n", "w"))
    held = before.filter(before.column("slot").is_null())
    before = before.filter(before.column("slot").is_valid())
    sums = [before.column(c).to_numpy().astype(np.int64) for c in ("slot", "n", "w")]
    order, above, heavy = sweep(level, slot, n, weight, *sums, *(sum(held.column(c).to_pylist()) for c in ("n", "w")))
    return pa.table([level[order], slot[order], n[order], above, heavy], schema=pa.schema(kinds))


def above(rows: DataFrame, slot: str = "slot", level: str = "level", weight: str = "weight", names: tuple[str, str] = ("n_above", "weight_above")) -> DataFrame:
    """``rows`` with two more columns: how many rows lie above each, and the sum of their weights."""
    spark = rows.sparkSession
    s, lv, w = common.columns([slot, level, weight])
    known = rows.where(s.isNotNull() & lv.isNotNull())
    cells = known.groupBy(lv.cast("long").alias("level"), s.cast("long").alias("slot")).agg(F.count("*").alias("n"), F.coalesce(F.sum(w.cast("long")), F.lit(0).cast("long")).alias("w"))
    cells = common.written(cells, "cells")
    size = cells.agg(F.count("*").alias("cells"), F.approx_count_distinct("slot").alias("slots"), F.sum("n").alias("rows")).first()
    parts = max(1, -(-size["cells"] // max(CELLS, CELLS_A_SLOT * size["slots"])))

    ranged = cells.repartitionByRange(parts, F.desc("level"), F.asc("slot")).withColumn("part", F.spark_partition_id())
    ranged = common.written(ranged, "ranges")
    made = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    if made > parts:  # a session may make more ranges than asked for: neighbours go together
        ranged = ranged.withColumn("part", F.floor(F.col("part") * parts / F.lit(made)).cast("int"))

    sums = [F.sum("n").alias("n"), F.sum("w").alias("w")]
    held = ranged.groupBy("slot", "part").agg(*sums)
    ends = held.select("slot").distinct().select("slot", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    higher = Window.partitionBy("slot").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    steps = held.withColumn("asks", F.lit(False)).unionByName(ends.select("slot", "part", *[F.lit(0).cast("long").alias(c) for c in ("n", "w")], F.lit(True).alias("asks")))
    before = steps.select("slot", "part", F.sum("n").over(higher).alias("n"), F.sum("w").over(higher).alias("w"), "asks").where("asks and n > 0").drop("asks")
    earlier = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = ranged.groupBy("level", "part").agg(*sums).select(F.lit(None).cast("long").alias("slot"), "part", F.sum("n").over(earlier).alias("n"), F.sum("w").over(earlier).alias("w")).where("n > 0")

    swept = ranged.groupBy("part").cogroup(before.unionByName(cut).groupBy("part")).applyInArrow(_sweep_part, SWEPT)
    swept = common.written(swept, "swept")
    at, to, n = common.fresh([*rows.columns, *names], "slot", "level", "n")
    table = swept.select(F.col("slot").alias(at), F.col("level").alias(to), F.col("n").alias(n), F.col("above").alias(names[0]), F.col("above_weight").alias(names[1]))
    keyed = rows.select("*", s.cast("long").alias(at), lv.cast("long").alias(to))
    return common.lookup(keyed, table, [at, to], n, size["rows"] or 0).select(*common.columns(rows.columns), *common.columns(list(names)))
