"""SimHash and anchor-point covering at a likeness of shingle sets, for stages that must find copies with many small edits.

At a Jaccard likeness of 0.8 two SimHashes differ in about 15 % of their bits. A covering code on all bits would have to
replicate each fingerprint to nearly all of its anchors at that radius. So the fingerprint is longer (256 bits), and several
tables cover a part of its bits each. A table samples 23 positions; its anchors are the 4,096 words of the binary Golay code,
whose covering radius there is 3: each word of 23 bits has one anchor, its home, within 3 bits. A fingerprint is replicated to
every anchor within 3 + ``THRESHOLD`` bits, about 5 of them, so two that differ in at most two of a table's 23 bits always meet
there, and others often do. Where many fingerprints call for more anchors, further sampled bits deal them to cells with anchors of
their own. Pairs that meet are compared in all 256 bits. The bound on these lies ``DEVIATIONS`` past the mean at the threshold,
and the number of tables gives isolated pairs at the threshold, over all distances that they may have, a chance of ``RECALL`` to
meet and to be within the bound.

Fingerprints only group what may be alike. Each group's shingle sets are then read from the texts, and a pair is linked
only if the Jaccard likeness of its two sets reaches the threshold; chains of such links make the components.

Distinct shingle sets alone take part, so copies cost nothing. The cells of a table grow with their count, so anchors
stay small but for groups of near copies. Where many of a batch share an anchor, what chains of close pairs join there is
linked before the shuffle, and one of it stands for the rest at this anchor, as it does where a task holds ``HELD`` of an
anchor. Each table has other anchors, so a group that large meets in many ways. Groups only say where to look; what is
alike in a group is found exactly. No anchor and no group is cut off, and none has to fit into one task:

- a group of more than ``BLOCK`` sets is dealt to blocks, each of which is searched exactly;
- one set of each block's components stands for it, and these are searched in the same way until one block is left;
- if a group still has several components, the sets outside its largest one are compared with all of the group, block by
  block. Near copies are one component by then; a group of unlike sets costs the square of its blocks, in as many tasks.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

WORDS, LIKENESS, RECALL, DEVIATIONS = 5, 0.8, 0.99, 3
LANES, SEED = 4, 42
BITS = 64 * LANES
#: The Golay code: length, bits of an anchor, covering radius, bits past it up to which an anchor is visited, and the generator.
LENGTH, ANCHOR_BITS, RADIUS, THRESHOLD, GENERATOR = 23, 12, 3, 1, 0b101011100011
#: Chance that two words of 23 bits that differ in so many have an anchor in common within 4 bits of both (those past 8 have none).
MEET = (1.0, 1.0, 1.0, 0.5947, 0.5947, 0.189, 0.189, 0.0342, 0.0342)
#: Average fingerprints at home with an anchor, the most bits that name an anchor and its cell, and the anchors from this size on that are searched instead of compared pair by pair.
MEMBERS, MOST_BITS, LARGE = 16, 44, 96
#: Fingerprints that are replicated together, and from how many of these at one anchor on one stands for all.
REPLICATED, SAME_ANCHOR = 2048, 16
#: Fingerprints of one anchor that a task holds at most to compare them.
HELD = 20_000
#: Sets, and hashes in them, that are searched as one; parts of which so many need no broadcast check.
BLOCK, BLOCK_HASHES, BROADCAST_PARTS = 256, 4_000_000, 100_000

SKETCH = [f"s{i}" for i in range(LANES)]
SKETCH_SCHEMA = ", ".join(f"{s} long" for s in SKETCH)


def differing_share(likeness: float) -> float:
    """Share of the bits in which SimHashes of two sets of that Jaccard likeness differ on average: their angle."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


def most_differing(likeness: float) -> int:
    """Bits by which fingerprints of one group may differ: the mean at the threshold and ``DEVIATIONS`` standard deviations more."""
    p = differing_share(likeness)
    return int(BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p)))


def recall(bits: int, tables: int, likeness: float) -> float:
    """Chance that two fingerprints of sets of that likeness meet in a table and differ by no more than the bound."""
    p = differing_share(likeness)
    others = BITS - LENGTH - (bits - ANCHOR_BITS)  # positions outside a table; those of the cell must be equal
    chance = 0.0
    for d in range(most_differing(likeness) + 1):
        share = math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d)
        met = sum(x * math.comb(LENGTH, w) * math.comb(others, d - w) for w, x in enumerate(MEET) if w <= d) / math.comb(BITS, d)
        chance += share * (1 - (1 - met) ** tables)
    return chance


def tables_for(n: int, likeness: float) -> tuple[int, int]:
    """(bits that name an anchor and its cell, tables) for ``n`` distinct fingerprints."""
    bits = min(MOST_BITS, max(ANCHOR_BITS, math.ceil(math.log2(max(n, 1) / MEMBERS))))
    tables = 1
    while recall(bits, tables, likeness) < RECALL:
        tables += max(1, tables // 50)
    return bits, tables


@functools.lru_cache(maxsize=8)
def sampled(bits: int, tables: int):
    """Positions of each table's bits: those that the code covers, then those of the cell."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(BITS, LENGTH + bits - ANCHOR_BITS, replace=False) for _ in range(tables)])


def syndromes(words):
    """Remainders of words of 23 bits by the code's generator; zero for an anchor."""
    import numpy as np

    words = np.array(words, np.int64)
    for i in range(LENGTH - 1, ANCHOR_BITS - 2, -1):
        words ^= (words >> i & 1) * (GENERATOR << (i - ANCHOR_BITS + 1))
    return words


@functools.cache
def ways():
    """(steps, counts): for each syndrome the differences to all anchors within radius and threshold, the home first, and how many."""
    import numpy as np

    steps = np.array([sum(1 << i for i in at) for w in range(RADIUS + THRESHOLD + 1) for at in itertools.combinations(range(LENGTH), w)])
    own = syndromes(steps)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own)
    found = np.zeros((len(counts), counts.max()), np.int64)
    found[own[order], np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)] = steps[order]
    return found, counts


def visited(words):
    """(row, anchor): the rows of words of 23 bits with each anchor, by its first 12 bits, within radius and threshold."""
    import numpy as np

    steps, counts = ways()
    own = syndromes(words)
    rows, at = np.nonzero(np.arange(steps.shape[1]) < counts[own][:, None])
    return rows, (words[rows] ^ steps[own[rows], at]) >> (LENGTH - ANCHOR_BITS)


def shingle_hashes(text: str, words: int = WORDS):
    """The sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    import numpy as np
    import xxhash

    parts = text.encode().lower().split()
    width = max(1, min(words, len(parts)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(x), SEED) for x in zip(*[parts[i:] for i in range(width)], strict=False)], np.uint64))


def set_digest(hashes) -> int:
    """A signed long that names a set of shingle hashes."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63


def sketch(hashes) -> tuple[int, ...]:
    """The fingerprint of a set of shingle hashes as signed longs; zero without any."""
    import numpy as np

    if not len(hashes):
        return (0,) * LANES
    found = []
    for lane in range(LANES):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (lane + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            ones += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(2 * ones > len(mixed)).view(np.int64)[0]))
    return tuple(found)


def with_sketches(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    schema = f"doc_id long, digest long, size long, {SKETCH_SCHEMA}"

    def run(batches):
        hashed = ((doc_id, shingle_hashes(body or "", words)) for doc_id, body in common.batch_rows(batches))
        return common.record_batches(((doc_id, set_digest(h), len(h), *sketch(h)) for doc_id, h in hashed), schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _apart(a, b):
    """Bits in which rows of two sketch arrays differ."""
    import numpy as np

    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)  # of signed integers it would count the absolute value's bits


def searched(sketches, k: int):
    """Pairs (x, y) of rows, y once at most: from each row through those not yet reached that are within ``k`` bits; x is what
    the search of a component began with."""
    import numpy as np

    rest, found = np.arange(len(sketches)), []
    while len(rest):
        begin, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = _apart(sketches[rest], sketches[front.pop()]) <= k
            found += [(begin, y) for y in rest[near]]
            front += list(rest[near])
            rest = rest[~near]
    return found


def group_links(keys, ids, sketches, k: int):
    """Links (a, b) that group what is within ``k`` bits at the same anchor; rows come sorted by anchor."""
    import numpy as np

    links = []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    for start, size in zip(starts[sizes >= LARGE], sizes[sizes >= LARGE], strict=True):
        links += [(ids[start + x], ids[start + y]) for x, y in searched(sketches[start : start + size], k)]
    small = np.repeat(sizes < LARGE, sizes)
    rows = np.flatnonzero(small)
    keys, ids, sketches = keys[rows], ids[rows], sketches[rows]
    for step in range(1, min(LARGE, len(keys))):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        near = same[_apart(sketches[same], sketches[same + step]) <= k]
        links += zip(ids[near], ids[near + step], strict=True)
    return links


def links(classes: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Pairs (a, b) of nodes that group all that meet and may be alike; classes: node (long) and its sketch."""
    n = classes.count()
    bits, tables = tables_for(n, likeness)
    k = most_differing(likeness)
    schema = f"anchor long, node long, {SKETCH_SCHEMA}"

    def replicate(batches):
        """A row for each node, table and anchor. Rows with a negative anchor are links already: node and, as s0, what stands for it."""
        import numpy as np
        import pyarrow as pa

        positions = sampled(bits, tables)
        powers = 1 << np.arange(max(LENGTH, bits), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, REPLICATED):
                part = batch.slice(at, REPLICATED)
                nodes = part.column("node").to_numpy()
                lanes = np.column_stack([part.column(s).to_numpy() for s in SKETCH])
                spread = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), -1), axis=1)
                rows, anchors = [], []
                for t, p in enumerate(positions):
                    own, met = visited(spread[:, p[:LENGTH]].astype(np.int64) @ powers[:LENGTH])
                    cells = spread[:, p[LENGTH:]].astype(np.int64) @ powers[: bits - ANCHOR_BITS]
                    rows.append(own)
                    anchors.append(met | cells[own] << ANCHOR_BITS | t << bits)
                rows, anchors = np.concatenate(rows), np.concatenate(anchors)
                order = np.argsort(anchors, kind="stable")
                sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], np.diff(anchors[order]) != 0))), len(order)))
                spare, joined = np.zeros(len(rows), bool), []
                for end, size in zip(np.cumsum(sizes)[sizes >= SAME_ANCHOR].tolist(), sizes[sizes >= SAME_ANCHOR].tolist(), strict=True):
                    own = order[end - size : end]
                    for x, y in searched(lanes[rows[own]], k):
                        spare[own[y]] = True
                        joined.append((rows[own[y]], rows[own[x]]))
                joined = np.unique(np.array(joined, np.int64).reshape(-1, 2), axis=0)
                keep = rows[~spare]
                own = lanes[np.concatenate((keep, joined[:, 0]))]
                own[len(keep) :, 0] = nodes[joined[:, 1]]
                ids = nodes[np.concatenate((keep, joined[:, 0]))]
                where = np.concatenate((anchors[~spare], -1 - np.abs(nodes[joined[:, 0]])))
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(ids), *[pa.array(own[:, i]) for i in range(LANES)]], ["anchor", "node", *SKETCH])

    def compare(batches):
        import numpy as np

        def rows():
            parent: dict[int, int] = {}

            def root(x):
                while (up := parent.setdefault(x, x)) != x:
                    parent[x] = x = parent.setdefault(up, up)
                return x

            def linked(pairs):
                for a, b in pairs:
                    a, b = int(a), int(b)
                    if (ra := root(a)) != (rb := root(b)):
                        parent[rb] = ra
                        yield min(a, b), max(a, b)

            held, most = None, HELD  # the last anchor's rows so far, as the next batch may go on with it
            for batch in itertools.chain(batches, [None]):
                if batch is None:
                    ready, held = held, None
                else:
                    lanes = np.column_stack([batch.column(s).to_numpy() for s in SKETCH]) if batch.num_rows else np.zeros((0, LANES), np.int64)
                    now = (batch.column("anchor").to_numpy(), batch.column("node").to_numpy(), lanes)
                    known = now[0] < 0
                    yield from linked(zip(now[1][known], now[2][known, 0], strict=True))
                    now = tuple(x[~known] for x in now)
                    now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
                    cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
                    ready, held = tuple(x[:cut] for x in now), tuple(x[cut:] for x in now)
                    if len(held[0]) > most:  # one of what is linked so far stands for it
                        pairs = searched(held[2], k)
                        yield from linked((held[1][x], held[1][y]) for x, y in pairs)
                        stay = np.ones(len(held[0]), bool)
                        stay[[y for _, y in pairs]] = False
                        held = tuple(x[stay] for x in held)
                        most = max(HELD, 2 * len(held[0]))
                if ready is not None and len(ready[0]):
                    yield from linked(group_links(*ready, k))

        return common.record_batches(rows(), "a long, b long", 1 << 14)

    parts = max(common.shuffle_partitions(classes.sparkSession), n * tables * 5 // 1_000_000)
    return classes.select("node", *SKETCH).mapInArrow(replicate, schema).repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def exact_links(sets, likeness: float) -> list[tuple[int, int]]:
    """Links (i, j) of positions that join all sets (sorted arrays of distinct hashes) whose Jaccard likeness reaches the threshold."""
    import numpy as np

    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")  # sets without hashes come first and are alike
    empty = int((sizes == 0).sum())
    found = [(int(order[0]), int(x)) for x in order[1:empty]]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    held = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
    own = lambda x: flat[ends[x] - sizes[x] : ends[x]]
    rest, front, rows, starts = order[empty:], [], None, None
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
            if rows is not None:
                rows, starts = rows[sizes[front[0]] :], starts[1:] - sizes[front[0]]
            continue
        x = front.pop()
        if rows is None:
            rows = np.concatenate([own(y) for y in rest])
            starts = np.cumsum(sizes[rest]) - sizes[rest]
        low, high = np.searchsorted(sizes[rest], [math.floor(likeness * sizes[x]), math.ceil(sizes[x] / likeness) + 1])
        if low == high:
            continue
        held[own(x)] = True
        part = rows[starts[low] : starts[high] if high < len(rest) else len(rows)]
        common_hashes = np.add.reduceat(held[part], starts[low:high] - starts[low], dtype=np.int64)
        held[own(x)] = False
        near = np.zeros(len(rest), bool)
        near[low:high] = common_hashes / (sizes[rest[low:high]] + sizes[x] - common_hashes) >= likeness
        if near.any():
            found += [(int(x), int(y)) for y in rest[near]]
            front += list(rest[near])
            rest, rows = rest[~near], None
    return found


def cross_links(sets, others, labels, of_others, likeness: float) -> list[tuple[int, int]]:
    """Links (i, j) from ``sets`` to ``others`` whose likeness reaches the threshold, of which one is enough for two labels."""
    import numpy as np

    sizes = np.array([len(x) for x in others], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, names = sizes[order], np.array(of_others, np.int64)[order]
    flat, place = np.unique(np.concatenate([others[i] for i in order]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held, found, joined = np.zeros(len(flat), bool), [], {}

    def root(x):
        while (up := joined.get(x, x)) != x:
            x = up
        return x

    for i, (own, label) in enumerate(zip(sets, labels, strict=True)):
        low, high = np.searchsorted(sizes, [max(1, math.floor(likeness * len(own))), math.ceil(len(own) / likeness) + 1])
        if low == high:
            continue
        at = np.searchsorted(flat, own)
        at = at[(at < len(flat)) & (flat[np.minimum(at, len(flat) - 1)] == own)]
        held[at] = True
        shared = np.add.reduceat(held[place[starts[low] : starts[high] if high < len(sizes) else len(place)]], starts[low:high] - starts[low], dtype=np.int64)
        held[at] = False
        for j in np.flatnonzero(shared / (sizes[low:high] + len(own) - shared) >= likeness) + low:
            if (a := root(label)) != (b := root(int(names[j]))):
                joined[a] = b
                found.append((i, int(order[j])))
    return found


def _read_sets(docs: DataFrame, members: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """part, block, node, hashes of the members (part, block, node, digest), from the texts."""
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).join(members, "node").select("part", "block", "node", "digest", "text")

    def read(batches):
        def rows():
            for part, block, node, digest, body in common.batch_rows(batches):
                hashes = shingle_hashes(body or "", words)
                if set_digest(hashes) == digest:  # rows that share an id may have other texts
                    yield part, block, node, hashes.tobytes()

        return common.record_batches(rows(), "part long, block int, node long, hashes binary", 512)

    return texts.mapInArrow(read, "part long, block int, node long, hashes binary")


def _searched(sets: DataFrame, likeness: float) -> DataFrame:
    """part, node, component of sets (part, block, node, hashes): exact within each block."""

    def search(batches):
        import numpy as np

        def rows():
            for (part, _), group in itertools.groupby(common.batch_rows(batches), lambda r: r[:2]):
                known = {node: np.frombuffer(hashes, np.uint64) for _, _, node, hashes in group}  # a row twice is one node
                nodes, parent = list(known), {x: x for x in known}

                def root(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for i, j in exact_links(list(known.values()), likeness):
                    a, b = sorted((root(nodes[i]), root(nodes[j])))
                    parent[b] = a
                yield from ((part, x, root(x)) for x in nodes)

        return common.record_batches(rows(), "part long, node long, component long")

    tasks = common.shuffle_partitions(sets.sparkSession)
    return sets.repartition(tasks, "part", "block").sortWithinPartitions("part", "block").select("part", "block", "node", "hashes").mapInArrow(search, "part long, node long, component long")


def _dealt(rows: DataFrame, salt: int) -> tuple[DataFrame, int]:
    """Rows (part, node, size) with the block of their part, and how many parts have more than one."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_HASHES)).cast("int")
    large = rows.groupBy("part").agg(blocks.alias("blocks")).where("blocks > 1")
    n = large.count()
    if not n:
        return rows.withColumn("block", F.lit(0)), 0
    large = F.broadcast(large) if n <= BROADCAST_PARTS else large
    block = F.pmod(F.xxhash64("node", F.lit(salt)), F.coalesce("blocks", F.lit(1))).cast("int")
    return rows.join(large, "part", "left").withColumn("block", block), n


def _across(sets: DataFrame, labels: DataFrame, few, likeness: float) -> DataFrame:
    """Links (a, b) between the components (labels: part, node, component) of parts that have several, sets outside the
    largest against all, block by block; a and b are components."""
    sizes = labels.groupBy("part", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("part").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    largest = largest.select("part", "largest", F.ceil(F.col("n") / BLOCK).cast("int").alias("every"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("minor"))
    rows = sets.select("part", "node", "hashes").join(labels.join(few(largest), "part"), ["part", "node"])
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(99)), F.col(n)).cast("int")
    minor = rows.where("component <> largest").select("part", block("minor").alias("x"), F.explode(F.sequence(F.lit(0), F.col("every") - 1)).alias("y"), F.lit(0).alias("side"), "component", "hashes")
    every = rows.select("part", F.explode(F.sequence(F.lit(0), F.col("minor") - 1)).alias("x"), block("every").alias("y"), F.lit(1).alias("side"), "component", "hashes")

    def search(batches):
        import numpy as np

        def rows():
            for _, group in itertools.groupby(common.batch_rows(batches), lambda r: r[:3]):
                sides = ([], [])
                for *_, side, component, hashes in group:
                    sides[side].append((component, np.frombuffer(hashes, np.uint64)))
                if all(sides):
                    (names, sets), (labels, others) = (zip(*s, strict=True) for s in sides)
                    yield from ((names[i], labels[j]) for i, j in cross_links(sets, others, names, labels, likeness))

        return common.record_batches(rows(), "a long, b long")

    tasks = common.shuffle_partitions(sets.sparkSession)
    return minor.union(every).repartition(tasks, "part", "x", "y").sortWithinPartitions("part", "x", "y", "side").mapInArrow(search, "a long, b long")


def alike(docs: DataFrame, classes: DataFrame, groups: DataFrame, likeness: float, key: str, text: str, words: int) -> DataFrame:
    """node, component: the least node that chains of pairs of that likeness reach within the groups (node, component)."""
    members = classes.join(groups, "node").select("node", "digest", "size", F.col("component").alias("part"))
    dealt, n_large = _dealt(members, 0)
    if not n_large:
        return _searched(_read_sets(docs, dealt, key, text, words), likeness).select("node", "component")
    sets = common.written(_read_sets(docs, dealt, key, text, words), "near-sets")
    found = common.written(_searched(sets, likeness), "near-blocks")  # of the groups of one block these are the components
    few = F.broadcast if n_large <= BROADCAST_PARTS else lambda rows: rows  # of one row a large group
    many = few(dealt.where("block > 0").select("part").distinct())
    labels, stands, before = found.join(many, "part", "left_semi"), found.join(many, "part", "left_semi").where("node = component").select("part", "node"), None
    for salt in itertools.count(1):
        rows = sets.select("part", "node", "hashes").join(stands, ["part", "node"])
        again, more = _dealt(rows.withColumn("size", F.octet_length("hashes") / 8), salt)
        level = common.written(_searched(again, likeness), "near-stands")
        up = level.select("part", F.col("node").alias("component"), F.col("component").alias("up"))
        labels = labels.join(up, ["part", "component"]).select("part", "node", F.col("up").alias("component"))
        stands = level.where("node = component").select("part", "node")
        left = stands.count()
        if not more or before is not None and left > 0.9 * before:  # one block a part, or sets that do not join
            break
        before = left
    labels = common.written(labels, "near-labels")
    across = common.written(_across(sets, labels, few, likeness), "near-across")
    if not across.isEmpty():
        joined = connected_components(across).select(F.col("node").alias("component"), F.col("component").alias("up"))
        labels = labels.join(joined, "component", "left").select("part", "node", F.coalesce("up", "component").alias("component"))
    return found.join(many, "part", "left_anti").select("node", "component").union(labels.select("node", "component"))


def near_duplicates(docs: DataFrame, likeness: float = LIKENESS, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, component_id: the least doc_id that chains of links reach, itself included. Null ids are components of their own."""
    prints = common.written(with_sketches(docs, key, text, words).where("doc_id is not null"), "sketches")
    classes = common.written(prints.groupBy("digest", *SKETCH).agg(F.min("doc_id").alias("node"), F.first("size").alias("size")), "sketch-classes")
    groups = connected_components(links(classes, likeness))
    found = common.written(alike(docs, classes, groups, likeness, key, text, words), "near-groups")
    labelled = classes.join(found, "node", "left").select("digest", *SKETCH, F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, ["digest", *SKETCH]).select("doc_id", "component_id")


def keep_first(docs: DataFrame, likeness: float = LIKENESS, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each component with its columns: that with the least doc_id, null ids last, and of rows that share it the
    first of the table's files. Rows, not ids, are linked and dropped, so a text goes only if one like it stays."""
    (own,) = common.fresh(docs.columns, "row")
    rows = common.with_number(docs, own)
    near = near_duplicates(rows, likeness, own, text, words)
    return common.first_of_components(rows, near, key, own)
