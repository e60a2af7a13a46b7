"""Operator 8: fingerprints, the covering property, and components against brute force."""

import random

import numpy as np
import xxhash

from tidemark.llm import common, components, simhash, simhash_similar


def plain_fingerprint(text, k=3):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {n: root(n) for n in nodes}


def test_fingerprint():
    for text in ["", " \t", "One", "one TWO", "a b c", "É é a b A B", "x " * 200, "a b c\x1cd e\x85f g"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_values_meet_at_an_anchor():
    rng = random.Random(1)
    for blocks in (8, 10, 14, 20, 26, 32, 40):
        lengths = simhash.block_lengths(blocks)
        assert sum(lengths) == 64 and len(lengths) == blocks and all(n % 2 for n in lengths)
        xs = [rng.getrandbits(64) for _ in range(200)]
        ys = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in xs]
        home, _, _ = simhash.anchors(xs, lengths, 2)
        _, rows, found = simhash.anchors(ys, lengths, 2)
        visited = [set(found[rows == i].tolist()) for i in range(len(ys))]
        assert all(int(home[i]) in visited[i] for i in range(len(xs)))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    both = set(pairs) | {(b, a) for a, b in pairs}
    assert found == plain_components(nodes, lambda a, b: (a, b) in both)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(300)) for _ in range(15)]
    texts = base + [b.replace(b.split()[10], "zz", 1) for b in base] + [b.upper() for b in base[:5]] + [None, "", "one", "one", "two words"]
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, fp string")
    prints = {i * 3: plain_fingerprint(t or "") for i, t in enumerate(texts)}
    wanted = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r["doc_id"]: r["component_id"] for r in rows} == wanted and all(r["fp"] % 2**64 == prints[r["doc_id"]] for r in rows)
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == sorted(set(wanted.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_no_join_is_broadcast_by_an_estimate(spark, monkeypatch):
    """24 visitors a fingerprint are sized as one, and files by their compressed bytes, so small estimates may hold large tables."""
    plans, write, names = [], common.written, ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "written", lambda df, *a, **b: plans.append(plan(df)) or write(df, *a, **b))
    before = [spark.conf.get(n, None) for n in names]
    docs = spark.createDataFrame([(i, f"one two three {i // 2}") for i in range(20)], "doc_id long, text string")
    for found in (simhash.links(spark.range(2000).selectExpr("xxhash64(id) as fp")), simhash.near_duplicates(docs)):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
        found.count()
        assert "Broadcast" not in plan(found)
    plans.clear()
    assert components.connected_components(spark.range(200).selectExpr("id as a", "id + 1 as b")).where("component = 0").count() == 201
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert [spark.conf.get(n, None) for n in names] == before


def test_alike_copies_meet_and_others_stay(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        w = words(rng.randint(150, 400))
        other = list(w)
        for _ in range(len(w) // 60):  # likeness about 0.85
            other[rng.randrange(len(w))] = "edited"
        texts += [" ".join(w), " ".join(other)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "stays"), (None, "stays")], "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash_similar.keep_first(docs).collect()]
    assert {i for i in kept if i is not None and i % 2 == 0 and i < 120} == set(range(0, 120, 2))
    assert len([i for i in kept if i is not None and i < 120 and i % 2]) <= 3
    assert 500 in kept and 501 not in kept and kept.count(None) == 1  # rows without an id are compared too
    assert simhash_similar.keep_first(docs.limit(0)).count() == 0


def test_large_anchors_are_searched_like_small_ones():
    rng = np.random.default_rng(5)
    centre = rng.integers(-(2**63), 2**63 - 1, (6, 4))
    rows = centre[rng.integers(0, 6, 130)].copy()
    rows[:, 0] ^= 1 << rng.integers(0, 62, 130)
    keys, ids = np.zeros(130, np.int64), np.arange(130)
    found = simhash_similar.group_links(keys, ids, rows, 8)
    assert len(found) == 130 - len({tuple(c[1:]) for c in rows.tolist()})


def shared_start(rng, size, tail):
    """Two texts of ``size`` five-word shingles each that differ in the last ``tail``: of likeness (size - tail) / (size + tail)."""
    words = [f"w{rng.getrandbits(40)}" for _ in range(size + 4 + tail)]
    return " ".join(words[: size + 4]), " ".join(words[: size + 4 - tail] + words[size + 4 :])


def plain_alike(a, b, likeness=0.8, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) >= likeness * len(x | y) - 1e-9


def test_pairs_below_the_likeness_are_not_linked(spark):
    rng = random.Random(6)
    texts = [t for tail in range(20, 70) for t in shared_start(rng, 270, tail)]  # likeness 0.59 to 0.86; 0.8 at a tail of 30
    chain = [f"c{rng.getrandbits(40)}" for _ in range(274 + 5 * 35)]
    texts += [" ".join(chain[35 * i : 35 * i + 274]) for i in range(6)]  # each is 0.77 like the next
    wanted = plain_components(range(len(texts)), lambda a, b: plain_alike(texts[a], texts[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash_similar.near_duplicates(docs).collect()}
    assert [i for i in wanted if found[i] != i and wanted[i] != found[i]] == []
    assert sum(wanted[i] != found[i] for i in wanted) <= 2


def test_exact_links_against_all_pairs():
    rng = np.random.default_rng(8)
    for most in (6, 40):
        base = [rng.choice(2**40, most, replace=False) for _ in range(4)]
        sets = [np.unique(np.concatenate([rng.choice(b, rng.integers(most // 2, most + 1), replace=False), rng.choice(2**40, rng.integers(0, 3))])).astype(np.uint64) for b in base for _ in range(30)]
        sets += [np.array([], np.uint64)] * 3
        like = lambda a, b: len({*sets[a].tolist()} & {*sets[b].tolist()}) / max(1, len({*sets[a].tolist()} | {*sets[b].tolist()})) >= 0.8 or not len(sets[a]) + len(sets[b])
        found = simhash_similar.exact_links(sets, 0.8)
        nodes = list(range(len(sets)))
        pairs = {*found, *((b, a) for a, b in found)}
        assert plain_components(nodes, lambda a, b: (a, b) in pairs) == plain_components(nodes, like)
        assert all(like(a, b) for a, b in found) and len(found) < len(sets)


def test_isolated_pairs_at_the_likeness_are_linked(spark):
    rng = random.Random(9)
    texts = [t for _ in range(200) for t in shared_start(rng, 270, 30)]  # likeness 0.8
    assert all(plain_alike(*texts[i : i + 2]) for i in range(0, 400, 2))
    near = simhash_similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert near.where("component_id <> doc_id").count() >= 194  # expected 198
    for n in (1000, 1_000_000, 100_000_000):
        assert simhash_similar.recall(*simhash_similar.tables_for(n, 0.8), 0.8) >= 0.99


def wandering(rng, n, size=120, edits=6):
    """Texts of which each is an edited copy of an earlier one: a group of chains, of which some reach the likeness."""
    texts = [[f"v{rng.getrandbits(40)}" for _ in range(size)]]
    while len(texts) < n:
        words = list(rng.choice(texts[-8:]))
        for _ in range(rng.randint(1, edits)):
            words[rng.randrange(size)] = f"v{rng.getrandbits(40)}"
        texts.append(words)
    return [" ".join(w) for w in texts]


def test_groups_that_no_task_may_hold(spark, monkeypatch):
    """Blocks, what stands for them, and links across, against all pairs; anchors are joined before the shuffle and after."""
    for name, value in {"BLOCK": 6, "SAME_ANCHOR": 4, "HELD": 12, "BROADCAST_PARTS": 1}.items():
        monkeypatch.setattr(simhash_similar, name, value)
    rng = random.Random(12)
    texts = [t for _ in range(4) for t in wandering(rng, 60)] + [" ".join(f"x{rng.getrandbits(40)}" for _ in range(90)) for _ in range(30)]
    texts += [texts[i] for i in range(0, 60, 3)]
    rng.shuffle(texts)
    wanted = plain_components(range(len(texts)), lambda a, b: plain_alike(texts[a], texts[b]))
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    rows = simhash_similar.near_duplicates(docs).collect()
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(texts) + 1 and len(set(wanted.values())) > 40
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    together = [(found[a] == found[b], wanted[a] == wanted[b]) for a, b in pairs]
    assert (True, False) not in together
    assert together.count((False, True)) <= 0.02 * together.count((True, True))


def test_a_large_group_of_near_copies_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(simhash_similar, "BLOCK", 32)
    rng = random.Random(13)
    words = [f"v{rng.getrandbits(40)}" for _ in range(200)]
    texts = [" ".join(words[: i % 200] + [f"e{i}"] + words[i % 200 + 1 :]) for i in range(600)] + [" ".join(f"x{rng.getrandbits(40)}" for _ in range(90)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash_similar.near_duplicates(docs).collect()}
    assert found == {i: 0 if i < 600 else i for i in range(620)}
    names = ["__gone", "gone", "node", "part", "x y"]
    more = docs.selectExpr("*", *[f"'a' as `{n}`" for n in names])
    kept = simhash_similar.keep_first(more)
    assert kept.columns == more.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, *range(600, 620)]


def test_rows_that_share_an_id_go_by_row(spark):
    """A text goes only if one like it stays, whatever ids repeat; rows without an id take part, and of an id's rows the first stays."""
    words = lambda seed: " ".join(f"{seed}{i}" for i in range(80))
    a, b = words("a"), words("b")
    rows = [(3, a), (5, a), (5, b), (7, words("c")), (None, b), (None, words("d")), (None, words("d")), (9, words("c"))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, __row int").repartition(3)
    for keep in (simhash.keep_first, simhash_similar.keep_first):
        kept = keep(docs).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, a), (5, b), (7, words("c")), (None, words("d"))], key=str)
        assert kept[0].asDict().keys() == {"doc_id", "text", "__row"}


def test_anchors_cover():
    """Every word has one home within the code's radius and visits all anchors up to the threshold; words that differ in two bits meet."""
    import itertools
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    code = np.flatnonzero(simhash_similar.syndromes(np.arange(1 << 23)) == 0)
    assert len(code) == 4096 and len(np.unique(code >> 11)) == 4096 and np.bitwise_count(code[1:]).min() == 7
    words = rng.integers(0, 1 << 23, 300)
    rows, met = simhash_similar.visited(words)
    apart = np.bitwise_count(words[:, None] ^ code)
    assert ((apart <= 3).sum(axis=1) == 1).all()
    wanted = {(int(i), int(code[j]) >> 11) for i, j in zip(*np.nonzero(apart <= 4), strict=True)}
    assert len(rows) == len(wanted) and set(zip(rows.tolist(), met.tolist(), strict=True)) == wanted
    own = [set(met[rows == i].tolist()) for i in range(40)]
    for i, flips in itertools.product(range(40), ((0,), (3, 17), (21, 22))):
        assert own[i] & set(simhash_similar.visited(words[i : i + 1] ^ sum(1 << f for f in flips))[1].tolist())
    for w, chance in enumerate(simhash_similar.MEET):
        a = rng.integers(0, 1 << 23, 3000)
        b = a ^ np.array([sum(1 << int(i) for i in rng.choice(23, w, replace=False)) for _ in a], np.int64)
        near = lambda x: {(int(i), int(c)) for i, c in zip(*simhash_similar.visited(x), strict=True)}
        share = len({i for i, _ in near(a) & near(b)}) / len(a)
        assert abs(share - chance) <= 4 * math.sqrt(chance * (1 - chance) / len(a))
