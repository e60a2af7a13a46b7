"""Operator 10: neighbours, edits, equality, and how near the estimate comes to the true likeness."""

import hashlib
import random

import pytest

from tidemark.llm import fingerprints as fp


def shingles(text):
    words = text.encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_rows_against_plain(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "é" * 9, "same text here", "same text here", "x " * 30_000]
    ids = rng.sample(range(-500, 5000), len(texts))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fingerprint string").repartition(5)
    found = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    order = sorted(zip(ids, texts, strict=True))
    assert len(found) == len(texts)
    hashes = fp.WordHashes()
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        row = found[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["fingerprint"] == fp.fingerprint(text, hashes) and row["edited_fingerprint"] == fp.fingerprint(changed, hashes)
        assert row["near_edited"] == fp.likeness(row["fingerprint"], row["edited_fingerprint"])
        assert row["near_next"] == fp.likeness(row["fingerprint"], fp.fingerprint(after, hashes))


def plain_fingerprint(text):
    """Bins, densification, stored bits and likeness by plain integers, one shingle and one bin at a time."""
    import xxhash

    whole = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 31) * 0x9E3779B97F4A7C15) & whole
        x = ((x ^ x >> 29) * 0xD6E8FEB86659FD93) & whole
        return x ^ x >> 32

    words = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().lower().split()]
    if not words:
        return ""
    width, bins = min(5, len(words)), {}
    for at in range(len(words) - width + 1):
        h = 0
        for i in range(width):
            h = (h * 0x100000001B3 + mix((words[at + i] + i) & whole)) & whole
        h = mix((h + width) & whole)
        bins[h >> 56] = min(bins.get(h >> 56, whole), h)
    out = []
    for b in range(256):
        source, attempt = b, 0
        while source not in bins:
            source = mix(attempt * 256 + b + 1) >> 56
            attempt += 1
        out.append(bins[source] & 255)
    return bytes(out).hex()


def test_fingerprint_against_plain():
    rng, hashes = random.Random(8), fp.WordHashes()
    texts = ["", " \t", "one", "a b c d e", "A b c d e f"] + [" ".join(f"w{rng.randint(0, 900)}" for _ in range(rng.choice([2, 6, 40, 300, 3000]))) for _ in range(40)]
    for text in texts:
        assert fp.fingerprint(text, hashes) == plain_fingerprint(text)
    for a, b in zip(texts[5:], texts[6:], strict=False):
        x, y = (bytes.fromhex(plain_fingerprint(t)) for t in (a, b))
        share = sum(p == q for p, q in zip(x, y, strict=True)) / 256
        assert fp.likeness(x.hex(), y.hex()) == pytest.approx(max(0.0, (share - 1 / 256) / (255 / 256)))


def test_hot_and_null_ids_are_split(spark):
    """A third of the rows each share one id and have none; every part stays small, and neighbours go on across parts."""
    rows = [(7, f"hot {i} a b c d") for i in range(400)] + [(None, f"none {i} a b c d") for i in range(400)] + [(i + 100, f"text {i} e f g h") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        dealt, parts = fp.neighbours(docs)
        sizes = [r["count"] for r in dealt.where("not ahead").groupBy("part").count().collect()]
        found = fp.fingerprints(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 8 and max(sizes) < 250 and sum(sizes) == 1200
    hashed = {r["tie"]: t for (_, t), r in zip(rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(text) as tie").collect(), strict=True)}
    ties = {t: k for k, t in hashed.items()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    wanted = sorted(hashlib.sha256(fp.edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in found) == wanted


def test_odd_tables(spark):
    one = spark.createDataFrame([(4, "a lone document of eight words in all")], "doc_id long, text string")
    assert [r["near_next"] for r in fp.fingerprints(one).collect()] == [1.0]
    assert fp.fingerprints(one.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "p q r s t"), (1, "a"), (1, "a"), (1, "b c"), (2, "d")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in fp.fingerprints(rows).collect()) == ["1", "1", "1", "2", "None"]


@pytest.mark.parametrize("size", [12, 60, 400, 3000])
def test_estimates(size):
    rng, hashes, errors = random.Random(size), fp.WordHashes(), []
    for _ in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
        other = words[: int(size * rng.uniform(0.3, 1))] + [f"v{rng.randint(0, 5000)}" for _ in range(int(size * 0.2))]
        a, b = " ".join(words), " ".join(other)
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        errors.append(fp.likeness(fp.fingerprint(a, hashes), fp.fingerprint(b, hashes)) - true)
    assert abs(sum(errors) / 60) < 0.03 and (sum(e * e for e in errors) / 60) ** 0.5 < (0.06 if size >= 60 else 0.12)


def test_equal_and_unlike():
    hashes = fp.WordHashes(most=3)  # starts anew all the time
    assert fp.fingerprint("A b c d e f", hashes) == fp.fingerprint("a  B c\nd e f", hashes)
    assert fp.fingerprint(" \n", hashes) == fp.EMPTY and fp.likeness("", "") == 1.0
    a, b = (fp.fingerprint(" ".join(f"{p}{i}" for i in range(500)), hashes) for p in "xy")
    assert fp.likeness(a, b) < 0.05 and fp.likeness(a, "") == 0.0 and len(a) == 512
