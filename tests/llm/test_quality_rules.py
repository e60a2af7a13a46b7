"""Operator 2 against a plain Python reading of its contract, and the host verdicts."""

import re
from collections import Counter

import pytest

from tidemark.llm import quality_rules

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "one", "a b c", "a b c a b c", "a b c d a b c", "x x x x x x", "w\n\nw\nv v\n w\nw", "\t\n\x0b\x0c\r ", "é ü ##$ a|b <c>", "word " * 60, " ".join(f"w{i}" for i in range(80)),
    "a b c d e " * 20, "l1 l2 l3\nl1 l2 l3\nq", "p q r s p q r " + " ".join(map(str, range(60))),
]


def plain(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, None if i % 3 else "h", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_words string")
    for row in quality_rules.judged(docs).collect():
        r = row["rules"]
        assert (*[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], row["base_failed"]) == plain(TEXTS[row["doc_id"]])


@pytest.mark.parametrize("broadcast", [0, 100])
def test_hosts_are_shrunk_and_join_back(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", broadcast)
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [("awful", bad)] * 40 + [("awful", good)] + [(f"h{i}", good) for i in range(30) for _ in range(10)] + [("tiny", bad), (None, good), (None, bad)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    found = quality_rules.judged(docs).collect()
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert not kept[40], "a good document of a rejected host goes"
    assert all(kept[i] for i in range(41, 341)) and kept[342] and not kept[343]
    rate = {r["source"]: r["host_rate"] for r in found}
    assert 0.8 < rate["awful"] < 40 / 41 and rate["tiny"] < 1 and rate[None] is None
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs.limit(0)).count() == 0
    whole = {r["doc_id"] for r in quality_rules.keep_good(docs, host_odds=1e9).collect()}
    assert whole - {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {40}


def test_a_small_host_is_not_judged_by_its_rate_alone(spark):
    """Both hosts fail wholly; one has too few documents to be sure."""
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [("many", bad)] * 30 + [("few", bad)] + [(f"h{i}", good if j else bad) for i in range(20) for j in range(10)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    judged = quality_rules.judged(docs)
    hosts = {r["source"]: r for r in judged.select("source", "host_rate", "host_least").distinct().collect()}
    rates, _, cut = quality_rules.host_rates(judged, "source", "base_failed")
    assert hosts["many"]["host_least"] > cut > hosts["few"]["host_least"] and hosts["many"]["host_least"] < hosts["many"]["host_rate"]


def test_names_that_clash(spark):
    names = ["__rules", "__host", "__body", "__words", "__windows", "__kept", "kept", "rules", "base_failed", "__base_failed", "host_rate", "host", "Text_", "a b.c"]
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "h", *names), (2, "short", "h", *names)], ["doc_id", "text", "source", *names])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.collect() == docs.where("doc_id = 1").collect()
    found = quality_rules.judged(docs)
    assert [r["kept"] for r in found.orderBy("doc_id").collect()] == [True, False] and found.where("`a b.c` = 'a b.c'").count() == 2


@pytest.mark.parametrize("sums", [(0, 0, 0, 0.0), (10, 0, 3, 0.0), (10, 10, 2, 10.0), (100, 20, 5, 12.0)])
def test_prior_is_finite(sums):
    a, b = quality_rules.beta_prior(*sums)
    assert a >= 0 and b >= 0 and a + b > 0
