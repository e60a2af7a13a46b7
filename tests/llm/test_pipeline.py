"""The corpus pipeline: each stage's decisions take effect, and the columns stay."""

import random

import corpus_pipeline


def test_stages(spark):
    rng = random.Random(1)
    prose = lambda n=90: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    rows = [(i, prose() + "\n" + prose(40) + ("\nshared line" if i < 12 else ""), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s0", 0), (101, rows[3][1].replace("\n", " edited\n", 1), "en", "s0", 0)]
    rows += [(200, "short", "en", "s1", 0), (201, None, None, None, None), (202, prose() + " mail a@b.co", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "pii", "packing"]
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "")
        assert made.columns == docs.columns
        docs = spark.createDataFrame(made.collect(), docs.schema)
        seen.append({r["doc_id"]: r for r in docs.collect()})
    rules, lines, near, masked = seen
    assert set(rules) == {*range(40), 100, 101, 202}
    assert all("shared line" not in r["text"] and r["n_chars"] == len(r["text"]) for r in lines.values()) and set(lines) == set(rules)
    assert set(near) == {*range(40), 202}
    assert masked[202]["text"].endswith("[EMAIL]") and masked[5]["text"] == near[5]["text"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(near)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        assert made.count() == 0


def test_run_against_brute_force(spark, tmp_path):
    """The whole pipeline, written and read between stages, against plain Python on the same rows."""
    import zlib

    import numpy as np
    from public_tokenizers import path as vocabulary_path
    from test_line_dedup import plain as plain_lines
    from test_pii import plain as plain_pii
    from test_quality_rules import plain as plain_rules
    from tokenizers import Tokenizer

    from tidemark.llm import packing, quality_rules

    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    texts = [prose(rng.randint(60, 250)) + rng.choice(["", "\nBoiler plate", "\n" + prose(20) + "\n boiler PLATE "]) for _ in range(60)]
    texts += [texts[i] + " tail" for i in range(5)] + [texts[6]] * 3 + ["bad"] * 60 + [prose(99) + f" write a{i}@b.co now +1 (423) 555-73{i:02d}." for i in range(12)] + [None, ""]
    hosts = [f"h{i % 6}" if t != "bad" else rng.choice(["junk"] * 9 + ["h1"]) for i, t in enumerate(texts)]
    hosts[10], hosts[20] = "junk", "junk"  # good documents of a host to be rejected
    rows = [(i, t, "en", h, 0) for i, (t, h) in enumerate(zip(texts, hosts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    failed = {i: plain_rules(t)[-1] for i, t, *_ in rows}
    counts = {}
    for i, _, _, h, _ in rows:
        n, k = counts.get(h, (0, 0))
        counts[h] = n + 1, k + failed[i]
    a, b = quality_rules.beta_prior(len(rows), sum(failed.values()), len(counts), sum(k * k / n for n, k in counts.values()))
    cut, rates = 8 * a / (8 * a + b), {h: ((k + a) / (n + a + b), n + a + b + 1) for h, (n, k) in counts.items()}
    rejected = {h for h, (r, n) in rates.items() if r - 1.645 * (r * (1 - r) / n) ** 0.5 > cut}
    assert rejected == {"junk"}
    kept = [(i, t) for i, t, _, h, _ in rows if not failed[i] and h not in rejected]
    cleaned = list(zip([i for i, _ in kept], plain_lines([t for _, t in kept], 10), strict=True))
    left = []
    for i, t in cleaned:
        words = t.lower().split()
        shingles = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        if all(len(shingles & s) / len(shingles | s) < 0.8 for _, _, s in left):
            left.append((i, t, shingles))
    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    wanted = []
    for i, t, _ in left:
        at, out = 0, ""
        for kind, start, end in sorted(plain_pii(t), key=lambda s: s[1]):
            out, at = f"{out}{t[at:start]}[{kind.upper()}]", end
        ids = np.array(tokenizer.encode(out + t[at:], add_special_tokens=False).ids + [0], "<u4")
        wanted += [(i, start, n, zlib.crc32(ids[start : start + n].tobytes())) for start, n in packing.cut(len(ids), 2048)]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(wanted)
    assert corpus_pipeline.ORACLE_SQL is None
