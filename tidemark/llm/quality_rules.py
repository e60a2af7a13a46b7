"""Operator 2: rule-based quality with verdicts on whole hosts. Native: DataFrame functions only.

Base rules fail a document that has few words or repeats itself. The failures of each host are counted, and its
failure rate is shrunk by a beta prior whose two parameters are fitted to all hosts by moments. The cut follows from the
prior: ``host_odds`` times the odds of its mean. A host is rejected, and with it all of its documents, when its posterior
rate is above the cut with the certainty that ``SURE`` standard deviations give; few documents are not enough.

Odd inputs: a null or empty text has no words and fails; documents without a host (null) get no host verdict;
repeated rows are judged and kept each on its own; an empty table gives an empty result; other columns pass through,
whatever their names (of ``judged``, those that are called as one of ``OUTPUTS`` give way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WINDOW = 3
SYMBOLS = r"[#*$%&|<>]"
#: How many times the odds of the mean failure rate a host's may have, and by how many posterior standard deviations it must exceed them.
HOST_ODDS, SURE = 8.0, 1.645
#: What ``judged`` adds: the base measures (a struct), whether they fail, the host's shrunk rate, its lower bound, the verdict.
OUTPUTS = ("rules", "base_failed", "host_rate", "host_least", "kept")
#: Hosts whose rates are broadcast at most; beyond, the join deals documents by host and adaptive execution splits large hosts.
BROADCAST_HOSTS = 100_000
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1e6)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, rf"{common.SPACE_CLASS}+", -1), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    """Hash of each run of three words; 64 bits tell the runs of one text apart."""
    return F.when(
        F.size(words) >= WINDOW,
        let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))),
    ).otherwise(F.array().cast("array<bigint>"))


def words_in_repeats(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more. Sorts the windows, so it takes n log n for n words."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.sort_array(places), start, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])

    def repeated(s: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(s, k)["h"] == p["h"], F.lit(False))
        return F.transform(F.filter(s, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: covered(repeated(s))))


def with_rules(docs: DataFrame, name: str, failed: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct of the base measures, ``name``, and ``failed``."""
    others = docs.columns
    body, split, windows = common.fresh([*others, name, failed], "body", "words", "windows")
    docs = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    docs = docs.withColumn(split, word_list(F.col(body)))
    docs = docs.withColumn(windows, window_hashes(F.col(split)))
    whole, words = F.col(body), F.col(split)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    measures = F.struct(
        F.size(words).cast("long").alias("n_words"),
        (F.char_length(whole) - F.regexp_count(whole, F.lit(common.SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        words_in_repeats(F.col(windows)).alias("n_repeat_words"),
    )
    docs = docs.select(*common.columns(others), measures.alias(name))
    m = F.col(name)
    return docs.withColumn(failed, (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]))


def host_rates(judged: DataFrame, host: str, failed: str, host_odds: float = HOST_ODDS) -> tuple[DataFrame, int, float]:
    """(host, documents n, failures k, shrunk rate, its lower bound; number of hosts; the cut). The prior's four sums over all
    hosts are one row, read by the driver."""
    hosts = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("k"))
    totals = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("hosts"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    alpha, beta = beta_prior(totals["n"] or 0, totals["k"] or 0, totals["hosts"], totals["kk"] or 0.0)
    rate = (F.col("k") + alpha) / (F.col("n") + alpha + beta)
    rates = hosts.select("host", "n", "k", rate.alias("rate"))
    rates = rates.withColumn("least", F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + alpha + beta + 1)))
    return rates, totals["hosts"], rate_cut(alpha, beta, host_odds)


def beta_prior(n: int, k: int, hosts: int, kk: float) -> tuple[float, float]:
    """Parameters by moments; kk is the sum of k * k / n over the hosts."""
    if not n:
        return 0.5, 0.5
    mean = k / n
    # variance of the hosts' rates about the mean, less what drawing n documents a host gives
    spread = kk / n - mean * mean - mean * (1 - mean) * hosts / n
    weight = min(max(mean * (1 - mean) / max(spread, 1e-12) - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    return mean * weight, (1 - mean) * weight


def rate_cut(alpha: float, beta: float, host_odds: float = HOST_ODDS) -> float:
    """The rate whose odds are ``host_odds`` times those of the prior's mean, alpha to beta."""
    return host_odds * alpha / (host_odds * alpha + beta)


def _judged(docs: DataFrame, host: str, text: str, host_odds: float, carry: list[str], names: list[str]) -> DataFrame:
    """Columns ``carry`` and, called ``names``, what OUTPUTS says."""
    rules, failed, rate, least, kept = names
    (own,) = common.fresh([*docs.columns, *names], "host")
    base = with_rules(docs.withColumn(own, F.col(host)), rules, failed, text)
    base = common.written(base.select(*common.columns(carry), own, rules, failed), "rules")
    rates, n_hosts, cut = host_rates(base, own, failed, host_odds)
    rates = rates.select(F.col("host").alias(own), F.col("rate").alias(rate), F.col("least").alias(least))
    rates = F.broadcast(rates) if n_hosts <= BROADCAST_HOSTS else rates
    return base.join(rates, own, "left").withColumn(kept, ~F.col(failed) & (F.coalesce(F.col(least), F.lit(0.0)) <= cut)).drop(own)


def judged(docs: DataFrame, host: str = "source", text: str = "text", host_odds: float = HOST_ODDS, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all by default) with ``OUTPUTS``.

    The measures are computed once and written to the shared folder. Hosts join back on their key: their rates are
    broadcast if there are no more than ``BROADCAST_HOSTS``, so that documents need not be dealt by host.
    """
    carry = docs.columns if carry is None else carry
    names = common.fresh(docs.columns, *OUTPUTS)
    found = _judged(docs, host, text, host_odds, [c for c in carry if c not in OUTPUTS], names)
    return found.withColumnsRenamed(dict(zip(names, OUTPUTS, strict=True)))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", host_odds: float = HOST_ODDS) -> DataFrame:
    """The documents that pass, with their columns."""
    names = common.fresh(docs.columns, *OUTPUTS)
    return _judged(docs, host, text, host_odds, docs.columns, names).where(F.col(names[-1])).select(*common.columns(docs.columns))
