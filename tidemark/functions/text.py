"""Headline classifiers and text functions. All are Column expressions and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns must be these for results to agree. Four of them look alike and differ on purpose.
ADMIN_NOISE = (
    r"change of (registered office|address|registry|share registry)"
    r"|constitution"
    r"|notice of (annual general meeting|meeting|agm)"
    r"|proxy form"
    r"|results of (annual general )?meeting"
    r"|cleansing (notice|statement)"
    r"|section 708A?"
    r"|corporate governance statement"
    r"|change of (company )?secretary"
)
RESULTS_CRAWL = (
    r"appendix\s*4[cde]|half[\s-]*year|full[\s-]*year|annual\s+report"
    r"|preliminary final|results (announcement|presentation|release)"
    r"|\bFY\d{2}.{0,12}results|results for announcement"
)
RESULTS_EXTRACTION = (
    r"appendix\s*4[cde]|half[\s-]*year|full[\s-]*year|annual\s+report"
    r"|preliminary final|results (announcement|presentation|release)"
    r"|results for announcement"
)
RESULTS_MANUAL = r"appendix\s*4[de]|half[\s-]*year|full[\s-]*year|annual\s+report|results"
FALSE_RESULTS = r"results of (annual general )?meeting|resignation of auditor"
FALSE_RESULTS_TRADING = r"results of (annual general )?meeting"
APPOINTMENT = (
    r"appendix\s*3[xz]|appointment of|resignation of (a )?director"
    r"|(initial|final) director.s interest|ceases (as|to be) (a )?director"
    r"|(managing director|ceo|chief executive|chairman|director) "
    r"(appointment|succession|transition|retirement)"
)
DIRECTOR_INTEREST = r"appendix\s*3y|change in director|director.s interest|directors interest"
GUIDANCE = (
    r"guidance|trading update|market update|profit warning|earnings update"
    r"|trading performance|outlook (update|statement)"
    r"|(upgrade|downgrade)s? (to )?(fy|hy|earnings|profit|guidance)"
    r"|business update|operational update"
)
DEMO_KEYWORDS = ("appendix 3y", "change in director", "director's interest", "directors interest")
NO_REVENUE_TICKERS = ("ANZ", "CBA", "NAB", "WBC", "MQG", "BEN", "BOQ", "QBE", "IAG", "SUN", "AMP", "MFG", "PPT", "CPU", "IFL", "HUB", "NWL", "PDL")
# End of fixed values.


def matches(text: Column, pattern: str) -> Column:
    """Does ``text`` contain the pattern, letters of either case."""
    return text.rlike(f"(?i){pattern}")


def is_director_interest(headline: Column, flagged: Column | None = None) -> Column:
    return matches(headline, DIRECTOR_INTEREST)


def is_broad(headline: Column, flagged: Column | None = None) -> Column:
    return ~matches(headline, ADMIN_NOISE)


def is_priority(headline: Column, flagged: Column) -> Column:
    """A flagged result, or an appointment, but never a look-alike."""
    return F.when(matches(headline, FALSE_RESULTS), False).when(flagged & matches(headline, RESULTS_CRAWL), True).otherwise(matches(headline, APPOINTMENT))


def is_guidance(headline: Column, flagged: Column | None = None) -> Column:
    return matches(headline, GUIDANCE)


def is_earnings(headline: Column, flagged: Column) -> Column:
    return flagged & matches(headline, RESULTS_MANUAL)


def is_results_extraction(headline: Column, flagged: Column) -> Column:
    return flagged & matches(headline, RESULTS_EXTRACTION) & ~matches(headline, FALSE_RESULTS)


def is_results_trading(headline: Column, flagged: Column) -> Column:
    return flagged & matches(headline, RESULTS_EXTRACTION) & ~matches(headline, FALSE_RESULTS_TRADING)


def is_appointment(headline: Column, flagged: Column | None = None) -> Column:
    return matches(headline, APPOINTMENT)


def has_keyword(text: Column, keywords=DEMO_KEYWORDS) -> Column:
    """Any of the literal keywords, in lower case."""
    low, found = F.lower(text), F.lit(False)
    for keyword in keywords:
        found = found | low.contains(keyword)
    return found


#: Candidate filters by name, each (headline, price-sensitive flag) -> boolean Column.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "3y": is_director_interest, "broad": is_broad, "p0": is_priority, "guidance": is_guidance, "earnings": is_earnings,
    "results_extraction": is_results_extraction, "results_trading": is_results_trading, "appointment": is_appointment,
}


#: White space as the source has it: Unicode's, and four control characters. Runs that are not a single space already.
_SPACE = r"\s\x1c-\x1f"
_RUNS = rf"(?: [{_SPACE}]+|[{_SPACE}&&[^ ]][{_SPACE}]*)"
#: Found in ASCII texts where there is something to collapse; most short ones are spared the dearer replacing.
_TO_COLLAPSE = r"[\t-\r\x1c-\x1f]|  "


def collapse_space(text: Column) -> Column:
    """Runs of white space, Unicode's included, as one space."""
    return F.regexp_replace(text, f"(?U){_RUNS}", " ")


def folded(text: Column) -> Column:
    """Full case folding for comparisons: upper and then lower case brings what folds together to one form (a sharp s to
    two), but for a dotless i, which must not become a dotted one, and a final sigma. Cherokee comes out in lower case."""
    put = lambda text, old, new: F.replace(text, F.lit(old), F.lit(new))
    upper = F.upper(put(put(put(text, "\u0131", "\ue000"), "\u1e9e", "ss"), "\u0130", "i\u0307"))
    # what stands between keeps the optimizer from taking lower(upper(x)) for lower(x)
    return put(F.lower(put(upper, "\ue000", "\u0131")), "\u03c2", "\u03c3")


def normalize(text: Column) -> Column:
    """For comparison: white space collapsed, ends stripped, case folded. Plain ASCII takes a shorter way to the same."""
    plain = F.lower(F.trim(F.when(F.rlike(text, F.lit(_TO_COLLAPSE)), F.regexp_replace(text, _RUNS, " ")).otherwise(text)))
    return F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(folded(F.trim(collapse_space(text))))


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at the ends."""
    return F.regexp_replace(text, f"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def marked_pages(pages: Column) -> Column:
    """Pages as one text, each headed by its number from 1, a blank line between."""
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("[page "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def quote_audit(quote: Column, page: Column, pages: Column) -> Column:
    """OK, MISSING (on no page) or WRONG PAGE (not on the page it names), white space collapsed on both sides."""
    wanted = collapse_space(quote)
    on = lambda p: F.contains(collapse_space(p), wanted)
    named = F.when(page >= 1, F.try_element_at(pages, page.cast("int")))
    return F.when(~F.exists(pages, on), "MISSING").when(F.coalesce(on(named), F.lit(False)), "OK").otherwise("WRONG PAGE")


def page_statistics(pages: Column, blank_below: int = 20) -> Column:
    """Struct of page_count, empty_page_count (fewer than ``blank_below`` characters once stripped), total_chars and quality."""
    empty = F.size(F.filter(pages, lambda p: F.char_length(strip(p)) < blank_below))
    total = F.aggregate(pages, F.lit(0).cast("long"), lambda a, p: a + F.char_length(p))
    quality = F.when(empty == F.size(pages), "empty").when(empty > 0, "partial").otherwise("good")
    return F.struct(F.size(pages).cast("long").alias("page_count"), empty.cast("long").alias("empty_page_count"), total.alias("total_chars"), quality.alias("quality"))


def lexicon_density(text: Column, words: list[str]) -> Column:
    """Occurrences of any of the words per word of the text."""
    pattern = r"(?i)\b(" + "|".join(words) + r")\b"
    return F.try_divide(F.regexp_count(text, F.lit(pattern)), F.size(F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0))))


def items_within(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item: str) -> DataFrame:
    """key, item_key for each document whose text holds the whole item. The items' inner words (all but the first and last,
    three at most) stand whole in any text that holds the item, so documents meet items on their hashes; the texts are read
    again for what meets. Items of fewer than three words have no inner word and are tried on every document."""
    words = lambda c: F.split(c, r"\s+", -1)
    gram = lambda n: lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(n)])
    inner = F.least(F.size(words(F.col(item))) - 2, F.lit(3))
    items = items.select(F.col(item_key).alias("__item_key"), F.col(item).alias("__item"), F.greatest(inner, F.lit(0)).alias("__n"))
    documents = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    sizes = sorted(r[0] for r in items.where("__item is not null").select("__n").distinct().collect())  # 0 to 3
    found = documents.join(items.where("__n = 0"), F.contains("__text", "__item")).select("__key", "__item_key") if 0 in sizes else None
    for n in (n for n in sizes if n):
        own = items.where(F.col("__n") == n).withColumn("__words", words(F.col("__item"))).select("__item_key", "__item", gram(n)(F.lit(1)).alias("__gram"))
        starts = F.sequence(F.lit(0), F.size("__words") - n)
        grams = documents.select("__key", words(F.col("__text")).alias("__words")).where(F.size("__words") >= n)
        grams = grams.select("__key", F.explode(F.array_distinct(F.transform(starts, gram(n)))).alias("__gram"))
        met = grams.join(own, "__gram").select("__key", "__item_key", "__item")
        whole = documents.join(met, "__key").where(F.contains("__text", "__item")).select("__key", "__item_key")
        found = whole if found is None else found.union(whole)
    if found is None:
        found = documents.join(items, F.lit(False)).select("__key", "__item_key")
    return found.select(F.col("__key").alias(key), F.col("__item_key").alias(item_key))
