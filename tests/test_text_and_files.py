"""Classifiers, page functions, readers, writers and streams on small inputs."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, udfs
from tidemark.plans.files import scratch
from tidemark.sources import http, readers, schemas, sinks
from tidemark.streaming import streams

HEADLINES = [
    ("Appendix 3Y", True, {"3y", "broad"}), ("Change of Director's Interest Notice", False, {"3y", "broad"}), ("Appendix 4E and Annual Report", True, {"broad", "p0", "earnings", "results_extraction", "results_trading"}),
    ("Appendix 4E and Annual Report", False, {"broad"}), ("FY24 audited results", True, {"broad", "p0", "earnings"}), ("Results of Annual General Meeting", True, {"earnings"}),
    ("Resignation of Auditor - results presentation", True, {"broad", "earnings", "results_trading"}), ("Appointment of CEO", False, {"broad", "p0", "appointment"}), ("Trading Update", False, {"broad", "guidance"}),
    ("Notice of Annual General Meeting/Proxy Form", False, set()), ("Downgrades to FY guidance", False, {"broad", "guidance"}), ("Final Director's Interest Notice", False, {"3y", "broad", "p0", "appointment"}),
]


def test_classifiers(spark):
    rows = spark.createDataFrame([(i, h, f) for i, (h, f, _) in enumerate(HEADLINES)], "i int, headline string, flag boolean")
    marks = rows.select("i", *[keep(F.col("headline"), F.col("flag")).alias(name) for name, keep in text.FILTERS.items()]).collect()
    for row in marks:
        assert {n for n in text.FILTERS if row[n]} == HEADLINES[row["i"]][2], HEADLINES[row["i"]]


def test_normalize_takes_unicode_space(spark):
    rows = spark.createDataFrame([(" A  b\n",)], "t string")
    assert rows.select(text.normalize(F.col("t"))).first()[0] == "a b"


def test_space_is_collapsed_as_the_source_does(spark):
    import re

    words = ["a  b", " a\tb ", "a\n\n b", "a b", "a\x1c\x1fb", "a\u00a0 b\u2003", "\u3000é \t", "", "   ", "a \x0b\x0c b\r\n", "é\x85è"]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, t string").orderBy("i")
    found = rows.select(text.collapse_space(F.col("t")), text.strip(F.col("t")), text.normalize(F.col("t"))).collect()
    for word, (collapsed, stripped, normal) in zip(words, found, strict=True):
        assert (collapsed, stripped, normal) == (re.sub(r"\s+", " ", word), re.sub(r"^\s+|\s+$", "", word), re.sub(r"\s+", " ", word).strip().casefold())


def test_page_functions(spark):
    pages = spark.createDataFrame([(["one page of more than twenty characters", "   short"],)], "pages array<string>")
    assert pages.select(text.marked_pages(F.col("pages"))).first()[0] == "[page 1]\none page of more than twenty characters\n\n[page 2]\n   short"
    facts = pages.select(text.page_statistics(F.col("pages"))).first()[0]
    assert tuple(facts) == (2, 1, 47, "partial")
    audit = lambda q, p: pages.select(text.quote_audit(F.lit(q), F.lit(p), F.col("pages"))).first()[0]
    assert [audit("page  of", 1), audit("page of", 2), audit("page of", 9), audit("page of", None), audit("nowhere", 1)] == ["OK", "WRONG PAGE", "WRONG PAGE", "WRONG PAGE", "MISSING"]


ROW = """<table><tr><th>Date</th></tr><tr><td> {when}<br> <span class="dates-time">{time}</span> </td><td class="pricesens">{flag}</td>
<td><a href="/x.do?display=pdf&idsId=0308495{n}"> Quarterly &amp; Activities<br> <span class="page">11 pages </span><span class="filesize"> 138.6KB </span></a></td></tr></table>"""


def test_listing(spark, tmp_path):
    flag = '<img title="price sensitive">'
    pages = spark.createDataFrame([(1, ROW.format(when="22/04/2026", time="8:30 am", flag=flag, n=4)), (2, ROW.format(when="2/01/2026", time="8:30 pm", flag="", n=5)), (3, "<p>none</p>")], "k int, html string")
    found = {r["k"]: r for r in readers.listings(pages).collect()}
    assert set(found) == {1, 2} and found[1]["headline"] == "Quarterly & Activities" and found[1]["pages"] == 11 and found[1]["file_size"] == "138.6KB"
    assert found[1]["price_sensitive"] and not found[2]["price_sensitive"] and found[1]["ids_id"] == "03084954"
    assert found[1]["announced_at"] == datetime(2026, 4, 21, 22, 30) and found[2]["announced_at"] == datetime(2026, 1, 2, 9, 30)
    with pytest.raises(ValueError):
        udfs.listing_rows(ROW.format(when="soon", time="", flag="", n=1))
    (tmp_path / "faked_site.py").write_text("""from tidemark.sources.http import Response

def get(address, parameters):
    row = '<tr><td>%s/%s 8:30 am</td><td><a href="?idsId=1%s">A %s<br></a></td></tr>'
    return Response(200, (row % ("22/04", parameters["year"], parameters["year"], parameters["asxCode"])).encode())
""")
    spark.sparkContext.addPyFile(str(tmp_path / "faked_site.py"))
    spark.dataSource.register(readers.ListingSource)
    site = spark.read.format("listing").option("transport", "faked_site:get").option("address", "https://site").option("requests", "aaa|2026, BBB|2025").option("interval", "0.05")
    got = site.load().orderBy("ticker").collect()
    assert [(r["ticker"], r["ids_id"], r["headline"], r["local_at"]) for r in got] == [("BBB", "12025", "A BBB", datetime(2025, 4, 22, 8, 30)), ("aaa", "12026", "A AAA", datetime(2026, 4, 22, 8, 30))]


def test_feed_maps_logs_and_universe(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"data": {"items": [{"documentKey": "k", "headline": "h", "date": "2026-06-11T00:00:00Z", "isPriceSensitive": true, "more": 1}]}}')
    assert readers.recent_announcements(spark, str(tmp_path / "feed.json")).first()["document_key"] == "k"
    (tmp_path / "bad.json").write_text('{"data": {"items": [{"documentKey": "k", "date": "2026-06-11T00:00:00Z", "isPriceSensitive": true}]}}')
    with pytest.raises(Exception, match="headline is missing"):
        readers.recent_announcements(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "roles.json").write_text('{"AAA|Ann": {"ticker": "AAA", "name": "Ann", "bucket": "exec", "role": "CEO"}}')
    assert readers.object_map(spark, str(tmp_path / "roles.json")).first()["bucket"] == "exec"
    line = "x extract.3y.stored content_hash=0123abcd input_tokens=12 npat=3 output_tokens=4\nother\n"
    (tmp_path / "a.log").write_bytes(line.encode("utf-16"))
    (tmp_path / "b.log").write_bytes(line.encode())
    rows = readers.usage(spark, f"{tmp_path}/*.log").collect()
    assert [tuple(r) for r in rows] == [("extract.3y.stored", "0123abcd", 12, 4)] * 2
    (tmp_path / "u.csv").write_bytes('﻿ticker,company,sector\n aaa ,"A, Ltd",s\n'.encode())
    assert readers.universe(spark, str(tmp_path / "u.csv")).first()["ticker"] == "AAA"
    (tmp_path / "e.csv").write_text("ticker,company,sector\n")
    with pytest.raises(ValueError):
        readers.universe(spark, str(tmp_path / "e.csv"))


def test_checks_and_payloads(spark):
    rows = spark.createDataFrame([("AB1", "a" * 64, "h", datetime(2026, 1, 1)), ("ab", "a" * 64, "h", datetime(2026, 1, 1)), ("ABC", "x", "", None)], "ticker string, content_hash string, headline string, announced_at timestamp")
    good, bad = schemas.split_valid(rows, schemas.announcement_checks())
    assert good.count() == 1 and sorted(map(tuple, (r["violations"] for r in bad.collect()))) == [("content_hash", "headline", "announced_at"), ("ticker",)]
    payloads = spark.createDataFrame([(1, '{"trades": [{"quantity": {"value": "1e3"}}]}'), (2, "not json"), (3, '{"trades": []}')], "k int, payload string")
    parsed, broken = schemas.parse_payload(payloads, "payload", schemas.TRADES_PAYLOAD)
    assert sorted(r["k"] for r in parsed.collect()) == [1, 3] and [r["k"] for r in broken.collect()] == [2]
    labels = spark.createDataFrame([("labeled", None, None, None), ("excluded", None, None, "scan"), ("odd", None, None, None)], "status string, labeled_by string, labeled_at string, exclusion_reason string")
    assert schemas.split_valid(labels, schemas.label_checks())[0].count() == 1
    ranges = spark.sql("select array(named_struct('range_low_aud', 2, 'range_high_aud', 1)) as s")
    assert not ranges.select(schemas.guidance_check(F.col("s"))).first()[0]


def test_stub_extraction_keeps_failures_apart(spark):
    docs = spark.createDataFrame([("h1", "Ann Lee bought 100 at 2.50 on 2024-01-31."), ("h2", None)], "content_hash string, text string")
    rows = {r["content_hash"]: r for r in udfs.extract(docs).collect()}
    assert '"100"' in rows["h1"]["payload"] and rows["h2"]["error"] is None

    def fails(body):
        raise RuntimeError("no")

    assert {r["error"] for r in udfs.extract(docs, fails).collect()} == {"no"}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(sinks.SchemaMismatch):
        sinks.append(rows.withColumnRenamed("v", "w"), str(tmp_path / "t"), rows.schema)
    first = sinks.write_absent(rows, str(tmp_path / "t"), ["k"])
    assert first.count() == 2
    again = sinks.write_absent(spark.createDataFrame([(2, "changed"), (3, "c"), (3, "c")], rows.schema), str(tmp_path / "t"), ["k"])
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sinks.create_if_absent(spark, "made_here", rows.schema) and not sinks.create_if_absent(spark, "made_here", rows.schema)
    sinks.rebuild_table(rows, "made_here")
    assert spark.table("made_here").count() == 2
    spark.sql("drop table made_here")


def test_prices_and_symbols(spark):
    wide = spark.createDataFrame([("2024-01-02", 1.5, 1.4, 100.0, float("nan"))], "date string, `A.AX|Close` double, `A.AX|Adj Close` double, `A.AX|Volume` double, `^INDEX|Close` double")
    assert [tuple(r[c] for c in ("ticker", "close", "adj_close", "volume")) for r in readers.prices_long(wide).collect()] == [("A", 1.5, 1.4, 100.0)]
    assert [r[0] for r in spark.createDataFrame([("A",), ("INDEX",)], "t string").select(readers.symbol_of(F.col("t"))).collect()] == ["A.AX", "^INDEX"]


def test_plain_pages_are_cut_as_the_parser_cuts_them(monkeypatch):
    """The same calls on pages of random marks, plain or not, and no parser's loop for a plain page."""
    import random
    from html.parser import HTMLParser

    class Calls(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.calls = []

        def handle_starttag(self, tag, attrs):
            self.calls.append(("start", tag, attrs))

        def handle_endtag(self, tag):
            self.calls.append(("end", tag))

        def handle_data(self, data):
            self.calls.append(("data", data))

    rng = random.Random(4)
    plain = ["<tr>", "</tr>", "<TD>", "</td>", '<a href="/x?idsId=7" Title="t">', "</a>", "text", " &amp; ", "&lt", "a > b", "\n", "<br>", "<h2>", "é &#65;", '<a b="/x?p=1&copy=2&amp;y=&lt;">']
    odd = ["<br/>", "<script>", "</script>", "<!-- x <td> -->", "<a href=x>", "<", "</", "<a href='y'>", "<!doctype html>", '<a b="&amp;">', "<img", "<td\n>", "</td >", "<title>", '</a x="y">', "&am", "<?x?>", "<![CDATA[x]]>", "\x00"]
    for i in range(4000):
        page = "".join(rng.choices(plain + odd * (i % 2), k=rng.randrange(12)))
        one, other = Calls(), Calls()
        udfs._fed(one, page)
        other.feed(page)
        assert one.calls == other.calls, page
    fed = []
    real = HTMLParser.feed
    monkeypatch.setattr(HTMLParser, "feed", lambda self, text: (fed.append(text), real(self, text))[1])
    page = '<table><tr><td> 1/02/2024<br> <span class="dates-time">9:30 am</span> </td><td></td><td><a href="/x.do?a=b&idsId=5"> Notes &amp; more<br> <span class="page">2 pages</span></a></td></tr></table>'
    assert udfs.listing_rows(page) == [("5", "1/02/2024 9:30 AM", False, "Notes & more", 2, None)]
    assert not fed


def test_price_frames_of_many_files(spark, tmp_path):
    """Each file has symbols of its own, in any order of columns; what is empty, no number or NaN is no price."""
    (tmp_path / "a.csv").write_text("date,A.AX|Close,B.AX|Close,A.AX|Volume,A.AX|Adj Close\n2024-01-02,1.5,,100.0,1.4\n2024-01-03,NaN,2.5,x,1.3\n")
    (tmp_path / "b.csv").write_text("date,^INDEX|Close,A.AX|Close\r\n2024-01-02,7000.123456789,1.6\r\n")
    found = readers.price_frames(spark, str(tmp_path)).collect()
    assert sorted((r["ticker"], str(r["date"]), r["close"], r["adj_close"], r["volume"]) for r in found) == [
        ("A", "2024-01-02", 1.5, 1.4, 100.0), ("A", "2024-01-02", 1.6, None, None), ("B", "2024-01-03", 2.5, None, None), ("INDEX", "2024-01-02", 7000.123456789, None, None),
    ]


def test_price_frames_are_one_plan(spark, tmp_path):
    """Of forty frames the query's plan is no longer than of one."""
    from tidemark.plans import registry

    spark.range(10_000).selectExpr("id as s_suppkey", "double(id + 1) / 3 as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.QUERIES["source_price_frame"].run(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("\n") < 30
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"S{i}", (i + 1) / 3) for i in range(10_000))


def test_patience():
    tries = []

    def call(statuses):
        def run():
            tries.append(1)
            status = statuses[len(tries) - 1]
            if status != 200:
                raise http.Refused(status)
            return "ok"

        tries.clear()
        return run

    waits = []
    assert http.with_retries(call([429, 503, 200]), sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(http.Refused):
        http.with_retries(call([404, 200]), sleep=waits.append)
    with pytest.raises(http.Refused):
        http.with_retries(call([500] * 4), sleep=waits.append)


def test_late_events_are_dropped(spark):
    folder = scratch(spark, "late")
    for rows in ([(1, datetime(2024, 1, 10)), (2, datetime(2024, 1, 10))], [(3, datetime(2024, 1, 9))], [(4, datetime(2024, 1, 1))], [(5, datetime(2024, 1, 20))]):
        made = spark.createDataFrame([(e, t, 1, "x", 1.0, "{}") for e, t in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        made.coalesce(1).write.mode("append").parquet(f"{folder}")
    found = streams.run_available(streams.tumbling(streams.read_events(spark, folder)), spark, scratch(spark, "late"), scratch(spark, "state"))
    got = {(r["start"].day, r["n"]) for r in found.collect()}
    assert (10, 2) in got and (9, 1) in got and not any(day == 1 for day, _ in got)


def test_every_document_is_hashed(spark, tmp_path):
    import hashlib

    from tidemark.plans import registry

    texts = [f"text {i}\r\n\x00é" * (i % 70) for i in range(2500)] + [None, "null", "\n", "x" * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = [r[0] for r in registry.QUERIES["source_binary_hash"].run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, found)) == sorted(str(None if t is None else hashlib.sha256(t.encode()).hexdigest()) for t in texts)


def test_every_supplier_and_order_takes_part(spark, tmp_path):
    from tidemark.plans import registry

    spark.createDataFrame([(i, float(i % 7 - 1)) for i in range(1, 601)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.QUERIES["source_price_frame"].run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted((f"S{i}", float(i % 7 - 1)) for i in range(1, 601) if i % 7 > 1)
    spark.createDataFrame([(i, datetime(1999 + i % 3, 5, 1)) for i in range(60)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.QUERIES["years_covering"].run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(i, y) for i in range(60) for y in range(1999 + i % 3, 2002)]


def test_whole_quotes_are_found(spark, tmp_path):
    from tidemark.plans import registry

    opening = "the same forty characters open both items "
    items = [(1, opening + "and end so"), (2, opening + "and end otherwise"), (3, "short one"), (4, "nowhere to be found at all"), (5, "ort  o"), (6, "a short one"), (7, "rty  chara"), (8, "x the same forty char")]
    texts = [f"x {items[0][1]} y", f"{opening}only", "a short one", f"{items[1][1]} short one {items[1][1]}", "", None]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["pages_quote_in_documents"].run(spark, str(tmp_path)).collect()
    wanted = [(i, sum(t is not None and item in t for t in texts)) for i, item in items]
    assert sorted(tuple(r) for r in found) == [x for x in wanted if x[1]] and dict(wanted)[3] == 2 and dict(wanted)[8] == 1


def test_constituents(spark):
    table = lambda rows, heading="Code", kind="wikitable sortable": f'<table class="{kind}"><tr><th> {heading} </th><th>Company</th></tr>{rows}</table>'
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    code = lambda i: "".join(chr(65 + i // 26**k % 26) for k in range(3))
    pages = [
        table(row("ABC", "<a> Alpha </a>", " Mining &amp; more") + row("not a code", "x") + row("123", "digits") + row("A1", "short") + row("ABCDEF", "long") + row("abc", "lower") + row("XYZ")),
        table(row("ABC", "a"), heading="Name") + table(row("ABC", "a"), kind="infobox") + table(row("DEF", "d"), heading="ASX symbol"),
        table("".join(row(code(i), f"c{i}") for i in range(200))) + table(row("ZZZ", "after enough")),
        table("".join(row(code(i), f"c{i}") for i in range(150))) + table(row("ZZZ", "one more table")), None, "",
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    found = {}
    for r in readers.wiki_constituents(rows).collect():
        found.setdefault(r["k"], []).append((r["ticker"], r["company"], r["sector"]))
    assert found[0] == [("ABC", "Alpha", "Mining & more"), ("A1", "short", "")] and found[1] == [("DEF", "d", "")]
    assert len(found[2]) == 200 and len(found[3]) == 151 and found.keys() == {0, 1, 2, 3}


FAKED_SITE = """from tidemark.sources.http import Response
SITE = "https://site/asx/v2/statistics/displayAnnouncement.do"
def get(address, parameters):
    if address == SITE:
        return {
            "page": Response(200, b'<INPUT type=hidden name="pdfURL" id="x" value="https://files/1.pdf">', "text/html"),
            "lost": Response(200, b'<input name="pdfURL" value="https://files/gone.pdf">', "text/html"),
            "odd": Response(200, b"<p>moved</p>", "text/html"),
            "direct": Response(200, b"%PDF", "application/pdf", "u"),
            "none": Response(404, b""),
        }[parameters["idsId"]]
    return Response(200, b"%PDF-1", "application/pdf;x", address) if address == "https://files/1.pdf" else Response(200, b"x", "text/html")
"""


def test_documents_in_two_steps(spark, tmp_path, monkeypatch):
    (tmp_path / "faked_documents.py").write_text(FAKED_SITE)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "faked_documents.py"))
    wanted = spark.createDataFrame([("page",), ("lost",), ("odd",), ("direct",), ("none",)], "ids_id string")
    found = {r["ids_id"]: r for r in http.documents(wanted, "https://site/", "faked_documents:get", interval=0.01, waits=()).collect()}
    assert (found["page"]["url"], bytes(found["page"]["content"])) == ("https://files/1.pdf", b"%PDF-1") and bytes(found["direct"]["content"]) == b"%PDF"
    assert {k for k, r in found.items() if r["problem"]} == {"lost", "odd", "none"} and found["none"]["problem"] == "status 404"
    assert all(found[k]["content"] is None for k in ("lost", "odd", "none"))
    asked = http.listing_requests(spark.createDataFrame([("abc", 2026)], "ticker string, year int"), "https://site/").first()
    assert asked["address"].endswith("announcements.do") and asked["parameters"]["asxCode"] == "ABC" and asked["parameters"]["year"] == "2026"


def test_turns_hold_across_fifty_tasks():
    """Each task has a clock of its own that nobody moves but it; all starts together keep their distance, tries again included."""
    turns, starts = http.Turns(1000.0, 50), []
    rng = random.Random(1)
    for place in range(50):
        now, left = [1000.0 + rng.random() * 20], [rng.choice([0, 0, 1, 3])]

        def call(now=now, left=left):
            starts.append(now[0])
            now[0] += rng.random() * 5
            left[0] -= 1
            return http.Response(503 if left[0] >= 0 else 200, b"")

        assert http.in_turn(call, place, turns, clock=lambda now=now: now[0], sleep=lambda s, now=now: now.__setitem__(0, now[0] + s)).status == 200
    starts.sort()
    assert len(starts) > 60 and min(b - a for a, b in zip(starts, starts[1:], strict=False)) > 2.999


def test_turns_end_with_refusals():
    for statuses, asked in (([404], 1), ([500] * 9, 4)):
        calls, now = iter(statuses), [0.0]
        seen = []
        with pytest.raises(http.Refused):
            http.in_turn(lambda: seen.append(1) or http.Response(next(calls), b""), 0, http.Turns(0.0, 1), clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
        assert len(seen) == asked


def test_document_url(spark):
    texts = ['<input type="hidden" name="pdfURL" class="x" value="https://a/b.pdf">', '<INPUT NAME="PDFURL" VALUE="u">', '<input name="pdfURL">', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, page string")
    assert [r[0] for r in rows.orderBy("i").select(http.document_url(F.col("page"))).collect()] == ["https://a/b.pdf", "u", None, None]


def test_case_folding(spark):
    words = ["Stra\u00dfe STRASSE stra\u1e9ee", "\u03a3\u03b9\u03c3\u03c5\u03c6\u03bf\u03c2 \u03a3\u0399\u03a3\u03a5\u03a6\u039f\u03a3", "\u0130stanbul", "d\u0131\u015f", "\ufb01n", "\u01f0", "\u00c9t\u00e9"]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(text.folded(F.col("t"))).collect()] == [w.casefold() for w in words]


def test_pages_of_blobs(spark):
    def numbered_pages(content):
        """A parser as a caller might give one: pages of a length-prefixed format."""
        if not content.startswith(b"PAGES"):
            raise ValueError("no pages")
        found, at = [], 5
        while at < len(content):
            found.append(content[at + 1 : at + 1 + content[at]].decode())
            at += 1 + content[at]
        return found

    rows = [("a", bytearray(b"PAGES\x05First\x00\x03two")), ("b", bytearray(b"no such format")), ("c", None)] + [(f"d{i}", bytearray(b"PAGES\x01x")) for i in range(40)]
    blobs = spark.createDataFrame(rows, "content_hash string, content binary")
    found = {r["content_hash"]: r for r in udfs.parse_pages(blobs, numbered_pages, "numbered-1").collect()}
    assert found["a"]["pages"] == ["First", "", "two"] and found["a"]["error"] is None and found["a"]["parser_version"] == "numbered-1"
    assert found["b"]["error"] == "no pages" and found["b"]["pages"] is None and found["c"]["pages"] is None and found["c"]["error"] is None
    assert len(found) == 43 and found["d39"]["pages"] == ["x"]
    assert udfs.parse_pages(blobs.where("content_hash = 'b'")).first()["pages"] == ["no such format"]


def test_a_failed_rebuild_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.rebuild(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        sinks.rebuild(spark.range(9).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    sinks.rebuild(spark.read.parquet(path).where("id > 0"), path)  # of itself
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1


def test_the_least_of_equal_keys_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 1), (2, None, 5)], "k int, v string, w int").repartition(4)
    assert sorted(tuple(r) for r in sinks.write_absent(rows, str(tmp_path / "t"), ["k"]).collect()) == [(1, "a", 1), (2, None, 5)]
