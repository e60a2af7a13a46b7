"""Functions that Spark lacks: the error function, HTML parsing, a deterministic extractor. Batched by Arrow."""

from __future__ import annotations

import json
import math
import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def z_to_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal z; null for null."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


class _Rows(HTMLParser):
    """Cells and the marks of a listing's rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.span, self.in_link = [], None, None, False

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        if tag == "tr":
            self.row = {"cells": [], "id": None, "headline": "", "done": False, "sensitive": False, "page": "", "filesize": ""}
        elif self.row is None:
            return
        elif tag == "td":
            self.row["cells"].append("")
        elif tag == "a" and (found := re.search(r"idsId=(\d+)", have.get("href") or "")):
            self.row["id"], self.in_link = found[1], True
        elif tag == "br" and self.in_link:
            self.row["done"] = True
        elif tag == "img" and have.get("title") == "price sensitive":
            self.row["sensitive"] = True
        elif tag == "span" and (have.get("class") or "") in ("page", "filesize"):
            self.span, self.row["done"] = have["class"], True

    def handle_endtag(self, tag):
        if tag == "tr" and self.row is not None:
            if self.row["id"]:
                self.rows.append(self.row)
            self.row = None
        elif tag == "a":
            self.in_link = False
        elif tag == "span":
            self.span = None

    def handle_data(self, data):
        if self.row is None:
            return
        if self.row["cells"]:
            self.row["cells"][-1] += f" {data}"
        if self.span:
            self.row[self.span] += data
        elif self.in_link and not self.row["done"]:
            self.row["headline"] += data


#: A tag whose attributes, if any, have plain values in double quotes, or text between tags.
_TOKEN = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z-]*="[^"<>]*")*)>|([^<]+)')
_ATTRIBUTE = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
#: Tags whose content is no markup.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))


def _fed(parser: HTMLParser, page: str) -> None:
    """Feeds the parser a page. One that is all plain tags and text is cut into them by one expression, with the same calls as
    the parser makes, which takes a fraction of its time; a page with any mark of another kind the parser reads itself."""
    at, end, tokens = 0, len(page), []
    for token in _TOKEN.finditer(page):
        if token.start() != at:
            break
        closing, tag, attributes, data = token.groups()
        if data is None and (tag.lower() in _RAW or closing and attributes):
            break
        tokens.append((closing, tag, attributes, data, token[0]))
        at = token.end()
    if at != end:
        return parser.feed(page)
    if tokens and tokens[-1][3] is not None and "&" in tokens[-1][3]:  # the parser waits for the rest of a reference
        return parser.feed(page)
    for closing, tag, attributes, data, whole in tokens:
        if data is not None:
            parser.handle_data(unescape(data) if "&" in data else data)
        elif closing:
            parser.handle_endtag(tag.lower())
        elif "&" in attributes and unescape(attributes) != attributes:  # references in attributes have rules of their own
            parser.feed(whole)
        else:
            parser.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else [])


def listing_rows(html: str) -> list[tuple]:
    """(ids_id, local time in words, price_sensitive, headline, pages, file_size) of each row that has a link; a row without
    a date in its first cell is an error, as the listing's layout must have changed."""
    parser = _Rows()
    _fed(parser, html)
    found = []
    for row in parser.rows:
        when = " ".join(row["cells"][0].split()) if row["cells"] else ""
        if not re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [apAP][mM]", when):
            raise ValueError(f"the listing's row has no time: {when!r}")
        pages = re.match(r"\d+", row["page"].strip())
        found.append((row["id"], when.upper(), row["sensitive"], row["headline"].strip(), int(pages[0]) if pages else None, row["filesize"].strip() or None))
    return found


LISTING = T.StructType([T.StructField(n, k) for n, k in (("ids_id", T.StringType()), ("local_time", T.StringType()), ("price_sensitive", T.BooleanType()), ("headline", T.StringType()), ("pages", T.IntegerType()), ("file_size", T.StringType()))])


@F.udtf(returnType=LISTING)
class ListingRows:
    """Table function over a listing's HTML."""

    def eval(self, html: str):
        if html:
            yield from listing_rows(html)


# Which tables list constituents, how many of their first headings are read, and after how many rows no further table is.
CONSTITUENT_CLASS, CONSTITUENT_HEADINGS, HEADINGS_READ, ENOUGH_ROWS = "wikitable", ("code", "symbol", "ticker"), 5, 150
# End of fixed values.


class _Tables(HTMLParser):
    """Rows of the tables of a class: for each table its headings, and for each row its cells; text is stripped node by node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.open:
                self.open += 1
            elif CONSTITUENT_CLASS in (dict(attrs).get("class") or "").split():
                self.open = 1
                self.tables.append({"headings": [], "rows": []})
        elif self.open and tag == "tr":
            self.tables[-1]["rows"].append([])
            self.cell = None
        elif self.open and tag in ("td", "th"):
            table = self.tables[-1]
            into = table["headings"] if tag == "th" else table["rows"][-1] if table["rows"] else []
            into.append("")
            self.cell = into

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open -= 1
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[-1] += data.strip()


def constituent_rows(html: str) -> list[tuple[str, str, str]]:
    """(ticker, company, sector) of the rows of a page's tables of constituents, whole tables only: none is begun once there
    are more than ``ENOUGH_ROWS`` rows. A ticker has two to five characters, letters among them, all in upper case."""
    parser, found = _Tables(), []
    parser.feed(html or "")
    for table in parser.tables:
        if len(found) > ENOUGH_ROWS:
            break
        if any(word in h.lower() for h in table["headings"][:HEADINGS_READ] for word in CONSTITUENT_HEADINGS):
            found += [(r[0], r[1], r[2] if len(r) > 2 else "") for r in table["rows"][1:] if len(r) >= 2 and r[0].isupper() and 2 <= len(r[0]) <= 5]
    return found


@F.udtf(returnType="ticker string, company string, sector string")
class ConstituentRows:
    """Table function over a page's HTML."""

    def eval(self, html: str):
        yield from constituent_rows(html)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.text, self.skip, self.in_title = "", 0, [], 0, False

    def handle_starttag(self, tag, attrs):
        self.links += tag == "a" and any(k == "href" for k, _ in attrs)
        self.skip += tag in ("script", "style")
        self.in_title = tag == "title"

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.text.append(data)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("n_links", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
def page_facts(html: pd.Series) -> pd.DataFrame:
    """Title, links and words of a page."""

    def facts(source):
        parser = _Page()
        parser.feed(source or "")
        return parser.title.strip(), parser.links, len(" ".join(parser.text).split())

    return pd.DataFrame([facts(h) for h in html], columns=["title", "n_links", "n_words"])


#: What the stand-in extractor reads: "Name bought 100 at 2.50 on 2024-01-31".
_STATEMENT = re.compile(r"([A-Z]\w+(?: [A-Z]\w+)*) (bought|sold) (\d+) at (\d+(?:\.\d+)?)(?: on (\d{4}-\d{2}-\d{2}))?")


def stub_extract(text: str) -> str:
    """JSON payload of the trades that a text states plainly. Stands in for a language model behind the same contract."""
    kinds = {"bought": "acquisition", "sold": "disposal"}
    trades = [
        {"director_name": {"value": m[1], "confidence": 1.0, "source_quote": m[0]}, "trade_type": {"value": kinds[m[2]]}, "quantity": {"value": m[3]}, "price_per_security": {"value": m[4]}, "trade_date": {"value": m[5]}}
        for m in _STATEMENT.finditer(text or "")
    ]
    return json.dumps({"trades": trades})


def extract(documents: DataFrame, extractor=stub_extract, key: str = "content_hash", text: str = "text") -> DataFrame:
    """key, payload, error for every document: text in, JSON out. A document that fails keeps its error and stays pending."""

    def run(frames):
        for frame in frames:
            made, errors = [], []
            for body in frame[text]:
                try:
                    made.append(extractor(body))
                    errors.append(None)
                except Exception as error:  # any model's failure is that document's
                    made.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({key: frame[key], "payload": made, "error": errors})

    return documents.select(key, text).mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, payload string, error string")


def text_pages(content: bytes) -> list[str]:
    """The pages of a text in UTF-8, which form feeds part."""
    return content.decode("utf-8", "replace").split("\f")


def parse_pages(blobs: DataFrame, parse=text_pages, version: str = "text-1") -> DataFrame:
    """content_hash, parser_version, pages, error of each blob (content_hash, content): ``parse`` turns bytes into pages. One
    that fails keeps its error. Blobs are taken a few at a time, as they may be large."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), 16):
                part, made, errors = frame.iloc[at : at + 16], [], []
                for content in part["content"]:
                    try:
                        made.append(None if content is None else parse(bytes(content)))
                        errors.append(None)
                    except Exception as error:  # any parser's failure is that blob's
                        made.append(None)
                        errors.append(str(error))
                yield pd.DataFrame({"content_hash": part["content_hash"], "parser_version": version, "pages": made, "error": errors})

    return blobs.select("content_hash", "content").mapInPandas(run, "content_hash string, parser_version string, pages array<string>, error string")
