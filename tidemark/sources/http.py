"""Requests to remote listings as frames, with a timetable that tasks keep and with patience. What does a request is passed in."""

from __future__ import annotations

import importlib
import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .. import scratch

# Seconds between requests, waits after failures, and what is worth another try.
MIN_INTERVAL = 3.0
BACKOFF = (1.0, 2.0, 4.0)
LOAD_BACKOFF = (10.0, 20.0, 40.0, 80.0, 160.0)
RETRY_STATUS = (429, 500, 502, 503, 504)
# The address of a document on the page that stands before it, letters of either case.
DOCUMENT_URL = r'''<input[^>]*name="pdfURL"[^>]*value="([^"]+)"'''
LISTING_PATH, DOCUMENT_PATH = "/asx/v2/statistics/announcements.do", "/asx/v2/statistics/displayAnnouncement.do"
# End of fixed values.


class Refused(RuntimeError):
    """A response whose status is not worth another try, or no longer."""

    def __init__(self, status: int | None, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def with_retries(call: Callable[[], object], waits=BACKOFF, sleep: Callable[[float], None] = time.sleep):
    """``call()``, again after each wait if the transport fails or the status is a passing one; other refusals are final."""
    for wait in (*waits, None):
        try:
            return call()
        except (OSError, Refused) as error:
            passing = not isinstance(error, Refused) or error.status in RETRY_STATUS
            if not passing or wait is None:
                raise
        sleep(wait)


def document_url(page: Column) -> Column:
    """The address of the document that an interstitial page leads to, or null."""
    return F.nullif(F.regexp_extract(page, f"(?i){DOCUMENT_URL}", 1), F.lit(""))


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes
    content_type: str = ""
    url: str = ""


class Changed(RuntimeError):
    """A page that does not look as it should: the site must have changed."""


@dataclass(frozen=True)
class Turns:
    """A timetable that tasks keep without talking to each other: of ``count`` requests to a host, the one with place i may start
    ``interval`` * (i + k * count) seconds after ``began``, for every k. So no two starts are closer than the interval, tries
    that are made again included, wherever they run. Clocks of the machines have to agree, as far as that distance matters."""

    began: float
    count: int
    interval: float = MIN_INTERVAL

    def start(self, place: int, earliest: float) -> float:
        """The first of its turns that is not before ``earliest``."""
        own = self.began + place * self.interval
        cycle = self.count * self.interval
        return own if earliest <= own or not cycle else own + math.ceil(round((earliest - own) / cycle, 9)) * cycle


def in_turn(call: Callable[[], Response], place: int, turns: Turns, waits=BACKOFF, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Response:
    """What ``call`` answers at one of its turns; after a passing failure and a wait it has another, until the waits are used up."""
    earliest = turns.began
    for wait in (*waits, None):
        begin = turns.start(place, max(earliest, clock()))
        if begin > clock():
            sleep(begin - clock())
        try:
            answer = call()
        except OSError:
            if wait is None:
                raise
        else:
            if answer.status < 400:
                return answer
            if wait is None or answer.status not in RETRY_STATUS:
                raise Refused(answer.status)
        earliest = clock() + wait


FETCHED = "status int, content_type string, url string, body binary, problem string"


def fetch(requests: DataFrame, transport: str, interval: float = MIN_INTERVAL, waits=BACKOFF) -> DataFrame:
    """requests (address, parameters: map of strings, and more) with FETCHED: one GET each through ``transport`` ("module:function",
    (address, parameters) -> Response). Requests of a host keep their distance across tasks; one that is refused for good
    has a problem and no body. Written, so that nothing is asked for twice by what reads it."""
    host = F.coalesce(F.parse_url("address", F.lit("HOST")), F.lit(""))
    names = requests.columns
    placed = requests.withColumn("__host", host).withColumn("__place", F.row_number().over(Window.partitionBy("__host").orderBy("address", F.to_json("parameters"))) - 1)
    placed = placed.withColumn("__count", F.count("*").over(Window.partitionBy("__host")))
    answer = StructType.fromDDL(FETCHED)
    schema, fields = StructType([*requests.schema.fields, *answer.fields]), answer.fieldNames()
    began = time.time()

    def run(frames):
        module, _, name = transport.partition(":")
        get = getattr(importlib.import_module(module), name)
        for frame in frames:
            frame, answers = frame.sort_values("__place"), []
            for row in frame.itertuples(index=False, name=None):
                own = dict(zip(frame.columns, row, strict=True))
                try:
                    r = in_turn(lambda own=own: get(own["address"], dict(own["parameters"] or {})), own["__place"], Turns(began, own["__count"], interval), waits)
                    answers.append((r.status, r.content_type, r.url or own["address"], r.body, None))
                except (Refused, OSError) as error:
                    answers.append((getattr(error, "status", None), None, own["address"], None, str(error)))
            made = frame[names].reset_index(drop=True)
            for at, field in enumerate(fields):
                made[field] = [x[at] for x in answers]
            yield made

    return scratch.written(placed.mapInPandas(run, schema), "fetched")


def listing_requests(wanted: DataFrame, address: str) -> DataFrame:
    """ticker, year with the request for each listing."""
    text = lambda c: F.col(c).cast("string")
    parameters = F.create_map(F.lit("by"), F.lit("asxCode"), F.lit("asxCode"), F.upper("ticker"), F.lit("timeframe"), F.lit("Y"), F.lit("year"), text("year"))
    return wanted.withColumn("address", F.lit(address.rstrip("/") + LISTING_PATH)).withColumn("parameters", parameters)


def documents(wanted: DataFrame, address: str, transport: str, interval: float = MIN_INTERVAL, waits=BACKOFF) -> DataFrame:
    """ids_id, url, content, problem: each document in two steps, the page or document that its id leads to, and, for pages, what
    their address column leads to. What is no document after that has a problem."""
    parameters = F.create_map(F.lit("display"), F.lit("pdf"), F.lit("idsId"), F.col("ids_id"))
    first = fetch(wanted.select("ids_id").withColumn("address", F.lit(address.rstrip("/") + DOCUMENT_PATH)).withColumn("parameters", parameters), transport, interval, waits)
    is_document = F.col("content_type").startswith("application/pdf")
    found = first.withColumn("next", F.when(F.col("problem").isNull() & ~is_document, document_url(F.decode("body", "utf-8"))))
    more = fetch(found.where("next is not null").select("ids_id", F.col("next").alias("address"), F.create_map().cast("map<string,string>").alias("parameters")), transport, interval, waits)
    problem = F.coalesce("problem", F.when(~is_document, F.lit("no document and no address of one")))
    result = lambda rows: rows.select("ids_id", "url", F.when(is_document, F.col("body")).alias("content"), problem.alias("problem"))
    return result(found.where("next is null")).unionByName(result(more))
