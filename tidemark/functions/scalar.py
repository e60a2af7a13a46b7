"""Scalar functions over Columns: casts that give null, zones, distances, and the outcomes of a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize

ZONE = "Australia/Sydney"
CLOSE_HOUR = 16


def numeric(text: Column) -> Column:
    """decimal(38,9), or null for what is no number."""
    return text.try_cast("decimal(38,9)")


def date_or_null(text: Column) -> Column:
    return text.try_cast("date")


def local(at: Column, zone: str = ZONE) -> Column:
    """Wall time in ``zone`` of a UTC wall time."""
    return F.from_utc_timestamp(at, zone)


def local_date(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(at, zone))


def tradeable_date(at: Column, zone: str = ZONE) -> Column:
    """The local date, or the next after the market's close: the first day on which an announcement can be traded, before holidays."""
    return F.date_add(local_date(at, zone), F.when(F.hour(local(at, zone)) >= CLOSE_HOUR, 1).otherwise(0))


def utc_from_local(text: Column, pattern: str = "d/M/yyyy h:mm a", zone: str = ZONE) -> Column:
    """UTC time of a local time in words, summer time included."""
    return F.to_utc_timestamp(F.to_timestamp(text, pattern), zone)


def years_covering(cutoff: Column, today: Column) -> Column:
    """Calendar years from the cutoff's to today's."""
    return F.sequence(F.year(cutoff), F.year(today))


def outcome(golden: Column, stated: Column, text: bool = False) -> Column:
    """correct, wrong, missed or hallucinated; two nulls are correct. Text is compared normalised."""
    same = normalize(golden) == normalize(stated) if text else golden == stated
    return F.when(golden.isNull() & stated.isNull(), "correct").when(golden.isNull(), "hallucinated").when(stated.isNull(), "missed").when(same, "correct").otherwise("wrong")


def share_size(size: Column, price: Column) -> Column:
    """Whole shares for a sum of money, one at least."""
    return F.greatest(F.lit(1), F.floor(F.try_divide(size, price))).cast("long")


def version_of(name: Column) -> Column:
    """The number after the last _v."""
    return F.regexp_extract(name, r"_v(\d+)$", 1).try_cast("int")
