"""Declared schemas of the persisted tables and payloads, and the checks that rows must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I64, D, B, TS, DAY, MONEY = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.DateType(), T.DecimalType(38, 9)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


ANNOUNCEMENTS = _schema(("content_hash", S, False), ("announcement_id", S, False), ("ticker", S, False), ("headline", S, False), ("document_url", S, False), ("document_type", S), ("price_sensitive", B), ("announced_at", TS), ("ingested_at", TS))
PARSED_DOCUMENTS = _schema(("content_hash", S, False), ("parser_version", S, False), ("quality", S), ("parsed_at", TS), ("page_count", I64), ("empty_page_count", I64), ("total_chars", I64))
EXTRACTIONS = _schema(("content_hash", S, False), ("model", S, False), ("prompt_version", S, False), ("extracted_at", TS), ("payload", S))
FIELD_SCORE = _schema(("field", S), ("correct", I64), ("wrong", I64), ("missed", I64), ("hallucinated", I64), ("total", I64), ("accuracy", D))
EVAL_RUNS = _schema(("model", S, False), ("prompt_version", S, False), ("dataset_version", S, False), ("evaluated_at", TS), ("n_documents", I64), ("n_skipped", I64), ("overall_accuracy", D), ("field_scores", T.ArrayType(FIELD_SCORE)))
EVAL_FIELD_RESULTS = _schema(("eval_run_id", S), ("content_hash", S), ("field", S), ("subfield", S), ("golden_value", S), ("extracted_value", S), ("value_match", B), ("source_quote", S), ("quote_soft_match", B))
DAILY_PRICES = _schema(("ticker", S), ("date", DAY), ("close", D), ("adj_close", D), ("volume", D), ("source", S), ("loaded_at", TS))
HEADLINES = _schema(("ticker", S), ("ids_id", S), ("announced_at", TS), ("headline", S), ("price_sensitive", B), ("pages", I64), ("listing_year", I64), ("ingested_at", TS))
LEDGER = _schema(("ts", TS, False), ("mode", S, False), ("action", S, False), ("ticker", S, False), ("director", S), ("filed_date", DAY), ("entry_date", DAY), ("qty", I64), ("price", D), ("size_aud", D), ("note", S))
EQUITY = _schema(("ts", TS, False), ("mode", S, False), ("net_liquidation", D), ("cash", D), ("gross_position_value", D), ("open_positions", I64))
ROLES = T.MapType(S, _schema(("ticker", S), ("name", S), ("bucket", S), ("role", S)))


def sourced(value: T.DataType) -> T.StructType:
    """A stated value with its confidence, quote and page."""
    return _schema(("value", value), ("confidence", D), ("source_quote", S), ("page", T.IntegerType()))


def metric(value: T.DataType) -> T.StructType:
    return _schema(("current", sourced(value)), ("prior", sourced(value)))


TRADE_FIELDS = ("director_name", "director_role", "trade_type", "nature", "security_class", "quantity", "price_per_security", "total_consideration", "trade_date", "holdings_before", "holdings_after")
#: Values come as strings and are cast later, so that one bad value nulls one field.
TRADES_PAYLOAD = _schema(("trades", T.ArrayType(_schema(*[(f, sourced(S)) for f in TRADE_FIELDS]))))
RESULTS_PAYLOAD = _schema(("period", sourced(S)), ("reporting_currency", sourced(S)), *[(m, metric(MONEY)) for m in ("revenue", "npat", "eps_cents", "dividend_cents")])
GUIDANCE_PAYLOAD = _schema(("statements", T.ArrayType(_schema(("direction", S), ("metric", S), ("basis", S), ("period", S), ("range_low_aud", MONEY), ("range_high_aud", MONEY)))))
ROLES_PAYLOAD = _schema(("events", T.ArrayType(_schema(("person_name", S), ("role", S), ("action", S), ("effective_date", DAY)))))

QUALITIES = ("good", "partial", "empty")
LABEL_STATUSES = ("unlabeled", "labeled", "excluded")
TICKER, HASH = "^[A-Z0-9]{3,6}$", "^[a-f0-9]{64}$"


def announcement_checks() -> dict[str, Column]:
    return {"ticker": F.col("ticker").rlike(TICKER), "content_hash": F.col("content_hash").rlike(HASH), "headline": F.col("headline") != "", "announced_at": F.col("announced_at").isNotNull()}


def label_checks() -> dict[str, Column]:
    """Labelled rows name who and when; excluded ones say why."""
    status = F.col("status")
    return {
        "status": status.isin(*LABEL_STATUSES),
        "labelled_by": (status != "labeled") | F.col("labeled_by").isNotNull() & F.col("labeled_at").isNotNull(),
        "reason": (status != "excluded") | F.col("exclusion_reason").isNotNull(),
    }


def sourced_checks(field: Column) -> Column:
    """Confidence from 0 to 1 and page from 1, where stated."""
    return F.coalesce(field["confidence"].between(0, 1), F.lit(True)) & F.coalesce(field["page"] >= 1, F.lit(True))


def guidance_check(statements: Column) -> Column:
    """No range upside down."""
    return F.forall(statements, lambda s: F.coalesce(s["range_low_aud"] <= s["range_high_aud"], F.lit(True)))


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with ``violations``). A check that comes out null has failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    judged = rows.withColumn("violations", failed)
    return judged.where("size(violations) = 0").drop("violations"), judged.where("size(violations) > 0")


def parse_payload(rows: DataFrame, payload: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with ``parsed``, rows whose payload is no JSON of that shape at all). The payload is parsed once, by a generator
    of one row, as a filter on a plain column would be pushed down and parse it again."""
    parsed = rows.select("*", F.explode(F.array(F.from_json(payload, schema))).alias("parsed"))
    top = [f.name for f in schema.fields]
    broken = F.col("parsed").isNull() | sum(F.col(f"parsed.{n}").isNull().cast("int") for n in top).__eq__(len(top))
    return parsed.where(~broken), parsed.where(broken).drop("parsed")
