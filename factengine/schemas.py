"""Schemas, closed vocabularies, and the invariants of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
LINE = f"struct<id: string, text: string, bbox: {BOX}, size: double>"
BAND = "struct<index: int, x0: double, x1: double>"
CELL = f"struct<text: string, bbox: {BOX}, lineIds: array<string>, column: int>"
ROW = f"struct<cells: array<{CELL}>, bbox: {BOX}>"
TABLE = f"struct<id: string, bandIndex: int, bbox: {BOX}, quality: string, raggedReason: string, title: string, unitLine: string, columnHeaders: array<string>, footnotes: array<string>, rows: array<{ROW}>>"
TABLE_CONTEXT = "struct<title: string, columnHeader: string, rowHeader: string, unitLine: string, footnotes: array<string>>"
PERIOD = "struct<start: date, end: date, precision: string>"
EVIDENCE = "struct<quote: string, lineIds: array<string>>"
CANDIDATE = f"subject string, predicate string, rawValue string, unit string, valueType string, qualifiers map<string, string>, modality string, attributedTo string, source string, tableContext {TABLE_CONTEXT}, evidence {EVIDENCE}, confidence double"
PAGE = f"document_id string, page_number int, width double, height double, text string, lines array<{LINE}>, bands array<{BAND}>, tables array<{TABLE}>, quality struct<textDensity: double, replacementCharRatio: double, imageRatio: double>, status string, failure_reason string, failure_detail string"

# Closed vocabularies of the stored columns.
MODALITY = ("observed", "projected")
SOURCE = ("prose", "table")
STATUS = ("published", "rejected")
REJECTION = ("quote_not_found", "line_not_found", "missing_context", "value_not_in_source", "normalization_failed")
VALUE_TYPE = ("money", "percent", "number", "date", "duration", "text")
PRECISION = ("day", "month", "quarter", "half_year", "fiscal_year", "year")
DOCUMENT_STATUS = ("pending", "parsing", "ready", "failed")
DOCUMENT_FAILURE = ("not_a_pdf", "encrypted", "corrupted", "scanned_unsupported", "parse_failed", "extraction_failed", "relation_failed")
PAGE_STATUS = ("parsed", "failed")
PAGE_FAILURE = ("no_text_layer", "parse_failed", "render_failed")
VERDICT = ("corroborates", "contradicts", "reconciles", "insufficient")
REASON = ("exact_duplicate", "equivalent_value", "value_conflict", "time_supersession", "vintage_difference", "unit_mismatch", "scope_mismatch", "projection_vs_actual", "attribution_mismatch", "missing_context")
FIELDS = ("subject", "predicate", "time", "scope", "unit", "value", "modality", "attribution")
JOB_STAGE = ("parse", "extract", "relate")
JOB_STATUS = ("queued", "running", "completed", "failed")
TABLE_QUALITY = ("clean", "ragged")


def pipeline_version(provider: str, base: str = "0.7.0") -> str:
    """The version that rows carry; another provider makes another version, so stored output is not mixed."""
    return f"{base}-{provider}"


def known(value: Column, vocabulary: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*vocabulary)


def one_of(value: str | None, vocabulary: tuple[str, ...], name: str) -> str | None:
    """An argument of a closed vocabulary, or an error that names it."""
    if value is not None and value not in vocabulary:
        raise ValueError(f"unknown {name} {value!r}; one of {', '.join(vocabulary)}")
    return value


def broken_fact() -> Column:
    """Why a fact row breaks an invariant; null if it doesn't."""
    return (
        F.when((F.col("status") == "published") & ~(F.coalesce("verified", F.lit(False)) & F.coalesce("context_complete", F.lit(False))), F.lit("published without verification"))
        .when((F.col("status") == "rejected") & F.col("rejection_reason").isNull(), F.lit("rejected without a reason"))
        .when(~known(F.col("status"), STATUS) | ~known(F.col("rejection_reason"), REJECTION) | ~known(F.col("value_type"), VALUE_TYPE), F.lit("unknown value of a closed column"))
    )


def assert_facts(facts: DataFrame) -> DataFrame:
    """``facts`` as they are; reading a row that breaks an invariant fails the job."""
    why = broken_fact()
    checked = F.when(why.isNotNull(), F.raise_error(why).cast("string")).otherwise(F.col("status"))
    return facts.withColumn("status", checked)
