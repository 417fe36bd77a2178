"""Grounding: gates, normalisation, dating and source verification of candidates, and the audit of what was published."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factengine.functions.periods import PERIOD, Calendar, find_period, fiscal_calendar_of, period_in_source, stated_year_end, try_period
from factengine.functions.text import WS, filled, word
from factengine.functions.values import normalize_value, verify_in_source
from factengine.operators.gates import KEY_FAMILIES, apply_gates, table_text, verbatim
from factengine.session import dealt

_PERIOD_KEY = re.compile(f"(?:^|_)(?:{KEY_FAMILIES['period']})(?:_|$)", re.IGNORECASE)
FISCAL_LABEL = word(rf"(?:fy|fiscal{WS}+year|q[1-4]{WS}*fy|h[12]{WS}*fy){WS}*['’]?[0-9]{{2,4}}")


def claim_period(kind, raw, header, title, quote, keys, values, month_day):
    """The period one claim is about, or None: a date's own value; else its period qualifiers in order, each whole and then
    in parts; else the column header, the title and the quote. A stated year end nearby beats the document's calendar."""
    sources = [s for s in (header, title, quote, *values) if s and s.strip()]
    cal = Calendar(stated_year_end(sources), (int(month_day[:2]), int(month_day[3:])) if month_day else None)
    if kind == "date":
        return try_period(raw, cal) if raw is not None else None
    for key, value in zip(keys, values, strict=True):
        if value is not None and _PERIOD_KEY.search(re.sub("[^a-z0-9]+", "_", key.lower())):
            period = try_period(value, cal) or find_period(value, cal)
            if period:
                return period
    for source in (header, title, quote):
        period = find_period(source, cal) if source else None
        if period:
            return period
    return None


@F.pandas_udf(PERIOD)
def _claim_periods(kind: pd.Series, raw: pd.Series, header: pd.Series, title: pd.Series, quote: pd.Series, keys: pd.Series, values: pd.Series, month_day: pd.Series) -> pd.DataFrame:
    found = [claim_period(*row) for row in zip(kind, raw, header, title, quote, keys, values, month_day, strict=True)]
    return pd.DataFrame([(p.start, p.end, p.precision, None) if p else (None,) * 4 for p in found], columns=["start", "end", "precision", "failure"], dtype=object)


def document_calendars(pages: DataFrame) -> DataFrame:
    """``(document_id, fiscal_month_day)``: the year end that each document's whole text states; null if it never does.

    Statements are found page by page before anything is gathered, so only pages with one are put together.
    """
    stated = pages.where(F.col("text").rlike(rf"(?i)(?:year|period){WS}+ende[dr]"))
    texts = stated.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("pages"))
    found = texts.select("document_id", fiscal_calendar_of(F.array_join(F.col("pages.text"), " ")).alias("fiscal_month_day"))
    return pages.select("document_id").distinct().join(found, "document_id", "left")


def ground(candidates: DataFrame) -> DataFrame:
    """Grounded candidates: every column, and ``canonical_value, canonical_number, unit, normalization_rule, period, verified,
    context_complete, status, rejection_reason, rejection_detail``.

    Needs the gates' columns and ``fiscal_month_day``. A rejected row keeps all that was computed. Qualifiers are read in
    the order of their map. Candidates are dealt out first, since a row takes far longer here than in a shuffle.
    """
    c = F.col
    none = F.lit(None).cast("string")
    gated = apply_gates(dealt(candidates))
    no_map = F.array().cast("array<string>")
    keys, values = F.coalesce(F.map_keys("qualifiers"), no_map), F.coalesce(F.map_values("qualifiers"), no_map)
    period = _claim_periods(c("valueType"), c("rawValue"), c("tableContext.columnHeader"), c("tableContext.title"), c("evidence.quote"), keys, values, c("fiscal_month_day"))
    governing = F.array_join(F.filter(F.array(c("unit"), c("tableContext.unitLine")), filled), " ")
    dated = gated.withColumn("__period", period)
    spoken = F.concat_ws(" ", c("evidence.quote"), c("tableContext.columnHeader"), c("tableContext.title"), F.array_join(values, " "))
    undated = c("__period.start").isNull() & spoken.rlike(FISCAL_LABEL)
    shown = F.array_join(F.filter(F.array(c("evidence.quote"), F.replace(table_text(c("tableContext")), F.lit(" \n "), F.lit("\n"))), filled), "\n")
    is_date = c("valueType") == "date"
    value = normalize_value(c("rawValue"), c("valueType"), F.when(governing != "", governing), c("__period.end"))
    valued = dated.withColumns({"__value": value, "__date_ok": period_in_source(F.when(is_date, c("rawValue")), c("__period.end"), shown)})  # one pass through Python
    checked = valued.withColumn("__absent", verify_in_source(c("rawValue"), c("valueType"), c("__value.unit"), shown, c("__date_ok")))
    reason = (
        F.when(c("gate_reason").isNotNull(), c("gate_reason"))
        .when(c("__value.failure").isNotNull() | undated, F.lit("normalization_failed"))
        .when(c("__absent").isNotNull(), F.lit("value_not_in_source"))
    )
    detail = (
        F.when(c("gate_reason").isNotNull(), c("gate_detail"))
        .when(c("__value.failure").isNotNull(), c("__value.failure"))
        .when(undated, F.lit("a fiscal period without a matching year end in its context"))
        .otherwise(c("__absent"))
    )
    whole = F.struct(c("__period.start").cast("date").alias("start"), c("__period.end").cast("date").alias("end"), c("__period.precision").alias("precision"))
    out = checked.withColumns(
        {
            "canonical_value": c("__value.canonical_value"),
            "canonical_number": c("__value.canonical_number"),
            "unit": F.when(c("__value.failure").isNull(), c("__value.unit")).otherwise(c("unit")),
            "normalization_rule": c("__value.normalization_rule"),
            "period": F.when(c("__period.start").isNotNull(), whole),
            "rejection_reason": reason,
            "rejection_detail": F.when(reason.isNotNull(), detail).otherwise(none),
            "status": F.when(reason.isNull(), "published").otherwise("rejected"),
        }
    )
    return out.drop("__period", "__value", "__date_ok", "__absent", "gate_reason", "gate_detail")


def audit(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Published facts that break their evidence, one row per fact and reason.

    facts: ``id, document_id, page, quote, line_ids, verified, context_complete, source, table_context, unit, status``; pages:
    ``document_id, page_number, text, lines``.
    """
    known = pages.select(F.col("document_id").alias("__doc"), F.col("page_number").alias("__page"), F.col("text").alias("__text"), F.col("lines.id").alias("__ids"))
    joined = facts.where("status = 'published'").join(known, (F.col("document_id") == F.col("__doc")) & (F.col("page") == F.col("__page")), "left")
    there = F.col("__doc").isNotNull()
    context = F.col("table_context")
    complete = filled(context["title"]) & filled(context["columnHeader"]) & filled(context["rowHeader"]) & (filled(context["unitLine"]) | filled(F.col("unit")))
    rules = [
        ("page_missing", ~there),
        ("line_missing", there & (F.size(F.array_except("line_ids", "__ids")) > 0)),
        ("quote_missing", there & ~verbatim(F.col("quote"), F.col("__text"))),
        ("not_verified", ~F.coalesce("verified", F.lit(False))),
        ("context_incomplete", ~F.coalesce("context_complete", F.lit(False))),
        ("table_context_missing", (F.col("source") == "table") & ~F.coalesce(complete, F.lit(False))),
    ]
    reasons = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    return joined.select("id", F.explode(reasons).alias("reason"))


def audit_summary(broken: DataFrame, examples: int = 20) -> DataFrame:
    """Per reason the number of facts and the first ids."""
    place = F.row_number().over(Window.partitionBy("reason").orderBy("id"))
    first = broken.withColumn("place", place).where(F.col("place") <= examples).groupBy("reason").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    return broken.groupBy("reason").agg(F.count("*").alias("count")).join(first, "reason").orderBy(F.col("count").desc(), "reason")
