"""The gates a candidate passes before it may be published, as column expressions.

Columns: ``subject, predicate, rawValue, unit, valueType, qualifiers, source, tableContext, evidence`` of the candidate, and
``page_text`` and ``page_line_ids`` of its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factengine.functions.text import WS, collapse, filled, strip, word

# Words in qualifier keys that make their families, and words in claims that call for context.
KEY_FAMILIES = {
    "period": "date|period|year|fiscal|fy|quarter|month|half_year",
    "geography": "geography|geographic|country|region|territory|location|market",
    "segment": "segment|division|business_unit|product_line|reportable_unit",
}
_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_FISCAL = rf"(?:{WS}*(?:fy)?{WS}*['’]?[0-9]{{2,4}})?"
PERIOD_VALUE = word(rf"fy{WS}*['’]?[0-9]{{2,4}}|q[1-4]{_FISCAL}|h[12]{_FISCAL}|(?:19|20)[0-9]{{2}}(?:{WS}*[-–/]{WS}*(?:[0-9]{{2}}|(?:19|20)[0-9]{{2}}))?|(?:{_MONTH}){WS}+(?:19|20)[0-9]{{2}}")
REVENUE = word("revenue|revenues|turnover|net sales")
GROWTH = word("growth|cagr|yoy|qoq|year[ -]over[ -]year|quarter[ -]over[ -]quarter|grew|increas(?:e|ed) by|decreas(?:e|ed) by")
GEOGRAPHIC = word("geograph(?:y|ic|ical)|region(?:al)?|countr(?:y|ies)|territor(?:y|ies)|location|by market")
SEGMENTED = word("segment(?:al)?|division|business unit|product line|reportable unit")


def key_pattern(family: str) -> str:
    return f"(?i)(?:^|_)(?:{KEY_FAMILIES[family]})(?:_|$)"


def normal_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(strip(key)), "[^a-z0-9]+", "_")


def qualifier_entries(qualifiers: Column) -> Column:
    """Entries with normal keys and trimmed values, in the map's order; a null map has none."""
    entries = F.coalesce(F.map_entries(qualifiers), F.array().cast("array<struct<key: string, value: string>>"))
    return F.transform(entries, lambda e: F.struct(normal_key(e["key"]).alias("key"), strip(F.coalesce(e["value"], F.lit(""))).alias("value")))


def table_text(context: Column) -> Column:
    parts = F.array_compact(F.concat(F.array(context["title"], context["columnHeader"], context["rowHeader"], context["unitLine"]), F.coalesce(context["footnotes"], F.array().cast("array<string>"))))
    return F.coalesce(F.array_join(F.filter(parts, filled), " \n "), F.lit(""))


def line_gate(cited: Column, page_line_ids: Column) -> Column:
    """The cited line ids that the page lacks, each once."""
    return F.array_except(cited, page_line_ids)


def verbatim(quote: Column, page_text: Column) -> Column:
    """Whether the quote stands on the page, white space aside; case and punctuation count."""
    return F.coalesce(collapse(page_text).contains(collapse(quote)), F.lit(False))


def missing_context(entries: Column, c=F.col) -> Column:
    """What a claim needs and lacks, in a fixed order. ``entries`` are its qualifiers (:func:`qualifier_entries`)."""
    context = c("tableContext")
    claim = F.concat_ws(" ", c("subject"), c("predicate"))
    told = lambda family, value: F.exists(entries, lambda e: e["key"].rlike(key_pattern(family)) & value(e["value"]))
    governing = F.concat_ws(" ", context["title"], context["columnHeader"])
    by_table = lambda pattern: F.coalesce(governing.rlike(pattern), F.lit(False)) & filled(context["rowHeader"])
    has = {
        "period": told("period", lambda v: v.rlike(PERIOD_VALUE)) | table_text(context).rlike(PERIOD_VALUE),
        "geography": told("geography", lambda v: F.length(v) > 0) | by_table(GEOGRAPHIC),
        "segment": told("segment", lambda v: F.length(v) > 0) | by_table(SEGMENTED),
    }
    in_table, growth = c("source") == "table", (c("valueType") == "percent") & claim.rlike(GROWTH)
    segmented = F.concat_ws(" ", claim, table_text(context)).rlike(SEGMENTED) | told("segment", lambda v: F.lit(True))
    rules = [
        ("table_title", in_table & ~filled(context["title"])),
        ("table_column_header", in_table & ~filled(context["columnHeader"])),
        ("table_row_header", in_table & ~filled(context["rowHeader"])),
        ("table_unit", in_table & ~filled(context["unitLine"]) & ~filled(c("unit"))),
        ("period", (claim.rlike(REVENUE) | growth) & ~has["period"]),
        ("geography", growth & ~has["geography"]),
        ("segment", segmented & ~has["segment"]),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules)))


def apply_gates(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``verified, context_complete, gate_reason, gate_detail``.

    A line or quote that is not on the page comes first, and still tells whether the context was complete.
    """
    out = candidates.withColumn("__lines", line_gate(F.col("evidence.lineIds"), F.col("page_line_ids")))
    out = out.withColumn("__quoted", verbatim(F.col("evidence.quote"), F.col("page_text"))).withColumn("__entries", qualifier_entries(F.col("qualifiers")))
    out = out.withColumn("__missing", missing_context(F.col("__entries")))
    no_line, incomplete = F.size("__lines") > 0, F.size("__missing") > 0
    reason = F.when(no_line, "line_not_found").when(~F.col("__quoted"), "quote_not_found").when(incomplete, "missing_context")
    detail = (
        F.when(no_line, F.concat(F.lit("cited lines are not on the page: "), F.array_join("__lines", ", ")))
        .when(~F.col("__quoted"), F.lit("the quote is not on the page"))
        .when(incomplete, F.concat(F.lit("missing required context: "), F.array_join("__missing", ", ")))
    )
    return out.withColumns({"verified": ~no_line & F.col("__quoted"), "context_complete": ~incomplete, "gate_reason": reason, "gate_detail": detail}).drop("__lines", "__quoted", "__entries", "__missing")
