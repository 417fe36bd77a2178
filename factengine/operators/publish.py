"""The write path: candidates of a run, the pages they come from, grounding, and the rows that are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factengine.operators import extract
from factengine.operators.grounding import document_calendars, ground
from factengine.operators.layout import bbox_of
from factengine.operators.providers import CandidateProvider
from factengine.session import written

#: Columns of a candidate as they are stored.
NAMES = {"rawValue": "raw_value", "valueType": "value_type", "attributedTo": "attributed_to", "tableContext": "table_context"}
FACT = ("id", "document_id", "page", "subject", "predicate", "raw_value", "canonical_value", "canonical_number", "unit", "value_type", "normalization_rule", "period_start", "period_end", "period_precision", "qualifiers", "modality", "attributed_to", "source", "table_context", "quote", "line_ids", "bbox", "verified", "context_complete", "status", "rejection_reason", "rejection_detail", "confidence", "salience", "pipeline_version")


def candidates_of(pages: DataFrame, provider: CandidateProvider | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates of pages with their tables rebuilt, and ``(document_id, batch_id, first_page)`` of the batches.

    Batches of prose are stored, since both results read them.
    """
    prose, tables = written(extract.prose_batches(pages), "prose_batches"), extract.table_batches(extract.table_inputs(pages))
    found = extract.generate(extract.prose_payloads(prose).unionByName(extract.table_payloads(tables)), provider)
    first = lambda batches: batches.groupBy("document_id", F.col("id").alias("batch_id")).agg(F.min("page_number").alias("first_page"))
    return found, first(prose).unionByName(first(tables))


def locate(found: DataFrame, pages: DataFrame, batches: DataFrame) -> DataFrame:
    """``found`` with ``page``: the page that has the first cited line, else the first page of the batch. Problems, and
    candidates that have neither, are left out."""
    owners = pages.select("document_id", "page_number", F.explode("lines.id").alias("line")).groupBy("document_id", "line").agg(F.min("page_number").alias("owner"))
    cited = found.where("candidate is not null").withColumn("line", F.get("candidate.evidence.lineIds", F.lit(0)))
    placed = cited.join(owners, ["document_id", "line"], "left").join(batches, ["document_id", "batch_id"], "left")
    there = placed.withColumn("page", F.coalesce("owner", "first_page")).drop("line", "owner", "first_page")
    return there.where("page is not null")


def to_facts(located: DataFrame, pages: DataFrame, pipeline_version: str) -> DataFrame:
    """Rows of the facts table from located candidates: grounded on their page, dated by their document's calendar, with the
    box of the cited lines, their salience and an id made of what they say and where.

    Grounded rows are stored without their pages before salience, which reads them twice.
    """
    shown = pages.select("document_id", F.col("page_number").alias("page"), F.col("text").alias("page_text"), F.col("lines.id").alias("page_line_ids"), "lines")
    placed = located.select("document_id", "page", "candidate.*").join(shown, ["document_id", "page"])
    boxed = placed.withColumn("bbox", bbox_of(F.col("lines"), F.col("evidence.lineIds"))).drop("lines")
    rows = boxed.join(document_calendars(pages), "document_id", "left")
    out = written(ground(rows).drop("page_text", "page_line_ids", "fiscal_month_day"), "grounded").withColumnsRenamed(NAMES)
    out = out.withColumns({"quote": F.col("evidence.quote"), "line_ids": F.col("evidence.lineIds"), "pipeline_version": F.lit(pipeline_version)})
    out = out.withColumns({f"period_{c}": F.col(f"period.{c}") for c in ("start", "end", "precision")})
    told = F.to_json(F.struct("pipeline_version", "document_id", "page", "subject", "predicate", "raw_value", "unit", "value_type", "quote", "line_ids"))
    return extract.with_salience(out.withColumn("id", F.sha2(told, 256))).select(*FACT)
