"""The export: one JSON document per source document with everything a reader needs to check it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factengine.plans.read import current_documents, document_summaries, nest_prior_pass
from factengine.schemas import assert_facts

# Names of the exported fields and the columns they come from.
FACT = {"id": "id", "documentId": "document_id", "page": "page", "subject": "subject", "predicate": "predicate", "rawValue": "raw_value", "canonicalValue": "canonical_value", "canonicalNumber": "canonical_number", "unit": "unit", "valueType": "value_type", "normalizationRule": "normalization_rule"}
FACT_REST = {"qualifiers": "qualifiers", "modality": "modality", "attributedTo": "attributed_to", "source": "source", "tableContext": "table_context", "confidence": "confidence", "salience": "salience", "pipelineVersion": "pipeline_version", "status": "status", "verified": "verified", "contextComplete": "context_complete", "rejectionReason": "rejection_reason", "rejectionDetail": "rejection_detail"}
EVIDENCE = {"quote": "quote", "lineIds": "line_ids", "bbox": "bbox"}
EDGE = {"id": "id", "sourceAssertionId": "source_id", "targetAssertionId": "target_id", "verdict": "verdict", "reasonCode": "reason_code", "matchedFields": "matched_fields", "mismatchedFields": "mismatched_fields", "explanation": "explanation", "confidence": "confidence"}
SUMMARY = {"id": "id", "filename": "filename", "contentHash": "content_hash", "status": "status", "pageCount": "page_count", "pagesParsed": "pages_parsed", "pagesFailed": "pages_failed"}
CHECKED = ("status", "verified", "context_complete", "rejection_reason", "value_type")


def _fields(df: DataFrame, names: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(name) for name, c in names.items() if c in df.columns]


def _fact(facts: DataFrame) -> Column:
    bounds = {"start": "period_start", "end": "period_end", "precision": "period_precision"}
    whole = F.lit(True)
    for c in bounds.values():
        whole &= F.col(c).isNotNull()
    period = F.when(whole, F.struct(*_fields(facts, bounds))).alias("period")
    evidence = F.struct(*_fields(facts, EVIDENCE)).alias("evidence")
    return F.struct(*_fields(facts, FACT), period, *_fields(facts, FACT_REST), evidence)


def _gathered(rows: DataFrame, row: Column, name: str) -> DataFrame:
    """``(document_id, name)``: the rows of each document, by their first field."""
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias(name))


def edges_of(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with ``document_id``, once for each document that has a fact on either side."""
    owners = facts.select("id", "document_id")
    sides = [edges.select("id", F.col(side).alias("fact")).join(owners.withColumnRenamed("id", "fact"), "fact").select("id", "document_id") for side in ("source_id", "target_id")]
    return sides[0].unionByName(sides[1]).distinct().join(edges.drop("document_id"), "id")


def _without_maps(facts: DataFrame) -> DataFrame:
    """Maps as JSON texts, since arrays of rows with maps have no order; they are read back into maps on the way out."""
    maps = {c: F.to_json(c) for c, kind in facts.dtypes if kind.startswith("map<")}
    return facts.withColumns(maps) if maps else facts


def export_documents(documents: DataFrame, pages: DataFrame, facts: DataFrame, edges: DataFrame, version: str, exported_at: Column | None = None) -> DataFrame:
    """``(document_id, json)`` of the documents of the current version and of those that failed before they had one.

    Each has its summary with coverage, its published facts, the edges that touch them, and its failures: of the document,
    of pages, and rejected facts with their reasons. Facts and edges are those of the version. A fact that breaks an
    invariant of the table fails the job, where the columns that tell are there.
    """
    own = lambda df: df.where(F.col("pipeline_version") == version) if "pipeline_version" in df.columns else df
    current = current_documents(documents, version)
    ids = current.select("document_id")
    held = own(facts).join(ids, "document_id", "left_semi")
    held = assert_facts(held) if set(CHECKED) <= set(held.columns) else held
    flat = _without_maps(held)
    whole = _gathered(flat, _fact(flat), "rows")
    touching = edges_of(own(edges), held)
    prior = [nest_prior_pass().alias("priorPass")] if {"prior_verdict", "prior_explanation"} <= set(edges.columns) else []
    linked = _gathered(touching, F.struct(*_fields(touching, EDGE), *prior), "edges")
    failed_pages = pages.where("status = 'failed'")
    broken = _gathered(failed_pages, F.struct(F.col("page_number").alias("page"), "document_id", *_fields(failed_pages, {"reason": "failure_reason", "detail": "failure_detail"})), "pages")
    columns = current.columns
    for c in ("filename", "content_hash"):
        current = current if c in columns else current.withColumn(c, F.lit(None).cast("string"))
    summary = document_summaries(current, pages).select(F.col("id").alias("document_id"), F.struct(*(F.col(c).alias(name) for name, c in SUMMARY.items())).alias("summary"))
    out = current.join(summary, "document_id").join(whole, "document_id", "left").join(linked, "document_id", "left").join(broken, "document_id", "left")
    none = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType))
    rows = none("rows", whole)
    failure = F.struct(F.col("document_id").alias("documentId"), "filename", F.col("failure_reason").alias("reason"), *([F.col("failure_detail").alias("detail")] if "failure_detail" in columns else []))
    body = F.struct(
        F.lit(version).alias("pipelineVersion"),
        (F.current_timestamp() if exported_at is None else exported_at).cast("timestamp").alias("exportedAt"),
        F.array("summary").alias("documents"),
        F.filter(rows, lambda r: r["status"] == "published").alias("facts"),
        none("edges", linked).alias("edges"),
        F.struct(
            F.when((F.col("status") == "failed") & F.col("failure_reason").isNotNull(), F.array(failure)).otherwise(F.array().cast(f"array<{_kind(out, failure)}>")).alias("documents"),
            none("pages", broken).alias("pages"),
            F.filter(rows, lambda r: r["status"] == "rejected").alias("assertions"),
        ).alias("failures"),
    )
    return out.select("document_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def _kind(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()
