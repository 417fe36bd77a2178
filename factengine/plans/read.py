"""Read models: counts, coverage, lists and single rows, showcase cases, search, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factengine.functions.text import clamp_limit, clamp_offset
from factengine.schemas import STATUS, VERDICT, one_of
from factengine.sources.intake import newest

#: The order in which verdicts of equal confidence are shown.
VERDICT_RANK = ("contradicts", "reconciles", "corroborates", "insufficient")
INTAKE_REFUSALS = ("not_a_pdf", "encrypted", "corrupted", "scanned_unsupported")


def fact_totals(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Published and rejected facts per document, 0 where there are none."""
    counts = facts.groupBy("document_id").agg(F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return documents.select("document_id").join(counts, "document_id", "left").select("document_id", zero("published"), zero("rejected"))


def coverage(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``(document_id, page_count, parsed, failed)`` in one pass over the pages."""
    counts = pages.groupBy("document_id").agg(F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(F.col("status") == "failed").alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return documents.select("document_id", "page_count").join(counts, "document_id", "left").select("document_id", "page_count", zero("parsed"), zero("failed"))


def survival(published: Column, rejected: Column) -> Column:
    """Published share in whole per cent, halves up; null without facts."""
    total = published + rejected
    return F.when(total > 0, F.floor(100.0 * published / total + 0.5).cast("int"))


def verdict_counts(edges: DataFrame) -> DataFrame:
    """One row with a count for every verdict."""
    return edges.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICT))


def rejection_tally(facts: DataFrame) -> DataFrame:
    """Rejections per reason, most first."""
    return facts.where("status = 'rejected'").groupBy("rejection_reason").agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "rejection_reason")


def busiest_pages(facts: DataFrame) -> DataFrame:
    """Per document the page with most published facts, of equals the first."""
    counts = facts.where("status = 'published'").groupBy("document_id", "page").agg(F.count("*").alias("count"))
    best = counts.groupBy("document_id").agg(F.max_by(F.struct("page", "count"), F.struct("count", -F.col("page"))).alias("b"))
    return best.select("document_id", "b.page", "b.count")


def shown(facts: DataFrame) -> DataFrame:
    """Facts without their vectors, which only retrieval reads."""
    return facts.drop("embedding")


def list_facts(facts: DataFrame, status: str | None = None, limit: float | None = None, offset: float | None = None) -> DataFrame:
    """A page of facts, most salient first; the id breaks ties. Limits are clamped, an unknown status is an error."""
    if one_of(status, STATUS, "status"):
        facts = facts.where(F.col("status") == status)
    ordered = shown(facts).orderBy(F.col("salience").desc_nulls_last(), F.col("confidence").desc_nulls_last(), "page", "id")
    return ordered.offset(clamp_offset(offset)).limit(clamp_limit(limit))


def list_edges(edges: DataFrame, verdict: str | None = None, limit: float | None = None) -> DataFrame:
    """A page of edges: the surest, those then by verdict."""
    if one_of(verdict, VERDICT, "verdict"):
        edges = edges.where(F.col("verdict") == verdict)
    rank = F.array_position(F.array(*map(F.lit, VERDICT_RANK)), F.col("verdict"))
    first = edges.orderBy(F.col("confidence").desc_nulls_last(), "id").limit(clamp_limit(limit, 100))
    return first.orderBy(rank, F.col("confidence").desc_nulls_last(), "id")


def edges_touching(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with a fact of the set on either side, each once."""
    ids = facts.select("id").distinct()
    parts = [edges.join(ids.withColumnRenamed("id", side), side, "left_semi").select(*edges.columns) for side in ("source_id", "target_id")]
    return parts[0].unionByName(parts[1]).dropDuplicates(["id"])


def hydrate(links: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Links with ``source`` and ``target`` structs of facts; a side that isn't there is null."""
    for side in ("source", "target"):
        body = facts.select(F.col("id").alias(f"{side}_id"), F.struct("id", *columns).alias(side))
        links = links.join(body, f"{side}_id", "left")
    return links


def search(rows: DataFrame, needle: str, *fields: str) -> DataFrame:
    """Rows that have a text, in whatever case, in their fields joined by spaces; null counts as empty."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    return rows.where(F.lower(text).contains(needle.strip().lower()))


def current_documents(documents: DataFrame, version: str) -> DataFrame:
    """Documents of the current version, and failed ones that never got a version."""
    return documents.where((F.col("pipeline_version") == version) | ((F.col("status") == "failed") & F.col("pipeline_version").isNull()))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Per document its newest job that is queued or running."""
    return newest(jobs.where(F.col("status").isin("queued", "running")), "document_id", F.col("created_at").desc(), F.col("id").desc())


def reuse(documents: DataFrame, jobs: DataFrame, version: str) -> DataFrame:
    """``(document_id, outcome, job_id)`` for an upload of known bytes."""
    same = (F.col("status") == "ready") & (F.col("pipeline_version") == version)
    outcome = F.when(same, "reused").when(F.col("failure_reason").isin(*INTAKE_REFUSALS), "refused").otherwise("reprocessing")
    active = latest_jobs(jobs).select("document_id", F.col("id").alias("job_id"))
    joined = documents.withColumn("outcome", outcome).join(active, "document_id", "left")
    return joined.select("document_id", "outcome", F.when(F.col("outcome") == "reprocessing", F.col("job_id")).alias("job_id"))


def stage_state(stage: str, job_stage: Column, job_status: Column, produced: Column) -> Column:
    """How a stage stands given a document's job: done, working, waiting or stopped."""
    order = F.array(*map(F.lit, ("parse", "extract", "relate")))
    own, now = F.array_position(order, F.lit(stage)), F.array_position(order, job_stage)
    return (
        F.when((job_status == "completed") | (own < now), "done")
        .when((own == now) & (job_status == "failed"), "stopped")
        .when((own == now) & (job_status == "running"), "working")
        .when(job_status.isNull() & produced, "done")
        .otherwise("waiting")
    )


def failed_pages(pages: DataFrame) -> DataFrame:
    return pages.where("status = 'failed'").orderBy("document_id", "page_number")


def batch_summary(batches: DataFrame) -> DataFrame:
    """Per document the batches' counters in one row: sums, the largest page count, all skips; all pages failed is an error."""
    out = batches.groupBy("document_id").agg(F.sum("parsed").alias("parsed"), F.sum("failed").alias("failed"), F.max("page_count").alias("page_count"), F.flatten(F.collect_list("skips")).alias("skips"))
    return out.withColumn("parsed", F.when((F.col("parsed") == 0) & (F.col("failed") > 0), F.raise_error("every page failed").cast("long")).otherwise(F.col("parsed")))


def showcase(edges: DataFrame, facts: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``(case, kind, id)``: the best example of each of four cases, by confidence; a missing case has no row."""
    sure = F.col("confidence").desc_nulls_last()
    pick = lambda df, case, kind, *order: df.orderBy(*order).limit(1).select(F.lit(case).alias("case"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
    failures = (
        documents.where(F.col("failure_reason").isin(*INTAKE_REFUSALS)).select(F.lit(1).alias("rank"), F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), F.lit(None).cast("double").alias("confidence"))
    ).unionByName(pages.where("status = 'failed'").select(F.lit(2).alias("rank"), F.lit("page").alias("kind"), F.concat_ws(":", "document_id", "page_number").alias("id"), F.lit(None).cast("double").alias("confidence")))
    order = F.when(F.col("rejection_reason") == "quote_not_found", 3).when(F.col("rejection_reason") == "line_not_found", 4).otherwise(5)
    failures = failures.unionByName(facts.where("status = 'rejected' and rejection_reason <> 'missing_context'").select(order.alias("rank"), F.lit("fact").alias("kind"), F.col("id").cast("string").alias("id"), "confidence"))
    worst = failures.orderBy("rank", sure, "id").limit(1).select(F.lit("failure").alias("case"), "kind", "id")
    return (
        pick(edges.where("verdict = 'corroborates' and reason_code = 'equivalent_value'"), "corroboration", "edge", sure, "id")
        .unionByName(pick(edges.where("verdict = 'contradicts'"), "contradiction", "edge", sure, "id"))
        .unionByName(pick(edges.where("verdict = 'reconciles'"), "reconciliation", "edge", F.col("prior_verdict").isNull(), sure, "id"))
        .unionByName(worst)
    )


def nest_fact() -> list[Column]:
    """The columns of a fact as the contract has them: evidence and a whole period as structs."""
    period = F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.col("period_precision").alias("precision"))
    whole = F.col("period_start").isNotNull() & F.col("period_end").isNotNull() & F.col("period_precision").isNotNull()
    return [F.struct(F.col("page").alias("page"), F.col("quote").alias("quote"), F.col("line_ids").alias("lineIds")).alias("evidence"), F.when(whole, period).alias("period")]


def flatten_fact(facts: DataFrame) -> DataFrame:
    """The inverse of :func:`nest_fact`: evidence and period as flat columns; no period gives three nulls."""
    e, p = F.col("evidence"), F.col("period")
    flat = {"page": e["page"], "quote": e["quote"], "line_ids": e["lineIds"], "period_start": p["start"], "period_end": p["end"], "period_precision": p["precision"]}
    return facts.withColumns(flat).drop("evidence", "period")


def nest_prior_pass() -> Column:
    """The first reading of an edge that a review overruled, as a struct; null unless both its columns are set."""
    whole = F.col("prior_verdict").isNotNull() & F.col("prior_explanation").isNotNull()
    return F.when(whole, F.struct(F.col("prior_verdict").alias("verdict"), F.col("prior_explanation").alias("explanation")))


def without_vector(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Facts that have no vector yet, neither in a column of their own nor in the side table."""
    open_ = facts.where("embedding is null") if "embedding" in facts.columns else facts
    return open_.join(vectors.select("id"), "id", "left_anti")


def document_summaries(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, filename, content_hash, status, page_count, pages_parsed, pages_failed)``."""
    counts = coverage(documents, pages).select("document_id", F.col("parsed").alias("pages_parsed"), F.col("failed").alias("pages_failed"))
    return documents.join(counts, "document_id").select(F.col("document_id").alias("id"), "filename", "content_hash", "status", "page_count", "pages_parsed", "pages_failed")


def list_documents(documents: DataFrame, facts: DataFrame, jobs: DataFrame, version: str) -> DataFrame:
    """Every document, newest first, with its counts of facts and its newest open job of the version, if there is one."""
    columns = [c for c in ("filename", "content_hash", "byte_size", "page_count", "status", "failure_reason", "failure_detail", "pipeline_version", "created_at") if c in documents.columns]
    job = latest_jobs(jobs.where(F.col("pipeline_version") == version)).select("document_id", F.struct("id", "stage", "status").alias("job"))
    totals = fact_totals(documents, facts).select("document_id", F.struct("published", "rejected").alias("facts"))
    return documents.select("document_id", *columns).join(totals, "document_id").join(job, "document_id", "left").orderBy(F.col("created_at").desc(), "document_id")


def page_number(value: object) -> int:
    """A page number from 1, or an error that names the value."""
    try:
        number = float(str(value))
    except ValueError:
        number = 0.0
    if not number.is_integer() or number < 1:
        raise ValueError(f"{value!r} is not a page number")
    return int(number)


def read_page(pages: DataFrame, document_id, number: object) -> DataFrame:
    """One page by its document and number; no row if it isn't there."""
    return pages.where((F.col("document_id") == document_id) & (F.col("page_number") == page_number(number)))


def read_job(jobs: DataFrame, documents: DataFrame, pages: DataFrame, job_id) -> DataFrame:
    """One job with the coverage of its document, so that a partial run shows how far it came."""
    job = jobs.where(F.col("id") == job_id)
    own = documents.join(job.select("document_id"), "document_id", "left_semi")
    counts = coverage(own, pages.join(own.select("document_id"), "document_id", "left_semi"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return job.join(counts, "document_id", "left").select(*jobs.columns, "page_count", zero("parsed"), zero("failed"))


def write_samples(documents: DataFrame, facts: DataFrame, edges: DataFrame, pages: DataFrame, version: str, folder: str) -> None:
    """The export of the smallest ready document, the four cases, and each document's busiest page, as JSON under ``folder``."""
    from factengine.plans.export import export_documents

    ready = documents.where("status = 'ready'").orderBy("page_count", "document_id").limit(1)
    export_documents(ready, pages, facts, edges, version).select("json").write.mode("overwrite").text(f"{folder}/export")
    showcase(edges, facts, pages, documents).write.mode("overwrite").json(f"{folder}/cases")
    busiest_pages(facts).write.mode("overwrite").json(f"{folder}/pages")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(missing, extra)``: rows of ``a`` that ``b`` lacks and the other way round, repeats counted; maps are not comparable."""
    b = b.select(*a.columns)
    return a.exceptAll(b).agg(F.count("*").alias("missing")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("extra")))  # single rows


def deep_diff(a: object, b: object, path: str = "") -> list[str]:
    """Paths at which two plain values differ; the order of keys does not count, a length is reported once."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in sorted({*a, *b}) for d in (deep_diff(a[k], b[k], f"{path}.{k}".lstrip(".")) if k in a and k in b else [f"{path}.{k}".lstrip(".")])]
    if isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            return [f"{path}.length".lstrip(".")]
        return [d for i, (x, y) in enumerate(zip(a, b, strict=True)) for d in deep_diff(x, y, f"{path}[{i}]")]
    return [] if a == b and type(a) is type(b) else [path or "."]
