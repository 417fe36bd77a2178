"""Queries over stores, read models, export and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factengine.plans import read
from factengine.plans.derived import customer_documents, customer_pages, event_jobs, order_edges, order_facts, stored_facts, table
from factengine.plans.export import export_documents
from factengine.plans.registry import query
from factengine.session import new_folder
from factengine.sources import store

_FACTS = """
f AS (
  SELECT o_orderkey AS id, o_custkey AS document_id, (o_orderkey % 7 + 1)::INT AS page, CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'published' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN ['quote_not_found', 'line_not_found', 'missing_context', 'value_not_in_source', 'normalization_failed'][(o_orderkey % 5 + 1)::INT] END AS rejection_reason,
    CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 89) / 100.0::DOUBLE END AS salience, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 97) / 100.0::DOUBLE END AS confidence,
    'order of ' || o_orderpriority AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'v2' ELSE 'v1' END AS pipeline_version
  FROM orders
)"""
_EDGES = """
e AS (
  SELECT o_orderkey AS id, o_orderkey AS source_id, o_orderkey + 1 AS target_id, ['corroborates', 'contradicts', 'reconciles', 'insufficient'][(o_orderkey // 3 % 4 + 1)::INT] AS verdict,
    ['equivalent_value', 'value_conflict', 'vintage_difference', 'missing_context'][(o_orderkey // 3 % 4 + 1)::INT] AS reason_code, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 97) / 100.0::DOUBLE END AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'contradicts' END AS prior_verdict
  FROM orders
)"""
_DOCS = """
d AS (
  SELECT c_custkey AS document_id, (c_nationkey + 1)::INT AS page_count, CASE WHEN c_custkey % 17 = 0 THEN 'failed' WHEN c_custkey % 4 = 0 THEN 'parsing' ELSE 'ready' END AS status,
    CASE WHEN c_custkey % 17 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'encrypted' ELSE 'parse_failed' END END AS failure_reason, CASE WHEN c_custkey % 17 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'v1' ELSE 'v2' END END AS pipeline_version
  FROM customer
), p AS (
  SELECT c_custkey AS document_id, n AS page_number, CASE WHEN (c_custkey + n) % 9 = 0 THEN 'failed' ELSE 'parsed' END AS status FROM customer, LATERAL (SELECT unnest(range(1, c_nationkey + 2)) AS n)
)"""
_JOBS = """
j AS (
  SELECT event_id AS id, user_id AS document_id, ts AS created_at, ['queued', 'running', 'completed', 'failed'][(event_id % 4 + 1)::INT] AS status, ['parse', 'extract', 'relate'][(event_id % 3 + 1)::INT] AS stage FROM events
)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_facts(table(spark, sf_dir, "orders"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_edges(table(spark, sf_dir, "orders"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_documents(table(spark, sf_dir, "customer"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_pages(table(spark, sf_dir, "customer"))


@query(f"WITH {_FACTS}, {_DOCS} SELECT d.document_id, count(*) FILTER (f.status = 'published') AS published, count(*) FILTER (f.status = 'rejected') AS rejected FROM d LEFT JOIN f USING (document_id) GROUP BY ALL")
def fact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.fact_totals(_documents(spark, sf_dir), _facts(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT d.document_id, page_count, count(*) FILTER (p.status = 'parsed') AS parsed, count(*) FILTER (p.status = 'failed') AS failed FROM d LEFT JOIN p USING (document_id) GROUP BY ALL")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.coverage(_documents(spark, sf_dir), _pages(spark, sf_dir))


@query(f"WITH {_FACTS}, t AS (SELECT document_id, count(*) FILTER (status = 'published') AS p, count(*) AS n FROM f GROUP BY ALL) SELECT document_id, floor(100.0::DOUBLE * p / n + 0.5)::INT AS share FROM t")
def survival_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole per cent of a document's facts that were published."""
    facts = _facts(spark, sf_dir)
    return read.fact_totals(facts.select("document_id").distinct(), facts).select("document_id", read.survival(F.col("published"), F.col("rejected")).alias("share"))


@query(f"WITH {_EDGES} SELECT count(*) FILTER (verdict = 'corroborates') AS corroborates, count(*) FILTER (verdict = 'contradicts') AS contradicts, count(*) FILTER (verdict = 'reconciles') AS reconciles, count(*) FILTER (verdict = 'insufficient') AS insufficient FROM e")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.verdict_counts(_edges(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT rejection_reason, count(*) AS count FROM f WHERE status = 'rejected' GROUP BY ALL")
def rejection_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.rejection_tally(_facts(spark, sf_dir))


@query(f"WITH {_FACTS}, c AS (SELECT document_id, page, count(*) AS count FROM f WHERE status = 'published' GROUP BY ALL) SELECT document_id, page, count FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY count DESC, page) = 1")
def busiest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.busiest_pages(_facts(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT id, page, salience, confidence FROM f WHERE status = 'published' ORDER BY salience DESC NULLS LAST, confidence DESC NULLS LAST, page, id LIMIT 50 OFFSET 100")
def facts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty published facts (a top-k report)."""
    return read.list_facts(_facts(spark, sf_dir), "published", None, 100).select("id", "page", "salience", "confidence")


@query(f"WITH {_FACTS} SELECT status, count(*) AS total FROM f GROUP BY ALL")
def facts_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("total"))


@query(f"WITH {_EDGES} SELECT id, verdict, confidence FROM e WHERE verdict = 'contradicts' ORDER BY confidence DESC NULLS LAST, id LIMIT 100")
def edges_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred surest contradictions (a top-k report)."""
    return read.list_edges(_edges(spark, sf_dir), "contradicts").select("id", "verdict", "confidence")


@query(f"WITH {_EDGES}, {_FACTS} SELECT id, verdict FROM e WHERE source_id IN (SELECT id FROM f WHERE document_id % 50 = 7) OR target_id IN (SELECT id FROM f WHERE document_id % 50 = 7)")
def edges_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with one end in a set of documents."""
    return read.edges_touching(_edges(spark, sf_dir), _facts(spark, sf_dir).where("document_id % 50 = 7")).select("id", "verdict")


@query(f"WITH {_EDGES}, {_FACTS} SELECT e.id, s.subject AS source_subject, t.subject AS target_subject FROM e LEFT JOIN f s ON s.id = e.source_id LEFT JOIN f t ON t.id = e.target_id")
def hydrate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both sides' facts; the last target is missing and null."""
    out = read.hydrate(_edges(spark, sf_dir), _facts(spark, sf_dir), "subject")
    return out.select("id", F.col("source.subject").alias("source_subject"), F.col("target.subject").alias("target_subject"))


@query(f"WITH {_FACTS} SELECT id FROM f WHERE contains(lower(subject), 'urgent')")
def search_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.search(_facts(spark, sf_dir), " URGENT", "subject", "predicate", "raw_value").select("id")


@query(f"WITH {_DOCS} SELECT document_id, status FROM d WHERE pipeline_version = 'v2' OR (status = 'failed' AND pipeline_version IS NULL)")
def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.current_documents(_documents(spark, sf_dir), "v2").select("document_id", "status")


@query(f"WITH {_JOBS} SELECT document_id, id, status, stage FROM j WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest open job of each document."""
    return read.latest_jobs(event_jobs(table(spark, sf_dir, "events"))).select("document_id", "id", "status", "stage")


@query(
    f"""
WITH {_DOCS}, {_JOBS}, l AS (SELECT document_id, id FROM j WHERE status IN ('queued', 'running') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1),
o AS (SELECT document_id, CASE WHEN status = 'ready' AND pipeline_version = 'v2' THEN 'reused' WHEN failure_reason = 'encrypted' THEN 'refused' ELSE 'reprocessing' END AS outcome FROM d)
SELECT o.document_id, outcome, CASE WHEN outcome = 'reprocessing' THEN l.id END AS job_id FROM o LEFT JOIN l USING (document_id)
"""
)
def reuse_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to an upload whose bytes are known."""
    return read.reuse(_documents(spark, sf_dir), event_jobs(table(spark, sf_dir, "events")), "v2")


@query(
    f"""
WITH {_JOBS} SELECT stage, status, CASE WHEN status = 'completed' OR stage = 'relate' THEN 'done' WHEN stage = 'extract' AND status = 'failed' THEN 'stopped' WHEN stage = 'extract' AND status = 'running' THEN 'working' ELSE 'waiting' END AS state, count(*) AS n FROM j GROUP BY ALL
"""
)
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How extraction stands, by a document's job."""
    jobs = event_jobs(table(spark, sf_dir, "events"))
    state = read.stage_state("extract", F.col("stage"), F.col("status"), F.lit(True))
    return jobs.groupBy("stage", "status", state.alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT document_id, page_number FROM p WHERE status = 'failed'")
def failed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.failed_pages(_pages(spark, sf_dir)).select("document_id", "page_number")


@query(
    f"""
WITH {_DOCS} SELECT document_id, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'failed') AS failed, max(page_number)::BIGINT AS page_count, count(*) FILTER (status = 'failed')::INT AS skips FROM p GROUP BY document_id HAVING parsed > 0
"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of three pages, reduced to one row per document."""
    pages = _pages(spark, sf_dir)
    failed = F.col("status") == "failed"
    batches = pages.groupBy("document_id", F.floor(F.col("page_number") / 3).alias("batch")).agg(F.count_if(~failed).alias("parsed"), F.count_if(failed).alias("failed"), F.max(F.col("page_number").cast("long")).alias("page_count"), F.collect_list(F.when(failed, F.col("page_number"))).alias("skips"))
    whole = batches.join(batches.groupBy("document_id").agg(F.sum("parsed").alias("n")).where("n > 0"), "document_id", "left_semi")
    return read.batch_summary(whole).select("document_id", "parsed", "failed", "page_count", F.size("skips").alias("skips"))


@query(
    f"""
WITH {_EDGES}, {_DOCS}
SELECT * FROM (SELECT 'corroboration' AS "case", 'edge' AS kind, id::VARCHAR AS id FROM e WHERE verdict = 'corroborates' AND reason_code = 'equivalent_value' ORDER BY confidence DESC NULLS LAST, e.id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'contradiction', 'edge', id::VARCHAR FROM e WHERE verdict = 'contradicts' ORDER BY confidence DESC NULLS LAST, e.id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'reconciliation', 'edge', id::VARCHAR FROM e WHERE verdict = 'reconciles' ORDER BY prior_verdict IS NULL, confidence DESC NULLS LAST, e.id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'failure', 'document', document_id::VARCHAR FROM d WHERE failure_reason = 'encrypted' ORDER BY document_id::VARCHAR LIMIT 1)
"""
)
def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best example of each of four cases (a top-1 report)."""
    return read.showcase(_edges(spark, sf_dir), _facts(spark, sf_dir), _pages(spark, sf_dir), _documents(spark, sf_dir))


# --- stores ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_EDGES} SELECT id, source_id, target_id, CASE WHEN id % 2 = 0 THEN 'insufficient' ELSE verdict END AS verdict FROM e UNION ALL SELECT -id, source_id, target_id + 1, 'reconciles' FROM e WHERE id % 10 = 1")
def edges_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the edges judged anew, twice, and some new ones: the last verdict wins, ids stay."""
    stored = _edges(spark, sf_dir).select("id", "source_id", "target_id", "verdict")
    again = stored.where("id % 2 = 0").select((F.col("id") + 1_000_000).alias("id"), "source_id", "target_id", F.explode(F.array(F.struct(F.lit("contradicts").alias("verdict"), F.lit(1).alias("version")), F.struct(F.lit("insufficient").alias("verdict"), F.lit(2).alias("version")))).alias("v")).select("id", "source_id", "target_id", "v.verdict", "v.version")
    new = stored.where("id % 10 = 1").select((-F.col("id")).alias("id"), "source_id", (F.col("target_id") + 1).alias("target_id"), F.lit("reconciles").alias("verdict"), F.lit(1).alias("version"))
    return store.upsert(stored, again.unionByName(new))


@query(f"WITH {_EDGES}, {_FACTS} SELECT id FROM e WHERE source_id NOT IN (SELECT id FROM f WHERE document_id % 9 = 0) AND target_id NOT IN (SELECT id FROM f WHERE document_id % 9 = 0)")
def stage_clear_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left after the documents of a ninth were cleared."""
    return store.clear_relations(_edges(spark, sf_dir), _facts(spark, sf_dir).where("document_id % 9 = 0")).select("id")


@query(f"WITH {_FACTS} SELECT id FROM f WHERE NOT (document_id = 7 AND pipeline_version = 'v2')")
def stage_clear_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.clear_facts(_facts(spark, sf_dir), 7, "v2").select("id")


@query(f"WITH {_DOCS} SELECT document_id, page_number FROM p WHERE NOT (document_id = 7 AND page_number > 2 AND page_number <= 4)")
def stage_clear_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.clear_pages(_pages(spark, sf_dir), 7, 2, 4).select("document_id", "page_number")


@query("SELECT min(s_suppkey) AS id, s_nationkey AS content_hash, s_nationkey >= 10 AS inserted FROM supplier GROUP BY s_nationkey")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation: the first of each, and whether it is new."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("content_hash"))
    return store.insert_or_ignore(s.where("content_hash < 10").select("content_hash").distinct(), s, "content_hash", F.col("id"))


@query("SELECT vec_id AS id, vec_id % 2 = 0 AS updated FROM embeddings")
def vector_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vectors for every second row."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    new = v.where("id % 2 = 0").select("id", F.array(F.lit(9.0)).cast("array<float>").alias("embedding"))
    return store.write_back(v, new).select("id", (F.size("embedding") == 1).alias("updated"))


@query(f"WITH {_EDGES}, v AS (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) SELECT id FROM e WHERE id NOT IN (SELECT vec_id FROM v)")
def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have no vector yet, by an anti join against the side table."""
    have = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"))
    return read.without_vector(_edges(spark, sf_dir), have).select("id")


_EXPORTED = "struct<documents: array<struct<pagesParsed: bigint, pagesFailed: bigint, filename: string>>, facts: array<struct<id: bigint, rawValue: string, period: struct<start: string>, evidence: struct<quote: string>, qualifiers: string>>, edges: array<struct<id: bigint, priorPass: struct<verdict: string>>>, failures: struct<documents: array<struct<reason: string>>, pages: array<struct<page: int, reason: string>>, assertions: array<struct<id: bigint, rejectionReason: string>>>>"


@query(
    f"""
WITH {_FACTS}, {_EDGES}, {_DOCS},
c AS (SELECT * FROM d WHERE pipeline_version = 'v2' OR (status = 'failed' AND pipeline_version IS NULL)),
w AS (SELECT document_id, count(*) FILTER (status = 'published') AS facts, count(*) FILTER (status = 'published' AND id % 4 = 0) AS dated, count(*) FILTER (status = 'rejected') AS rejected, coalesce(sum(id) FILTER (status = 'published'), 0) AS id_sum FROM f WHERE pipeline_version = 'v2' GROUP BY ALL),
t AS (SELECT DISTINCT f.document_id, e.id FROM e JOIN f ON f.pipeline_version = 'v2' AND (f.id = e.source_id OR f.id = e.target_id) WHERE e.id % 4 <> 0),
l AS (SELECT document_id, count(*) AS edges, count(*) FILTER (id % 10 = 0) AS priors FROM t GROUP BY ALL),
g AS (SELECT document_id, count(*) FILTER (status = 'parsed') AS parsed, count(*) FILTER (status = 'failed') AS failed, sum(page_number) FILTER (status = 'failed') AS failed_sum FROM p GROUP BY ALL)
SELECT c.document_id, g.parsed, g.failed, coalesce(g.failed_sum, 0)::BIGINT AS failed_sum, c.failure_reason, coalesce(facts, 0) AS facts, coalesce(dated, 0) AS dated, coalesce(rejected, 0) AS rejected, coalesce(id_sum, 0)::BIGINT AS id_sum, coalesce(edges, 0) AS edges, coalesce(priors, 0) AS priors
FROM c LEFT JOIN w USING (document_id) LEFT JOIN l USING (document_id) LEFT JOIN g USING (document_id)
"""
)
def export_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per customer of the current version, read again and counted."""
    orders = table(spark, sf_dir, "orders")
    out = export_documents(_documents(spark, sf_dir), _pages(spark, sf_dir), stored_facts(orders), order_edges(orders), "v2")
    j = out.select("document_id", F.from_json("json", _EXPORTED).alias("j"))
    size = lambda c: F.size(c).cast("long")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    dated = F.filter("j.facts", lambda f: f["period"].isNotNull())
    priors = F.filter("j.edges", lambda e: e["priorPass"].isNotNull())
    return j.select(
        "document_id",
        F.col("j.documents")[0]["pagesParsed"].alias("parsed"),
        F.col("j.documents")[0]["pagesFailed"].alias("failed"),
        total(F.transform("j.failures.pages", lambda p: p["page"].cast("long"))).alias("failed_sum"),
        F.get("j.failures.documents.reason", F.lit(0)).alias("failure_reason"),
        size("j.facts").alias("facts"),
        size(dated).alias("dated"),
        size("j.failures.assertions").alias("rejected"),
        total("j.facts.id").alias("id_sum"),
        size("j.edges").alias("edges"),
        size(priors).alias("priors"),
    )


@query(f"WITH {_DOCS} SELECT d.document_id AS id, c_name || '.pdf' AS filename, sha256(c_name) AS content_hash, d.status, page_count, count(*) FILTER (p.status = 'parsed') AS pages_parsed, count(*) FILTER (p.status = 'failed') AS pages_failed FROM d JOIN customer ON c_custkey = d.document_id LEFT JOIN p USING (document_id) GROUP BY ALL")
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.document_summaries(_documents(spark, sf_dir), _pages(spark, sf_dir))


@query(
    f"""
WITH {_DOCS}, {_FACTS}, {_JOBS}, t AS (SELECT document_id, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'rejected') AS rejected FROM f GROUP BY ALL),
o AS (SELECT document_id, id, stage FROM j WHERE status IN ('queued', 'running') AND id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1)
SELECT d.document_id, d.document_id * 1000 AS byte_size, d.status, DATE '2024-01-01' + (d.document_id % 400)::INT AS created_at, coalesce(published, 0) AS published, coalesce(rejected, 0) AS rejected, o.id AS job_id, o.stage FROM d LEFT JOIN t USING (document_id) LEFT JOIN o USING (document_id)
"""
)
def documents_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, newest first, with their counts and open jobs."""
    out = read.list_documents(_documents(spark, sf_dir), _facts(spark, sf_dir), event_jobs(table(spark, sf_dir, "events")), "v2")
    return out.select("document_id", "byte_size", "status", "created_at", "facts.published", "facts.rejected", F.col("job.id").alias("job_id"), "job.stage")


@query(f"WITH {_DOCS} SELECT document_id, page_number, status FROM p WHERE document_id = 7 AND page_number = 2")
def page_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of one document (a look-up)."""
    return read.read_page(_pages(spark, sf_dir), 7, "2").select("document_id", "page_number", "status")


@query(
    f"""
WITH {_DOCS}, {_JOBS}, one AS (SELECT * FROM j WHERE id = 42)
SELECT one.id, one.document_id, one.stage, one.status, max(d.page_count) AS page_count, count(*) FILTER (p.status = 'parsed') AS parsed, count(*) FILTER (p.status = 'failed') AS failed FROM one LEFT JOIN d USING (document_id) LEFT JOIN p USING (document_id) GROUP BY ALL
"""
)
def job_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job with its document's coverage (a look-up)."""
    out = read.read_job(event_jobs(table(spark, sf_dir, "events")), _documents(spark, sf_dir), _pages(spark, sf_dir), 42)
    return out.select("id", "document_id", "stage", "status", "page_count", "parsed", "failed")


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS extra")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts nested, written, read back and flattened again are the same facts."""
    from factengine.sources.store import Store

    facts = _facts(spark, sf_dir).withColumns({"quote": F.col("subject"), "line_ids": F.array(F.lit("p1l1")), "period_start": F.when(F.col("id") % 2 == 0, F.lit("2024-01-01").cast("date")), "period_end": F.lit("2024-12-31").cast("date"), "period_precision": F.lit("year")})
    whole = F.col("period_start").isNotNull()
    facts = facts.withColumns({c: F.when(whole, F.col(c)) for c in ("period_end", "period_precision")})
    nested = facts.select(*(c for c in facts.columns if c not in ("page", "quote", "line_ids", "period_start", "period_end", "period_precision")), *read.nest_fact())
    return read.differences(facts, read.flatten_fact(Store(spark, new_folder(spark, "round-trip")).write("facts", nested)))


@query(f"WITH {_EDGES} SELECT id, CASE WHEN id % 10 = 0 THEN 'contradicts' END AS prior FROM e")
def nest_prior_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior pass only where both of its columns are set."""
    return _edges(spark, sf_dir).withColumn("p", read.nest_prior_pass()).select("id", F.col("p.verdict").alias("prior"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS count FROM events GROUP BY ALL")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events, by the same expression that runs on a stream."""
    from factengine.streaming.intake import stream_counts

    return stream_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("hour"), "event_type", "count")


@query("SELECT count(DISTINCT coalesce(text, '')) AS documents, count(DISTINCT coalesce(text, '')) AS contents FROM documents")
def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the file stream, landed twice: each content is stored once."""
    from factengine.sources.store import Store
    from factengine.streaming.intake import stream_intake as run

    root = new_folder(spark, "intake")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tables = Store(spark, f"{root}/store")
    for _ in range(2):
        docs.write.mode("append").parquet(f"{root}/landing")
        run(spark, f"{root}/landing", docs.schema, tables, f"{root}/checkpoint").awaitTermination()
    return tables.read("documents").groupBy().agg(F.count("*").alias("documents"), F.countDistinct("content_hash").alias("contents"))
