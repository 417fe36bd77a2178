"""Queries over sources, gates, layout and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factengine.operators import extract, gates, layout
from factengine.operators.grounding import audit, audit_summary, ground
from factengine.operators.providers import embed
from factengine.operators.publish import candidates_of, locate, to_facts
from factengine.plans.derived import document_pages, grid_pages, line_boxes, price_pages, table
from factengine.plans.registry import query
from factengine.schemas import CANDIDATE
from factengine.session import dealt, new_folder, qualified, written
from factengine.sources import intake
from factengine.sources.objects import put_objects
from factengine.sources.store import Store

_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t: regexp_replace(t, '^[\\s\\x{00a0}\\x{3000}\\x{feff}]+|[\\s\\x{00a0}\\x{3000}\\x{feff}]+$', '', 'g')), lambda t: length(t) > 0)"


@query(f"SELECT doc_id AS document_id, len({_LINES}) AS n_lines, md5(array_to_string({_LINES}, '|')) AS digest FROM documents WHERE len({_LINES}) > 0")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, numbered lines of every document, put together again in order."""
    lines = intake.number_lines(document_pages(table(spark, sf_dir, "documents")))
    whole = lines.groupBy("document_id").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_number", "text"))).alias("l"))
    return whole.select("document_id", "n_lines", F.md5(F.array_join("l.text", "|")).alias("digest"))


@query(f"WITH l AS (SELECT doc_id, {_LINES} AS ls FROM documents) SELECT doc_id AS document_id, round(length(array_to_string(ls, chr(10))) / (612.0 * 792.0) * 1000, 6) AS density, CASE WHEN len(ls) = 0 THEN 'failed' ELSE 'parsed' END AS status FROM l")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text density of every page."""
    pages = intake.text_pages(document_pages(table(spark, sf_dir, "documents")))
    return pages.select("document_id", F.round("quality.textDensity", 6).alias("density"), "status")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1 AS inserted FROM documents QUALIFY inserted")
def intake_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per content hash, the first."""
    from factengine.sources.store import insert_or_ignore

    docs = table(spark, sf_dir, "documents").withColumn("content", F.coalesce("text", F.lit("")).cast("binary"))
    new = intake.with_identity(docs).select("doc_id", "content_hash")
    return insert_or_ignore(new.limit(0).select("content_hash"), new, "content_hash", F.col("doc_id"))


@query("SELECT DISTINCT 'doc:' || sha256(coalesce(text, '')) AS name, 'doc-' || sha256(coalesce(text, '')) AS stored_as, false AS reused FROM documents")
def object_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct content stored once under the name of its hash."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(content.alias("content"))
    return put_objects(rows, qualified(spark, new_folder(spark, "objects")), intake.storage_key(F.sha2("content", 256)))


@query(
    """
WITH p AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT *, least(n, 12) AS k FROM p),
q AS (SELECT * FROM s WHERE list_contains(list_transform(range(k::BIGINT), lambda i: CASE WHEN k > 1 THEN floor(i * (n - 1) / (k - 1)::DOUBLE + 0.5)::BIGINT ELSE 0 END), position))
SELECT source AS document_id, n AS page_count, median(n_chars)::DOUBLE AS median_chars, CASE WHEN median(n_chars) < 120 THEN 'scanned_unsupported' END AS refusal FROM q GROUP BY ALL
"""
)
def intake_scan_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median characters over up to twelve evenly spaced pages of each source."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    place = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    return intake.scan_refusals(docs.select(F.col("source").alias("document_id"), place.alias("position"), F.col("n_chars").alias("chars")))


@query("SELECT s_suppkey, list_transform(range(least(s_suppkey, 12)::BIGINT), lambda i: CASE WHEN least(s_suppkey, 12) > 1 THEN floor(i * (s_suppkey - 1) / (least(s_suppkey, 12) - 1)::DOUBLE + 0.5)::INT ELSE 0 END) AS pages FROM supplier WHERE s_suppkey > 0")
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced pages of documents of many lengths."""
    return table(spark, sf_dir, "supplier").where("s_suppkey > 0").select("s_suppkey", intake.sampled_pages(F.col("s_suppkey")).alias("pages"))


@query("SELECT doc_id, text IS NOT NULL AND doc_id % 3 <> 2 AS quoted FROM documents")
def verbatim_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as quotes: with other line breaks they are found, with an invented word they are not; null has none."""
    docs = table(spark, sf_dir, "documents")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    quote = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("inventedword "), flat)).when(F.col("doc_id") % 3 == 1, F.replace(flat, F.lit(" "), F.lit("\n"))).otherwise(flat)
    return docs.select("doc_id", gates.verbatim(quote, F.col("text")).alias("quoted"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'p1l9, p1l8' WHEN o_orderkey % 5 = 1 THEN 'p1l7' ELSE '' END AS missing FROM orders")
def line_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited lines that a page lacks, each once and in order."""
    k = F.col("o_orderkey") % 5
    cited = F.when(k == 0, F.array(*map(F.lit, ("p1l9", "p1l1", "p1l8", "p1l9")))).when(k == 1, F.array(F.lit("p1l7"))).otherwise(F.array(F.lit("p1l2")))
    there = F.array(*map(F.lit, ("p1l1", "p1l2", "p1l3")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(gates.line_gate(cited, there), ", ").alias("missing"))


@query(
    """
SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 <> 0 THEN 'table_title' END, CASE WHEN p_partkey % 4 = 1 THEN 'table_column_header' END,
  CASE WHEN p_partkey % 4 = 1 AND p_partkey % 5 = 0 THEN 'table_unit' END,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN 'period' END, CASE WHEN p_partkey % 4 = 2 AND p_partkey % 3 <> 0 THEN 'geography' END,
  CASE WHEN p_partkey % 4 = 3 AND p_partkey % 7 <> 0 THEN 'segment' END], lambda x: x IS NOT NULL), ', ') AS missing
FROM part
"""
)
def context_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, growth, table and segment claims with and without the context they need."""
    k = F.col("p_partkey")
    kind = k % 4
    none = F.lit(None).cast("string")
    qualifiers = F.map_concat(
        F.when((k % 7 == 0) & (kind % 2 == 0), F.create_map(F.lit("Fiscal Year"), F.lit(" FY2024 "))).otherwise(F.create_map().cast("map<string, string>")),
        F.when((k % 3 == 0) & (kind == 2), F.create_map(F.lit("country"), F.lit("India"))).otherwise(F.create_map().cast("map<string, string>")),
        F.when((k % 7 == 0) & (kind == 3), F.create_map(F.lit("Business Unit"), F.lit("Retail"))).otherwise(F.create_map().cast("map<string, string>")),
    )
    context = F.when(kind == 1, F.struct(F.when(k % 3 == 0, "Sizes").alias("title"), none.alias("columnHeader"), F.lit("row").alias("rowHeader"), none.alias("unitLine"), F.array().cast("array<string>").alias("footnotes")))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(kind == 0, "Net sales").when(kind == 3, "Retail segment").otherwise("Volume").alias("subject"),
        F.when(kind == 2, "CAGR").otherwise("is").alias("predicate"),
        F.when(kind == 2, "percent").otherwise("number").alias("valueType"),
        F.when(kind == 1, "table").otherwise("prose").alias("source"),
        F.when(k % 5 != 0, "kg").alias("unit"),
        qualifiers.alias("qualifiers"),
        context.alias("tableContext"),
    )
    return rows.select("p_partkey", F.array_join(gates.missing_context(gates.qualifier_entries(F.col("qualifiers"))), ", ").alias("missing"))


@query(
    """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'published' ELSE 'rejected' END AS status, CASE p_partkey % 4 WHEN 1 THEN 'quote_not_found' WHEN 2 THEN 'value_not_in_source' WHEN 3 THEN 'line_not_found' END AS rejection_reason, count(*) AS n FROM part GROUP BY ALL
"""
)
def ground_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price claims with true quotes, invented quotes, wrong values and wrong lines, all the way through grounding. Equal
    candidates are grounded once and counted."""
    k = F.col("k")
    amount = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    line = F.concat(F.lit("The price of "), "p_name", F.lit(" was ₹"), amount, F.lit(" million for the year ended 31 March 2024."))
    part = table(spark, sf_dir, "part").groupBy("p_name", "p_retailprice", (F.col("p_partkey") % 4).alias("k")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    candidates = part.select(
        "n",
        F.col("p_name").alias("subject"),
        F.lit("price").alias("predicate"),
        F.concat(F.lit("₹"), F.when(k == 2, F.concat(F.lit("9"), amount)).otherwise(amount), F.lit(" million")).alias("rawValue"),
        F.lit("INR").alias("unit"),
        F.lit("money").alias("valueType"),
        F.create_map(F.lit("fiscal_year"), F.lit("FY2024")).alias("qualifiers"),
        F.lit("observed").alias("modality"),
        none.alias("attributedTo"),
        F.lit("prose").alias("source"),
        F.lit(None).cast(CANDIDATE.split("tableContext ")[1].split(", evidence")[0]).alias("tableContext"),
        F.struct(F.when(k == 1, F.concat(line, F.lit("!"))).otherwise(line).alias("quote"), F.array(F.when(k == 3, "p1l9").otherwise("p1l1")).alias("lineIds")).alias("evidence"),
        F.lit(0.9).alias("confidence"),
        F.concat(F.lit("Prices\n"), line).alias("page_text"),
        F.array(F.lit("p1l1")).alias("page_line_ids"),
        none.alias("fiscal_month_day"),
    )
    return ground(candidates).groupBy("status", "rejection_reason").agg(F.sum("n").alias("n"))


@query(
    """
WITH d AS (SELECT doc_id FROM documents)
SELECT reason, count(*) AS count FROM (
  SELECT unnest(list_filter([CASE WHEN doc_id % 10 = 1 THEN 'page_missing' END, CASE WHEN doc_id % 10 <> 1 AND doc_id % 10 = 2 THEN 'line_missing' END, CASE WHEN doc_id % 10 = 3 THEN 'quote_missing' END, CASE WHEN doc_id % 10 = 4 THEN 'not_verified' END, CASE WHEN doc_id % 10 = 5 THEN 'context_incomplete' END, CASE WHEN doc_id % 10 = 6 THEN 'table_context_missing' END], lambda x: x IS NOT NULL)) AS reason FROM d)
GROUP BY ALL
"""
)
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published facts with one planted fault in ten kinds, found again by the audit."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    k = F.col("doc_id") % 10
    none = F.lit(None).cast("string")
    facts = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("document_id"),
        F.when(k == 1, 2).otherwise(1).alias("page"),
        F.when(k == 3, F.concat(F.lit("\u0001invented "), "text")).otherwise(F.col("text")).alias("quote"),
        F.array(F.when(k == 2, "p1l99999999").otherwise("p1l1")).alias("line_ids"),
        (k != 4).alias("verified"),
        (k != 5).alias("context_complete"),
        F.when(k == 6, "table").otherwise("prose").alias("source"),
        F.lit(None).cast("struct<title: string, columnHeader: string, rowHeader: string, unitLine: string, footnotes: array<string>>").alias("table_context"),
        none.alias("unit"),
        F.lit("published").alias("status"),
    )
    pages = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text", F.array(F.struct(F.lit("p1l1").alias("id"))).alias("lines"))
    return audit_summary(audit(facts, pages)).select("reason", "count")


# --- layout ---------------------------------------------------------------------------------------------------------

_BOXES = "b AS (SELECT l_orderkey AS page, (l_partkey % 400)::DOUBLE AS x0, (l_partkey % 400 + l_quantity)::DOUBLE AS x1, (l_suppkey % 700)::DOUBLE AS y0 FROM lineitem)"


@query(
    f"""
WITH {_BOXES}, m AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM b),
i AS (SELECT *, sum(CASE WHEN x0 > reached OR reached IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
SELECT page, min(x0) AS x0, max(x1) AS x1 FROM i GROUP BY page, island
"""
)
def band_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal spans of each page's boxes, merged."""
    return layout.merge_intervals(line_boxes(table(spark, sf_dir, "lineitem")), ["page"])


@query(f"WITH {_BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y0 + 10) AS y1 FROM b GROUP BY page")
def union_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all of a page's lines."""
    boxes = line_boxes(table(spark, sf_dir, "lineitem"))
    box = F.struct("x0", "y0", "x1", (F.col("y0") + 10).alias("y1"))
    pages = boxes.groupBy("page").agg(F.collect_list(F.struct(F.col("line").cast("string").alias("id"), box.alias("bbox"))).alias("lines"))
    return pages.select("page", layout.bbox_of(F.col("lines"), F.col("lines.id")).alias("b")).select("page", "b.*")


@query(
    f"""
WITH {_BOXES}, u AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y0 + 10) AS y1 FROM b GROUP BY page),
s AS (SELECT *, least(612, greatest((x1 - x0) * 1.6, 612 * 0.34)) AS w, least(792, greatest((y1 - y0) * 2.4, 792 * 0.34)) AS h FROM u)
SELECT page, round(greatest(0, least((x0 + x1) / 2 - w / 2, 612 - w))::DOUBLE, 6) AS left_edge, round(greatest(0, least((y0 + y1) / 2 - h / 2, 792 - h))::DOUBLE, 6) AS top_edge, round(w::DOUBLE, 6) AS width, round(h::DOUBLE, 6) AS height FROM s
"""
)
def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What part of a page to show as evidence."""
    boxes = line_boxes(table(spark, sf_dir, "lineitem")).groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max(F.col("y0") + 10).alias("y1"))
    w = boxes.select("page", layout.crop_window(F.struct("x0", "y0", "x1", "y1"), F.lit(612.0), F.lit(792.0)).alias("w"))
    return w.select("page", F.round("w.x0", 6).alias("left_edge"), F.round("w.y0", 6).alias("top_edge"), F.round(F.col("w.x1") - F.col("w.x0"), 6).alias("width"), F.round(F.col("w.y1") - F.col("w.y0"), 6).alias("height"))


@query(
    """
WITH n AS (SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT document_id, 'clean' AS quality, 'Order lines' AS title, '(amounts in US dollars)' AS unit_line, '|Quantity|Price' AS headers, n AS rows, 3 * n AS cells FROM n WHERE n >= 2
"""
)
def table_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables rebuilt from the boxes of a page per order; three gridded rows, the heading's among them, make a table."""
    pages = layout.reconstruct(grid_pages(table(spark, sf_dir, "lineitem")))
    t = pages.select("document_id", F.explode("tables").alias("t"))
    cells = F.aggregate("t.rows", F.lit(0), lambda n, r: n + F.size(r["cells"])).cast("long")
    return t.select("document_id", "t.quality", "t.title", F.col("t.unitLine").alias("unit_line"), F.array_join("t.columnHeaders", "|").alias("headers"), F.size("t.rows").cast("long").alias("rows"), cells.alias("cells"))


@query(
    """
WITH n AS (SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT document_id, 'p1t1-cells' AS id, 3 * n AS cells, 'Quantity' AS some_header FROM n WHERE n >= 2
"""
)
def table_cell_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the rebuilt tables with their context, one batch per table. A first cell with digits is no row header, so
    all three cells of a row become inputs."""
    inputs = extract.table_inputs(layout.reconstruct(grid_pages(table(spark, sf_dir, "lineitem"))))
    out = extract.table_batches(inputs)
    headers = F.array_sort(F.array_compact(F.transform("cells", lambda c: c["context"]["columnHeader"])))
    return out.select("document_id", "id", F.size("cells").cast("long").alias("cells"), F.get(headers, F.size(headers) - 1).alias("some_header"))


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LINES} AS ls FROM documents), l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM d), n AS (SELECT doc_id, i, length(ls[i]) + 1 AS size FROM l),
r AS (
  SELECT doc_id, i, 1 AS b, size AS run, size FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN r.run + n.size > 4000 THEN r.b + 1 ELSE r.b END, CASE WHEN r.run + n.size > 4000 THEN n.size ELSE r.run + n.size END, n.size FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1
)
SELECT doc_id AS document_id, 'prose-' || b AS id, count(*) AS lines, sum(size)::BIGINT AS chars FROM r GROUP BY ALL
"""
)
def prose_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of every document in batches of at most 4,000 characters."""
    pages = intake.text_pages(document_pages(table(spark, sf_dir, "documents"))).withColumn("tables", F.array().cast("array<struct<quality: string, rows: array<struct<cells: array<struct<lineIds: array<string>>>>>>>"))
    return extract.prose_batches(pages).groupBy("document_id", "id").agg(F.count("*").alias("lines"), F.sum(F.length("text") + 1).alias("chars"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT 'number' AS \"valueType\", NULL::VARCHAR AS kind, (3 * sum(n))::BIGINT AS n FROM n WHERE n >= 2")
def extract_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the rebuilt tables by the offline provider, counted by type."""
    batches = extract.table_batches(extract.table_inputs(layout.reconstruct(grid_pages(table(spark, sf_dir, "lineitem")))))
    found = extract.generate(extract.table_payloads(batches))
    return found.groupBy("candidate.valueType", "kind").agg(F.count("*").alias("n"))


@query(
    """
WITH t AS (SELECT l_orderkey AS document_id, count(*) AS n, sum(length('part ' || l_partkey) + length(CAST(CAST(l_quantity AS DECIMAL(10,2)) AS VARCHAR)) + length(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR))) AS c FROM lineitem GROUP BY ALL)
SELECT document_id, round(CASE WHEN n >= 2 THEN 0.6 * least(1.0, log10(1 + 3 * n) / 2) ELSE 0 END + 0.1 * least(1.0, (c + length('Order lines(amounts in US dollars)QuantityPrice')) / 2000.0::DOUBLE), 6) AS priority FROM t
"""
)
def page_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How early each page of an order should be extracted."""
    pages = layout.reconstruct(grid_pages(table(spark, sf_dir, "lineitem")))
    return pages.select("document_id", F.round(extract.page_priority(F.col("lines"), F.col("tables")), 6).alias("priority"))


@query("SELECT source AS document_id, doc_id AS page_number, ((row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) // 4)::INT AS batch FROM documents")
def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as pages, longest first, in fours."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.col("n_chars").alias("priority"))
    return extract.extraction_plan(docs).select("document_id", "page_number", "batch")


@query("SELECT p_partkey AS document_id, unnest(range(0, p_size * 3, 25))::INT AS start, least(unnest(range(0, p_size * 3, 25)) + 25, p_size * 3)::INT AS stop FROM part WHERE p_size > 0")
def parse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of documents of three pages per unit of size."""
    return extract.parse_plan(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), (F.col("p_size") * 3).alias("page_count")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fiscal_year,k' ELSE 'k' END AS keys FROM events")
def qualifier_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as qualifiers, without keys that only repeat the parser's context."""
    props = F.from_json("props", "map<string, string>")
    extra = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("Title"), F.lit("x"), F.lit("Cell ID"), F.lit("y"), F.lit("column_header"), F.lit("z"), F.lit("fiscal_year"), F.lit("FY24"))).otherwise(F.create_map(F.lit("line-ids"), F.lit("1")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(extract.strip_qualifiers(F.map_concat(props, extra)))), ",").alias("keys"))


@query(
    """
WITH s AS (SELECT DISTINCT p_brand, lower(p_name) AS name, p_size FROM part), c AS (SELECT name, p_size, count(*) AS d FROM s GROUP BY ALL)
SELECT p_partkey, c.d - 1 AS repetitions, round(least(1.0, CASE WHEN p_partkey % 4 = 0 THEN 0.05 ELSE 0.6 END + least(0.4, (c.d - 1) * 0.1))::DOUBLE, 6) AS salience
FROM part JOIN c ON lower(p_name) = c.name AND part.p_size = c.p_size
"""
)
def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as claims of a brand: how many other brands state the same, and how much a claim is worth."""
    part = table(spark, sf_dir, "part")
    facts = part.select("p_partkey", F.col("p_brand").alias("document_id"), F.col("p_name").alias("subject"), F.lit("size").alias("predicate"), F.col("p_size").cast("string").alias("raw_value"), F.lit(None).cast("string").alias("unit"), F.when(F.col("p_partkey") % 4 == 0, "ISBN 1").otherwise("size").alias("quote"))
    return extract.with_salience(facts).select("p_partkey", "repetitions", F.round("salience", 6).alias("salience"))


@query("SELECT p_partkey, 1.0::DOUBLE AS norm FROM part")
def embed_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offline vectors of part names are of unit length."""
    v = table(spark, sf_dir, "part").select("p_partkey", embed(F.col("p_name"), dimensions=64).alias("v"))
    return v.select("p_partkey", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 5).alias("norm"))


@query(
    """
WITH l AS (SELECT o_custkey AS document_id, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 14.0 ELSE 10.0 END AS size FROM orders),
h AS (SELECT *, size >= 1.12 * median(size) OVER (PARTITION BY document_id) AS heading, row_number() OVER (PARTITION BY document_id ORDER BY o_orderkey) AS pos FROM l),
b AS (SELECT *, sum(CASE WHEN heading OR pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS batch FROM h)
SELECT document_id, 'prose-' || batch AS id, max(CASE WHEN heading THEN 'Order ' || o_orderkey END) AS title, count(*) AS lines FROM b GROUP BY document_id, batch
"""
)
def heading_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as lines, every fifth key in large print: each heading starts a batch and names it."""
    line = F.struct(F.col("o_orderkey").alias("k"), F.concat(F.lit("p1l"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("text"), F.when(F.col("o_orderkey") % 5 == 0, 14.0).otherwise(10.0).alias("size"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    pages = rows.withColumns({"page_number": F.lit(1), "tables": F.array().cast("array<struct<quality: string, rows: array<struct<cells: array<struct<lineIds: array<string>>>>>>>")})
    out = extract.prose_batches(pages).groupBy("document_id", "id").agg(F.max("section_title").alias("title"), F.count("*").alias("lines"))
    return out


@query(
    """
SELECT s_suppkey AS document_id, unnest(CASE s_suppkey % 2 WHEN 0 THEN ['clean', 'clean'] ELSE ['ragged'] END) AS quality, unnest(CASE s_suppkey % 2 WHEN 0 THEN ['Item|Value', 'Year|Sum'] ELSE [''] END) AS headers,
  unnest(CASE s_suppkey % 2 WHEN 0 THEN [2, 3] ELSE [0] END) AS rows, unnest(CASE s_suppkey % 2 WHEN 0 THEN ['', '* estimated'] ELSE ['* estimated'] END) AS notes
FROM supplier
"""
)
def stacked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grids on one page, parted by a second heading row, with a footnote below; and cells that overlap, which make no
    columns."""
    def cell(i: int, text: str, x: float, y: int, width: float) -> str:
        return f"struct('l{i}' AS id, '{text}' AS text, struct({x}D AS x0, {y}D AS y0, {x + width}D AS x1, {y + 10}D AS y1) AS bbox, 10D AS size)"

    def page(rows: list[list[str]], shift: float, width: float) -> str:
        cells = [(t, shift * j, 20 * i, 210.0 if t == top else width) for i, row in enumerate(rows) for j, t in enumerate(row)]
        return f"array({', '.join(cell(n, t, x, y, w) for n, (t, x, y, w) in enumerate(cells))})"

    top = "Figures in brief"  # it crosses the gutter, so that the page is one band
    grids = page([[top], ["Item", "Value"], ["1.5", "2"], ["3", "4"], ["Year", "Sum"], ["5", "6"], ["7", "8"], ["9", "10"], ["* estimated"]], 200.0, 40.0)
    overlap = page([["1", "2"], ["3", "4"], ["5", "6"], ["* estimated"]], 30.0, 60.0)
    pages = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS document_id", "1 AS page_number", "400D AS width", f"CASE WHEN s_suppkey % 2 = 0 THEN {grids} ELSE {overlap} END AS lines")
    t = layout.reconstruct(pages).select("document_id", F.explode("tables").alias("t"))
    return t.select("document_id", "t.quality", F.array_join("t.columnHeaders", "|").alias("headers"), F.size("t.rows").alias("rows"), F.array_join("t.footnotes", "|").alias("notes"))


@query("SELECT c_nationkey AS document_id, CASE WHEN count(*) >= 8 AND count(DISTINCT c_custkey % 2) = 2 THEN 2 ELSE 1 END AS bands, CASE WHEN count(*) >= 8 AND count(DISTINCT c_custkey % 2) = 2 THEN 250.0::DOUBLE ELSE 600.0::DOUBLE END AS first_end FROM customer GROUP BY ALL")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as lines in two columns of a page: the gutter between them cuts it."""
    c = table(spark, sf_dir, "customer")
    left, y = F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(300.0), (F.col("c_custkey") * 20).cast("double")
    box = F.struct(left.alias("x0"), y.alias("y0"), (left + 200).alias("x1"), (y + 10).alias("y1"))
    line = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"), box.alias("bbox"), F.lit(10.0).alias("size"))
    pages = c.groupBy(F.col("c_nationkey").alias("document_id")).agg(F.collect_list(line).alias("lines")).withColumns({"page_number": F.lit(1), "width": F.lit(600.0)})
    return layout.reconstruct(pages).select("document_id", F.size("bands").alias("bands"), F.col("bands")[0]["x1"].alias("first_end"))


@query(
    """
WITH p AS (SELECT p_brand, p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS amount, p_partkey % 3 AS k,
  CASE p_partkey % 3 WHEN 0 THEN 'Revenue from ' || p_name || ' was ₹' || CAST(p_retailprice AS DECIMAL(18,2)) || ' million' ELSE 'The price of ' || p_name || ' was ₹' || CAST(p_retailprice AS DECIMAL(18,2)) || ' million for the year ended 31 March 2024.' END AS line FROM part)
SELECT p_brand AS document_id, p_partkey::INT AS page, CASE k WHEN 0 THEN 'rejected' ELSE 'published' END AS status, CASE k WHEN 0 THEN 'missing_context' END AS rejection_reason,
  (amount * 1000000)::DECIMAL(30,0)::VARCHAR AS canonical_value, 'INR' AS unit, 'p' || p_partkey || 'l2' AS lines, least(612.0, length(line) * 6.0)::DOUBLE AS x1, CASE k WHEN 1 THEN DATE '2024-03-31' END AS period_end
FROM p WHERE k < 2
"""
)
def write_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to stored facts: batches over many pages, candidates, each put on the page of its first cited line,
    grounded there, stored and read back."""
    raw = price_pages(dealt(table(spark, sf_dir, "part")))
    pages = written(layout.reconstruct(intake.text_pages(raw)), "pages")
    found, batches = candidates_of(pages)
    facts = to_facts(locate(written(found, "candidates"), pages, batches), pages, "v2")
    stored = Store(spark, new_folder(spark, "facts")).write("facts", facts)
    return stored.select("document_id", "page", "status", "rejection_reason", "canonical_value", "unit", F.array_join("line_ids", ",").alias("lines"), "bbox.x1", "period_end")
