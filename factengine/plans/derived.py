"""Facts, pages, edges and pairs derived from the star-schema tables, so that every operator has data to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factengine.functions.values import normalized
from factengine.schemas import TABLE_CONTEXT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price(column: str = "p_retailprice") -> Column:
    return F.col(column).cast("decimal(18,2)")


def price_claims(part: DataFrame) -> DataFrame:
    """Two claims per part in two documents: its price in millions of rupees, and the same in crores."""
    both = F.array(
        F.struct(F.lit("m").alias("form"), F.concat(F.lit("₹"), price().cast("string"), F.lit(" million")).alias("raw_value"), F.lit(None).cast("string").alias("unit")),
        F.struct(F.lit("c").alias("form"), F.concat((price() / 10).cast("decimal(18,3)").cast("string"), F.lit(" crore")).alias("raw_value"), F.lit("INR").alias("unit")),
    )
    rows = part.withColumn("v", F.explode(both))
    return rows.select(
        F.concat("v.form", "p_partkey").alias("id"),
        F.concat("v.form", F.lit(":"), "p_brand").alias("document_id"),
        F.col("p_name").alias("subject"),
        F.when(F.col("v.form") == "m", "retail price").otherwise("price at retail").alias("predicate"),
        F.lit("money").alias("value_type"),
        "v.raw_value",
        "v.unit",
        "p_partkey",
        "p_size",
        "p_type",
        "p_retailprice",
    )


def price_facts(part: DataFrame, normalised: bool = True) -> DataFrame:
    """The price claims as facts, their values normalised, or as a table of stored facts has them. By the last digit of the
    key the second claim differs in type, predicate, subject or document, so that every rule about pairs has something to
    refuse."""
    claims = price_claims(part)
    if normalised:
        valued = normalized(claims, F.col("raw_value"), F.col("value_type"), F.col("unit"))
    else:
        amount = (price() * 1000000).cast("decimal(30,0)")
        valued = claims.withColumn("v", F.struct(F.lit("INR").alias("unit"), amount.cast("string").alias("canonical_value"), amount.cast("double").alias("canonical_number")))
    facts = valued.withColumn("k", F.col("p_partkey") % 10).withColumn("second", F.col("id").startswith("c"))
    k, second = F.col("k"), F.col("second")
    return facts.select(
        "id",
        F.when(second & (k == 9), F.concat(F.lit("m"), F.substring("document_id", 2, 100))).otherwise(F.col("document_id")).alias("document_id"),
        F.when(second & k.isin(4, 5), "Something else").otherwise(F.col("subject")).alias("subject"),
        F.when(second & (k == 3), "headcount").when(second & (k == 4), "includes").when(second & (k == 5), "climbs").otherwise(F.col("predicate")).alias("predicate"),
        F.when(second & (k == 2), "duration").otherwise(F.col("value_type")).alias("value_type"),
        "raw_value",
        F.col("v.unit").alias("unit"),
        F.col("v.canonical_value").alias("canonical_value"),
        F.col("v.canonical_number").alias("canonical_number"),
        "p_partkey",
        "p_size",
        "p_type",
        F.when(second & (F.col("p_partkey") % 13 == 0), "rejected").otherwise("published").alias("status"),
        F.when(F.col("p_partkey") % 17 == 0, "v1").otherwise("v2").alias("pipeline_version"),
    )


def order_facts(orders: DataFrame) -> DataFrame:
    """One fact per order; its customer is the document."""
    k = F.col("o_orderkey")
    reasons = ("quote_not_found", "line_not_found", "missing_context", "value_not_in_source", "normalization_failed")
    rejected = F.col("o_orderstatus") == "F"
    return orders.select(
        k.alias("id"),
        F.col("o_custkey").alias("document_id"),
        (k % 7 + 1).cast("int").alias("page"),
        F.when(rejected, "rejected").otherwise("published").alias("status"),
        F.when(rejected, F.element_at(F.array(*map(F.lit, reasons)), (k % 5 + 1).cast("int"))).alias("rejection_reason"),
        F.when(k % 11 != 0, (k % 89) / 100.0).alias("salience"),
        F.when(k % 13 != 0, (k % 97) / 100.0).alias("confidence"),
        F.concat(F.lit("order of "), F.col("o_orderpriority")).alias("subject"),
        F.lit("totals").alias("predicate"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("raw_value"),
        F.when(k % 2 == 0, "v2").otherwise("v1").alias("pipeline_version"),
    )


def stored_facts(orders: DataFrame) -> DataFrame:
    """The order facts with every column of the facts table; every second one has a period of four."""
    k, published = F.col("id"), F.col("status") == "published"
    dated = k % 4 == 0
    return order_facts(orders).withColumns(
        {
            "canonical_value": F.col("raw_value"),
            "canonical_number": F.col("raw_value").cast("double"),
            "unit": F.when(k % 3 != 0, "USD"),
            "value_type": F.lit("money"),
            "normalization_rule": F.lit("usd_identity"),
            "period_start": F.when(dated, F.lit("2024-01-01").cast("date")),
            "period_end": F.when(dated, F.lit("2024-12-31").cast("date")),
            "period_precision": F.when(dated, "year"),
            "qualifiers": F.create_map(F.lit("region"), F.lit("north")),
            "modality": F.when(k % 4 == 0, "projected").otherwise("observed"),
            "attributed_to": F.lit(None).cast("string"),
            "source": F.lit("prose"),
            "table_context": F.lit(None).cast(TABLE_CONTEXT),
            "quote": F.col("subject"),
            "line_ids": F.array(F.lit("p1l1")),
            "verified": published,
            "context_complete": published,
            "rejection_detail": F.when(~published, "not found"),
        }
    )


def order_edges(orders: DataFrame) -> DataFrame:
    """One edge per order, to the fact of the next order key."""
    k = F.col("o_orderkey")
    verdicts = F.array(*map(F.lit, ("corroborates", "contradicts", "reconciles", "insufficient")))
    reasons = F.array(*map(F.lit, ("equivalent_value", "value_conflict", "vintage_difference", "missing_context")))
    at = (F.floor(k / 3) % 4 + 1).cast("int")
    return orders.select(k.alias("id"), k.alias("source_id"), (k + 1).alias("target_id"), F.element_at(verdicts, at).alias("verdict"), F.element_at(reasons, at).alias("reason_code"), F.when(k % 13 != 0, (k % 97) / 100.0).alias("confidence"), F.when(k % 5 == 0, "contradicts").alias("prior_verdict"), F.when(k % 10 == 0, "Restated.").alias("prior_explanation"), F.array(F.lit("unit")).alias("matched_fields"), F.array(F.lit("value")).alias("mismatched_fields"), F.lit("So it is.").alias("explanation"), F.when(k % 4 == 0, "v1").otherwise("v2").alias("pipeline_version"))


def customer_documents(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    failed = k % 17 == 0
    return customer.select(
        k.alias("document_id"),
        (F.col("c_nationkey") + 1).cast("int").alias("page_count"),
        F.when(failed, "failed").when(k % 4 == 0, "parsing").otherwise("ready").alias("status"),
        F.when(failed, F.when(k % 2 == 0, "encrypted").otherwise("parse_failed")).alias("failure_reason"),
        F.when(~failed, F.when(k % 3 == 0, "v1").otherwise("v2")).alias("pipeline_version"),
        F.concat("c_name", F.lit(".pdf")).alias("filename"),
        F.sha2("c_name", 256).alias("content_hash"),
        (k * 1000).cast("long").alias("byte_size"),
        F.when(failed, "it would not open").alias("failure_detail"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).alias("created_at"),
    )


def customer_pages(customer: DataFrame) -> DataFrame:
    """As many pages per customer as its nation's number; some failed."""
    pages = customer.select(F.col("c_custkey").alias("document_id"), F.explode(F.sequence(F.lit(1), (F.col("c_nationkey") + 1).cast("int"))).alias("page_number"))
    failed = (F.col("document_id") + F.col("page_number")) % 9 == 0
    return pages.withColumns({"status": F.when(failed, "failed").otherwise("parsed"), "failure_reason": F.when(failed, "no_text_layer"), "failure_detail": F.lit(None).cast("string")})


def event_jobs(events: DataFrame) -> DataFrame:
    """Events as jobs: the user is the document."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "failed"))), (k % 4 + 1).cast("int"))
    stage = F.element_at(F.array(*map(F.lit, ("parse", "extract", "relate"))), (k % 3 + 1).cast("int"))
    return events.select(k.alias("id"), F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"), status.alias("status"), stage.alias("stage"), F.when(k % 2 == 0, "v2").otherwise("v1").alias("pipeline_version"), F.when(k % 4 == 3, "parse_failed").alias("failure_reason"))


def line_boxes(lineitem: DataFrame) -> DataFrame:
    """A box per order line on a page per order."""
    x0 = (F.col("l_partkey") % 400).cast("double")
    return lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), x0.alias("x0"), (x0 + F.col("l_quantity")).cast("double").alias("x1"), (F.col("l_suppkey") % 700).cast("double").alias("y0"))


def document_pages(documents: DataFrame) -> DataFrame:
    """Every document as one page of plain text."""
    return documents.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def grid_pages(lineitem: DataFrame) -> DataFrame:
    """A page per order: a title, a unit line, a heading row and one row of cells per line of the order."""

    def cell(at: Column, name: str, x: float, text: Column, y: Column, size: float = 10.0, width: float = 60.0) -> Column:
        box = F.struct(F.lit(x).alias("x0"), y.cast("double").alias("y0"), F.lit(x + width).alias("x1"), (y + 10).cast("double").alias("y1"))
        return F.struct(F.concat(F.lit("l"), at, F.lit(name)).alias("id"), text.alias("text"), box.alias("bbox"), F.lit(size).alias("size"))

    def row(r: Column, at: Column) -> Column:
        y = 60 + at * 14
        part, amount, price = F.concat(F.lit("part "), r["l_partkey"].cast("string")), r["l_quantity"].cast("decimal(10,2)"), r["l_extendedprice"].cast("decimal(18,2)")
        return F.array(cell(at, "a", 20.0, part, y), cell(at, "b", 120.0, amount.cast("string"), y), cell(at, "c", 220.0, price.cast("string"), y))

    rows = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).alias("rows"))
    zero = F.lit("h")
    head = F.array(cell(zero, "t", 20.0, F.lit("Order lines"), F.lit(5), 16.0, 230.0), cell(zero, "u", 20.0, F.lit("(amounts in US dollars)"), F.lit(25)), cell(zero, "q", 120.0, F.lit("Quantity"), F.lit(44)), cell(zero, "e", 220.0, F.lit("Price"), F.lit(44)))
    return rows.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit(612.0).alias("width"), F.concat(head, F.flatten(F.transform("rows", row))).alias("lines"))


def price_pages(part: DataFrame) -> DataFrame:
    """A page per part in a document per brand, as plain text: a line with a price and its year, a line about revenue that
    names no year, or a line without a number."""
    amount = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    k = F.col("p_partkey") % 3
    line = (
        F.when(k == 0, F.concat(F.lit("Revenue from "), "p_name", F.lit(" was ₹"), amount, F.lit(" million")))
        .when(k == 1, F.concat(F.lit("The price of "), "p_name", F.lit(" was ₹"), amount, F.lit(" million for the year ended 31 March 2024.")))
        .otherwise(F.concat(F.lit("No price was set for "), "p_name"))
    )
    return part.select(F.col("p_brand").alias("document_id"), F.col("p_partkey").cast("int").alias("page_number"), F.concat(F.lit("Prices and amounts\n"), line).alias("text"))
