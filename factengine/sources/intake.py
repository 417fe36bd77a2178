"""Sources: document bytes, their inspection, and pages of text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factengine.functions.text import strip
from factengine.schemas import LINE

# Fixed values of intake: largest upload, bytes that must hold the header, pages that are sampled, and the characters a
# page has to have.
MAX_BYTES, HEADER_BYTES, SAMPLED_PAGES, MIN_CHARS = 64 << 20, 1024, 12, 120


def read_binary(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """``(path, length, content, content_hash, refusal)`` of all files; the hash of the bytes is the identity.

    Files above 64 MiB are refused as ``too_large`` and their bytes are not read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("content_hash"), F.lit("too_large").alias("refusal"))
    return inspected(with_identity(files.where(F.col("length") <= most))).unionByName(large)


def inspected(files: DataFrame) -> DataFrame:
    """Adds to ``refusal`` what the bytes of a document tell without a parser: ``encrypted`` if its trailer names an
    encryption dictionary, ``corrupted`` if it has no cross-reference or no page."""
    text = F.decode("content", "ISO-8859-1")
    whole = text.contains("startxref") & (text.rlike(r"/Type\s*/Page[^A-Za-z]") | text.contains("/ObjStm"))
    return files.withColumn("refusal", F.coalesce("refusal", F.when(~whole, "corrupted").when(text.rlike(r"/Encrypt[^A-Za-z]"), "encrypted")))


def with_identity(files: DataFrame) -> DataFrame:
    """Adds ``content_hash`` and ``refusal`` to rows with ``content``."""
    head = F.decode(F.substring("content", 1, HEADER_BYTES), "ISO-8859-1")
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn("refusal", F.when(~head.contains("%PDF-"), "not_a_pdf"))


def storage_key(content_hash: Column, page: Column | None = None) -> Column:
    """Content-addressed name of a document, or of one of its pages."""
    return F.concat(F.lit("doc:"), content_hash) if page is None else F.concat(F.lit("page:"), content_hash, F.lit(":"), page)


def sampled_pages(count: Column, size: int = SAMPLED_PAGES) -> Column:
    """Up to ``size`` evenly spaced page positions from 0, each once."""
    n = F.least(count, F.lit(size))
    at = lambda i: F.when(n > 1, F.floor(i * (count - 1) / (n - 1) + 0.5)).otherwise(F.lit(0)).cast("int")
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), at))).otherwise(F.array().cast("array<int>"))


def scan_refusals(pages: DataFrame) -> DataFrame:
    """``(document_id, page_count, median_chars, refusal)`` of ``pages(document_id, position, chars)``, positions from 0.

    The exact median over the sampled pages decides; a document without pages is not there.
    """
    sized = pages.groupBy("document_id").agg((F.max("position") + 1).alias("page_count"))
    picked = sized.select("document_id", "page_count", F.explode(sampled_pages(F.col("page_count"))).alias("position"))
    sample = pages.join(picked, ["document_id", "position"]).groupBy("document_id", "page_count").agg(F.expr("percentile(chars, 0.5)").alias("median_chars"))
    return sample.withColumn("refusal", F.when(F.col("median_chars") < MIN_CHARS, "scanned_unsupported"))


def number_lines(raw: DataFrame) -> DataFrame:
    """``(document_id, page_number, line_number, id, text)`` of ``raw(document_id, page_number, text)``: trimmed lines; blank
    ones get no number."""
    texts = F.filter(F.transform(F.split("text", "\n"), strip), lambda t: F.length(t) > 0)
    rows = raw.select("document_id", "page_number", F.posexplode(texts).alias("at", "text"))
    return rows.select("document_id", "page_number", (F.col("at") + 1).alias("line_number"), F.concat(F.lit("p"), "page_number", F.lit("l"), F.col("at") + 1).alias("id"), "text")


def text_pages(raw: DataFrame, width: float = 612.0, height: float = 792.0, line_height: float = 12.0) -> DataFrame:
    """Pages in the stored schema from plain text: one full-width line box per non-blank line, top to bottom.

    ``quality`` has characters per 1,000 square points, the share of replacement characters, and an image share of 0; a page
    without lines is failed with ``no_text_layer``.
    """
    texts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip), lambda t: F.length(t) > 0)

    def line(text: Column, i: Column) -> Column:
        box = F.struct(F.lit(0.0).alias("x0"), (i * line_height).cast("double").alias("y0"), F.least(F.lit(width), F.length(text) * 6.0).alias("x1"), ((i + 1) * line_height).cast("double").alias("y1"))
        return F.struct(F.concat(F.lit("p"), F.col("page_number"), F.lit("l"), i + 1).alias("id"), text.alias("text"), box.alias("bbox"), F.lit(line_height).alias("size"))

    out = raw.withColumn("lines", F.transform(texts, line).cast(f"array<{LINE}>")).withColumn("text", F.array_join(texts, "\n"))
    chars = F.length("text")
    quality = F.struct((chars / (width * height) * 1000).alias("textDensity"), F.when(chars > 0, F.regexp_count("text", F.lit("�")) / chars).otherwise(0.0).alias("replacementCharRatio"), F.lit(0.0).alias("imageRatio"))
    empty = F.size("lines") == 0
    return out.withColumns({"width": F.lit(width), "height": F.lit(height), "quality": quality, "status": F.when(empty, "failed").otherwise("parsed"), "failure_reason": F.when(empty, "no_text_layer")})


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row per key in an order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")
