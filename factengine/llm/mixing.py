"""Mixing sources to target weights (operator 2).

Words are summed per source; the targets follow by water filling; a source's repetition rate is its target over its
size. Each document is emitted floor(rate) times, and once more if a hash of seed, id, text and the number of the row
among its equals falls below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factengine.llm.common import bounded, each, free_name, materialise, numbered_copies, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, size)``.

    Sources in code-point order, null last, take the weights in turn and share the total. A target stops at ``cap``
    times its source's size; what is beyond is shared again by weight until none is above. The end of that process is
    the level at which min(cap * size, level * weight) sums to the total, found by one pass in the order in which
    sources reach their caps. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    whole = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("full", F.col("most") / F.col("weight"))
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("spent", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if all sources from here on stay below their caps; it holds from the first source that does stay below
    per = per.withColumn("level", (F.col("total") - F.col("spent")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "source", "level"))).over(everything)["level"]
    per = per.withColumn("held", level)
    target = F.when(F.col("held").isNull() | (F.col("full") <= F.col("held")), F.col("most")).otherwise(F.col("held") * F.col("weight"))
    return per.select("source", "source_size", F.least("most", target).alias("target"))


def _draw(id_col: Column, key: Column, nth: Column, seed: str) -> Column:
    """A number in [0, 1) from 32 bits of a keyed hash; null ids and texts count as empty strings."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(key, F.lit("")), F.lit(":"), nth.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    Null texts have size 0; the null source is one source, last in order. A source without words has target and rate 0
    and takes none. Rows of equal id, source and text are numbered and draw one by one, so runs agree. An empty table
    gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.md5(F.col(text_col)).alias("key"), word_count(F.col(text_col)).alias("size"))
    rows = materialise(rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows")), "sizes")
    targets = materialise(source_targets(rows.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, cap), "targets").withColumnRenamed("source", "name")
    if bounded(targets, 100_000):
        targets = F.broadcast(targets)
    joined = each(rows, "rows", "nth").join(targets, F.col("source").eqNullSafe(F.col("name")), "left").drop("name", "rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate)
    copies = F.floor("rate") + (_draw(F.col("doc_id"), F.col("key"), F.col("nth"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("key", "nth")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its source's rate and its draw say, columns as they are.

    Only the rates travel: the sizes and targets are aggregated first and joined back per source, so texts are not
    shuffled, but for rows whose id and text are repeated. See :func:`mixing_plan` for nulls and repeated rows; here
    identical rows are numbered.
    """
    source, rate, nth, copy = (free_name(docs.columns, f"__mix_{n}") for n in ("source", "rate", "nth", "copy"))
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = materialise(source_targets(sizes, weights, cap), "targets").select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    if bounded(targets, 100_000):
        targets = F.broadcast(targets)
    rows = numbered_copies(docs, id_col, text_col, nth)
    joined = rows.join(targets, rows[source_col].eqNullSafe(F.col(source)), "left")
    copies = (F.floor(rate) + (_draw(rows[id_col], F.md5(rows[text_col]), F.col(nth), seed) < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))
