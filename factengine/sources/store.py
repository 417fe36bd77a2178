"""Stored tables: Parquet in versions and increments, with insert-or-ignore, upsert and idempotent replay as whole-table expressions.

The functions take and return DataFrames; :class:`Store` keeps each result as a new version directory and switches a
pointer, so readers never see a half-written table and a write may read the version it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that an upsert of an edge replaces; its id and creation time stay.
EDGE_KEY, EDGE_KEPT = ("source_id", "target_id"), ("id", "created_at")


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str, *order) -> DataFrame:
    """``new`` rows of least ``order`` per key, with ``inserted``: false where the key is stored already."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = new.withColumn("__place", place).where("__place = 1").drop("__place")
    return first.join(stored.select(key, F.lit(True).alias("__there")), key, "left").withColumn("inserted", F.col("__there").isNull()).drop("__there")


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = EDGE_KEY, kept: tuple[str, ...] = EDGE_KEPT, order: str = "version") -> DataFrame:
    """``stored`` with ``new`` merged in by key: of several new rows the last by ``order`` wins, ``kept`` columns keep the
    stored values. Both sides have the same columns but ``order``, which only ``new`` needs."""
    columns = stored.columns
    last = new.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("__place = 1")
    old = stored.select(*(F.col(c).alias(f"__old_{c}") for c in columns))
    on = [F.col(f"__old_{k}") == F.col(k) for k in key]
    both = last.select(*columns, F.lit(True).alias("__new")).join(old, on, "full_outer")

    def value(c: str):
        newer, older = F.col(c), F.col(f"__old_{c}")
        if c in kept:
            return F.coalesce(older, newer)
        return F.when(F.col("__new"), newer).otherwise(older)

    return both.select(*(value(c).alias(c) for c in columns))


def write_back(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``facts`` with new vectors by id; an id that no fact has, or that comes twice, fails the job."""
    marked = vectors.groupBy("id").agg(F.first("embedding").alias("__vector"), F.count("*").alias("__n"))
    joined = marked.join(facts.select("id", F.lit(1).alias("__there")), "id", "left")
    bad = F.col("__there").isNull() | (F.col("__n") > 1)
    checked = joined.select("id", F.when(bad, F.raise_error(F.concat(F.lit("no single row to update: "), "id")).cast(vectors.schema["embedding"].dataType)).otherwise(F.col("__vector")).alias("__vector"), F.lit(True).alias("__set"))
    out = facts.join(checked, "id", "full_outer")
    return out.withColumn("embedding", F.when(F.col("__set"), F.col("__vector")).otherwise(F.col("embedding"))).drop("__vector", "__set")


def clear_relations(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges that touch none of the facts on either side."""
    ids = facts.select("id").distinct()
    for side in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", side), side, "left_anti")
    return edges


def clear_facts(facts: DataFrame, document_id, pipeline_version: str, pages: list[int] | None = None) -> DataFrame:
    """Facts without those of a document and version, or only of some of its pages."""
    gone = (F.col("document_id") == document_id) & (F.col("pipeline_version") == pipeline_version)
    return facts.where(~F.coalesce(gone if pages is None else gone & F.col("page").isin(pages), F.lit(False)))


def clear_pages(pages: DataFrame, document_id, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Pages without those of a document, or only without a half-open range of page positions from 0."""
    gone = F.col("document_id") == document_id
    if start is not None:
        gone &= (F.col("page_number") > start) & (F.col("page_number") <= stop)
    return pages.where(~F.coalesce(gone, F.lit(False)))


def append_log(events: DataFrame, folder: str) -> None:
    """Structured log rows as one JSON object per line, by day."""
    events.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(folder)


class Store:
    """Named tables under one root; every write makes a new version of a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[1:]) for n in self._whole(folder) if n[1:].isdigit() and n[0] == "v")

    def _whole(self, folder) -> list[str]:
        """Names of the directories in a folder that were written to the end."""
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return [n for n in names if self._fs.exists(self._path(f"{folder.toString()}/{n}/_SUCCESS"))]

    def _increments(self, name: str, version: int) -> list[str]:
        folder = self._path(f"{self.root}/{name}")
        return sorted(n for n in self._whole(folder) if n.startswith(f"v{version}.a")) if self._fs.exists(folder) else []

    def read(self, name: str, version: int | None = None, without: str | None = None) -> DataFrame | None:
        """The newest whole version, or a given one, with its increments (but the one of a key); None if there is nothing."""
        versions = self.versions(name)
        at = version if version is not None else versions[-1] if versions else 0
        parts = [f"v{at}"] * (at in versions) + [n for n in self._increments(name, at) if n != f"v{at}.a{without}"]
        return self.spark.read.parquet(*(f"{self.root}/{name}/{n}" for n in parts)) if parts else None

    def append(self, name: str, df: DataFrame, key: str) -> None:
        """Adds an increment to the newest version. The same key again replaces that increment, so a replayed batch counts
        once; nothing that is stored is read or written again."""
        at = (self.versions(name) or [0])[-1]
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{at}.a{key}")

    def prune(self, name: str, keep: int = 2) -> list[int]:
        """Deletes all but the newest versions, with their increments; returns the versions that are left."""
        versions = self.versions(name)
        for old in versions[: -keep or None]:
            for part in [f"v{old}", *self._increments(name, old)]:
                self._fs.delete(self._path(f"{self.root}/{name}/{part}"), True)
        return self.versions(name)

    def write(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        """Writes the next version; a version counts once Spark's success marker is there."""
        at = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}/v{at}")
        return self.read(name, at)
