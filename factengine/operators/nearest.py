"""Exact nearest rows by cosine: blocks of vectors multiplied in NumPy, top k per row merged by a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors in a block.
BLOCK = 2048
#: Lanes per core.
LANES = 2


def _blocks(rows: DataFrame, count: int, prefix: str) -> DataFrame:
    """One row per block: parallel arrays of ids and groups, the vectors end to end, and their length."""
    packed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).groupBy("block")
    out = packed.agg(F.collect_list(F.struct("id", "grp", "v")).alias("rows"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"))  # BLOCK rows on average
    even = F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(F.raise_error("vectors of unequal length").cast("int"))
    return out.select("block", *(c.alias(f"{prefix}_{n}") for n, c in (("ids", F.col("rows.id")), ("groups", F.col("rows.grp")), ("flat", F.flatten("rows.v")), ("size", even))))


def _side(batch: pa.RecordBatch, prefix: str, i: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, groups and unit vectors of one block."""
    ids, groups, flat = (batch.column(f"{prefix}_{n}")[i].values for n in ("ids", "groups", "flat"))
    x = flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    return ids, groups.to_numpy(zero_copy_only=False), x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of(sims: np.ndarray, open_: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` largest open values, ties by ``order`` of the columns."""
    masked = np.where(open_, sims, -np.inf)
    rows, columns = np.nonzero(open_ & (masked >= np.partition(masked, -k, axis=1)[:, -k][:, None])) if masked.shape[1] > k else np.nonzero(open_)
    placed = np.lexsort((order[columns], -masked[rows, columns], rows))
    rows, columns = rows[placed], columns[placed]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], columns[nth < k]


def _order(ids: pa.Array) -> np.ndarray:
    """The place of each id among them all."""
    return np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _merged(one: tuple[np.ndarray, pa.Array, np.ndarray], two: tuple[np.ndarray, pa.Array, np.ndarray], k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The ``k`` best per row of two lists of rows, ids and similarities."""
    rows, ids, sims = np.concatenate([one[0], two[0]]), pa.concat_arrays([one[1], two[1]]), np.concatenate([one[2], two[2]])
    placed = np.lexsort((_order(ids), -sims, rows))
    ordered = rows[placed]
    placed = placed[np.arange(len(ordered)) - np.searchsorted(ordered, ordered) < k]
    return rows[placed], ids.take(pa.array(placed)), sims[placed]


def nearest(focus: DataFrame, corpus: DataFrame, k: int = 20, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """``(source_id, target_id, similarity)``: per focus row its ``k`` nearest corpus rows of other groups.

    Both sides have ``id, grp, v``; null and zero vectors are skipped, vectors of unequal length are an error. Ties go to
    the smaller id.
    """
    found = lanes_best(focus, corpus, k, floor, block)
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("similarity").desc(), "target_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def lanes_best(focus: DataFrame, corpus: DataFrame, k: int, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows per focus row and task that meets it, in general one.

    Focus blocks are dealt to lanes, a few per core however many blocks there are, and each lane gets every corpus block; so a
    focus block is shuffled once and a corpus block once per lane. A task keeps the best of each of its focus rows while it
    goes through the blocks.
    """
    usable = "v is not null and exists(v, x -> x <> 0)"
    focus, corpus = (d.select("id", "grp", F.col("v").cast("array<double>").alias("v")).where(usable) for d in (focus, corpus))
    n_focus, n_corpus = (max(1, -(-d.count() // block)) for d in (focus, corpus))
    lanes = min(int(focus.sparkSession.conf.get("spark.sql.shuffle.partitions")), LANES * focus.sparkSession.sparkContext.defaultParallelism, n_focus)
    left = _blocks(focus, n_focus, "a").withColumn("lane", F.pmod("block", F.lit(lanes)))
    right = _blocks(corpus, n_corpus, "b").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).drop("block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("block")[i].as_py()
                ids, groups, x = _side(batch, "a", i)
                other_ids, other_groups, y = _side(batch, "b", i)
                sims = x @ y.T
                open_ = groups[:, None] != other_groups[None, :]
                if floor is not None:
                    open_ &= sims >= floor
                rows, columns = best_of(sims, open_, _order(other_ids), k)
                found = (rows, other_ids.take(pa.array(columns)), sims[rows, columns])
                if at in best:
                    found = _merged(best[at][1:], found, k)
                best[at] = (pa.concat_arrays([ids]), *found)
        for ids, rows, targets, similarity in best.values():
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), targets, pa.array(similarity)], ["source_id", "target_id", "similarity"])

    kind = focus.schema["id"].dataType
    schema = T.StructType([T.StructField("source_id", kind), T.StructField("target_id", kind), T.StructField("similarity", T.DoubleType())])
    met = left.join(right, "lane").select("block", *(f"{p}_{n}" for p in "ab" for n in ("ids", "groups", "flat")), "a_size", "b_size")
    same = F.when(F.col("a_size") == F.col("b_size"), F.col("a_flat")).otherwise(F.raise_error("vectors of unequal length").cast("array<double>"))
    return met.withColumn("a_flat", same).drop("a_size", "b_size").mapInArrow(score, schema)
