"""Near-duplicate vectors by cross-polytope hashing (operator 1).

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the coordinate of the
largest absolute value, with its sign. A table joins ``width`` such hashes. Multiprobe: besides its own bucket a vector
takes, in each table, the buckets that change one hash to its runner-up, closest first. Vectors that share a bucket
are candidates, and each is verified by its cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factengine.llm.buckets import links, numbered_members, per_class
from factengine.llm.common import materialise
from factengine.llm.shingles import constants, mix


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def _signs(seed: int, n: int) -> np.ndarray:
    return np.where(constants(seed, n) >> np.uint64(63), 1.0, -1.0)


def polytope_codes(x: np.ndarray, labels: np.ndarray, tables: int, width: int, probes: int, seed: int = 1) -> np.ndarray:
    """Codes of the rows of ``x``: in each of the tables, the own bucket and the ``probes`` next ones."""
    n, dim = x.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = x
    rows, out = np.arange(n), []
    label = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim))
    for table in range(tables):
        first, second, loss = [], [], []
        for k in range(width):
            y = padded
            for turn in range(3):
                y = hadamard(y * _signs(seed + 31 * (table * width + k) + 7 * turn, size)) / np.sqrt(size)
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.take_along_axis(np.abs(y), order, axis=1)
            order = np.where((value[:, 0] < value[:, 1])[:, None], order[:, ::-1], order)
            pick = np.take_along_axis(y, order, axis=1)
            cell = 2 * order + (pick < 0)
            first.append(cell[:, 0])
            second.append(cell[:, 1])
            loss.append(np.abs(pick[:, 0]) - np.abs(pick[:, 1]))
        closest = np.argsort(np.stack(loss), axis=0, kind="stable")
        for probe in range(min(probes, width) + 1):
            cells = np.stack(first)
            if probe:
                at = closest[probe - 1]
                cells[at, rows] = np.stack(second)[at, rows]
            code = label + np.uint64(table + 1)
            for k in range(width):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + cells[k].astype(np.uint64))
            out.append(code)
    return np.stack(out, axis=1).view(np.int64)


def cosine_pairs(vectors: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions left < right of the pairs with at least this cosine, in double precision, and the cosines."""
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    left, right, cosine, step = [], [], [], max(64, (1 << 22) // len(x))
    for at in range(0, len(x), step):
        dots = x[at : at + step] @ x.T
        i, j = np.nonzero(np.triu(dots >= threshold, at + 1))
        left.append(i + at)
        right.append(j)
        cosine.append(dots[i, j])
    return np.concatenate(left), np.concatenate(right), np.concatenate(cosine)


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = 8, width: int = 2, probes: int = 1, block: int = 512) -> DataFrame:
    """Links between vectors of equal labels whose cosine reaches the threshold.

    Returns ``id_col, class_id, n_links, component_id, kept, first`` per row: the least id with an equal vector and label,
    the number of other rows linked to directly, the least id reachable by links, whether the row's id is that one, and
    whether its class is the only one of its component for which ``first`` is true.

    Equal vectors are one member with a weight, however many they are. Null, zero, empty or non-finite vectors, null
    labels and null ids link with nothing; such a row is its own component. Vectors of different lengths are never
    compared. Rows are what is linked and counted, whether or not their ids repeat. Extra columns are ignored; an empty
    table gives no rows.
    """
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(finite & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    vectors = vectors.withColumn("own", usable).withColumn("key", F.when(F.col("own"), F.md5(F.to_json(F.struct("label", "v")))))
    good = vectors.where("own").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("payload"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, labels = batch.column("payload").to_pylist(), np.array(batch.column("label").to_pylist(), dtype=np.int64)
            codes: list = [None] * len(values)
            for dim in sorted({len(v) for v in values}):
                rows = [i for i, v in enumerate(values) if len(v) == dim]
                x = np.array([values[i] for i in rows], dtype=np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, code in zip(rows, polytope_codes(x, labels[rows], tables, width, probes), strict=True):
                    codes[i] = np.unique(code)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "weight", "payload")), pa.array(codes, pa.list_(pa.int64()))], ["key", "id", "weight", "payload", "codes"])

    classes = numbered_members(good.mapInArrow(sign, "key string, id long, weight long, payload array<double>, codes array<long>"), "vectors")
    found = materialise(links(classes.drop("payload"), classes.select("id", "key", "payload"), lambda v: cosine_pairs(v, threshold), block), "links")
    out = vectors.select("id", "key").join(per_class(classes, found), "key", "left")
    component = F.coalesce("component_id", "id")
    n_links = F.coalesce(F.col("weight") - 1 + F.col("n"), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), F.coalesce("first", F.lit(True)).alias("first"))
