"""Exact top-k by inner product with distributed histogram selection (operator 9).

Vectors and queries are packed into blocks. Vector blocks are dealt to lanes, and each lane gets every query block, so
every pair of blocks meets once and nothing but blocks is shuffled.
All scores are computed; each pass counts, per query, the scores above the known bound in equal bins of the open
range, and the summed counts tell the bin that holds the kth score. The range shrinks to that bin until its width is
one. Then scores above or at the kth value are kept and ties go to the smaller id.

A query is itself one of the vectors. One more score than asked for is selected, and of the rows that have a query's id
and its score with itself one is left out at the end; which one makes no difference to the result.

A task's count below its own kth score can't matter, since the counts above it already reach k; so a task sends at most
k bins per query and pass, and at most k rows per query at the end, whatever the number of ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factengine.llm.buckets import grouped
from factengine.llm.common import each, materialise

#: Vectors and queries in a packed block.
VECTORS, QUERIES = 4096, 1024
#: Bins of a counting pass, and queries whose counts or rows a task holds before it sends them on.
BINS, HELD = 2048, 100_000


def _pack(rows: DataFrame, per_block: int, total: int, name: str, spread: bool) -> DataFrame:
    """``(dim, block, ids binary, vectors binary)``: int64 arrays of the rows that a hash puts together; ``spread`` hashes
    places of rows, so that equal rows part."""
    blocks = max(1, -(-total // per_block))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.xxhash64(F.monotonically_increasing_id()) if spread else F.xxhash64("id")
    dealt = rows.withColumn("dim", F.size("v")).withColumn("block", F.pmod(by, F.lit(blocks)).cast("int")).repartition(parts, "dim", "block").sortWithinPartitions("dim", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, block), values in grouped(batches, ("dim", "block"), ("id", "v")):
            ids, vectors = (np.array(values[c], dtype=np.int64).tobytes() for c in ("id", "v"))
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), pa.array([ids]), pa.array([vectors])], ["dim", "block", "ids", "vectors"])

    return materialise(dealt.select("dim", "block", "id", "v").mapInArrow(run, "dim int, block int, ids binary, vectors binary"), name)


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(vectors, dtype=np.int64).reshape(-1, dim)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where no sum can leave 53 bits, else in 64-bit integers."""
    high = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return np.rint(q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if high < 2**53 else q @ v.T


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(query_id, rank, id_col, score)``: per query the ``k`` highest inner products of floor(scale * x) over all other
    rows of ``vectors``, ties to the smaller id; all rows, if there are fewer.

    ``queries`` are rows of ``vectors``; each is asked, also if its id or its vector repeats, and compared with every row
    but itself. Rows whose vector is null, empty or holds null or non-finite components, and rows with a null id, take no
    part. A query is compared with vectors of its own length. Scores that may not fit into 64 bits are an error. Empty
    tables give no rows; extra columns are ignored.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
        good = F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        return rows.where(F.coalesce(good, F.lit(False))).select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))

    wanted, k = k, k + 1
    data = usable(vectors)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    n_data, reach = data.agg(F.count("*"), F.max(norm)).first()
    # no score is beyond the product of the largest norms; the first bins span that range
    bound = (reach or 0.0) ** 2 * (1 + 1e-9) + 1
    if bound >= 2**62:
        raise ValueError("the inner products may not fit into 64 bits")
    # equal queries are asked once, under a number
    asked = usable(queries).groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("own", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))
    asked = materialise(asked.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("own_id"), "v", "times", "own"), "asked")
    data, packed = _pack(data, VECTORS, n_data, "vectors", True), _pack(asked.select(F.col("query").alias("id"), "v"), QUERIES, asked.count(), "queries", False)
    lanes = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-n_data // VECTORS)))
    left = data.select("dim", F.pmod("block", F.lit(lanes)).alias("lane"), "ids", "vectors")
    right = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("block").alias("query_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def meet(state: DataFrame) -> DataFrame:
        """Each query block, with the open ranges of its queries, beside each vector block of a lane."""
        return right.join(state, ["dim", "query_block"]).join(left, ["dim", "lane"]).select("dim", "query_block", "q_ids", "q_vectors", "low", "width", "ids", "vectors")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _unpack(row["q_ids"], row["q_vectors"], row["dim"])
                ids, v = _unpack(row["ids"], row["vectors"], row["dim"])
                low, width = (np.frombuffer(row[c], dtype=np.int64) for c in ("low", "width"))
                yield row["dim"], row["query_block"], q_ids, ids, _scores(q, v), low, width

    def as_batch(rows: list, names: list[str]) -> pa.RecordBatch:
        small = {"dim": pa.int32(), "query_block": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], small.get(n, pa.int64())) for j, n in enumerate(names)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found = ["dim", "query_block", "query_id", "bin", "n"], {}
        out = lambda: as_batch([(*key, b, n) for key, held in found.items() for b, n in held.items()], names)
        for dim, block, q_ids, _, score, low, width in met(batches):
            bins = np.minimum((score - low[:, None]) // width[:, None], BINS)
            if bins.shape[1] > k:
                bins = np.where(bins >= np.partition(bins, -k, axis=1)[:, -k][:, None], bins, -1)
            for q_id, own in zip(q_ids.tolist(), bins, strict=True):
                held = found.setdefault((dim, block, q_id), {})
                for b, n in zip(*(x.tolist() for x in np.unique(own[own >= 0], return_counts=True)), strict=True):
                    held[b] = held.get(b, 0) + n
                while len(held) > 1 and sum(held.values()) - held[least := min(held)] >= k:
                    del held[least]
            if len(found) > HELD:
                yield out()
                found.clear()
        yield out()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best = ["query_id", "id", "score"], {}
        out = lambda: as_batch([(q, int(w), int(s)) for q, (ss, ww) in best.items() for s, w in zip(ss, ww, strict=True)], names)
        for _, _, q_ids, ids, score, low, _ in met(batches):
            keep = score >= low[:, None]
            for i in np.flatnonzero(keep.any(axis=1)).tolist():
                q_id, s, w = int(q_ids[i]), score[i][keep[i]], ids[keep[i]]
                if q_id in best:
                    s, w = np.concatenate((best[q_id][0], s)), np.concatenate((best[q_id][1], w))
                order = np.lexsort((w, -s))[:k]
                best[q_id] = (s[order], w[order])
            if len(best) > HELD:
                yield out()
                best.clear()
        yield out()

    bound = int(bound)
    start, width = -bound, max(1, -(-(2 * bound + 1) // BINS))
    state = _ranges(packed, None, start, width)
    while True:
        bins = meet(state).mapInArrow(count, "dim int, query_block int, query_id long, bin long, n long").groupBy("dim", "query_block", "query_id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query_id").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
        # the bin of the kth score is the first at which the counts from above reach k; with fewer scores, the lowest
        kth = bins.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("above") < k).groupBy("dim", "query_block", "query_id").agg(F.min("bin").alias("bin"))
        state = _ranges(packed, materialise(kth, "kth"), start, width, state)
        if width == 1:
            break
        width = max(1, -(-width // BINS))
    found = meet(state).mapInArrow(pick, "query_id long, id long, score long").withColumnRenamed("query_id", "query")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(asked.drop("v"), "query")
    # the first row of the query's id and its score with itself stands for the query
    itself = F.min(F.when((F.col("id") == F.col("own_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(Window.partitionBy("query"))
    top = top.withColumn("itself", F.coalesce(itself, F.lit(k))).where("rank <> itself")
    rank = (F.col("rank") - (F.col("rank") > F.col("itself")).cast("int")).cast("int")
    return each(top.where(rank <= wanted).withColumn("place", rank), "times", "time").select(F.col("own_id").alias("query_id"), F.col("place").alias("rank"), F.col("id").alias(id_col), "score")


def _ranges(asked: DataFrame, kth: DataFrame | None, start: int, width: int, before: DataFrame | None = None) -> DataFrame:
    """``(dim, query_block, low, width)``: per packed query block the lower end of each query's open range and the width
    of the bins to count next, as int64 arrays in the order of the block's ids."""
    blocks = asked.select("dim", F.col("block").alias("query_block"), "ids")
    if kth is None:
        rows = blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = [len(x) // 8 for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("query_block"), *(pa.array([np.full(n, x, dtype=np.int64).tobytes() for n in sizes], pa.binary()) for x in (start, width))], ["dim", "query_block", "low", "width"])

    else:
        found = kth.groupBy("dim", "query_block").agg(F.collect_list(F.struct("query_id", "bin")).alias("found"))  # one packed block's queries
        rows = blocks.join(before, ["dim", "query_block"]).join(found, ["dim", "query_block"], "left")
        finer = max(1, -(-width // BINS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lows = []
                for ids, low, found in zip(*(batch.column(c).to_pylist() for c in ("ids", "low", "found")), strict=True):
                    bins = {r["query_id"]: r["bin"] for r in found or []}
                    low = np.frombuffer(low, dtype=np.int64).copy()
                    for i, q_id in enumerate(np.frombuffer(ids, dtype=np.int64).tolist()):
                        low[i] += bins.get(q_id, 0) * width
                    lows.append(low)
                yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("query_block"), pa.array([x.tobytes() for x in lows], pa.binary()), pa.array([np.full(len(x), finer, dtype=np.int64).tobytes() for x in lows], pa.binary())], ["dim", "query_block", "low", "width"])

    return materialise(rows.mapInArrow(run, "dim int, query_block int, low binary, width binary"), "ranges")
