"""Verified links among the members of hash buckets, without a row for each pair.

A *member* is a class of equal rows. It has a number of its own (ids may repeat), the least id and the key of its rows, a
weight (how many rows it stands for) and a set of bucket codes. Two members are candidates if they share a code. Each
candidate pair is compared once: in the bucket whose code is the least of those both have. Buckets with the same members
are kept once. A bucket of more than ``block`` members is cut into blocks of half that by a hash of the member, and each
pair of blocks is one unit of work, so no unit has many more than ``block`` members.

A unit yields, for each of its members with links, how many rows it links to and one edge towards the root of its tree
in the unit; the rows made are in proportion to the members, not to the pairs.

Members may also carry ``inner`` codes, one beside each code: of a bucket inside that bucket whose pairs are compared
already. Pairs that share an inner code are left out, and so are buckets whose members all do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factengine.llm.common import bounded, materialise
from factengine.llm.components import components

#: Rows with a member: a part of its links, and an edge. Rows without: how many pairs have a similarity in a bin.
LINKS = "m long, n long, root long, bin int, pairs long"


def numbered_members(classes: DataFrame, name: str) -> DataFrame:
    """``classes`` as a written table with a number ``m`` of each row, which holds for all later reads."""
    return materialise(classes.withColumn("m", F.monotonically_increasing_id()), name)


def units(members: DataFrame, block: int) -> DataFrame:
    """``(code, a, b, side, m)``: the members of each unit; ``a`` = ``b`` for pairs inside one block."""
    marks = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("m")).alias("s1"), F.bit_xor(F.xxhash64("m", F.lit(7))).alias("s2")]
    if "inner" in members.columns:
        both = members.select("m", F.explode(F.arrays_zip("codes", "inner")).alias("at")).select("m", "at.codes", "at.inner")
        placed = both.select("m", F.col("codes").alias("code"))
        per = both.groupBy(F.col("codes").alias("code"), "inner").agg(*marks)
        buckets = per.groupBy("code").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")).where("n > most")
    else:
        placed = members.select("m", F.explode("codes").alias("code"))
        buckets = placed.groupBy("code").agg(*marks).where("n > 1")
    blocks = F.when(F.col("n") <= block, 1).otherwise(F.ceil(F.col("n") * 2 / block)).cast("int")
    kept = buckets.groupBy("n", "s1", "s2").agg(F.min("code").alias("code")).select("code", blocks.alias("blocks"))
    side = F.pmod(F.xxhash64("m", "code"), F.col("blocks")).cast("int")
    dealt = placed.join(kept, "code").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("code", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "m")


def open_pairs(codes: list, inner: list | None, sides: np.ndarray, unit: tuple) -> np.ndarray:
    """Which pairs of a unit's members, left < right, are to be compared in it: those of its two blocks that share no code
    below the unit's and no inner code."""
    code, a, b = unit
    n = len(codes)
    out = np.triu(np.ones((n, n), dtype=bool), 1)
    if a != b:
        out &= sides[:, None] != sides[None, :]
    owner = np.repeat(np.arange(n), [len(c) for c in codes])
    flat = np.concatenate(codes)
    low = flat < code
    owner, flat = owner[low], flat[low]
    if inner is not None:
        owner = np.concatenate((owner, np.repeat(np.arange(n), [len(c) for c in inner])))
        flat = np.concatenate((flat, *inner))
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, dtype=int)
    ends = np.append(starts[1:], len(flat)) if len(flat) else starts
    done: set[bytes] = set()
    for i in np.flatnonzero(ends - starts > 1).tolist():
        group = np.unique(owner[starts[i] : ends[i]])
        if len(group) > 1 and (mark := group.tobytes()) not in done:
            done.add(mark)
            out[np.ix_(group, group)] = False
    return out


def _unit_links(unit: tuple, rows: dict, similar: Callable, edges: np.ndarray) -> tuple[list, list, list, np.ndarray]:
    """Links of one unit, and its pairs per bin of similarity; rows: columns as lists in the order of arrival. Only members
    that have a pair to be compared are compared."""
    none: tuple[list, list, list, np.ndarray] = ([], [], [], np.zeros(len(edges), dtype=np.int64))
    numbers = np.array(rows["m"], dtype=np.int64)
    order = np.lexsort((numbers, np.array(rows["side"])))
    array = lambda name: [np.array(rows[name][i], dtype=np.int64) for i in order] if name in rows else None
    wanted = open_pairs(array("codes"), array("inner"), np.array(rows["side"])[order], unit)
    own = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
    if not len(own):
        return none
    left, right, likeness = similar([rows["payload"][i] for i in order[own]])  # pairs of positions, left < right
    keep = wanted[own[left], own[right]]
    left, right = left[keep], right[keep]
    if not len(left):
        return none
    numbers, weights = numbers[order][own], np.array(rows["weight"], dtype=np.int64)[order][own]
    bins = np.bincount(np.searchsorted(edges, likeness[keep], side="right"), minlength=len(edges) + 1)[1:][: len(edges)]
    counts = np.zeros(len(numbers), dtype=np.int64)
    np.add.at(counts, left, weights[right])
    np.add.at(counts, right, weights[left])
    root = np.arange(len(numbers))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    linked = np.flatnonzero(counts)
    return numbers[linked].tolist(), counts[linked].tolist(), [int(numbers[find(i)]) for i in linked.tolist()], bins


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple[tuple, dict]]:
    """Runs of equal keys in sorted batches, as columns of Python values; a run may go over batches."""
    held: tuple | None = None
    rows: dict = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        columns = {v: batch.column(v).to_pylist() for v in values}
        start = 0
        for i in range(1, len(heads) + 1):
            if i < len(heads) and heads[i] == heads[start]:
                continue
            if heads[start] != held:
                if held is not None:
                    yield held, rows
                held, rows = heads[start], {v: [] for v in values}
            for v in values:
                rows[v] += columns[v][start:i]
            start = i
    if held is not None:
        yield held, rows


def links(members: DataFrame, payload: DataFrame, similar: Callable, block: int, edges: tuple[float, ...] = ()) -> DataFrame:
    """Rows of :data:`LINKS`: parts of each member's number of links, edges that span the links of a unit, and how many
    pairs have a similarity from one of the ascending ``edges`` to the next (above the last: in its bin).

    members: ``m, id, key, weight, codes`` and perhaps ``inner``, codes and inner codes in the same order; payload:
    ``id, key, payload``, by which a member finds the payload of its rows. ``similar(payloads)`` returns two arrays of
    positions, left < right, of the pairs that are alike, and their similarities.
    """
    work = materialise(units(members, block), "units")
    partners = work.select("m").distinct()
    if bounded(work) or bounded(partners):  # rows of a written table are counted from its footers
        members = members.join(F.broadcast(partners), "m", "left_semi")
        payload = payload.join(F.broadcast(members.select("id").distinct()), "id", "left_semi")
    own = [c for c in ("m", "weight", "codes", "inner") if c in members.columns]
    full = payload.groupBy("id", "key").agg(F.first("payload").alias("payload")).join(members.select("id", "key", *own), ["id", "key"]).select(*own, "payload")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.join(full, "m").repartition(parts, "code", "a", "b").sortWithinPartitions("code", "a", "b")
    steps, values = np.array(edges, dtype=np.float64), ("side", "payload", *own)

    def batch_of(found: tuple[list, list, list], bins: np.ndarray) -> pa.RecordBatch:
        n, k = len(found[0]), np.flatnonzero(bins)
        none = [None] * len(k)
        columns = [*([*x, *none] for x in found), [None] * n + k.tolist(), [None] * n + bins[k].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c == "bin" else pa.int64()) for c, x in zip(("m", "n", "root", "bin", "pairs"), columns, strict=True)], ["m", "n", "root", "bin", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bins = ([], [], []), np.zeros(len(steps), dtype=np.int64)
        for unit, rows in grouped(batches, ("code", "a", "b"), values):
            *found, seen = _unit_links(unit, rows, similar, steps)
            bins += seen
            for whole, part in zip(out, found, strict=True):
                whole += part
            if len(out[0]) > 50_000:
                yield batch_of(out, bins)
                out, bins = ([], [], []), np.zeros(len(steps), dtype=np.int64)
        yield batch_of(out, bins)

    return dealt.mapInArrow(run, LINKS)


def per_class(members: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, class_id, weight, n, component_id, first)`` per member: rows linked to in other classes, the least id of its
    component, and whether it is its component's one representative, the class of least id and then key."""
    counts = found.where("m is not null").groupBy("m").agg(F.sum("n").alias("n"))
    parts = components(found.where("m is not null").select(F.col("m").alias("u"), F.col("root").alias("v")))
    named = parts.withColumnRenamed("node", "m").join(members.select("m", "id", "key"), "m")
    heads = named.groupBy("component").agg(F.min(F.struct("id", "key")).alias("head"))
    # on a hash beside the component, so that a large component's rows are dealt out for this join and can be split
    keyed = lambda df: df.withColumn("h", F.xxhash64("component"))
    placed = keyed(named.select("m", "component")).join(keyed(heads), ["h", "component"]).select("m", "head")
    out = members.select("m", "id", "key", "weight").join(counts, "m", "left").join(placed, "m", "left")
    own = F.struct("id", "key")
    return out.select("key", F.col("id").alias("class_id"), "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("head.id"), F.col("id")).alias("component_id"), F.coalesce(F.col("head") == own, F.lit(True)).alias("first"))
