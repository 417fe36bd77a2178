"""N-gram Jaccard join with a MinHash LSH forest (operator 10).

Each distinct text gets ``trees`` paths of MinHash values, one per prefix trie. Texts that share a node of some trie are
candidates, and each candidate is verified on its full set of shingles. The search starts with long prefixes, at
``max_depth``, where nodes are small. From the similarities of the links found so far it estimates how many pairs close to
the threshold that depth misses, and shortens the matched prefixes until the target recall is met; only pairs that did
not meet in a longer prefix are compared again. At the depth where even a pair at the threshold itself is found with the
target recall, 1 - (1 - t^depth)^trees, it ends in any case.

A node is named by the hash of its prefix, so a trie is a table of texts by node and level, and nothing is built or held
in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factengine.llm.buckets import links, numbered_members, per_class
from factengine.llm.common import materialise
from factengine.llm.shingles import CHUNK_BYTES, constants, jaccard_pairs, mix, shingles

#: Pairs whose similarity is at most this far above the threshold are those of which the recall is estimated, in so many bins.
BAND, BINS = 0.05, 10


def chance(similarity: float, depth: int, trees: int) -> float:
    """The probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - min(1.0, similarity) ** depth) ** trees


def least_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix at which every pair from the threshold on is found with the target recall."""
    return next((d for d in range(max_depth, 1, -1) if chance(threshold, d, trees) >= recall), 1)


def next_depth(seen: dict[float, int], depth: int, least: int, trees: int, recall: float) -> int:
    """The longest prefix, at most ``depth``, that meets the recall over the pairs there must be, given the numbers of
    pairs seen by similarity: a pair found with probability p stands for 1 / p pairs."""
    there = {s: n / chance(s, depth, trees) for s, n in seen.items() if n}
    for d in range(depth, least, -1):
        if sum(x * chance(s, d, trees) for s, x in there.items()) >= recall * sum(there.values()):
            return d
    return least


def trie_paths(texts: list[str | None], trees: int, least: int, depth: int, n: int = 5, seed: int = 1) -> list[np.ndarray]:
    """Per text, the names of its nodes from level ``least`` to ``depth``, level by level and tree by tree in each; none for
    a text without words."""
    a, b = constants(seed, trees * depth) | np.uint64(1), constants(seed + 1, trees * depth)
    salt, fold = constants(seed + 2, trees), np.uint64(0x9E3779B97F4A7C15)
    out: list[np.ndarray] = []
    at, none = 0, np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        while at < len(texts):
            to, size = at + 1, len(texts[at] or "")
            while to < len(texts) and size + len(texts[to] or "") <= CHUNK_BYTES:
                size += len(texts[to] or "")
                to += 1
            hashes, ends = shingles(texts[at:to], n)
            begins = np.concatenate(([0], ends[:-1]))
            full = np.flatnonzero(ends > begins)
            nodes = np.empty((len(full), depth - least + 1, trees), dtype=np.uint64)
            if len(full):
                for tree in range(trees):
                    node = np.full(len(full), salt[tree], dtype=np.uint64)
                    for level in range(1, depth + 1):
                        k = tree * depth + level - 1
                        node = mix(node * fold + np.minimum.reduceat(hashes * a[k] + b[k], begins[full]))
                        if level >= least:
                            nodes[:, level - least, tree] = node
            row = dict(zip(full.tolist(), nodes.reshape(len(full), (depth - least + 1) * trees).view(np.int64), strict=True))
            out += [row.get(i, none) for i in range(to - at)]
            at = to
    return out


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, n: int = 5, trees: int = 16, max_depth: int = 6, recall: float = 0.9995, block: int = 512) -> DataFrame:
    """Self-join of texts whose sets of word ``n``-grams have a Jaccard similarity of ``threshold`` or more.

    Returns per row ``id_col, class_id, n_links, component_id, kept, key, first``: the least id with an equal text, the
    number of other rows linked to directly (rows with an equal text included), the least id reachable by links, whether
    the row's id is that one, the MD5 of the text, and whether its class of equal texts is the only one of its component
    for which ``first`` is true. Pairs of different texts are never written out.

    Null and empty texts, and rows with a null id, link with nothing; their class and component are their own id. Texts
    of one to ``n - 1`` words have one shingle of all their words. Rows are what is linked and counted, whether or not
    their ids repeat. Extra columns are ignored, so their names don't matter. An empty table gives no rows.
    """
    least = least_depth(threshold, trees, max_depth, recall)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = trie_paths(batch.column("text").to_pylist(), trees, least, max_depth, n)
            ends = np.concatenate(([0], np.cumsum([len(c) for c in paths]))).astype(np.int32)
            flat = np.concatenate([*paths, np.zeros(0, dtype=np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.ListArray.from_arrays(ends, flat)], ["id", "key", "paths"])

    def level(depth: int) -> Column:
        return F.slice("paths", 1 + (depth - least) * trees, trees)

    signed = materialise(docs.select("id", F.md5("text").alias("key"), "text").mapInArrow(sign, "id long, key string, paths array<long>"), "signed")
    classes = numbered_members(signed.where("id is not null and size(paths) > 0").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("paths").alias("paths")), "classes")
    payload = docs.where("id is not null and text is not null").select("id", F.md5("text").alias("key"), F.col("text").alias("payload"))
    edges = tuple(threshold + BAND * i / BINS for i in range(BINS + 1))
    found, seen, depth, before = None, dict.fromkeys(edges[:BINS], 0), max_depth, None
    while True:
        members = classes.select("m", "id", "key", "weight", level(depth).alias("codes"), *([level(before).alias("inner")] if before else []))
        new = materialise(links(members, payload, lambda texts: jaccard_pairs(texts, threshold, n), block, edges), "links")
        found = new if found is None else found.unionByName(new)
        for row in new.where(F.col("bin") < BINS).groupBy("bin").agg(F.sum("pairs").alias("pairs")).collect():
            seen[edges[row.bin]] += row.pairs
        before, depth = depth, next_depth(seen, depth, least, trees, recall)
        if depth == before:
            break
    out = signed.select("id", "key", (F.size("paths") > 0).alias("has")).join(per_class(classes, found), "key", "left")
    own = F.col("has") & F.col("id").isNotNull() & F.col("class_id").isNotNull()
    class_id = F.when(own, F.col("class_id")).otherwise(F.col("id"))
    component = F.when(own, F.col("component_id")).otherwise(F.col("id"))
    n_links = F.when(own, F.col("weight") - 1 + F.col("n")).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "key", F.when(own, F.col("first")).otherwise(F.lit(True)).alias("first"))
