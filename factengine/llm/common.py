"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factengine.session import new_folder as new_path
from factengine.session import qualified
from factengine.session import written as materialise

__all__ = ["BROADCAST_KEYED", "BROADCAST_ROWS", "bounded", "checked_broadcast", "each", "free_name", "materialise", "new_path", "numbered_copies", "qualified", "word_count"]

#: Rows of a table of ids, sources or slots up to which it may be broadcast: 2 million longs are 16 MB.
BROADCAST_ROWS = 2_000_000
#: The same for rows with a digest beside the id, of which each is about 100 bytes.
BROADCAST_KEYED = 250_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows, by a count that each task sums up for itself."""
    return df.count() <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if bounded(df, limit) else df


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def word_count(text):
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def each(df: DataFrame, count: str, out_col: str) -> DataFrame:
    """Each row of ``df`` as often as its column ``count`` says, numbered from 1 in ``out_col``; in two steps, so that no long
    array is made."""
    step, block = 4096, free_name(df.columns, "__block")
    n = F.col(count)
    rows = df.withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))))
    first = F.col(block).cast("long") * step
    return rows.withColumn(out_col, F.explode(F.sequence(first + 1, F.least(n, first + step)))).drop(block)


def numbered_copies(df: DataFrame, id_col: str, text_col: str, out_col: str) -> DataFrame:
    """``df`` with ``out_col``, the number of a row among the identical rows, from 1.

    Only rows whose id and text occur again are shuffled; identical ones are counted, which each task does for itself
    first, and written out again by their count. So a row that is repeated without end fills no task.
    """
    id_, key, n = (free_name(df.columns, f"__copy_{x}") for x in ("id", "key", "n"))
    named = df.select(F.col(id_col).alias(id_), F.md5(F.col(text_col)).alias(key))
    again = materialise(named.groupBy(id_, key).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(id_, key), "repeated")
    if again.isEmpty():
        return df.withColumn(out_col, F.lit(1).cast("long"))
    same = df[id_col].eqNullSafe(F.col(id_)) & F.md5(df[text_col]).eqNullSafe(F.col(key))
    again = checked_broadcast(again, BROADCAST_KEYED)
    once = df.join(again, same, "left_anti").withColumn(out_col, F.lit(1).cast("long"))
    counted = df.join(again, same, "left_semi").groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias(n))
    return once.unionByName(each(counted, n, out_col).drop(n))
