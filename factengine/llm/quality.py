"""Quality classifier by compression (operator 3).

Two zstandard dictionaries are built from labelled texts, one from good and one from bad ones. A text's feature is the
difference of its compressed sizes under the two, over its own size; a logistic curve fitted on labelled texts turns
features into a probability. Labels only reach the model through a bounded sample. Every text is compressed in pieces of
one size that together are all of it, so the end of a long text is held against the dictionaries as its head is, and not
against the text itself.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled texts per class that the fit may take (half for the dictionary, half for the curve), their most bytes, and the
#: size of a dictionary. These bounds are the model's, whatever the size of the corpus; they hold for the fit alone.
SAMPLE_PER_CLASS, LONGEST_LABELLED, DICTIONARY_BYTES = 2000, 65_536, 524_288
#: zstandard's level.
LEVEL = 3
#: Bytes of a piece that is compressed alone.
SCORED_BYTES = 2000


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries, and the curve over [1, difference, compressibility, log size and their products]; without labels of
    both kinds the score is the constant share of good labels."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]


def is_held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; such labels are never learnt."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def shared_lines(texts: list[str]) -> set[str]:
    """Lines that two texts or more have; passages that go round say nothing about quality."""
    seen = Counter(line for text in texts for line in set(text.split("\n")))
    return {line for line, n in seen.items() if n > 1}


def build_dictionary(texts: list[str], leave_out: set[str] = frozenset(), size: int = DICTIONARY_BYTES) -> bytes:
    """Raw dictionary content: whole texts, without the lines to leave out; in turn, each that fits into what is left."""
    pieces, total = [], 0
    for text in texts:
        data = "\n".join(x for x in text.split("\n") if x not in leave_out).encode("utf-8", "surrogatepass")
        if data and total + len(data) < size:
            pieces.append(data)
            total += len(data) + 1
    return b"\n".join(pieces)


class Compressor:
    """Features of texts under a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def packer(content: bytes) -> zstandard.ZstdCompressor:
            if len(content) < 8:
                return zstandard.ZstdCompressor(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

        self.packers = packer(good), packer(bad)

    def features(self, text: str | None) -> tuple[float, ...]:
        data = (text or "").encode("utf-8", "surrogatepass")
        n = max(1, -(-len(data) // SCORED_BYTES))
        ends = [len(data) * i // n for i in range(n + 1)]
        pieces = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        good, bad = (sum(len(p.compress(x)) for x in pieces) for p in self.packers)
        # by the size of a piece, so that a text of many pieces lies where the curve was fitted
        size = len(data) + 32 * n
        d, c, s = (bad - good) / size, good / size, math.log(size / n) / 10
        return d, c, s, c * c, s * s, d * s, d * c, c * s


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression by Newton's method; deterministic. Returns the intercept, then the coefficients."""
    mean, spread = np.average(x, axis=0, weights=weight), np.sqrt(np.average((x - np.average(x, axis=0, weights=weight)) ** 2, axis=0, weights=weight)) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    beta = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1]) * weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    coefficients = beta[1:] / spread
    return (float(beta[0] - (coefficients * mean).sum()), *map(float, coefficients))


def score_of(curve: tuple[float, ...], features: tuple[float, ...]) -> float:
    if len(curve) == 1:
        return curve[0]
    z = curve[0] + sum(c * f for c, f in zip(curve[1:], features, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> CompressionModel:
    """Fits on at most ``per_class`` labelled texts of each class, those whose hashes are least, of at most
    ``LONGEST_LABELLED`` bytes. Every second one is for the dictionaries, which take whole texts up to their size.

    Labels that are held out, null, neither 0 nor 1, contradictory or without a text are not used. The curve weighs the
    two samples by the classes' numbers over all usable labels, so scores are probabilities in the corpus.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return CompressionModel(b"", b"", (float(next(iter(counts), 1)),))
    order = [F.md5(F.concat(F.lit("quality:"), F.col("id").cast("string"))), F.col("id")]
    picked = usable.where("y = 0").orderBy(*order).limit(per_class).unionByName(usable.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= LONGEST_LABELLED)
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(*order).limit(2 * per_class).collect()
    halves = {y: ([r.text for r in rows if r.y == y][::2], [r.text for r in rows if r.y == y][1::2]) for y in (0, 1)}
    common = shared_lines([r.text for r in rows])
    good, bad = build_dictionary(halves[1][0], common), build_dictionary(halves[0][0], common)
    packer = Compressor(good, bad)
    x, y, w = [], [], []
    for kind in (0, 1):
        part = halves[kind][1] or halves[kind][0]
        x += [packer.features(t) for t in part]
        y += [kind] * len(part)
        w += [counts[kind] / sum(counts.values()) / max(1, len(part))] * len(part)
    if len(set(y)) < 2:
        return CompressionModel(good, bad, (counts[1] / sum(counts.values()),))
    return CompressionModel(good, bad, fit_curve(np.array(x), np.array(y, dtype=float), np.array(w)))


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, the probability that the text is good; null counts as empty. One pass, no shuffle."""
    good, bad, curve = model.good, model.bad, model.curve

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = Compressor(good, bad)
        for texts in batches:
            yield pd.Series([score_of(curve, packer.features(t)) for t in texts], dtype="float64")

    return docs.withColumn(out_col, scored(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; trains first (see :func:`train`).

    The texts are the only input of a score, so equal texts get equal scores, repeated rows included. Null texts count
    as empty. Null ids are held out by the checksum of an empty string. Empty tables give no rows; extra columns are
    ignored.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    out = score(rows, model, "__text")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
