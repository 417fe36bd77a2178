"""A training corpus from `documents`: reject bad texts, keep one of each group of near copies, mix sources, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factengine.llm import merge_dropout
from factengine.llm.common import BROADCAST_KEYED, checked_broadcast, free_name, materialise, numbered_copies
from factengine.llm.jaccard_join import ngram_jaccard_join
from factengine.llm.mixing import mix
from factengine.llm.quality import score, train

#: The score from which a document stays.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the model learns from `labels` that are not held out.

    Every text is scored whole, whatever its length; null counts as empty, repeated rows share their fate, an empty table
    gives no rows, and columns that go by the names of the operators' own are kept.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs.columns, "__score")
    return score(docs, model, "text", name).where(F.col(name) >= LEAST_QUALITY).drop(name)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8, that of least id; rows that repeat its id and text stay
    once. Rows with a null id or a text without words have no links and stay. An empty table gives no rows."""
    found = materialise(ngram_jaccard_join(docs), "joined")
    id_, key = free_name(docs.columns, "__id"), free_name(docs.columns, "__key")
    gone = found.where("doc_id is not null and key is not null and not (first and doc_id = class_id)").select(F.col("doc_id").alias(id_), F.col("key").alias(key)).distinct()
    same = (F.col("doc_id") == F.col(id_)) & (F.md5("text") == F.col(key))
    kept = docs.join(checked_broadcast(gone, BROADCAST_KEYED), same, "left_anti")
    repeated = found.where("first and doc_id = class_id and n_links > 0").groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias(id_), F.col("key").alias(key))
    repeated = materialise(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    repeated = checked_broadcast(repeated, BROADCAST_KEYED)
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned out so that the sources reach weights 5, 2, 1 in turn. Null texts and sources, repeated
    rows and empty tables as :func:`factengine.llm.mixing.mix` has them."""
    return mix(docs)


def merge_dropout_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with seeded merge-dropout; copies of a document are varied one by one. Null texts have
    null ids and a null number, empty ones none; texts of any length are encoded whole; an empty table gives no rows."""
    coded = merge_dropout.encode(numbered_copies(docs.select("doc_id", "source", "text"), "doc_id", "text", "copy"), copy_col="copy")
    return coded.select("doc_id", "source", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", merge_dropout_tokens),
]

#: Compression and tokenisation are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
