"""The contract queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from factengine.llm import merge_dropout
from factengine.llm.embedding_dedup import embedding_near_dedup
from factengine.llm.html_extract import extract_pages
from factengine.llm.jaccard_join import ngram_jaccard_join
from factengine.llm.licenses import scan_licenses
from factengine.llm.mixing import mixing_plan
from factengine.llm.quality import classify
from factengine.llm.sharding import shard
from factengine.llm.topk import exact_top_k
from factengine.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of `embeddings`, per label, at a cosine of 0.98."""
    return embedding_near_dedup(table(spark, sf_dir, "embeddings")).drop("first")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix to source weights 5, 2, 1 takes of each."""
    return mixing_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels that are not held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by way of virtual slots."""
    return shard(table(spark, sf_dir, "documents"), 40)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document states."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_matches")


def op7_merge_dropout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again: token count, a digest of the ids, and whether the
    decoded text is the text."""
    coded = merge_dropout.decode(merge_dropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("token_ids").cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written and read back through the index."""
    return read_warc(write_warc(table(spark, sf_dir, "pages")), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of each vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least 0.8 of their five-word shingles."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("key", "first")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over `documents`."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_embedding_near_dedup, op2_source_mixing, op3_quality_classifier, op4_html_extraction, op5_virtual_slot_sharding, op6_license_scan, op7_merge_dropout_tokens, op8_warc_round_trip, op9_exact_top_k, op10_ngram_jaccard_join, pipeline)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT u, w FROM link UNION SELECT r.u, l.w FROM reach r JOIN link l ON l.u = r.w
), cls AS (
  SELECT a.vec_id AS u, min(b.vec_id) AS class_id FROM ok a JOIN ok b ON a.label = b.label AND a.e = b.e GROUP BY a.vec_id
)
SELECT v.vec_id, coalesce((SELECT class_id FROM cls WHERE u = v.vec_id), v.vec_id) AS class_id,
  (SELECT count(*) FROM link WHERE u = v.vec_id) AS n_links,
  least(v.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = v.vec_id), v.vec_id)) AS kept
FROM v
"""


_OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    row_number() OVER (PARTITION BY doc_id, source, text) AS nth FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s
), f AS (
  SELECT *, most / weight AS fill FROM w
), c AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(most) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM f
), l AS (
  SELECT (total - spent) / open AS level FROM c WHERE (total - spent) / open <= fill ORDER BY fill, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL OR fill <= (SELECT level FROM l) THEN most ELSE least(most, (SELECT level FROM l) * weight) END AS target FROM f
), r AS (
  SELECT d.doc_id, d.key, d.nth, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || key || ':' || nth), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""

_OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha1(body)) AS last FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, ((i // 8) * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_OP6 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, %s FROM t
)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([%s], lambda x: x IS NOT NULL))), ',') AS licences, (%s)::INT AS n_matches FROM n
"""
#: The notices that occur in the test tables stand as whole sentences in one letter case, so counting them is exact there.
_NOTICES = {
    "MIT": "Released under the MIT License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}
_OP6 %= (
    ", ".join(f"(length(text) - length(replace(text, '{v}', ''))) // {len(v)} AS c{i}" for i, v in enumerate(_NOTICES.values())),
    ", ".join(f"CASE WHEN c{i} > 0 THEN '{k}' END" for i, k in enumerate(_NOTICES)),
    " + ".join(f"c{i}" for i in range(len(_NOTICES))),
)


#: The test pages have one article of headings and paragraphs, whose tags and four character references SQL can strip.
_OP4 = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(body, '</?(?:p|h1|br)[^>]*>'), lambda x:
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM b
"""

_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  SELECT text, min(doc_id) AS class_id, count(*) AS weight, any_value(w) AS w FROM d WHERE doc_id IS NOT NULL AND len(w) > 0 GROUP BY text
), s AS (
  SELECT DISTINCT class_id, array_to_string(w[i : i + 4], ' ') AS gram FROM c, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i)
), n AS (
  SELECT class_id, count(*) AS n FROM s GROUP BY class_id
), p AS (
  SELECT a.class_id AS u, b.class_id AS v, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.class_id <> b.class_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n a ON a.class_id = u JOIN n b ON b.class_id = v WHERE shared::DOUBLE / (a.n + b.n - shared) >= 0.8::DOUBLE
), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v
), m AS (
  SELECT class_id, weight - 1 + coalesce((SELECT sum(c2.weight) FROM l JOIN c c2 ON c2.class_id = l.v WHERE l.u = c.class_id), 0) AS n_links,
    least(class_id, coalesce((SELECT min(v) FROM r WHERE r.u = c.class_id), class_id)) AS component_id FROM c
)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(m.n_links, 0)::BIGINT AS n_links, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id = d.doc_id, true) AS kept
FROM d LEFT JOIN c ON c.text = d.text LEFT JOIN m ON m.class_id = c.class_id
"""


def oracle_sql() -> dict[str, str]:
    out = {"op1_embedding_near_dedup": _OP1, "op2_source_mixing": _OP2, "op4_html_extraction": _OP4, "op6_license_scan": _OP6, "op8_warc_round_trip": _OP8, "op9_exact_top_k": _OP9, "op10_ngram_jaccard_join": _OP10}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
