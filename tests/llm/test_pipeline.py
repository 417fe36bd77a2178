"""The quality classifier and the corpus pipeline against brute-force versions that share no code with them."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

import corpus_pipeline
from factengine.llm import merge_dropout, quality
from tests.llm.test_joins import brute_jaccard
from tests.llm.test_operators import naive_dropout, signed, water_fill

SF = "/root/testdata/sf0.001"


def brute_quality(docs, labels):
    """rows (id, text), rows (id, label) -> id -> score, written out one text after the other."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    text = {i: t for i, t in docs if t is not None and len(t.encode()) <= 65_536}
    known = {i: y for i, y in labels if not held(i)}
    by = {y: sorted((i for i in known if known[i] == y), key=lambda i: hashlib.md5(f"quality:{i}".encode()).hexdigest())[:2000] for y in (0, 1)}
    total = {y: sum(v == y for v in known.values()) for y in (0, 1)}
    texts = {y: [text[i] for i in by[y] if i in text] for y in (0, 1)}
    seen = Counter(line for y in (0, 1) for t in texts[y] for line in set(t.split("\n")))

    def dictionary(some):
        parts, size = [], 0
        for t in some:
            data = "\n".join(x for x in t.split("\n") if seen[x] < 2).encode()
            if data and size + len(data) < 524_288:
                parts.append(data)
                size += len(data) + 1
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(b"\n".join(parts), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    good, bad = dictionary(texts[1][::2]), dictionary(texts[0][::2])

    def features(t):
        data = (t or "").encode()
        n = max(1, math.ceil(len(data) / 2000))
        parts = [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]
        g, b = (sum(len(p.compress(x)) for x in parts) for p in (good, bad))
        size = len(data) + 32 * n
        d, c, s = (b - g) / size, g / size, math.log(size / n) / 10
        return [d, c, s, c * c, s * s, d * s, d * c, c * s]

    fit = [(features(t), y, total[y] / len(known) / len(texts[y][1::2])) for y in (0, 1) for t in texts[y][1::2]]
    x, y, w = np.array([f for f, *_ in fit]), np.array([k for _, k, _ in fit], float), np.array([v for *_, v in fit])
    mean = (x * w[:, None]).sum(axis=0) / w.sum()
    scale = np.sqrt(((x - mean) ** 2 * w[:, None]).sum(axis=0) / w.sum()) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.array([1e-6] + [1e-3] * 8) * w.sum()
    beta = np.zeros(9)
    for _ in range(3000):  # damped steps to where the penalised likelihood is level
        p = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (w * (y - p)) - ridge * beta
        bend = z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        beta += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-12:
            break
    score = lambda t: 1 / (1 + math.exp(-float(np.concatenate(([1.0], (np.array(features(t)) - mean) / scale)) @ beta)))
    return {i: score(t) for i, t in docs}


def brute_mix(rows):
    """rows (id, text, source) -> id -> copies, by water filling and the keyed draw."""
    words = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += words[i]
    target = water_fill(dict(sizes))
    out = {}
    for i, t, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        digest = hashlib.md5(f"mix-1:{i}:{hashlib.md5(t.encode()).hexdigest() if t is not None else ''}:1".encode()).hexdigest()
        out[i] = math.floor(rate) + (int(digest[:8], 16) / 2**32 < rate - math.floor(rate))
    return out


def spark_hash(*values):
    """Spark's 64-bit hash of strings and longs."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def test_scores_equal_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
        want = brute_quality([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
        got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)


def test_stages_and_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 4
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], SF))
        assert frames[-1].columns == docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    score = brute_quality([(i, r.text) for i, r in rows.items()], [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()])
    good = {i: rows[i].text for i in rows if score[i] >= 0.3}
    assert {r.doc_id for r in frames[1].collect()} == set(good)
    part = brute_jaccard(list(good.items()))
    kept = {i for i, (_, c) in part.items() if c == i}
    assert {r.doc_id for r in frames[2].collect()} == kept
    copies = brute_mix([(i, rows[i].text, rows[i].source) for i in sorted(kept)])
    want = Counter({i: n for i, n in copies.items() if n})
    assert Counter(r.doc_id for r in frames[3].collect()) == want
    out = corpus_pipeline.run(spark, SF).collect()
    with open(merge_dropout.MODEL, "rb") as f:
        encoder = merge_dropout.Encoder(f.read(), 0.1, 1)
    tokens = Counter((i, tuple(naive_dropout(encoder, rows[i].text, spark_hash(str(i), rows[i].text, nth)))) for i, n in want.items() if rows[i].text is not None and len(rows[i].text) < 3000 for nth in range(1, n + 1))
    long = {i for i in want if rows[i].text is None or len(rows[i].text) >= 3000}
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in out if r.doc_id not in long) == tokens and len(tokens) > 20
    assert Counter(r.doc_id for r in out) == want
    assert all(encoder.decode(r.token_ids) == rows[r.doc_id].text and r.n_tokens == len(r.token_ids) for r in out if r.token_ids is not None)


def test_stages_on_odd_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, copies int, first boolean, __score int, __copy_id int, __mix_rate int, __key string"
    more = (1, "k", 0.5, 1, True, 1, 1, 1, "x")
    base = "plain words of some length that say nothing new at all "
    rows = [(1, None, "en", "s", 0, *more), (2, "", "en", None, 0, *more), (3, base * 20_000, "en", "s", 1, *more), (None, "a text without an id", "en", "t", 1, *more), (4, base, None, "t", 1, *more), (4, base, None, "t", 1, *more)]
    odd, empty = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            found = out.collect()
            assert docs is odd or found == []
    kept = corpus_pipeline.ngram_jaccard(spark, odd, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "None"]
    tokens = corpus_pipeline.merge_dropout_tokens(spark, odd, SF).collect()
    assert {r.doc_id: r.n_tokens for r in tokens if r.doc_id in (1, 2)} == {1: None, 2: 0} and len(tokens) == 6
    assert corpus_pipeline.merge_dropout_tokens(spark, empty, SF).collect() == []


def test_repeated_rows_stay_once(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (1, "other words of this very id", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (3, None, "en", "s", 1), (1, "a b c d e f g", "de", "t", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.ngram_jaccard(spark, df, "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, rows[0][1]), (1, rows[2][1]), (None, rows[4][1]), (3, None)], key=str)


def test_copies_are_split_each_in_its_own_way(spark):
    df = spark.createDataFrame([(1, "several international statisticians " * 20, "s")] * 4 + [(2, None, "s")], "doc_id long, text string, source string")
    out = corpus_pipeline.merge_dropout_tokens(spark, df, "").collect()
    assert len({tuple(r.token_ids) for r in out if r.doc_id == 1}) == 4 and len(out) == 5
    again = corpus_pipeline.merge_dropout_tokens(spark, df.repartition(3), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
