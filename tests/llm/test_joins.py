import random

import numpy as np

from factengine.llm.embedding_dedup import embedding_near_dedup
from factengine.llm.jaccard_join import chance, least_depth, next_depth, ngram_jaccard_join
from factengine.llm.shingles import shingles

SF = "/root/testdata/sf0.01"


def least_reachable(ids, links):
    out = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(out[a], out[b])
            if out[a] != low or out[b] != low:
                out[a] = out[b] = low
                changed = True
    return out


def word_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets


def brute_jaccard(rows):
    """rows: (id, text) -> id -> (n_links, component)."""
    sets = word_sets([t for _, t in rows])
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-12]
    part = least_reachable([i for i, _ in rows], links)
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], part[i]) for i in count}


def test_shingle_sets_are_exact():
    texts = ["a b c d e f", "a b c d e f", "a b", "", None, " \t\n", "x" * 70000 + " y z w v u", "a b c d e\x00 f", "é ü ñ " * 40]
    hashes, ends = shingles(texts)
    parts = [set(p.tolist()) for p in np.split(hashes, ends[:-1])]
    assert [len(p) for p in parts] == [2, 2, 1, 0, 0, 0, 2, 2, 3]
    assert parts[0] == parts[1] and parts[0] != parts[7]
    alone = [set(shingles([t])[0].tolist()) for t in texts]
    assert alone == parts


def test_depth_meets_recall():
    assert least_depth(0.8, 16, 6, 0.9995) == 4 and chance(0.8, 4, 16) >= 0.9995 > chance(0.8, 5, 16)
    # no pair close to the threshold: the longest prefix does; many: it is shortened
    assert next_depth({0.8: 0}, 6, 4, 16, 0.9995) == 6
    assert next_depth({0.8: 100}, 6, 4, 16, 0.9995) == 4
    assert next_depth({0.845: 100}, 6, 4, 16, 0.9995) == 5
    assert next_depth({0.8: 1, 0.845: 100}, 6, 4, 16, 0.9995) == 5


def by_row(rows, key):
    return sorted((str(key(r)) for r in rows))


def brute_rows(n, ids, alike):
    """Rows, not ids, are linked: per row its number of links and the least id reachable."""
    links = [(i, j) for i in range(n) for j in range(i) if alike(i, j)]
    part = least_reachable(range(n), links)
    count = [0] * n
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return [(ids[i], count[i], min(ids[j] for j in range(n) if part[j] == part[i])) for i in range(n)]


def test_repeated_ids_are_rows(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:-1], f"x{i}"]) for i in range(4)] + ["other text of some six words", "other text of some six words"]
    ids = [1, 1, 2, 1, 3, 2]
    sets = word_sets(texts)
    want = brute_rows(6, ids, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = ngram_jaccard_join(df).collect()
    assert by_row(got, lambda r: (r.doc_id, r.n_links, r.component_id)) == by_row(want, tuple)
    assert len({(r.doc_id, r.key) for r in got if r.first and r.doc_id == r.class_id}) == 2
    vectors = [[1.0, 0.01 * i, 0.0] for i in range(4)] + [[0.0, 0.0, 1.0]] * 2
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, label int")
    want = brute_rows(6, ids, lambda i, j: (i < 4) == (j < 4))
    assert by_row(embedding_near_dedup(df).collect(), lambda r: (r.vec_id, r.n_links, r.component_id)) == by_row(want, tuple)


def test_prefixes_are_shortened_until_all_pairs_are_found(spark):
    rng = random.Random(8)
    rows = []
    for group in range(60):
        base = [f"g{group}w{i}" for i in range(105)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):  # two words apart: close to the threshold
            words = list(base)
            for at in (rng.randrange(5, 50), rng.randrange(55, 100)):
                words[at] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_jaccard(rows)
    assert any(n for n, _ in want.values())
    assert {r.doc_id: (r.n_links, r.component_id) for r in ngram_jaccard_join(df, block=16).collect()} == want


def test_join_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_jaccard(rows)
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_jaccard_join(docs).collect()}
    assert got == want


def test_join_on_blocks_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.component_id) for r in ngram_jaccard_join(df, block=16).collect()}
    want = brute_jaccard(rows)
    missed = sum(abs(got[i][0] - want[i][0]) for i in want)
    assert missed <= 0.001 * sum(n for n, _ in want.values())
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_join_edge_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "a b", "k"), (4, "a b", None), (5, "a b c d e f g", "x"), (5, "a b c d e f g", "x"), (None, "a b c d e f g", "x"), (6, " \n ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, codes string")
    got = sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True), (6, 0, 6, True)], key=str)
    assert ngram_jaccard_join(df.limit(0)).collect() == []


def test_pairs_are_compared_in_one_unit(spark):
    from factengine.llm.buckets import open_pairs

    rng = random.Random(13)
    for _ in range(200):
        n = rng.randrange(2, 12)
        codes = [np.array(sorted(rng.sample(range(12), rng.randrange(1, 5)))) for _ in range(n)]
        inner = [np.array(rng.sample(range(100, 130), 2)) for _ in range(n)] if rng.random() < 0.5 else None
        sides, code = np.array(sorted(rng.randrange(2) for _ in range(n))), rng.randrange(12)
        for a, b in ((0, 0), (0, 1)):
            got = open_pairs(codes, inner, sides, (code, a, b))
            for i in range(n):
                for j in range(n):
                    low = {c for c in set(codes[i]) & set(codes[j]) if c < code}
                    met = inner is not None and set(inner[i]) & set(inner[j])
                    assert got[i, j] == (i < j and not low and not met and (a == b or sides[i] != sides[j]))


def brute_cosine(rows, threshold=0.98):
    links = []
    for i, (a, x, k) in enumerate(rows):
        for b, y, m in rows[:i]:
            if k is None or k != m or not x or not y or len(x) != len(y):
                continue
            if any(v is None or not np.isfinite(v) for v in [*x, *y]) or not any(x) or not any(y):
                continue
            if np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links.append((a, b))
    part = least_reachable([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], part[i]) for i in count}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(30):
        centre = rng.normal(size=24)
        for _ in range(12):
            rows.append((len(rows), (centre + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.2])).tolist(), group % 3))
    rows += [(1000, rows[0][1], 0), (1001, [2 * v for v in rows[0][1]], 0), (1002, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_cosine(rows)
    for block in (4, 1024):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_dedup(df, block=block).collect()}
        assert got == want


def test_vector_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 1.0], None), (8, [1.0, 1.0], None), (9, [1.0, 1.0], 2), (10, [2.0, 2.0], 2), (11, [1.0, 1.0, 0.0], 2), (12, [1e300, 1e300], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS key", "1 AS n")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_dedup(df).collect()}
    want = {i: (0, i, True) for i in range(1, 13)} | {9: (2, 9, True), 10: (2, 9, False), 12: (2, 9, False)}
    assert got == want
    assert embedding_near_dedup(df.limit(0)).collect() == []
