"""The other operators against brute force, round trips and SQL, with edge rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from factengine.llm import merge_dropout, quality
from factengine.llm.html_extract import Aligner, extract, extract_pages, folded, measure, parse
from factengine.llm.licenses import RULES, SENTENCES, Recogniser, anchor, scan_licenses
from factengine.llm.mixing import mix, mixing_plan
from factengine.llm.sharding import assign_slots, rebalance, rebalance_map, save_map, shard
from factengine.llm.topk import exact_top_k
from factengine.llm.warc import ranges, read_warc, write_warc

SF = "/root/testdata/sf0.01"


# --- 2 ---------------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_targets_and_edges(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "B", "é", None, "big", "big", "big", "tiny" if i < 3 else "a"]), "x") for i in range(900)]
    rows += [(900, None, "a", "x"), (901, "", "none", "x"), (7, "w w", "a", "x"), (7, "w w", "a", "x"), (None, "w", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __mix_rate string")
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water_fill(dict(sizes))
    plan = mixing_plan(df).collect()
    assert len(plan) == len(rows)
    taken = Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in ("a", "B", "big"):
        assert abs(taken[s] - want[s]) < 0.25 * want[s] + 100
    again = sorted(map(str, mixing_plan(df).collect()))
    assert again == sorted(map(str, plan))
    # rows of one id draw one by one
    same = spark.createDataFrame([(None, f"w {i} w", "a") for i in range(300)] + [(5, "w w w", "a")] * 300 + [(i, "w " * 30, "b") for i in range(1000, 1040)], "doc_id long, text string, source string")
    for one in (None, 5):
        part = [r for r in mixing_plan(same).collect() if r.source == "a" and r.doc_id == one]
        rate = part[0].rate
        assert len(part) == 300 and abs(sum(r.copies for r in part) - 300 * rate) < 45
    out = mix(df)
    assert out.columns == df.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in plan)
    assert mixing_plan(df.limit(0)).collect() == [] and mix(df.limit(0)).collect() == []


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [x for x in held if x[1] == 1], [x for x in held if x[1] == 0]
    assert sum(p for *_, p in good) / len(good) > 0.98
    assert sum(1 - p for *_, p in bad) / len(bad) > 0.8
    order = sorted(held)
    ranks = sum(i for i, x in enumerate(order) if x[1] == 1) - len(good) * (len(good) - 1) / 2
    assert ranks / (len(good) * len(bad)) > 0.98


def test_long_texts_are_scored_to_their_end(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels)
    packer = quality.Compressor(model.good, model.bad)
    held = docs.join(labels.where(quality.is_held_out(F.col("doc_id"))), "doc_id").where("text is not null").orderBy("doc_id").select("text", "quality").collect()
    for y in (0, 1):
        texts = [r.text for r in held if r.quality == y]
        for n in (20, 100):
            joined = ["\n".join((texts * 9)[i * 13 : i * 13 + n]) for i in range(6)]
            scores = [quality.score_of(model.curve, packer.features(t)) for t in joined]
            assert all((x >= 0.3) == bool(y) for x in scores), (y, n, scores)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 50000, "x"), (3, "word " * 50000, "x"), (None, "a", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {1.0}
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (4, 7), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(docs.limit(0), labels).collect() == []


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_extract_parts():
    page = """<!DOCTYPE html><html><head><title>T</title></head><body><header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><div class="sidebar">Side</div><main><article><header><h1>Head &amp; line</h1></header><p>One
      <b>two</b>&nbsp;three<script>x("</p>")</script><p>Four &lt;five&gt;<div class=ad>Buy</div><ul><li>six<li>seven</ul><form><input>Sign up</form>
      <section id="comments"><p>Nice</p></section></article></main><aside>More</aside><footer>&copy; me</footer></body></html>"""
    assert extract(page) == "Head & line\nOne two three\nFour <five>\nsix\nseven"
    assert extract("") == "" and extract("plain text") == "plain text"
    named = """<body><div class=pageHeader>Site</div><article><header class="entry-header"><h1>Title</h1></header><div class="postTitle">Under it</div><p>Text</p>
    <div class="adSlot">Buy</div><div id="commentsSection">Nice</div><div class="shareButtons">Share</div></article><div class="newsletterSignup">Join</div></body>"""
    assert extract(named) == "Title\nUnder it\nText"
    assert extract("<p>a<br>b</p><!-- c --><p title=it's>d") == "a\nb\nd"
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def shapes_of(aligner, trees):
    def number(tree):
        return aligner._numbered(tree[0], tuple(number(c) for c in tree[1]))

    return [number(t) for t in trees]


def naive_match(a, b):
    """The textbook recursion of simple tree matching."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + naive_match(x, y))
    return best[-1][-1] + 1


def test_simple_tree_matching():
    aligner = Aligner()
    page, ref = ("r", (("a", ()), ("x", ()), ("b", (("c", ()),)))), ("r", (("a", ()), ("b", (("c", ()), ("d", ())))))
    assert aligner.align(*shapes_of(aligner, (page, ref))) == [0, 1, -1, 2, 3]
    rng = random.Random(6)

    def tree(depth):
        return (rng.choice("abc"), tuple(tree(depth - 1) for _ in range(rng.randrange(0, 6))) if depth else ())

    for _ in range(300):
        a, b = ("r", tree(3)[1]), ("r", tree(3)[1])
        aligner = Aligner()
        x, y = shapes_of(aligner, (a, b))
        assert aligner.match(x, y) == naive_match(a, b)
        out = [k for k in aligner.align(x, y) if k >= 0]
        assert len(out) == naive_match(a, b) and out == sorted(set(out))
    # no length of a list and no depth is too much
    left, right = ("r", (("p", ()), ("q", ())) * 300 + (("z", ()),)), ("r", (("p", ()), ("q", ())) * 900 + (("z", ()),))
    aligner = Aligner()
    assert aligner.align(*shapes_of(aligner, (left, right)))[-1] == 1801
    deep = parse("<div>" * 5000 + "deep" + "</div>" * 5000)
    measure(deep)
    folds = folded(deep)
    shape = aligner.shape(folds)
    assert len(folds) == 5001 and aligner.align(shape, shape) == list(range(5001))


def nameless(i, body, head="Site of all things", foot="Written by nobody"):
    deep = "<div>" * 15 + foot + "</div>" * 15
    return f"<body><div><span>{head}</span></div><div><div><a href=/{i}>go {i}</a> <a>to {i}</a></div><div>{body}</div></div>{deep}</body>"


def test_alignment_finds_chrome_without_names(spark):
    rows = [(i, "http://one.host/x", nameless(i, f"<h1>Title {i}</h1><p>Story {i} begins.</p><h2>Sources</h2><p>It ends {i * i}.</p>")) for i in range(8)]
    # a second layout on the same host, which the reference page lacks
    rows += [(100 + i, "http://one.host/y", f"<body><section><h1>Entry {i}</h1><p>Of another kind {i}</p></section><section><div>Please pay</div></section></body>") for i in range(8)]
    # cards are marked as articles, the text is not
    rows += [(200 + i, "http://cards.host/z", f"<body><article><p>Card {i}</p></article><div><p>{'Long text number %d of many words. ' % i * 5}</p></div><div>Always here</div></body>") for i in range(8)]
    # the same article everywhere, without a mark: what pages share is all there is
    rows += [(300 + i, "http://same.host/z", "<body><div><p>All the same</p></div></body><!-- %d -->" % i) for i in range(5)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\nStory {i} begins.\nSources\nIt ends {i * i}."
        assert extract(rows[i][2]) != got[i]
        assert got[100 + i] == f"Entry {i}\nOf another kind {i}"
        assert got[200 + i] == f"Card {i}\n" + ("Long text number %d of many words. " % i * 5).strip()
    assert {got[300 + i] for i in range(5)} == {"All the same"}


def test_wrappers_drop_what_pages_share(spark):
    rows = [(i, "http://a.b/x" if i < 40 else "nohost", f"<body><div class=k1>Shared top</div><div class=k2><a href=/{i}>go {i}</a> <a>to {i}</a></div><div class=k3><p>Story number {i} is told here</p></div></body>", "z") for i in range(42)]
    rows += [(100, None, None, "z"), (101, "http://c.d", "", "z"), (102, "http://e.f", "<p>alone</p>", "z"), (3, rows[3][1], rows[3][2], "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {}
    for r in extract_pages(df).collect():
        got[r.page_id] = (r.text, r.n_chars)
    assert got[5] == ("Story number 5 is told here", 27)
    assert got[41][0].startswith("Shared top")  # two pages are too few for a wrapper
    assert got[100] == ("", 0) and got[101] == ("", 0) and got[102][0] == "alone"
    assert extract_pages(df).count() == len(rows) and extract_pages(df.limit(0)).collect() == []


def test_articles_are_never_template(spark):
    def page(i, article):
        return f"<body><div class=k1><a href=/{i}>go {i}</a></div><article>{article}</article><div class=k2>Constant end</div></body>"

    same = "<h1>One</h1><h2>Ingredients</h2><p>Body</p><ul><li><a href=/a>Linked item</a></li></ul>"
    rows = [(i, "http://same.host/x", page(i, same)) for i in range(12)]
    rows += [(100 + i, "http://cook.book/x", page(i, f"<h1>Dish {i}</h1><h2>Ingredients</h2><p>Step {i}</p>")) for i in range(12)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(12)} == {"One\nIngredients\nBody\nLinked item"}
    assert all(got[100 + i] == f"Dish {i}\nIngredients\nStep {i}" for i in range(12))


def test_extraction_of_test_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == want
    assert parse("<p>x").items[0].name == "p"


# --- 5 ---------------------------------------------------------------------------------------------------------------


def check_shards(rows, got, shards=40):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return {s: sum(r.size for r in by.get(s, [])) for s in range(shards)}


def test_sharding_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = shard(docs).collect()
    loads = check_shards(rows, got)
    assert max(loads.values()) < 1.02 * min(loads.values())
    places = {}
    for r in got:
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())


def test_sharding_edges(spark, tmp_path):
    rows = [(i, "t" * (i % 50), "s") for i in range(2000)] + [(5000, "copy " * 20, "s")] * 1500 + [(6000 + i, "same text", "s") for i in range(1500)] + [(None, None, "s"), (7, None, "s"), (9999, "x" * 300_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = shard(df, 8, map_path=str(tmp_path / "map")).collect()
    loads = check_shards(rows, got, 8)
    rest = sorted(loads.values())[:-1]  # one text is larger than a fair share
    assert max(rest) < 1.2 * min(rest)
    assert shard(df.limit(0)).collect() == []
    sizes = {r.virtual_slot: r.bytes for r in spark.read.parquet(str(tmp_path / "map")).collect()}
    first = assign_slots(sizes, 8)
    grown = rebalance(first, sizes, 9)
    load = Counter()
    for s, at in grown.items():
        load[at] += sizes[s]
    assert any(at == 8 for at in grown.values()) and sum(first[s] == grown[s] for s in first) > 0.7 * len(first)
    assert sorted(load.values())[-2] < 1.2 * min(load.values())
    shrunk = rebalance(grown, sizes, 7)
    assert max(shrunk.values()) == 6
    for _ in range(2):  # a rerun writes its version anew
        assert {r.virtual_slot: r.shard for r in rebalance_map(spark, str(tmp_path / "map"), 1, 9).collect()} == grown
    assert sorted(r.version for r in spark.read.parquet(str(tmp_path / "map")).select("version").distinct().collect()) == [1, 2]
    assert save_map(spark, str(tmp_path / "map"), 2, grown, sizes).count() == len(sizes)


def test_equal_texts_stay_together_while_they_fit(spark):
    rows = [(i, "t" * (i % 90)) for i in range(4000)] + [(10_000, "row")] * 500 + [(20_000, "row again")] * 65 + [(30_000 + i, "many ids") for i in range(900)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    loads = check_shards(rows, got, 8)
    assert max(loads.values()) < 1.05 * min(loads.values())
    places = {}
    for r in got:
        places.setdefault((r.size, r.text_crc32), set()).add((r.shard, r.virtual_slot))
    assert all(len(p) == 1 for p in places.values())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values):
    """Spark's hash of strings and longs, from the public algorithm."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def test_sharding_equals_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "word " * rng.randrange(0, 300)) for i in range(3000)] + [(i, None) for i in range(3)] + [(50_000 + i, "large group " * 100) for i in range(700)] + [(60_000, "large group " * 100)] * 40
    shards, slots = 6, 256
    size = {t: len((t or "").encode()) + 16 for _, t in rows}
    total = sum(size[t] for _, t in rows)
    bytes_of = Counter()
    for _, t in rows:
        bytes_of[t or ""] += size[t]
    where, seen = [], Counter()
    for i, t in rows:
        h, nth = xx(t or ""), seen[i, t]
        seen[i, t] += 1
        parts = -(-bytes_of[t or ""] * 8 * shards // total) if bytes_of[t or ""] * shards > 0.95 * total else 1
        where.append(xx(h, (xx(i) + nth) % parts if parts > 1 else None) % slots)
    load = Counter()
    for (_, t), s in zip(rows, where, strict=True):
        load[s] += size[t]
    held, shard_of = [0] * shards, {}
    for s in sorted(load, key=lambda s: (-load[s], s)):
        shard_of[s] = held.index(min(held))
        held[shard_of[s]] += load[s]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(df, shards, virtual_slots=slots).collect()
    want = Counter((i, size[t], s, shard_of[s]) for (i, t), s in zip(rows, where, strict=True))
    assert Counter((r.doc_id, r.size, r.virtual_slot, r.shard) for r in got) == want
    check_shards(rows, got, shards)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_licence_rules(spark):
    r = Recogniser()
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#   http://www.apache.org/licenses/LICENSE-2.0\n'
    assert [m[:2] for m in r.recognise(apache)][0][0] == "Apache-2.0"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    end = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert [m[0] for m in r.recognise(bsd)] == ["BSD-2-Clause"]
    assert [m[0] for m in r.recognise(bsd + end)] == ["BSD-3-Clause"]
    assert [m[0] for m in r.recognise("no full stop here\nreleased under  the MIT\nLicense.\nmore text")] == ["MIT"]
    assert r.recognise("The MIT License is often used.") == []
    rows = [(1, None), (2, ""), (3, "x " * 200_000 + "\nLicensed under CC BY-NC 4.0. y"), (4, "Released under the MIT License. " * 2), (4, "Released under the MIT License. " * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit(1))
    got = sorted((x.doc_id, x.licences, x.n_matches) for x in scan_licenses(df).collect())
    assert got == [(1, [], 0), (2, [], 0), (3, ["CC-BY-NC-4.0"], 1), (4, ["MIT"], 2), (4, ["MIT"], 2)]
    assert scan_licenses(df.limit(0)).collect() == []


def test_every_licence_rule():
    r = Recogniser()
    assert len(RULES) > 800 and anchor() and len({licence for licence, *_ in RULES}) >= 30
    for licence, kind, sequence in RULES:
        # as a comment, with an unknown sentence between two of a text
        text = "An unknown beginning.\n# " + "\n# Another sentence here.\n# ".join(SENTENCES[s] for s in sequence) + "\n\nThe end of it."
        found = r.recognise(text)
        assert found and found[0][0] == licence and (len(sequence) == 1 or found[0][1] == kind), (licence, sequence, found)
        assert text[found[0][2]].isalnum() and len(found) == 1
    far = "\n".join([SENTENCES["mit-grant"], *["Quite another sentence."] * 3, SENTENCES["mit-notice"], SENTENCES["mit-warranty"], SENTENCES["mit-liable"]])
    assert [m[:2] for m in r.recognise(far)] == [("MIT", "partial")]
    assert r.recognise("MIT License terms are discussed: licensed under the MIT License today by many") == []


def test_licences_in_texts_of_many_lines():
    r, last = Recogniser(), "\nReleased under the MIT License.\n"
    for line in ("this line has no stop and the word licensed in it", "licensed under the apache license", "This program is free software"):
        text = f"{line}\n" * (2_000_000 // len(line)) + last
        began = time.time()
        assert [m[0] for m in r.recognise(text)] == ["MIT"]
        assert time.time() - began < 20
    many = "Released under the MIT License. " * 20_000
    assert len(r.recognise(many)) == 20_000


# --- 7 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    with open(merge_dropout.MODEL, "rb") as f:
        return f.read()


def test_without_dropout_it_is_the_library(model):
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), merge_dropout.Encoder(model, 0.0)
    rng = random.Random(2)
    texts = ["", " ", "  a  ", "a" * 500, "x\n\n y", "é🙂 z", " " * 40 + "q", "<s> <0x41>"] + ["".join(rng.choice(" abcdethin\n.é") for _ in range(rng.randrange(1, 150))) for _ in range(400)]
    assert [own.encode(t) for t in texts] == sp.encode(texts)


def test_dropout_varies_and_decodes(model):
    one, two = merge_dropout.Encoder(model, 0.3, 1), merge_dropout.Encoder(model, 0.3, 2)
    text = "the international community of statisticians\n▁ and ▁▁ marks \x00 é 🙂" * 20
    assert one.decode(one.encode(text)) == text == two.decode(two.encode(text, 1))
    assert one.encode(text) == merge_dropout.Encoder(model, 0.3, 1).encode(text) != two.encode(text)
    whole = merge_dropout.Encoder(model, 0.0).encode(text)
    assert len(whole) < len(one.encode(text))
    assert merge_dropout.Encoder(model, 1.0).encode("ab") == merge_dropout.Encoder(model, 0.0).encode(" ")[:0] + [merge_dropout.Encoder(model, 0.0).ids[c] for c in "▁ab"]
    long_chunk = "statistician" * 30
    assert one.decode(one.encode(long_chunk)) == long_chunk


def naive_dropout(encoder, text, key):
    """Merges one candidate at a time over plain strings, with the keyed hash written out."""
    word = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & word
        x = (x ^ x >> 27) * 0x94D049BB133111EB & word
        return x ^ x >> 31

    base, out = xxhash.xxh64_intdigest(f"{encoder.seed}:{key}".encode()), []
    for place, chunk in enumerate(re.findall(r" *[^ \n]+| +|\n+", " " + text), 1):
        state, nth, skipped, fresh = mix(place * 0xC2B2AE3D27D4EB4F + base & word), 0, set(), 1000
        symbols = [(i, merge_dropout.MARK if c == " " else "\ue000" if c == merge_dropout.MARK else c) for i, c in enumerate(chunk)]
        while True:
            found = [(encoder.order[x + y], k) for k, ((i, x), (j, y)) in enumerate(zip(symbols, symbols[1:])) if x + y in encoder.order and (i, j) not in skipped]
            if not found:
                break
            k, nth = min(found)[1], nth + 1
            if mix(state + nth * 0x9E3779B97F4A7C15 & word) / 2**64 < encoder.rate:
                skipped.add((symbols[k][0], symbols[k + 1][0]))
            else:
                symbols[k : k + 2] = [(fresh, symbols[k][1] + symbols[k + 1][1])]
                fresh += 1
        for _, x in symbols:
            out += [encoder.ids[x]] if x in encoder.ids else [encoder.bytes[b] for b in (merge_dropout.MARK if x == "\ue000" else x).encode()]
    return out


def test_dropout_equals_brute_force(model, monkeypatch):
    rng = random.Random(9)
    texts = ["several international statisticians", "a\n\n  b", "x" * 70, "the " * 80, "é🙂\x00 naïve", "▁ and ▁▁ marks"] + ["".join(rng.choice("etaoin shrdlu\n.é") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    for rate in (0.1, 0.5, 1.0):
        encoder = merge_dropout.Encoder(model, rate, 3)
        want = [naive_dropout(encoder, t, k) for k, t in enumerate(texts)]
        assert [x.tolist() for x in encoder.encode_many(texts, list(range(len(texts))))] == want
        # long chunks, blocks of few rows and parts of long texts change nothing
        monkeypatch.setattr(merge_dropout, "LONGEST", 4)
        assert [encoder.encode(t, k) for k, t in enumerate(texts)] == want
        monkeypatch.setattr(merge_dropout, "LONGEST", 63)
        monkeypatch.setattr(merge_dropout, "CHARS", 20)
        monkeypatch.setattr(merge_dropout, "ROWS", 3)
        monkeypatch.setattr(merge_dropout, "IDS", 7)
        assert all(encoder.decode(x) == t for x, t in zip(want, texts, strict=True))
        assert [encoder.encode(t, k) for k, t in enumerate(texts)] == want
        monkeypatch.undo()


def test_dropout_is_drawn_per_document_and_place(model):
    one = merge_dropout.Encoder(model, 0.1, 1)
    plain, word = merge_dropout.Encoder(model, 0.0).encode("statisticians"), " statisticians"
    seen = Counter()
    for key in range(40):
        ids = one.encode((word * 100)[1:], key)
        shown = [one.pieces[i] for i in ids]
        starts = [n for n, p in enumerate(shown) if p.startswith(merge_dropout.MARK)] + [len(ids)]
        seen.update(tuple(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True))
    assert sum(seen.values()) == 4000 and len(seen) > 20 and tuple(plain) in seen
    text = "the international community of statisticians met in Ljubljana " * 30
    assert len({tuple(one.encode(text, k)) for k in range(5)}) == 5


def test_encode_decode_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "a b " * 30000, "k"), (3, "a b " * 30000, "k"), (None, "x\ty", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = merge_dropout.decode(merge_dropout.encode(df)).collect()
    assert sorted((str(r.doc_id), r.text, r.decoded) for r in out if r.text is not None) == sorted((str(i), t, t) for i, t, _ in rows if t is not None)
    assert [r.token_ids for r in out if r.doc_id == 1] == [None] and [r.token_ids for r in out if r.doc_id == 2] == [[]]
    assert merge_dropout.encode(df.limit(0)).collect() == []


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_edges(spark):
    rows = [(1, "http://a/1", "<p>same</p>", 0), (5, "http://a/5", "<p>same</p>", 0), (3, "http://a\r\n/3", "<p>same</p>", 0), (7, None, None, 0), (8, "u", "", 0), (9, "u", "é" * 100_000, 0), (9, "u", "é" * 100_000, 0), (None, "u", "null id", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    index = write_warc(df)
    assert index.count() == len(rows)
    got = read_warc(index).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted([(1, digest(rows[0][2]), "revisit", 5), (5, digest(rows[0][2]), "response", None), (3, digest(rows[0][2]), "revisit", 5), (7, digest(""), "revisit", 8), (8, digest(""), "response", None), (9, digest(rows[5][2]), "response", None), (9, digest(rows[5][2]), "response", None), (None, digest("null id"), "response", None)], key=str)
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    for r in got:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes
    some = read_warc(index.where("page_id in (5, 9)"), payload=False).collect()
    assert sorted(r.page_id for r in some) == [5, 9, 9] and all(r.payload is None for r in some)
    assert read_warc(write_warc(df.limit(0))).collect() == []


def test_ranges_coalesce():
    assert ranges([(0, 10), (10, 5), (200_000, 10), (200_020, 10)], gap=100, most=1000) == [(0, 2, 0, 15), (2, 4, 200_000, 200_030)]
    assert len(ranges([(i * 600, 600) for i in range(10)], gap=100, most=1000)) == 10


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 6) for i in range(60)]
    rows += [(2000, None), (2001, [float("nan")] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("inf")] * 6), (2200, [1.0, 2.0]), (2300, [2.0, 1.0]), (None, [1.0] * 6), (0, rows[0][1]), (2400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in exact_top_k(df, df.where("vec_id % 100 = 0"), 10).collect()]
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, x) in enumerate(ok):
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for n, (i, y) in enumerate(ok) if n != at and len(y) == len(x))[:10]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert sorted(got) == sorted(want)
    assert exact_top_k(df.limit(0), df.limit(0)).collect() == []


def test_top_k_of_repeated_ids_and_large_components(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in exact_top_k(df, df.where("vec_id = 0"), 10).collect())
    unit, half = 1024 * 1024, 512 * 1024
    once = [(0, 1, 0, half), (0, 2, 1, half), (0, 3, 0, half // 2)]
    assert got == sorted([(0, 1, 1, unit), (0, 2, 0, half), (0, 3, 0, half), *once, *once])
    with pytest.raises(ValueError, match="64 bits"):
        exact_top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>"), df)
