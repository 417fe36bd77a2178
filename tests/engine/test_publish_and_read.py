"""The write path, objects, increments, payloads and single reads."""

import json
import random
import sys
from decimal import Decimal

import numpy as np
import pytest
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factengine.functions.values import shift_decimal
from factengine.operators.adjudicate import SHOWN, adjudicate
from factengine.operators.layout import reconstruct
from factengine.operators.nearest import best_of
from factengine.operators.pairing import pair_deterministic
from factengine.operators.publish import candidates_of, locate, to_facts
from factengine.plans import read
from factengine.plans.export import export_documents
from factengine.schemas import CANDIDATE, LINE
from factengine.sources.intake import read_binary, text_pages
from factengine.sources.objects import put_object, put_objects
from factengine.sources.store import Store
from factengine.streaming.intake import stream_intake
from tests.engine.test_ground_and_judge import SIDE, side

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_candidates_go_to_the_page_of_their_first_line(spark):
    pages = spark.createDataFrame([("d", n, [(f"p{n}l1", "x", (0.0, 0.0, 1.0, 1.0), 1.0)]) for n in (1, 2, 3)], f"document_id string, page_number int, lines array<{LINE}>")
    batches = spark.createDataFrame([("d", "b", 3)], "document_id string, batch_id string, first_page int")

    def found(batch, lines):
        return ("d", batch, ("s", "p", "1", None, "number", {}, "observed", None, "prose", None, ("x", lines), 0.5), None)

    rows = [found("b", ["p2l1", "p1l1"]), found("b", ["nowhere"]), found("b", []), found("gone", ["nowhere"]), ("d", "b", None, "model_error")]
    df = spark.createDataFrame(rows, f"document_id string, batch_id string, candidate struct<{CANDIDATE}>, kind string")
    assert sorted(r.page for r in locate(df, pages, batches).collect()) == [2, 3, 3]


def test_write_path_end_to_end(spark):
    texts = [("d", 1, "Heading\nThe price of oil was ₹5.5 million for the year ended 31 March 2024."), ("d", 2, "Revenue was ₹7 million"), ("e", 1, "Nothing here")]
    pages = reconstruct(text_pages(spark.createDataFrame(texts, "document_id string, page_number int, text string")))
    found, batches = candidates_of(pages)
    facts = {r.page: r for r in to_facts(locate(found, pages, batches), pages, "v").collect()}
    assert (facts[1].status, facts[1].canonical_value, str(facts[1].period_end), facts[1].bbox.y0) == ("published", "5500000", "2024-03-31", 12.0)
    assert (facts[2].status, facts[2].rejection_reason) == ("rejected", "missing_context")
    assert facts[1].id != facts[2].id and all(f.salience > 0 for f in facts.values())


def test_grounding_and_batches_are_done_once_though_read_twice(spark):
    pages = reconstruct(text_pages(spark.createDataFrame([("d", 1, "The price of oil was ₹5.5 million")], "document_id string, page_number int, text string")))
    found, batches = candidates_of(pages)
    facts = to_facts(locate(found, pages, batches), pages, "v")
    assert batches._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the pages of the tables, not the fold
    assert "EvalPython" not in facts._jdf.queryExecution().optimizedPlan().toString()
    assert facts.count() == 1


def test_shifted_decimals_are_exact(spark):
    rng = random.Random(3)
    tokens = ["0", "0.0", "(0)", "-0", "007", "1,234.50", "(12)", "(-3)", "(+3)", "−4", "+.5", "(5", "5)", "", "x", "1.", "- 2"]
    tokens += ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 45))) + rng.choice(["", "." + "".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 25)))]) for _ in range(200)]
    rows = [(t, p) for t in tokens for p in (-30, -2, 0, 3, 7)]

    def want(token, power):
        plain = token.replace(",", "").replace("−", "-")
        minus = plain.startswith("-") or plain.startswith("(") and not plain.startswith("(+") or plain.startswith("(-")
        bare = plain.strip("()+-")
        if not bare or plain.startswith("(") != plain.endswith(")") or not all(x.isdigit() for x in bare.split(".")) or bare.count(".") > 1:
            return None
        sign, digits, exponent = Decimal(bare).as_tuple()
        text = f"{Decimal((sign, digits, exponent + power)):f}"
        text = text.rstrip("0").rstrip(".") if "." in text else text
        text = text.lstrip("0") or "0"
        text = "0" + text if text.startswith(".") else text
        return ("-" if minus and text != "0" else "") + text

    df = spark.createDataFrame(rows, "t string, p int")
    for r in df.select("t", "p", shift_decimal(F.col("t"), F.col("p")).alias("v")).collect():
        assert r.v == want(r.t, r.p), (r.t, r.p, r.v)


class Failing:
    """A file system whose first writes fail, and whose look-ups may."""

    def __init__(self, real, failures, lookups=0):
        self.real, self.failures, self.lookups = real, failures, lookups

    def get_file_info(self, path):
        if self.lookups:
            self.lookups -= 1
            raise OSError("busy")
        return self.real.get_file_info(path)

    def open_output_stream(self, path, **kw):
        if self.failures:
            self.failures -= 1
            raise OSError("full")
        return self.real.open_output_stream(path, **kw)

    def move(self, a, b):
        self.real.move(a, b)


def test_objects_are_put_once(spark, tmp_path):
    local, waits = fs.LocalFileSystem(), []
    assert put_object(local, str(tmp_path), "h", b"x") == ("h", False)
    assert put_object(local, str(tmp_path), "h", b"x") == ("h", True)
    assert put_object(Failing(local, 1), str(tmp_path), "i", b"x", waits.append) == ("i", False) and waits == [0.4]
    assert put_object(Failing(local, 2, 3), str(tmp_path), "j", b"x", waits.append) == ("j#1", False)
    with pytest.raises(OSError, match="4 attempts"):
        put_object(Failing(local, 9), str(tmp_path), "k", b"x", waits.append)
    rows = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),), (None,)], "content binary").withColumn("name", F.concat(F.lit("doc:"), F.sha2("content", 256)))
    uri = f"file://{tmp_path}/objects"
    assert sorted(r.reused for r in put_objects(rows, uri, F.col("name")).collect()) == [False, False]
    assert all(r.reused for r in put_objects(rows, uri, F.col("name")).collect())


def test_every_file_is_accounted_for(spark, tmp_path):
    whole = b"%PDF-1.7\n1 0 obj << /Type /Page >> endobj\nxref\ntrailer << /Root 1 0 R >>\nstartxref\n9\n%%EOF"
    files = {"ok": whole, "locked": whole.replace(b"/Root", b"/Encrypt 2 0 R /Root"), "cut": whole[:40], "text": b"hello", "large": whole + b" " * 500}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in read_binary(spark, str(tmp_path), 300).collect()}
    assert {n: r.refusal for n, r in got.items()} == {"ok": None, "locked": "encrypted", "cut": "corrupted", "text": "not_a_pdf", "large": "too_large"}
    assert got["large"].content is None and got["ok"].content_hash


def test_increments_and_replayed_batches(spark, tmp_path):
    tables = Store(spark, str(tmp_path / "store"))
    row = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string")
    tables.append("t", row(1, "a"), "1")
    tables.append("t", row(2, "b"), "2")
    tables.append("t", row(3, "c"), "2")
    assert sorted(r.doc_id for r in tables.read("t").collect()) == [1, 3] and [r.doc_id for r in tables.read("t", without="2").collect()] == [1]
    for i in (7, 8, 9):
        tables.write("t", row(i, "x"))
        tables.append("t", row(10 + i, "x"), "1")
    assert sorted(r.doc_id for r in tables.read("t").collect()) == [9, 19] and tables.prune("t") == [2, 3]
    assert sorted(r.doc_id for r in tables.read("t", 2).collect()) == [8, 18]
    # a batch that runs again, since its checkpoint was lost after the write, stores its documents once
    landing = str(tmp_path / "landing")
    row(1, "x").write.parquet(landing)
    for checkpoint in ("one", "two"):
        stream_intake(spark, landing, "doc_id long, text string", tables, str(tmp_path / checkpoint)).awaitTermination()
        assert [r.doc_id for r in tables.read("documents").collect()] == [1]


class Echo:
    """Contradicts, and tells in its review what it was shown."""

    def generate(self, *, name, system, prompt, schema, escalate=False):
        shown = json.loads(prompt.split("\n")[1])
        if escalate:
            return {"reconcilable": True, "reasonCode": "vintage_difference", "explanation": json.dumps(shown), "confidence": 0.5}
        return {"verdict": "contradicts", "reasonCode": "value_conflict", "contextMatches": [], "explanation": "First reading.", "confidence": 0.8}


def test_a_review_sees_both_sides_and_the_first_reading(spark):
    more = ", document_id: string, page: int, value_type: string, quote: string>"
    kind = SIDE[:-1] + more
    a, b = (*side("a"), "da", 3, "money", "It was 100."), (*side("b", raw_value="120", canonical_value="120", canonical_number=120.0), "db", 4, "money", "It was 120.")
    edges, _ = adjudicate(spark.createDataFrame([("k", a, b)], f"pair_key string, source {kind}, target {kind}"), "v", Echo())
    shown = json.loads(edges.first().explanation)
    assert set(shown["source"]) == set(SHOWN) and len(SHOWN) == 14
    assert (shown["source"]["quote"], shown["target"]["page"], shown["first_reading"], shown["findings"]["values_equal"]) == ("It was 100.", 4, "First reading.", False)
    assert shown["source"]["table_context"] is None


def test_best_of_equals_sorting():
    rng = np.random.default_rng(4)
    sims, open_ = rng.integers(0, 4, (40, 30)) / 4.0, rng.random((40, 30)) < 0.7
    order = rng.permutation(30)
    rows, columns = best_of(sims, open_, order, 5)
    for i in range(40):
        want = sorted(np.flatnonzero(open_[i]).tolist(), key=lambda j: (-sims[i, j], order[j]))[:5]  # noqa: B023
        assert columns[rows == i].tolist() == want


def test_only_published_facts_of_a_version_are_paired(spark):
    rows = [("a", "da", "5", 5.0, "published", "v"), ("b", "db", "5", 5.0, "published", "v"), ("c", "dc", "5", 5.0, "rejected", "v"), ("d", "dd", "5", 5.0, "published", "w")]
    facts = spark.createDataFrame(rows, "id string, document_id string, canonical_value string, canonical_number double, status string, pipeline_version string")
    assert sorted(map(tuple, pair_deterministic(facts, facts, "v").collect())) == [("a", "b"), ("b", "a")]


def test_page_numbers():
    assert [read.page_number(x) for x in (1, "2", "3.0")] == [1, 2, 3]
    for bad in (0, -1, "x", "1.5", None, ""):
        with pytest.raises(ValueError, match="page number"):
            read.page_number(bad)


def test_export_of_broken_facts_fails(spark):
    documents = spark.createDataFrame([("d", "ready", None, "v", 1)], "document_id string, status string, failure_reason string, pipeline_version string, page_count int")
    pages = spark.createDataFrame([("d", 1, "failed", "no_text_layer", "blank")], "document_id string, page_number int, status string, failure_reason string, failure_detail string")
    fact = "id string, document_id string, page int, subject string, predicate string, status string, verified boolean, context_complete boolean, rejection_reason string, value_type string, pipeline_version string, quote string, line_ids array<string>, period_start date, period_end date, period_precision string"
    edges = spark.createDataFrame([("e", "a", "z", "insufficient", "v")], "id string, source_id string, target_id string, verdict string, pipeline_version string")
    row = lambda verified: spark.createDataFrame([("a", "d", 1, "s", "p", "published", verified, True, None, "money", "v", "q", ["l"], None, None, None)], fact)
    body = json.loads(export_documents(documents, pages, row(True), edges, "v").first().json)
    assert body["documents"][0]["pagesFailed"] == 1 and body["facts"][0]["evidence"] == {"quote": "q", "lineIds": ["l"]} and body["facts"][0]["period"] is None
    assert [e["id"] for e in body["edges"]] == ["e"] and body["failures"]["pages"][0]["detail"] == "blank" and body["failures"]["documents"] == []
    with pytest.raises(Exception, match="published without"):
        export_documents(documents, pages, row(False), edges, "v").collect()
