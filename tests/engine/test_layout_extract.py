"""Layout, extraction, stores and streams."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factengine.functions.text import clamp_limit
from factengine.operators.extract import call_batch, extraction_plan, page_priority, parse_plan, prose_batches, split_lines, strip_qualifiers, table_inputs, with_salience
from factengine.operators.layout import column_bands, merge_intervals, merge_spans, page_tables, reconstruct
from factengine.operators.nearest import nearest
from factengine.operators.providers import PermanentFailure, SchemaFailure
from factengine.plans.read import deep_diff
from factengine.schemas import LINE, TABLE, assert_facts
from factengine.sources.intake import with_identity
from factengine.sources.store import Store, upsert
from factengine.streaming.intake import stream_intake

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def line(i, text, x0, y, x1=None, size=10.0):
    return {"id": f"l{i}", "text": text, "bbox": {"x0": float(x0), "y0": float(y), "x1": float(x1 if x1 is not None else x0 + 40), "y1": float(y + 10)}, "size": size}


def two_grids():
    """A summary grid above a time series, with a heading row between."""
    rows, y = [[("Projections", 0)], [("Item", 0), ("Value", 200)], [("Growth", 0), ("6.5", 200), ("%", 300)], [("Long label that spans", 0), ("7.5", 200), ("8.5", 300)], [("Rate", 0), ("1.0", 200), ("2.0", 300)]], 0
    rows += [[("Years", 0)], [("2021/22", 60), ("2022/23", 120), ("2023/24", 180), ("2024/25", 240)]]
    rows += [[("abc"[n] * 5, 0), (f"{n}.1", 60), (f"{n}.2", 120), (f"{n}.3", 180), (f"{n}.4", 240)] for n in range(3)]
    out = []
    for row in rows:
        for text, x in row:
            wide = 300 if text == "Projections" else x + (150 if text.startswith("Long") else 40)
            out.append(line(len(out), text, x, y, wide))
        y += 20
    return out


def test_stacked_grids_are_two_tables():
    lines = two_grids()
    tables = page_tables(lines, [(0.0, 400.0)], 3)
    assert [t["id"] for t in tables] == ["p3t1", "p3t2"]
    assert tables[1]["columnHeaders"][1:] == ["2021/22", "2022/23", "2023/24", "2024/25"]
    assert [c["text"] for c in tables[1]["rows"][0]["cells"]] == ["aaaaa", "0.1", "0.2", "0.3", "0.4"]
    assert tables[1]["rows"][0]["cells"][4]["column"] == 4


def test_bands_and_spans():
    assert merge_spans([(0, 5), (3, 8), (10, 12), (12, 13), (20, 30)]) == [(0, 8), (10, 13), (20, 30)]
    assert merge_spans([(10, 12), (12, 13)], touching=False) == [(10, 12), (12, 13)]
    two = [line(i, "x", 0 if i % 2 else 300, i * 20, 200 if i % 2 else 500) for i in range(12)]
    assert column_bands(two, 500.0) == [(0.0, 250.0), (250.0, 500.0)]
    assert column_bands(two[:6], 500.0) == [(0.0, 500.0)]
    assert column_bands([], 500.0) == [(0.0, 500.0)]


def test_tables_reach_inputs(spark):
    pages = spark.createDataFrame([("d", 3, 400.0, [tuple(x.values())[:2] + (tuple(x["bbox"].values()), x["size"]) for x in two_grids()]), ("e", 1, 400.0, [])], f"document_id string, page_number int, width double, lines array<{LINE}>")
    out = reconstruct(pages)
    rows = {r.id: r for r in table_inputs(out).collect()}
    cell = rows["p3t2-r1-c5"]
    assert (cell.value, cell.context.rowHeader, cell.context.columnHeader) == ("0.4", "aaaaa", "2024/25")
    scores = {r.document_id: r.p for r in out.select("document_id", page_priority(F.col("lines"), F.col("tables")).alias("p")).collect()}
    assert scores["e"] == 0 and scores["d"] > 0.3


def test_pages_of_one_form_are_laid_out_once(spark, monkeypatch):
    from factengine.operators import layout

    pages = [[{**n, "text": n["text"].replace("5", str(i)), "id": f"{n['id']}-{i}"} for n in two_grids()] for i in range(5)] + [[]]
    rows = [(i, 1, 400.0, [(n["id"], n["text"], tuple(n["bbox"].values()), n["size"]) for n in lines]) for i, lines in enumerate(pages)] + [(9, 1, 400.0, None)]
    frame = spark.createDataFrame(rows, f"document_id int, page_number int, width double, lines array<{LINE}>").coalesce(1)
    out = {r.document_id: r.asDict(True)["tables"] for r in reconstruct(frame).collect()}
    assert out == {i: page_tables(lines, column_bands(lines, 400.0), 1) for i, lines in enumerate(pages)} | {9: []}
    plans = [layout._Plan(lines, 400.0) for lines in pages[:2]]
    assert (plans[0].cells == plans[1].cells).all()
    marks = [[layout.text_class(n["text"]) for n in lines] for lines in pages[:5]]
    assert all(m == marks[0] for m in marks)


def test_prose_batches_and_plans(spark):
    def page(n, texts):
        return ("d", n, [(f"p{n}l{i}", t, (0.0, 0.0, 1.0, 1.0), s) for i, (t, s) in enumerate(texts)], [])

    pages = spark.createDataFrame([page(2, [("b" * 30, 10.0)]), page(1, [("Heading", 12.0), ("a" * 30, 10.0), ("a" * 30, 10.0), (" ", 10.0)])], f"document_id string, page_number int, lines array<{LINE}>, tables array<{TABLE}>")
    rows = sorted(prose_batches(pages, 70).collect(), key=lambda r: r.position)
    assert [(r.id, r.section_title, r.page_number) for r in rows] == [("prose-1", "Heading", 1), ("prose-1", "Heading", 1), ("prose-1", "Heading", 1), ("prose-2", "Heading", 2)] or [r.id for r in rows] == ["prose-1", "prose-1", "prose-2", "prose-2"]
    with pytest.raises(ValueError):
        prose_batches(pages, 0)
    ranked = spark.createDataFrame([("d", 1, 0.1), ("d", 2, 0.1), ("d", 40, 0.9), ("d", 41, 0.9), ("d", 3, 0.0)], "document_id string, page_number int, priority double")
    got = {}
    for r in extraction_plan(ranked, 2).collect():
        got.setdefault(r.batch, set()).add(r.page_number)
    assert got == {0: {40, 41}, 1: {1, 2}, 2: {3}}
    assert sorted(tuple(r) for r in parse_plan(spark.createDataFrame([("d", 51), ("e", 0)], "document_id string, page_count int")).collect()) == [("d", 0, 25), ("d", 25, 50), ("d", 50, 51)]


def test_salience_and_qualifiers(spark):
    rows = [("d0", "Revenue", "is", "5", None, "q"), ("d0", "page number", "is", "5", None, "q"), ("d0", "Company", "registration number", "U1", None, "q"), ("d0", "p19t3-r8", "is", "5", None, "q"), ("d0", "Survey", "is", "5", None, "doi 10.1"), ("d0", "Name", "is", "Ann", None, "q")]
    rows += [(f"d{n}", "revenue", "IS", "5", "", "q") for n in range(1, 7)]
    df = spark.createDataFrame(rows, "document_id string, subject string, predicate string, raw_value string, unit string, quote string")
    got = {r.subject: round(r.salience, 6) for r in with_salience(df).where("document_id = 'd0'").collect()}
    assert got == {"Revenue": 1.0, "page number": 0.05, "Company": 0.05, "p19t3-r8": 0.05, "Survey": 0.05, "Name": 0.2}
    q = spark.createDataFrame([({"title": "x", "cellId": "y", "columnHeader": "z", "fiscal_year": "FY24", "geography": "India"},)], "q map<string, string>")
    assert set(q.select(strip_qualifiers(F.col("q"))).first()[0]) == {"fiscal_year", "geography"}


class Stub:
    def __init__(self, answer):
        self.answer, self.calls = answer, 0

    def generate(self, **kw):
        self.calls += 1
        return self.answer(json.loads(kw["prompt"].split("\n")[1]), self.calls)


def test_provider_calls():
    lines = [{"text": f"line {i}", "lineIds": [f"l{i}"]} for i in range(4)]
    good = {"subject": "s", "predicate": "p", "rawValue": "1", "valueType": "number", "modality": "observed", "evidence": {"quote": "line", "lineIds": ["l0"]}, "qualifiers": [{"key": "title", "value": "x"}, {"key": "geography", "value": "India"}]}

    def shape(batch, n):
        if len(batch["lines"]) == 4:
            raise SchemaFailure("too long")
        return {"candidates": [good]}

    stub = Stub(shape)
    rows, problems = call_batch(stub, {"id": "b", "lines": lines})
    assert (stub.calls, len(rows), problems) == (3, 2, [])
    assert rows[0]["qualifiers"] == {"geography": "India"}

    def broken(batch, n):
        raise RuntimeError("down")

    stub = Stub(broken)
    assert call_batch(stub, {"id": "b", "lines": lines})[1][0]["kind"] == "model_error" and stub.calls == 2

    def never(batch, n):
        raise PermanentFailure("no")

    stub = Stub(never)
    assert call_batch(stub, {"id": "b", "lines": lines})[1] and stub.calls == 1
    twice = {**good, "qualifiers": [{"key": "a", "value": "1"}, {"key": "a", "value": "2"}]}
    assert call_batch(Stub(lambda b, n: {"candidates": [twice]}), {"id": "b", "lines": lines})[1][0]["kind"] == "invalid_output"
    cells = {"id": "t", "cells": [{"text": "1", "lineIds": ["c1"], "context": {"title": "T"}}, {"text": "2", "lineIds": ["c2"], "context": {}}]}
    item = {**good, "evidence": {"quote": "1", "lineIds": ["c1"]}}
    assert call_batch(Stub(lambda b, n: {"candidates": [item, {**item, "rawValue": "9"}]}), cells)[0][0]["tableContext"] == {"title": "T"}
    assert split_lines(lines) == (lines[:2], lines[2:])


def test_nearest_is_exact_in_blocks(spark):
    rng = random.Random(1)
    rows = [(i, i % 4, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(200, 0, None), (201, 1, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, grp int, v array<double>")
    got = {}
    for r in nearest(df, df, 5, block=16).collect():
        got.setdefault(r.source_id, set()).add(r.target_id)
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    unit = {i: (g, norm(v)) for i, g, v in rows[:90]}
    want = {i: set(sorted((j for j in unit if unit[j][0] != g), key=lambda j: (-sum(a * b for a, b in zip(v, unit[j][1], strict=True)), j))[:5]) for i, (g, v) in unit.items()}
    assert got == want


def test_store_upsert_stream(spark, tmp_path):
    tables = Store(spark, str(tmp_path / "store"))
    assert tables.read("t") is None
    edges = spark.createDataFrame([(1, "a", "b", "x"), (2, "a", "c", "x")], "id int, source_id string, target_id string, verdict string")
    tables.write("t", edges)
    new = spark.createDataFrame([(9, "a", "b", "y", 1), (8, "d", "e", "z", 1), (7, "a", "b", "w", 2)], "id int, source_id string, target_id string, verdict string, version int")
    tables.write("t", upsert(tables.read("t"), new))
    assert sorted(map(tuple, tables.read("t").collect())) == [(1, "a", "b", "w"), (2, "a", "c", "x"), (8, "d", "e", "z")]
    assert tables.versions("t") == [1, 2] and tables.read("t", 1).count() == 2
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, text string")
    landing = str(tmp_path / "landing")
    for _ in range(2):
        docs.write.mode("append").parquet(landing)
        stream_intake(spark, landing, docs.schema, tables, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in tables.read("documents").collect()) == [1, 2]
    versions = tables.versions("documents")
    stream_intake(spark, landing, docs.schema, tables, str(tmp_path / "cp")).awaitTermination()
    assert tables.versions("documents") == versions


def test_invariants_and_helpers(spark):
    bad = spark.createDataFrame([("published", False, True, None, "money")], "status string, verified boolean, context_complete boolean, rejection_reason string, value_type string")
    with pytest.raises(Exception, match="published without"):
        assert_facts(bad).collect()
    files = with_identity(spark.createDataFrame([(bytearray(b"%PDF-1.7 x"),), (bytearray(b"hello"),)], "content binary")).collect()
    assert [f.refusal for f in files] == [None, "not_a_pdf"]
    assert [clamp_limit(x) for x in (None, 0, 7.9, 9999, float("nan"))] == [50, 1, 7, 500, 50]
    assert deep_diff({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}], "c": 1}) == ["a[1].b", "c"]
    assert deep_diff([1], [1, 2]) == ["length"]


def test_prose_of_many_documents_is_folded_in_one_stream(spark):
    line = "struct(concat('l', i) AS id, concat('line ', i, ' of ', id) AS text, if(i % 4 = 0, 14D, 10D) AS size)"
    tables = "cast(array() AS array<struct<quality: string, rows: array<struct<cells: array<struct<lineIds: array<string>>>>>>>) AS tables"
    pages = spark.range(300).selectExpr("nullif(id, 7) AS document_id", "1 AS page_number", f"transform(sequence(1, int(id % 9 + 1)), i -> {line}) AS lines", tables)
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # documents go over the ends of batches
        done = prose_batches(pages, 30)
        assert "FlatMapGroupsInPandas" not in done._jdf.queryExecution().executedPlan().toString()
        got = done.orderBy("document_id", "position").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    want = []
    for d in range(300):
        number, chars, title = 0, 0, None
        sizes = sorted(14.0 if i % 4 == 0 else 10.0 for i in range(1, d % 9 + 2))
        body = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
        for place, i in enumerate(range(1, d % 9 + 2)):
            text = f"line {i} of {d}"
            head = i % 4 == 0 and 14.0 >= body * 1.12
            if not number or head or chars + len(text) + 1 > 30:
                number, chars, title = number + 1, 0, text if head else title
            chars += len(text) + 1
            want.append((None if d == 7 else d, f"prose-{number}", title, f"l{i}", place))
    key = lambda r: (r[0] is not None, r[0] or 0, r[4])
    assert sorted(((r.document_id, r.id, r.section_title, r.line_id, r.position) for r in got), key=key) == sorted(want, key=key)


def test_a_task_keeps_the_nearest_of_all_blocks(spark):
    from factengine.operators.nearest import lanes_best

    rng = random.Random(2)
    rows = [(f"v{i}", i % 4, [rng.choice((-1.0, 1.0)) for _ in range(5)]) for i in range(200)]  # many ties
    df = spark.createDataFrame(rows, "id string, grp int, v array<double>")
    found = lanes_best(df, df, 3, block=10)  # twenty blocks a side
    assert found.count() <= 200 * 3 * 2
    got = sorted((r.source_id, r.target_id) for r in nearest(df, df, 3, block=10).collect())
    dot = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True))
    assert got == sorted((i, j) for i, g, v in rows for j in sorted((j for j, h, _ in rows if h != g), key=lambda j, v=v: (-dot(v, rows[int(j[1:])][2]), j))[:3])


def test_spans_without_bounds_extend_nothing(spark):
    import duckdb

    from factengine.plans import catalogue
    from factengine.plans.derived import line_boxes

    # page, part, quantity: a span is from part to part + quantity
    rows = [(1, 10, 5.0), (1, 40, 5.0), (1, None, 5.0), (1, 12, None), (2, None, None), (2, None, 1.0), (3, 7, None), (3, 9, 2.0), (3, 9, 2.0), (None, 3, 4.0), (None, None, 4.0)]
    rows += [(4, 56, 26.0), (4, 56, 26.0), (4, 142, 12.0), (5, 31, 2.0), (5, 80, 40.0), (5, 80, 40.0)]
    names = "l_orderkey, l_partkey, l_quantity, l_suppkey, l_linenumber"
    lines = spark.createDataFrame([(*r, 1, 1) for r in rows], "l_orderkey long, l_partkey long, l_quantity double, l_suppkey long, l_linenumber int")
    con = duckdb.connect()
    con.execute("SET threads=1")  # the SQL leaves equal spans open
    con.execute(f"create table lineitem as select * from (values {', '.join(str(tuple(r) + (1, 1)).replace('None', 'null') for r in rows)}) t({names})")
    merged = merge_intervals(line_boxes(lines), ["page"])
    assert merged.columns == ["page", "x0", "x1"]
    got = sorted(map(tuple, merged.collect()), key=str)
    assert got == sorted(con.execute(catalogue.oracle_sql()["band_merge"]).fetchall(), key=str)
    want = [(1, 10.0, 15.0), (1, 40.0, 45.0), (2, None, None), (2, None, None), (3, 7.0, None), (3, 9.0, 11.0), (4, 56.0, 82.0), (4, 142.0, 154.0), (5, 31.0, 33.0), (5, 80.0, 120.0), (None, 3.0, 7.0)]
    assert got == sorted(want, key=str)
