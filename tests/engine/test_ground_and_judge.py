"""Golden results of grounding, pairing and adjudication."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factengine.operators.adjudicate import adjudicate, batch_stats, compare, orient, split_unknown
from factengine.operators.grounding import audit, audit_summary, ground
from factengine.operators.pairing import exclusion_summary, pair_deterministic, pair_stats, prefilter, rank_pairs, union_paths
from factengine.operators.providers import PermanentFailure
from factengine.schemas import CANDIDATE

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

PAGE = "FY2024 results\nRevenue was ₹81,415.38 million for the year ended 31 March 2024."
QUOTE = "Revenue was ₹81,415.38 million for the year ended 31 March 2024."


def candidate(**changes):
    base = dict(subject="Revenue", predicate="revenue", rawValue="₹81,415.38 million", unit="INR", valueType="money", qualifiers={"fiscal_year": "FY2024"}, modality="observed", attributedTo=None, source="prose", tableContext=None, evidence=(QUOTE, ["p1l1"]), confidence=0.9)
    return {**base, **changes}


TABLE = ("Consolidated statement", "Year ended 31 March 2024", "Revenue from operations", "(All amounts in Indian Rupees in million)", [])
CASES = {
    "plain": (candidate(), PAGE, ("published", None)),
    "table": (candidate(rawValue="I 81,415.38", unit=None, source="table", tableContext=TABLE, evidence=("I 81,415.38", ["p1l1"])), "I 81,415.38", ("published", None)),
    "bare table": (candidate(source="table", unit=None, tableContext=(None, None, None, None, [])), PAGE, ("rejected", "missing_context")),
    "invented": (candidate(evidence=("Revenue doubled", ["p1l1"])), PAGE, ("rejected", "quote_not_found")),
    "no line": (candidate(evidence=(QUOTE, ["p1l99"])), PAGE, ("rejected", "line_not_found")),
    "no qualifiers": (candidate(qualifiers={}), PAGE, ("rejected", "missing_context")),
    "not stated": (candidate(qualifiers={"fiscal_year": "not stated"}), PAGE, ("rejected", "missing_context")),
    "sign": (candidate(subject="Margin", predicate="margin", rawValue="-12%", unit=None, valueType="percent", qualifiers={}, evidence=("The margin was 12%.", ["p1l1"])), "The margin was 12%.", ("rejected", "value_not_in_source")),
    "no percent": (candidate(subject="Margin", predicate="margin", rawValue="12", unit=None, valueType="percent", qualifiers={}, evidence=("The margin was 12.", ["p1l1"])), "The margin was 12.", ("rejected", "value_not_in_source")),
    "calendar year": (candidate(rawValue="$10 million", unit="USD", evidence=("FY2024 revenue of $10 million for the year ended 31 December 2024", ["p1l1"])), "FY2024 revenue of $10 million for the year ended 31 December 2024", ("published", None)),
    "fiscal date": (candidate(subject="Report", predicate="covers", rawValue="FY2024", unit=None, valueType="date", evidence=("FY2024, the year ended 31 March 2024", ["p1l1"])), "FY2024, the year ended 31 March 2024", ("published", None)),
    "undated": (candidate(subject="Cost", predicate="cost", evidence=("Cost of ₹81,415.38 million in FY2024", ["p1l1"])), "Cost of ₹81,415.38 million in FY2024", ("rejected", "normalization_failed")),
}


def test_grounding(spark):
    names = list(CASES)
    rows = []
    for name in names:
        c, page, _ = CASES[name]
        rows.append((*c.values(), page, ["p1l1", "p1l2"], None, name))
    df = spark.createDataFrame(rows, CANDIDATE + ", page_text string, page_line_ids array<string>, fiscal_month_day string, name string")
    got = {r.name: r for r in ground(df).collect()}
    for name in names:
        assert (got[name].status, got[name].rejection_reason) == CASES[name][2], (name, got[name].rejection_detail)
    plain = got["plain"]
    assert (plain.canonical_value, plain.canonical_number, plain.unit) == ("81415380000", 81415380000.0, "INR")
    assert (str(plain.period.start), str(plain.period.end)) == ("2023-04-01", "2024-03-31")
    assert got["table"].canonical_value == "81415380000"
    assert got["bare table"].verified
    assert all(x in got["bare table"].rejection_detail for x in ("table_title", "table_column_header", "table_row_header", "table_unit"))
    assert not got["invented"].verified
    assert got["no qualifiers"].verified
    assert str(got["calendar year"].period.start) == "2024-01-01"
    assert got["fiscal date"].canonical_value == "2023-04-01"
    assert got["undated"].canonical_value == "81415380000"


def test_candidates_of_one_partition_are_grounded_by_all_cores(spark):
    rows = [(*candidate(subject=f"Revenue {i}").values(), PAGE, ["p1l1"], None) for i in range(40)]
    df = spark.createDataFrame(rows, CANDIDATE + ", page_text string, page_line_ids array<string>, fiscal_month_day string").coalesce(1)
    out = ground(df).select(F.spark_partition_id().alias("at"), "status")
    assert out.count() == 40 and out.select("at").distinct().count() > 1
    assert {r.status for r in out.collect()} == {"published"}


def test_equal_candidates_are_grounded_once(spark):
    from factengine.plans.catalogue import queries

    found = queries()["ground_candidates"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("ArrowEvalPython", 1)[1]
    assert found.agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()



def test_audit(spark):
    facts = spark.createDataFrame(
        [("a", "d", 1, "x y", ["l1"], True, True, "prose", None, None, "published"), ("b", "d", 1, "zzz", ["l9"], True, True, "prose", None, None, "published"), ("c", "d", 7, "x", ["l1"], False, True, "prose", None, None, "published"), ("e", "d", 1, "q", [], False, False, "prose", None, None, "rejected")],
        "id string, document_id string, page int, quote string, line_ids array<string>, verified boolean, context_complete boolean, source string, table_context struct<title: string, columnHeader: string, rowHeader: string, unitLine: string, footnotes: array<string>>, unit string, status string",
    )
    pages = spark.createDataFrame([("d", 1, "x\ny", [("l1", "x")])], "document_id string, page_number int, text string, lines array<struct<id: string, text: string>>")
    broken = audit(facts, pages)
    assert sorted((r.id, r.reason) for r in broken.collect()) == [("b", "line_missing"), ("b", "quote_missing"), ("c", "not_verified"), ("c", "page_missing")]
    assert {r.reason: (r["count"], r.examples) for r in audit_summary(broken).collect()}["page_missing"] == (1, ["c"])


FACT = "id string, document_id string, subject string, predicate string, value_type string, unit string, canonical_value string, canonical_number double"


def fact(i, doc, **changes):
    base = dict(subject="Revenue from operations", predicate="revenue", value_type="money", unit="INR", canonical_value="81415380000", canonical_number=81415380000.0)
    return (i, doc, *{**base, **changes}.values())


def test_prefilter_cascade(spark):
    facts = [fact("a", "da"), fact("b", "db"), fact("same", "da"), fact("usd", "db", unit="USD", canonical_value="5", canonical_number=5.0), fact("pct", "db", value_type="percent"), fact("head", "db", subject="Employee headcount", predicate="headcount"), fact("low", "db", canonical_value="7", canonical_number=7.0), fact("lab", "db", subject="Figure", predicate="has label", canonical_value="8", canonical_number=8.0), fact("inc", "db", subject="Other thing", predicate="includes", canonical_value="9", canonical_number=9.0), fact("clm", "db", subject="Volume", predicate="climbed", canonical_value="11", canonical_number=11.0)]
    facts = spark.createDataFrame(facts, FACT)
    det = spark.createDataFrame([("a", "b"), ("a", "head"), ("a", "same"), ("a", "gone"), ("a", "pct"), ("a", "low")], "source_id string, target_id string")
    sem = spark.createDataFrame([("b", "a", 0.91), ("a", "usd", 0.82), ("a", "lab", 0.54), ("a", "inc", 0.56), ("a", "clm", 0.83), ("usd", "low", 0.2)], "source_id string, target_id string, similarity double")
    merged = union_paths(det, sem)
    rows = {r.pair_key: r for r in prefilter(merged, facts).collect()}
    want = {"a:b": None, "a:head": "predicate", "a:same": "same_document", "a:gone": "unknown_assertion", "a:pct": "value_type", "a:low": "value_mismatch", "a:usd": None, "a:lab": "claim_relation", "a:inc": "claim_relation", "a:clm": None, "low:usd": "same_document"}
    assert {k: r.exclusion_reason for k, r in rows.items()} == want
    both = rows["a:b"]
    assert both.paths == ["deterministic", "semantic"] and both.similarity == 0.91 and both.values_equal and both.score == 1.0 and both.source_id == "a"
    assert not rows["a:usd"].values_equal and not rows["a:usd"].units_comparable
    done = prefilter(merged, facts)
    assert [r.pair_key for r in rank_pairs(done).collect()] == ["a:b", "a:clm", "a:usd"]
    assert sum(r["count"] for r in exclusion_summary(done).collect()) == 8
    stats = pair_stats(facts, facts, done).first()
    assert (stats.retrieved, stats.pairs, stats.dropped, stats.capped) == (11, 3, 8, 0)


def test_equal_values_pair_without_a_cap(spark):
    facts = spark.createDataFrame([fact(f"{d}{i}", d) for d in ("x", "y") for i in range(6)], FACT)
    pairs = pair_deterministic(facts.where("document_id = 'x'"), facts.where("document_id = 'y'"))
    done = prefilter(union_paths(pairs, pairs.limit(0).selectExpr("source_id", "target_id", "0D as similarity")), facts)
    assert rank_pairs(done).count() == 36


def test_tolerance_join_equals_nested_loop(spark):
    import random

    rng = random.Random(2)
    base = [0.0, 1.0, -1.0, 1e-12, 1e15, -3.5] + [rng.uniform(-3, 3) * 10 ** rng.randrange(-9, 14) for _ in range(120)]
    near = [x + d * max(abs(x), 1) for x in base for d in (0, 0.9e-9, -0.9e-9, 1.5e-9)]
    rows = [fact(f"a{i}", "x", canonical_number=v) for i, v in enumerate(base)] + [fact(f"b{i}", "y", canonical_number=v) for i, v in enumerate(near)]
    facts = spark.createDataFrame(rows, FACT)
    got = {(r.source_id, r.target_id) for r in pair_deterministic(facts.where("document_id = 'x'"), facts.where("document_id = 'y'")).collect()}
    want = {(f"a{i}", f"b{j}") for i, x in enumerate(base) for j, y in enumerate(near) if abs(x - y) <= 1e-9 * max(abs(x), abs(y), 1)}
    assert got == want


SIDE = "struct<id: string, subject: string, predicate: string, raw_value: string, canonical_value: string, canonical_number: double, unit: string, qualifiers: map<string, string>, modality: string, attributed_to: string, period: struct<start: date, end: date, precision: string>>"


def side(i, **changes):
    import datetime

    base = dict(subject="Revenue", predicate="revenue", raw_value="100", canonical_value="100", canonical_number=100.0, unit="INR", qualifiers={"geography": "India"}, modality="observed", attributed_to=None, period=(datetime.date(2023, 4, 1), datetime.date(2024, 3, 31), "fiscal_year"))
    return (i, *{**base, **changes}.values())


class Scripted:
    """One reply for the first pass and one for the review; exceptions are raised."""

    def __init__(self, *replies):
        self.replies = replies

    def generate(self, *, escalate=False, **kw):
        answer = self.replies[-1 if escalate else 0]
        if isinstance(answer, Exception):
            raise answer
        return answer


def reply(verdict, code="value_conflict", matches=(), text="So it seems."):
    return {"verdict": verdict, "reasonCode": code, "contextMatches": list(matches), "explanation": text, "confidence": 0.8}


def judged(spark, a, b, *replies):
    pairs = spark.createDataFrame([("k", a, b)], f"pair_key string, source {SIDE}, target {SIDE}")
    edges, skips = adjudicate(pairs, "v", Scripted(*replies))
    return edges.collect(), skips.collect()


def test_settlement_and_withholding(spark):
    import datetime

    other = (datetime.date(2022, 4, 1), datetime.date(2023, 3, 31), "fiscal_year")
    (edge,), _ = judged(spark, side("a"), side("b", raw_value="one hundred"), RuntimeError("not asked"))
    assert (edge.verdict, edge.reason_code, edge.confidence) == ("corroborates", "equivalent_value", 1.0)
    (edge,), _ = judged(spark, side("a"), side("b", raw_value=" 100 "), RuntimeError("not asked"))
    assert edge.reason_code == "exact_duplicate"
    (edge,), _ = judged(spark, side("a"), side("b", raw_value="120", canonical_value="120", canonical_number=120.0, period=other), reply("contradicts"))
    assert (edge.verdict, edge.reason_code, edge.withheld) == ("insufficient", "missing_context", True)
    assert edge.explanation.startswith("Withheld a contradiction: time")
    (edge,), _ = judged(spark, side("a"), side("b", raw_value="120", canonical_value="120", canonical_number=120.0, modality="projected"), reply("contradicts"))
    assert (edge.reason_code, edge.source_id) == ("projection_vs_actual", "a")


def test_review(spark):
    a, b = side("a"), side("b", raw_value="120", canonical_value="120", canonical_number=120.0)
    (edge,), _ = judged(spark, a, b, reply("contradicts"), {"reconcilable": True, "reasonCode": "vintage_difference", "explanation": "Restated.", "confidence": 0.7})
    assert (edge.verdict, edge.reason_code, edge.prior_verdict, edge.downgraded) == ("reconciles", "vintage_difference", "contradicts", True)
    (edge,), _ = judged(spark, a, b, reply("contradicts"), {"reconcilable": False, "reasonCode": "missing_context", "explanation": "Nothing.", "confidence": 0.7})
    assert (edge.verdict, edge.reason_code, edge.reviewed) == ("contradicts", "value_conflict", True)
    edges, skips = judged(spark, a, b, PermanentFailure("no"))
    assert not edges and skips[0].reason == "model_error"


def test_comparison_fields(spark):
    import datetime

    quarter = (datetime.date(2023, 4, 1), datetime.date(2023, 6, 30), "quarter")
    rows = [
        ("quarter", side("a"), side("b", period=quarter)),
        ("keys", side("a"), side("b", qualifiers={"segment": "Retail"})),
        ("none", side("a", qualifiers=None, unit=None), side("b", qualifiers={}, unit=None)),
        ("close", side("a", canonical_number=1_270_000_000.0), side("b", canonical_number=1_266_410_000.0)),
        ("far", side("a"), side("b", canonical_number=120.0, attributed_to="CEO")),
    ]
    got = {r.name: r for r in compare(spark.createDataFrame(rows, f"name string, source {SIDE}, target {SIDE}")).collect()}
    assert got["quarter"].overlap and "time" in got["quarter"].mismatched
    assert "scope" in got["keys"].unknown
    assert got["none"].settled == "exact_duplicate"
    assert "value" in got["close"].unknown and got["close"].delta < 0.005
    assert {"value", "attribution"} <= set(got["far"].mismatched) and got["far"].same_sign


def test_orientation_skips_and_stats(spark):
    import datetime

    late = (datetime.date(2024, 4, 1), datetime.date(2025, 3, 31), "fiscal_year")
    rows = [("t", side("a"), side("b", period=late), "time_supersession"), ("m", side("b", modality="projected"), side("a"), "projection_vs_actual"), ("o", side("b"), side("a"), "value_conflict")]
    got = {r.name: (r.source_id, r.target_id) for r in orient(spark.createDataFrame(rows, f"name string, source {SIDE}, target {SIDE}, reason_code string")).collect()}
    assert got == {"t": ("b", "a"), "m": ("a", "b"), "o": ("a", "b")}
    pairs = spark.createDataFrame([("k", "a", "b", side("a"), None), ("l", "a", "c", side("a"), side("c"))], f"pair_key string, source_id string, target_id string, source {SIDE}, target {SIDE}")
    whole, skips = split_unknown(pairs)
    assert whole.count() == 1 and "b" in skips.first().detail
    edges, none = adjudicate(whole.drop("source_id", "target_id"), "v")
    stats = batch_stats(edges, none).first()
    assert (stats.edges, stats.settled, stats.judged, stats.skipped) == (1, 1, 0, 0)


def test_unknown_argument():
    from factengine.schemas import STATUS, one_of

    with pytest.raises(ValueError, match="status"):
        one_of("odd", STATUS, "status")
    assert F is not None


def paired(spark):
    """Two sides of facts with few values, one by one and by classes."""
    from factengine.operators import pairing

    kind = "id string, document_id string, subject string, predicate string, value_type string, unit string, canonical_value string, canonical_number double"
    rows = lambda side, n: [(f"{side}{i}", f"d{i % 3}", ("red ring", "blue bolt")[i % 2], ("price", "cost of sales")[i % 5 == 0], ("money", "duration")[i % 7 == 0], None, str(i % 4), None if i % 4 == 3 else float(i % 4)) for i in range(n)]
    a, b = (spark.createDataFrame(rows(side, 40), kind) for side in "ab")
    near = spark.createDataFrame([(f"a{i}", f"b{j}", s) for i in range(0, 40, 3) for j, s in ((i, 0.9), (i + 4, 0.0), (i + 1, 0.6), (99, 0.9))], "source_id string, target_id string, similarity double")
    none = near.limit(0).select("source_id", "target_id")
    plain = pairing.prefilter(pairing.union_paths(pairing.pair_deterministic(a, b), near), a.unionByName(b)).collect()
    return plain, pairing.Grouped(a, b, pairing.union_paths(none, near))


def test_pairs_by_classes_are_the_pairs_one_by_one(spark):
    from factengine.operators import pairing

    plain, grouped = paired(spark)
    got, want = {}, {}
    for r in grouped.rows("exclusion_reason", "score", "paths").collect():
        key = (r.exclusion_reason, round(r.score, 9), tuple(r.paths))
        got[key] = got.get(key, 0) + r.n
    for r in plain:
        key = (r.exclusion_reason, round(r.score, 9), tuple(r.paths))
        want[key] = want.get(key, 0) + 1
    assert got == want and grouped.classes.count() < len(plain) / 4
    refused = {}
    for r in plain:
        if r.exclusion_reason:
            n, best = refused.get((r.source_id, r.exclusion_reason), (0, 0.0))
            refused[r.source_id, r.exclusion_reason] = (n + 1, max(best, round(r.score, 9)))
    assert {(r.source_id, r.exclusion_reason): (r["count"], round(r.best_score, 9)) for r in pairing.exclusion_summary(grouped.refused()).collect()} == refused


def test_ranking_by_classes_is_the_ranking_one_by_one(spark):
    plain, grouped = paired(spark)
    order = sorted(((-r.score, r.pair_key, r.source_id, r.target_id) for r in plain if r.exclusion_reason is None))
    assert len({s for s, *_ in order[:25]}) < 10
    for limit, whole, take in ((1, 0, 1), (5, 0, 1), (25, 0, 3), (60, 1_000_000, 1), (10_000, 0, 2)):
        got = [(-r.score, r.pair_key, r.source_id, r.target_id) for r in grouped.best(limit, whole, take).orderBy(F.desc("score"), "pair_key").collect()]
        assert got == order[:limit]


def test_batches_by_classes_need_no_shuffle_of_pairs(spark, monkeypatch):
    from factengine.operators import pairing
    from factengine.operators.extract import pair_plan

    plain, grouped = paired(spark)
    want = sorted((r.source_id, r.pair_key, round(r.score, 9)) for r in plain if r.exclusion_reason is None)
    for part, block in ((4_000_000, 512), (7, 3)):
        monkeypatch.setattr(pairing, "PART", part)
        monkeypatch.setattr(pairing, "BLOCK", block)
        kept = grouped.kept()
        assert sorted((r.source_id, r.pair_key, round(r.score, 9)) for r in kept.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pair_plan(kept, "source_id", 2, ("cls", "part"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    top = plan.splitlines()
    window = next(i for i, n in enumerate(top) if "Window" in n)
    assert next(n for n in top[window:] if "Exchange" in n or "SortMergeJoin" in n).count("SortMergeJoin") == 1


def test_pairs_of_a_popular_value_are_dealt_out(spark):
    from factengine.operators.pairing import pair_deterministic

    facts = spark.range(1500).selectExpr("concat('f', id) AS id", "concat('d', id % 2) AS document_id", "if(id < 1400, 'x', cast(id AS string)) AS canonical_value", "if(id % 50 < 48, 7D, cast(null AS double)) AS canonical_number")
    pairs = pair_deterministic(facts, facts)
    assert pairs.distinct().count() == pairs.count() == 2 * 720 * 720 + 2 * 28 * 28
    spread = [n for n in pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(spread) > 1 and max(spread) < 0.8 * sum(spread)


def test_forms_stand_for_all_their_pairs(spark):
    from factengine.operators.adjudicate import forms
    from factengine.plans.queries_pairs import Contrary, _order_pairs

    pairs = _order_pairs(spark, "/root/testdata/sf0.001")
    few = forms(pairs)
    assert few.agg(F.sum("n")).first()[0] == pairs.count() > few.count()
    told = ("comparison", "delta", "same_sign", "overlap", "settled")
    text = lambda d: F.to_json(F.struct(*(d[c] for c in told)))
    one, many = compare(pairs), compare(few)
    want = {r.k: r.n for r in one.groupBy(text(one).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert {r.k: r.n for r in many.groupBy(text(many).alias("k")).agg(F.sum("n").alias("n")).collect()} == want
    by = ("verdict", "reason_code", "reviewed", "downgraded")
    some = pairs.where("int(split(pair_key, ':')[0]) < 100")
    edges, _ = adjudicate(some, "v", Contrary())
    folded, _ = adjudicate(forms(some), "v", Contrary())
    assert sorted(map(str, folded.groupBy(*by).agg(F.sum("n").alias("n")).collect())) == sorted(map(str, edges.groupBy(*by).agg(F.count("*").alias("n")).collect()))
