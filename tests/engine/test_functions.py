"""Golden values of value and period normalisation."""

import pytest
from pyspark.sql import functions as F

from factengine.functions.periods import Calendar, Refused, date_in_source, find_period, fiscal_calendar, read_period
from factengine.functions.text import affinity
from factengine.functions.values import normalize_value, normalized, verify_in_source


VALUES = [
    ("₹81,415.38 million", "money", None, "81415380000", "INR", "inr_million_to_inr"),
    ("8,141.538 crore", "money", "INR", "81415380000", "INR", "inr_crore_to_inr"),
    ("72.25 billion", "money", "INR", "72250000000", "INR", "inr_billion_to_inr"),
    ("7,225 crore", "money", "INR", "72250000000", "INR", "inr_crore_to_inr"),
    ("(18%)", "percent", None, "-0.18", "percent", "percent_to_ratio"),
    ("1%", "percent", None, "0.01", "percent", "percent_to_ratio"),
    ("0.5%", "percent", None, "0.005", "percent", "percent_to_ratio"),
    ("−1.25 million", "number", None, "-1250000", None, "million_to_base"),
    ("+2.5 thousand", "number", None, "2500", None, "thousand_to_base"),
    ("₹10 to 12 million", "money", None, "10000000..12000000", "INR", "inr_million_to_inr_range"),
    ("12.5 kilograms", "number", None, "12.5", "kg", "kg_identity"),
    ("18 months", "duration", None, "18", "month", "month_identity"),
    ("5 millions", "number", None, "5", None, "number_identity"),
    ("10-12", "number", None, "10", None, "number_identity"),
    ("9,324,309", "number", "Equity Shares", "9324309", "Equity Shares", "equity shares_identity"),
    ("$5 and ₹6", "money", None, "5", "USD", "usd_identity"),
    ("$1 to 2", "money", None, "1..2", "USD", "number_identity_range"),
    ("000.500", "number", None, "0.5", None, "number_identity"),
    ("-0.0", "number", None, "0", None, "number_identity"),
    ("31 March 2024", "date", None, "2024-03-31", None, "date_day_to_iso"),
    ("ﬁne  words", "text", " x ", "fine words", "x", "text_nfkc"),
    ("", "number", None, None, None, None),
    ("none", "number", None, None, None, None),
    (None, "number", None, None, None, None),
]


def test_normalize_value(spark):
    rows = [(i, *v[:3]) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "i int, r string, k string, u string").repartition(4)
    got = {r.i: r.v for r in df.select("i", normalize_value(F.col("r"), F.col("k"), F.col("u")).alias("v")).collect()}
    for i, (_, kind, _, text, unit, rule) in enumerate(VALUES):
        v = got[i]
        assert (v.canonical_value, v.unit, v.normalization_rule) == (text, unit, rule), VALUES[i]
        scalar = text is not None and ".." not in text and kind not in ("date", "text")
        assert v.canonical_number == (float(text) if scalar else None)
        assert (v.failure is None) == (text is not None)


@pytest.mark.parametrize(
    ("text", "year_end", "want"),
    [
        ("31 March 2024", None, ("2024-03-31", "2024-03-31", "day")),
        ("March 2024", None, ("2024-03-01", "2024-03-31", "month")),
        ("2024", None, ("2024-01-01", "2024-12-31", "year")),
        ("FY2024", "2024-03-31", ("2023-04-01", "2024-03-31", "fiscal_year")),
        ("Q3 FY2024", "2024-03-31", ("2023-10-01", "2023-12-31", "quarter")),
        ("Q3 2024", None, ("2024-07-01", "2024-09-30", "quarter")),
        ("H2 FY2024", "2024-03-31", ("2023-10-01", "2024-03-31", "half_year")),
        ("2023-2024", None, ("2023-01-01", "2024-12-31", "year")),
        ("2022-23", "2023-03-31", ("2022-04-01", "2023-03-31", "fiscal_year")),
        ("FY2024", "2024-02-29", ("2023-03-02", "2024-02-29", "fiscal_year")),
        ("1 January 2024 to 31 March 2024", None, ("2024-01-01", "2024-03-31", "day")),
    ],
)
def test_periods(text, year_end, want):
    p = read_period(text, Calendar(year_end))
    assert (p.start, p.end, p.precision) == want


def test_refusals_and_calendars():
    with pytest.raises(Refused, match="unsupported"):
        read_period("Q5 2024")
    with pytest.raises(Refused):
        read_period("FY2024")
    with pytest.raises(Refused):
        read_period("31st March 2024")
    assert fiscal_calendar("FY2024 results") is None
    text = "for the year ended March 31, 2024; year ended 31 March 2023; period ended 31 December 2023"
    assert fiscal_calendar(text) == (3, 31)
    p = read_period("FY2022", Calendar(None, fiscal_calendar(text)))
    assert (p.start, p.end) == ("2021-04-01", "2022-03-31")
    found = find_period("Results for 2022-23")
    assert (found.start, found.end, found.precision) == ("2022-01-01", "2023-12-31", "year")


SPANS = [
    ("81,415.38 million", "money", "INR", "Revenue was I 81,415.38 million. All amounts are in Indian Rupees.", None),
    ("12 kg", "number", None, "The mass is 12 kilograms.", None),
    ("-12%", "percent", None, "The margin was 12%.", "numeric value"),
    ("12 kg", "number", None, "The length is 12 metres.", "unit"),
    ("9,324,309", "number", "Equity Shares", "Issue of 9,324,309 Equity Shares aggregating to ₹4,540 million", None),
    ("9,324,309", "number", "Preference Shares", "Issue of 9,324,309 Equity Shares aggregating to ₹4,540 million", "unit"),
    ("12", "percent", None, "It grew 12 in the year", "percentage"),
    ("Mumbai", "text", None, "Based in Pune", "text value"),
]


def test_verify_in_source(spark):
    df = spark.createDataFrame([(i, *v[:4]) for i, v in enumerate(SPANS)], "i int, r string, k string, u string, s string")
    df = df.withColumn("v", normalize_value(F.col("r"), F.col("k"), F.col("u")))
    why = verify_in_source(F.col("r"), F.col("k"), F.coalesce("v.unit", "u"), F.col("s"), F.lit(None).cast("boolean"))
    got = {r.i: r.why for r in df.select("i", why.alias("why")).collect()}
    for i, (*_, part) in enumerate(SPANS):
        assert got[i] is None if part is None else part in got[i], SPANS[i]


def test_dates_in_source():
    assert not date_in_source("2024", None, "as of 31 March 2024")
    assert date_in_source("31 March 2024", None, "year ended 31 March 2024")
    assert date_in_source("FY2024", "2024-03-31", "FY2024, year ended 31 March 2024")


def test_affinity(spark):
    pairs = [("revenue", "revenue"), ("revenue", "revenue from operations"), ("revenue growth", "growth in revenue"), ("revenue", "employee headcount"), ("", "x"), ("companies", "company")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(affinity(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [1.0, 0.75, 1.0, 0.0, 0.0, 1.0]


def test_each_value_is_normalised_once(spark):
    rows = [(1, "₹5 million", "money", None), (2, "₹5 million", "money", None), (3, "₹5 million", "money", "INR"), (4, None, "money", None), (5, None, None, None), (6, "7", "number", "kg"), (7, " ﬁne ", "text", None), (8, "2024", "date", None)]
    df = spark.createDataFrame(rows, "id int, raw string, kind string, unit string")
    c = F.col
    direct = df.withColumn("v", normalize_value(c("raw"), c("kind"), c("unit")))
    folded = normalized(df, c("raw"), c("kind"), c("unit"))
    assert folded.columns == direct.columns
    assert sorted(map(repr, folded.collect())) == sorted(map(repr, direct.collect()))


def test_prices_are_grouped_before_they_are_normalised(spark):
    from factengine.plans.catalogue import queries

    plan = queries()["value_money_scale"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("ArrowEvalPython", 1)[1]
