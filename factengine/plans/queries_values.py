"""Queries over value, period and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factengine.functions.periods import overlaps, parse_period, period_in_text
from factengine.functions.text import affinity, prettify
from factengine.functions.values import detect_currency, detect_scale, normalized, unit_in_source, verify_in_source
from factengine.operators.adjudicate import compare_time
from factengine.operators.grounding import document_calendars
from factengine.plans.derived import price_claims, table
from factengine.plans.registry import query
from factengine.session import dealt


def _none():
    return F.lit(None).cast("string")


def _normal(df: DataFrame, raw, kind: str, unit=None) -> DataFrame:
    return normalized(df, raw, F.lit(kind), _none() if unit is None else unit)


@query(
    """
SELECT f.form || p_partkey AS id, (CAST(p_retailprice AS DECIMAL(18,2)) * 1000000)::DECIMAL(30,0)::VARCHAR AS canonical_value,
  (CAST(p_retailprice AS DECIMAL(18,2)) * 1000000)::DECIMAL(30,0)::DOUBLE AS canonical_number, 'INR' AS unit,
  CASE f.form WHEN 'm' THEN 'inr_million_to_inr' ELSE 'inr_crore_to_inr' END AS normalization_rule
FROM part, (VALUES ('m'), ('c')) f(form)
"""
)
def value_money_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in millions and in crores come to the same exact value."""
    claims = price_claims(table(spark, sf_dir, "part")).select("id", "raw_value", F.col("unit").alias("given"))
    return _normal(claims, F.col("raw_value"), "money", F.col("given")).select("id", "v.canonical_value", "v.canonical_number", "v.unit", "v.normalization_rule")


@query(
    """
SELECT rtrim(rtrim(CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR), '0'), '.') AS canonical_value, CAST(CAST(l_discount AS DECIMAL(4,2)) AS DOUBLE) AS canonical_number,
  'percent' AS unit, 'percent_to_ratio' AS normalization_rule, count(*) AS n
FROM lineitem GROUP BY ALL
"""
)
def value_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as percentages come to ratios."""
    raw = F.concat((F.col("l_discount").cast("decimal(4,2)") * 100).cast("int").cast("string"), F.lit("%"))
    distinct = table(spark, sf_dir, "lineitem").groupBy(raw.alias("raw")).agg(F.count("*").alias("rows"))
    return _normal(distinct, F.col("raw"), "percent").groupBy("v.canonical_value", "v.canonical_number", "v.unit", "v.normalization_rule").agg(F.sum("rows").alias("n"))


@query("SELECT p_partkey, 'fine ' || p_name AS canonical_value, 'text_nfkc' AS normalization_rule FROM part")
def value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in compatibility form with single spaces."""
    out = _normal(table(spark, sf_dir, "part"), F.concat(F.lit(" \ufb01ne  "), "p_name"), "text")
    return out.select("p_partkey", "v.canonical_value", "v.normalization_rule")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS canonical_value, 'date_day_to_iso' AS normalization_rule FROM orders")
def value_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as values, in their words."""
    out = _normal(table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "d MMMM yyyy"), "date")
    return out.select("o_orderkey", "v.canonical_value", "v.normalization_rule")


@query(
    """
SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS canonical_number, CAST(c_acctbal AS DECIMAL(18,2)) < 0 AS negative FROM customer
"""
)
def value_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances with brackets or a true minus sign keep their sign."""
    size = F.abs(F.col("c_acctbal").cast("decimal(18,2)")).cast("string")
    raw = F.when(F.col("c_acctbal") >= 0, size).when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("("), size, F.lit(")"))).otherwise(F.concat(F.lit("−"), size))
    out = _normal(table(spark, sf_dir, "customer"), raw, "number")
    return out.select("c_custkey", "v.canonical_number", F.col("v.canonical_value").startswith("-").alias("negative"))


@query(
    """
SELECT p_partkey, (p_size::BIGINT * 1000000)::VARCHAR || '..' || ((p_size + 5)::BIGINT * 1000000)::VARCHAR AS canonical_value, 'INR' AS unit, 'inr_million_to_inr_range' AS normalization_rule FROM part
"""
)
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges keep both ends and have no number."""
    raw = F.concat(F.lit("₹"), F.col("p_size"), F.lit(" to "), F.col("p_size") + 5, F.lit(" million"))
    out = _normal(table(spark, sf_dir, "part"), raw, "money").where("v.canonical_number is null")
    return out.select("p_partkey", "v.canonical_value", "v.unit", "v.normalization_rule")


@query(
    """
SELECT p_partkey, p_size::VARCHAR AS canonical_value, ['kg', 'month', 'km', 'Equity Shares'][(p_partkey % 4 + 1)::INT] AS unit, ['kg', 'month', 'km', 'equity shares'][(p_partkey % 4 + 1)::INT] || '_identity' AS normalization_rule FROM part
"""
)
def value_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by their words, and units that no table knows as they were given."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat("p_size", F.lit(" kilograms"))).when(k == 1, F.concat("p_size", F.lit(" months"))).when(k == 2, F.concat("p_size", F.lit(" Kilometres"))).otherwise(F.col("p_size").cast("string"))
    out = _normal(table(spark, sf_dir, "part"), raw, "number", F.when(k == 3, "Equity Shares"))
    return out.select("p_partkey", "v.canonical_value", "v.unit", "v.normalization_rule")


@query("SELECT ['USD', 'INR', 'GBP', 'EUR', 'JPY', 'USD', NULL][(o_orderkey % 7 + 1)::INT] AS currency, count(*) AS n FROM orders GROUP BY ALL")
def currency_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first currency of the fixed order; a dollar sign beats the rest; letters around a word hide it."""
    texts = F.array(*map(F.lit, ("5 dollars", "Rs. 7 lakh", "GBP 3", "€4", "¥ 9", "₹5 or $5", "hrs 5")))
    text = F.element_at(texts, (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(detect_currency(text, _none()).alias("currency")).agg(F.count("*").alias("n"))


@query("SELECT ['thousand', 'million', 'crore', 'base', 'lakh', 'cr'][(o_orderkey % 6 + 1)::INT] AS scale, count(*) AS n FROM orders GROUP BY ALL")
def scale_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scale word; plurals are none."""
    texts = F.array(*map(F.lit, ("2 Thousand", "in million and crore", "9 crore", "3 millions", "1 lakh", "4 Cr")))
    return table(spark, sf_dir, "orders").groupBy(detect_scale(F.element_at(texts, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("scale")).agg(F.count("*").alias("n"))


@query(
    """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'numeric value' ELSE 'currency INR' END AS problem FROM part
"""
)
def value_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed values against spans that show them, show another one, or show another currency."""
    amount = F.concat(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" million"))
    k = F.col("p_partkey") % 3
    span = F.when(k == 0, F.concat(F.lit("It was Rs "), amount, F.lit(" in all"))).when(k == 1, F.concat(F.lit("It was Rs 1"), amount)).otherwise(F.concat(F.lit("It was £"), amount))
    why = verify_in_source(F.concat(F.lit("₹"), amount), F.lit("money"), F.lit("INR"), span, F.lit(None).cast("boolean"))
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", F.nullif(F.regexp_extract(why, "^(numeric value|currency [A-Z]+)", 1), F.lit("")).alias("problem"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 1, 2) AS shown FROM part")
def unit_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a span shows a unit, by its sign, by a word for it, or in so many words."""
    k = (F.col("p_partkey") % 5 + 1).cast("int")
    units, spans = ("INR", "kg", "equity shares", "km", "equity shares"), ("Rs 5 in all", "a mass of 3 kilograms", "9 Equity  Shares", "3 kilograms", "9 preference shares")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), k)
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", unit_in_source(pick(units), pick(spans)).alias("shown"))


def _periods(spark: SparkSession, sf_dir: str, raw, year_end=None, month_day=None) -> DataFrame:
    """Bounds and precision of a period rendered from each order's date, counted."""
    p = table(spark, sf_dir, "orders").select(parse_period(raw, year_end, month_day).alias("p"))
    return p.groupBy(F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"), "p.precision").agg(F.count("*").alias("n"))


def _sql(start: str, end: str, precision: str) -> str:
    return f"SELECT strftime({start}, '%Y-%m-%d') AS start_day, strftime({end}, '%Y-%m-%d') AS end_day, '{precision}' AS precision, count(*) AS n FROM orders GROUP BY ALL"




def _day():
    return F.col("o_orderdate")


@query(_sql("o_orderdate", "o_orderdate", "day"))
def period_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in three spellings."""
    k = F.col("o_orderkey") % 3
    return _periods(spark, sf_dir, F.when(k == 0, F.date_format(_day(), "d MMMM yyyy")).when(k == 1, F.date_format(_day(), "MMM d, yyyy")).otherwise(F.date_format(_day(), "yyyy-MM-dd")))


@query(_sql("date_trunc('month', o_orderdate)", "last_day(o_orderdate)", "month"))
def period_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir, F.when(F.col("o_orderkey") % 2 == 0, F.date_format(_day(), "MMMM yyyy")).otherwise(F.date_format(_day(), "yyyy-MM")))


@query(_sql("date_trunc('quarter', o_orderdate)", "date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY", "quarter"))
def period_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir, F.concat(F.lit("Q"), F.quarter(_day()), F.lit(" "), F.year(_day())))


@query(_sql("make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1)", "make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END, CASE WHEN month(o_orderdate) <= 6 THEN 30 ELSE 31 END)", "half_year"))
def period_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir, F.concat(F.year(_day()), F.lit(" H"), F.when(F.month(_day()) <= 6, 1).otherwise(2)))


@query(_sql("date_trunc('year', o_orderdate)", "make_date(year(o_orderdate), 12, 31)", "year"))
def period_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir, F.year(_day()).cast("string"))


@query(_sql("make_date(year(o_orderdate) - 1, 4, 1)", "make_date(year(o_orderdate), 3, 31)", "fiscal_year"))
def period_fiscal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years by an explicit year end, and by a document's month and day."""
    year = F.year(_day())
    explicit = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("31 March "), year))
    return _periods(spark, sf_dir, F.concat(F.lit("FY"), year), explicit, F.lit("03-31"))


@query(_sql("make_date(year(o_orderdate) - 1, 10, 1)", "make_date(year(o_orderdate) - 1, 12, 31)", "quarter"))
def period_fiscal_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir, F.concat(F.lit("Q3 FY"), F.year(_day())), None, F.lit("03-31"))


@query("SELECT o_orderkey % 4 AS form, CASE o_orderkey % 4 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'fiscal year' WHEN 2 THEN 'invalid date' ELSE 'the period ends' END AS problem, count(*) AS n FROM orders GROUP BY ALL")
def period_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no periods, and why."""
    texts = F.array(*map(F.lit, ("Q5 2024", "FY2024", "30 February 2024", "2024-1999")))
    p = parse_period(F.element_at(texts, (F.col("o_orderkey") % 4 + 1).cast("int")))
    out = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("form"), F.regexp_extract(p["failure"], "^(unsupported|fiscal year|invalid date|the period ends)", 1).alias("problem"))
    return out.groupBy("form", "problem").agg(F.count("*").alias("n"))


@query(_sql("date_trunc('month', o_orderdate)", "last_day(o_orderdate)", "month"))
def period_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first period inside a longer text."""
    p = period_in_text(F.concat(F.lit("sales for "), F.date_format(_day(), "MMMM yyyy"), F.lit(" rose")))
    out = table(spark, sf_dir, "orders").select(p.alias("p"))
    return out.groupBy(F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"), "p.precision").agg(F.count("*").alias("n"))


@query(
    """
WITH v AS (SELECT o_custkey, strftime(o_orderdate, '%m-%d') AS md, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey AS document_id, md AS fiscal_month_day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, md) AS rn FROM v) WHERE rn = 1
"""
)
def fiscal_calendar_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year end that a customer's orders state most often."""
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("For the year ended "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(_day(), "d MMMM yyyy")).otherwise(F.date_format(_day(), "MMMM d, yyyy")), F.lit(". "))
    return document_calendars(orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_number"), text.alias("text")))


@query(
    """
SELECT CASE WHEN date_trunc('month', o_orderdate) = date_trunc('month', l_shipdate) THEN 'matched' ELSE 'mismatched' END AS state,
  date_trunc('month', o_orderdate) <= l_shipdate AND date_trunc('month', l_shipdate) <= last_day(o_orderdate) AS overlap, count(*) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
"""
)
def time_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month of an order against the month of each of its shipments."""
    month = lambda c: F.struct(F.trunc(c, "month").alias("start"), F.last_day(c).alias("end"))
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(month("o_orderdate").alias("a"), month("l_shipdate").alias("b"))
    return both.groupBy(compare_time(F.col("a"), F.col("b")).alias("state"), overlaps(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")).alias("overlap")).agg(F.count("*").alias("n"))


_STEM = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 3 AND w LIKE '%ss' THEN w WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END"
_TOKENS = "list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('the', 'of', 'and')), lambda w: " + _STEM + "))"


@query(
    f"""
WITH p AS (SELECT p_partkey, {_TOKENS.format("p_name")} AS a, {_TOKENS.format("'the ' || p_type || ' rings of ' || p_name")} AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) = 0 THEN 0.0
  ELSE greatest(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 0.75 * len(list_intersect(a, b)) / least(len(a), len(b))) END, 9) AS affinity FROM p
"""
)
def token_affinity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affinity of part names and longer descriptions."""
    text = F.concat(F.lit("the "), "p_type", F.lit(" rings of "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(affinity(F.col("p_name"), text), 9).alias("affinity"))


@query("SELECT p_partkey, replace(p_name, '_', ' ') AS label FROM part")
def label_prettify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", prettify(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"))
