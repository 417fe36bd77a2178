"""Samples and logs land as JSON."""

import datetime

from factengine.plans.derived import customer_documents, customer_pages, order_edges, order_facts, table
from factengine.plans.read import write_samples
from factengine.sources.store import append_log


def test_samples_and_log(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    facts = order_facts(orders).selectExpr("*", "subject AS quote", "array('p1l1') AS line_ids", "CAST(NULL AS DATE) AS period_start", "CAST(NULL AS DATE) AS period_end", "CAST(NULL AS STRING) AS period_precision")
    write_samples(customer_documents(customer), facts, order_edges(orders), customer_pages(customer), "v2", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/export")).count() <= 1
    assert spark.read.json(str(tmp_path / "out/cases")).count() == 4
    assert spark.read.json(str(tmp_path / "out/pages")).count() > 0
    append_log(spark.createDataFrame([(datetime.datetime(2024, 1, 2), "x")], "at timestamp, event string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
