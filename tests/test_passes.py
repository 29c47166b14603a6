"""How often rows are made: what several passes read is stored once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as tx
from ledgerlark.operators import decision, detect
from ledgerlark.plans import cleaning
from ledgerlark.roles import Roles

SF = "/root/testdata/sf0.001"


def counting(spark, kind):
    """A function that gives its value back and counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(v):
        calls.add(1)
        return v

    return calls, F.udf(same, kind)


def test_repeat_economics_reads_its_rows_once(spark):
    calls, same = counting(spark, "double")
    rows = spark.range(300).select(F.col("id").alias("o"), (F.col("id") % 40).alias("c"), F.lit("2024-01-01").cast("timestamp_ntz").alias("t"), same(F.col("id") * 1.5).alias("r"), F.lit(1.0).alias("q"))
    got = decision.repeat_economics(rows, Roles(time="t", revenue="r", order="o", customer="c", quantity="q")).first()
    assert calls.value == 300
    assert (got["customers"], got["repeat_customers"], got["median_order_value"]) == (40, 40, pytest.approx(224.25))


def test_a_table_is_made_once_to_be_cleaned(spark, monkeypatch):
    calls, same = counting(spark, "string")
    real = cleaning.dirty
    monkeypatch.setattr(cleaning, "dirty", lambda *a: real(*a).withColumn("price", same("price")))
    rows = {r["table_name"]: r["rows"] for r in cleaning.clean_every_table(spark, SF).collect()}
    assert calls.value == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert rows["orders"] > 0 and rows["customers"] > 0


def test_dates_by_their_shape(spark):
    want = {"2024-01-05": "2024-01-05 00:00:00", "2024/1/5 7:08": "2024-01-05 07:08:00", "2024-01-05T07:08:09": "2024-01-05 07:08:09", "5.12.2024": "2024-05-12 00:00:00",
            "25/12/24": "2024-12-25 00:00:00", " 5 Jan 2024 ": "2024-01-05 00:00:00", "Jan 5, 2024": "2024-01-05 00:00:00", "5 January 2024": "2024-01-05 00:00:00",
            "May 5, 2024": "2024-05-05 00:00:00", "1,234.50": None, "A-12": None, "12345-1-1": None, "Total 5": None, "": None, None: None, "24-": None}
    rows = spark.createDataFrame([(k,) for k in want], "v string").select("v", tx.parse_timestamp("v").cast("string").alias("d")).collect()
    assert {r["v"]: r["d"] for r in rows} == want


@pytest.mark.parametrize("values, found", [
    (["yes", "No ", "YES", "no", None], True), (["yes", "no", "true", "false"], True), (["yes", "no", "true", "false", "t"], False),
    (["yes", "no", "maybe"], False), (["1", "0"], False), ([None], False), (["نعم", "لا"], True)])
def test_flags_with_few_words(spark, values, found):
    df = spark.createDataFrame([(v,) for v in values], "answer string")
    kinds = Counter(r["kind"] for r in detect.run_detectors(df, ["boolean_stored_as_text"]).collect())
    assert kinds == ({"boolean_stored_as_text": 1} if found else {})
