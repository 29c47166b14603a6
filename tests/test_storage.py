"""Projects written and read back."""

from ledgerlark.plans import QUERIES


def test_project_saved_twice_reads_back_the_newest(spark, tmp_path):
    spark.range(7).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["table_name"]: r["rows"] for r in QUERIES["A11_save_project"](spark, str(tmp_path)).collect()}
    assert got == {"orders": 7, "customer": 3}
