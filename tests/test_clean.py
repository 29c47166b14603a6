"""Cleaning operators, the plan run and the invariants."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as tx
from ledgerlark.operators import clean, detect, invariants
from ledgerlark.operators.clean import OperatorSpec, Step


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expr("v").alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("raw, value", [
    ("$1,299.00", 1299.0), ("(1,234)", -1234.0), ("45%", 0.45), ("1e3", 1000.0), ("−7", -7.0), ("12,5", 12.5), ("EGP 10", 10.0),
    ("A1", None), ("2024-01-05", None), ("12.5.6", None), ("N/A", None), ("", None), ("-", None),
])
def test_money_text(spark, raw, value):
    assert one(spark, [raw], tx.parse_number) == [value]


def test_european_numbers(spark):
    df = spark.createDataFrame([("1.299,00",), ("2.000,50",), ("7",)], "v string")
    assert df.agg(tx.decimal_separator("v")).first()[0] == ","
    assert one(spark, ["1.299,00"], lambda c: tx.parse_number(c, ",")) == [1299.0]


@pytest.mark.parametrize("values, expected", [
    (["25/01/2024", "01/02/2024"], True), (["01/25/2024"], False), (["01/02/2024"], None), (["25/01/2024", "01/25/2024"], None), (["2024-01-25"], False)])
def test_day_first(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert df.agg(tx.day_first("v")).first()[0] is expected


def test_dates_and_year_first_stays(spark):
    got = one(spark, ["2024-01-05", "05/01/2024", "5 Jan 2024", "nonsense", "31.12.2023", "05/01/24"], lambda c: tx.parse_timestamp(c, True).cast("date").cast("string"))
    assert got == ["2024-01-05", "2024-01-05", "2024-01-05", None, "2023-12-31", "2024-01-05"]


def test_serials_and_epochs(spark):
    df = spark.createDataFrame([(45296.0, 1704412800.0, 1704412800000.0)], "a double, b double, c double")
    out = clean.parse_datetime(df, ["a", "b", "c"], {}).select(*[F.col(c).cast("date").cast("string") for c in "abc"]).first()
    assert list(out) == ["2024-01-05"] * 3


def test_arabic(spark):
    assert one(spark, ["مُحَمَّد  كتـــاب ٢٠٢٤٫٥", "أحمد إلى"], tx.normalize_arabic) == ["محمد كتاب 2024.5", "احمد الي"]
    assert one(spark, ["في", "كتاب في البيت"], tx.remove_stop_words) == ["في", "كتاب البيت"]
    assert one(spark, ["غير معروف", "خطأ", "UNKNOWN ", None, "Cairo"], tx.is_placeholder) == [True, True, True, False, False]


def test_category_key_and_title(spark):
    assert one(spark, ["Cairo", " cairo ", "CAIRO!", "Giza"], tx.category_key) == ["cairo"] * 3 + ["giza"]
    assert one(spark, ["o'neil SMITH"], lambda c: clean.title_case(F.col(c))) == ["O'Neil Smith"]


def frame(spark):
    rows = [(0, "Cairo", "10", 5.0), (1, "cairo ", "20", None), (2, "Cairo", "N/A", 7.0), (3, "Giza", "30", 9.0), (4, "Giza", "30", 9.0)]
    return spark.createDataFrame(rows, "_rid long, city string, amount string, score double")


def test_plan_is_ordered_measured_and_skips(spark):
    steps = [Step("impute", ("score",), {"strategy": "median"}), Step("drop_duplicate_rows"), Step("parse_numeric", ("amount",)),
             Step("standardize_null_placeholders", ("amount",)), Step("harmonize_case", ("city",), {"style": "upper"}), Step("parse_numeric", ("nope",)),
             Step("impute", ("score",), {"strategy": "guess"})]
    out, ledger = clean.apply_plan(frame(spark), steps, protected={"city"})
    rows = {(r["op"], r["position"]): r for r in ledger.collect()}
    by = {r["op"]: r for r in rows.values() if r["applied"]}
    assert by["standardize_null_placeholders"]["nulls_introduced"] == 1
    assert by["drop_duplicate_rows"]["rows_removed"] == 1 and by["drop_duplicate_rows"]["rows_before"] == 5
    assert by["impute"]["nulls_filled"] == 1 and by["impute"]["rows_before"] == 4
    assert by["parse_numeric"]["cells_changed"] == 0 and by["parse_numeric"]["dtype_changes"] == {"amount": "double"}
    assert "harmonize_case" not in by and sum(not r["applied"] for r in rows.values()) == 3
    assert sorted(r["_rid"] for r in out.collect()) == [0, 1, 2, 3]


def test_own_operator_is_measured(spark):
    def double(df, columns, params):
        return df.withColumns({c: F.col(c) * 2 for c in columns})

    clean.register(OperatorSpec("double_it", order=55), double)
    try:
        out, ledger = clean.apply_plan(frame(spark), [Step("double_it", ("score",))])
        assert ledger.first()["cells_changed"] == 4
        assert invariants.check_invariants(frame(spark), out, [Step("double_it", ("score",))]).count() == 0
    finally:
        del clean.OPERATORS["double_it"]


def test_majority_missing_is_not_imputed(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, 1.0)], "_rid long, v double")
    assert clean.impute(df, ["v"], {"strategy": "mean"}).where("v is null").count() == 2


def test_harmonize_to_commonest(spark):
    out = clean.harmonize_categories(frame(spark), ["city"], {})
    assert {r["city"] for r in out.collect()} == {"Cairo", "Giza"} and out.count() == 5


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "a")], "_rid long, k string")
    assert sorted(r["_rid"] for r in clean.keep_one(df, ["k"]).collect()) == [0, 2]
    assert sorted(r["_rid"] for r in clean.keep_one(df, ["k"], "last").collect()) == [1, 2]
    flagged = clean.flag_duplicate_keys(df, ["k"], {})
    assert {r["_rid"]: r["k__is_duplicate_key"] for r in flagged.collect()} == {0: True, 1: True, 2: False}


@pytest.mark.parametrize("tamper, rule", [
    (lambda d: d.withColumn("score", F.col("score") * 100), "unauthorized_value_change"),
    (lambda d: d.withColumn("score", F.coalesce("score", F.lit(1.0))), "unauthorized_null_fill"),
    (lambda d: d.withColumn("city", F.lit(None).cast("string")), "unauthorized_null_introduction"),
    (lambda d: d.where("_rid <> 3"), "unauthorized_row_removal"),
    (lambda d: d.drop("city"), "unauthorized_column_drop"),
    (lambda d: d.withColumn("extra", F.lit(1)), "unauthorized_column_add"),
    (lambda d: d.withColumn("score", F.col("score").cast("string")), "unauthorized_dtype_change"),
    (lambda d: d.unionByName(d.withColumn("_rid", F.col("_rid") + 100)), "rows_invented"),
])
def test_tampering_is_rejected(spark, tamper, rule):
    steps = [Step("trim_whitespace", ("amount",))]
    found = {r["rule"] for r in invariants.check_invariants(frame(spark), tamper(frame(spark)), steps).collect()}
    assert rule in found


def test_removing_a_row_that_is_no_copy(spark):
    found = invariants.check_invariants(frame(spark), frame(spark).where("_rid <> 0"), [Step("drop_duplicate_rows")]).collect()
    assert [r["rule"] for r in found] == ["rows_removed_that_were_not_duplicates"]
    assert invariants.check_invariants(frame(spark), frame(spark).where("_rid <> 4"), [Step("drop_duplicate_rows", ("city", "amount"))]).count() == 0


def test_join_key_may_not_be_rewritten(spark):
    changed = frame(spark).withColumn("city", F.upper("city"))
    found = {r["rule"] for r in invariants.check_invariants(frame(spark), changed, [Step("harmonize_case", ("city",))], keys={"city"}).collect()}
    assert found == {"join_key_modified"}


def test_clean_table_has_no_plan(spark):
    df = spark.createDataFrame([(i, f"name {i}", float(i)) for i in range(20)], "_rid long, title string, size double")
    found = detect.detect_defects(df)
    assert detect.verdict(found).first()["is_clean"] and detect.plan_steps(found) == []


def test_line_items_are_not_duplicates(spark):
    rows = [(i, f"o{i // 2}" if i < 8 else f"o{i}", f"c{i // 2}" if i < 8 else f"c{i}", f"p{i}", float(i), float(i * 2)) for i in range(14)]
    df = spark.createDataFrame(rows, "_rid long, order_id string, customer string, product string, qty double, price double")
    kinds = {r["column_name"]: r["kind"] for r in detect.duplicate_keys(df).collect()}
    assert kinds == {"order_id": "line_item_grain"}


def test_end_to_end_plan(spark):
    rows = [(i, ["Cairo", "cairo", "Giza"][i % 3], f"${i * 10}.00" if i % 9 else "N/A") for i in range(60)]
    df = spark.createDataFrame(rows, "_rid long, city string, amount string")
    steps = detect.plan_steps(detect.detect_defects(df))
    out, ledger = clean.apply_plan(df, steps)
    assert invariants.check_invariants(df, out, steps).count() == 0
    assert dict(out.dtypes)["amount"] == "double" and {r["city"] for r in out.collect()} == {"Cairo", "Giza"}


def test_registered_detector_runs_with_the_others(spark):
    """A detector of one's own is asked about every column and shares the one aggregate."""
    def shouting(p):
        return detect.finding("shouting", p, F.count_if(p.value == F.upper(p.value)), severity="low") if p.kind == "string" else None

    detect.register("shouting", shouting)
    try:
        df = spark.createDataFrame([("ABC", 1.0), ("abc", 2.0), ("XYZ", 3.0)], "word string, v double")
        found = {(r["kind"], r["column_name"], r["n"]) for r in detect.run_detectors(df).collect()}
    finally:
        del detect.DETECTORS["shouting"]
    assert ("shouting", "word", 2) in found and not any(k == "shouting" and c == "v" for k, c, _ in found)
