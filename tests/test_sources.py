"""Readers, stored tables, texts and streams."""

import math
import os
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import claims as cl
from ledgerlark.sources import databases, files, store
from ledgerlark.sources.buckets import Buckets, newest
from ledgerlark.streaming import streams


def write(path, data):
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


def test_delimiters(spark, tmp_path):
    for i, d in enumerate([",", ";", "\t", "|"]):
        path = write(tmp_path / f"{i}.csv", "\n".join(d.join(["a", "b", "c"]) for _ in range(5)))
        assert files.sniff_delimiter(spark, path) == d
    assert files.sniff_delimiter(spark, write(tmp_path / "plain.csv", "a\nb\n")) == ","


def test_encodings_are_told_apart(spark, tmp_path):
    write(tmp_path / "utf.csv", b"\xef\xbb\xbf" + "city;n\nالقاهرة;1\n".encode())
    write(tmp_path / "old.csv", "city;n\nالقاهرة;2\n".encode("cp1256"))
    got = files.read_delimited(spark, str(tmp_path))
    assert sorted((r["city"], r["n"]) for r in got.collect()) == [("القاهرة", "1"), ("القاهرة", "2")]
    assert set(files.encodings(spark, str(tmp_path))) == {"UTF-8", "windows-1256"}


def test_source_file_column(spark, tmp_path):
    write(tmp_path / "one.csv", "a\n1\n")
    df = spark.read.option("header", True).csv(str(tmp_path))
    assert files.with_source_file(df).first()["_source_file"] == "one.csv"


def test_json_envelopes_and_nesting(spark, tmp_path):
    doc = write(tmp_path / "d.json", '{"meta": 1,\n "records": [{"id": 1, "who": {"name": "a", "at": {"city": "x"}}, "tags": [1, 2]}, {"id": 2}]}')
    got = files.read_json(spark, doc)
    assert set(got.columns) == {"id", "tags", "who.at.city", "who.name"} and got.count() == 2
    lines = write(tmp_path / "l.json", '{"id": 1}\n{"id": 2}\n')
    assert files.read_json(spark, lines).count() == 2
    assert files.read_json(spark, write(tmp_path / "a.json", '[{"id": 1},\n {"id": 2}]')).count() == 2


def test_only_a_select_passes():
    assert databases.checked_select(" SELECT 1; ") == "SELECT 1"
    assert databases.checked_select("-- note\nwith x as (select 1) select 'drop' from x").startswith("with")
    for bad in ("drop table x", "select 1; delete from x", "with x as (select 1) delete from x", "update x set a = 1"):
        with pytest.raises(ValueError):
            databases.checked_select(bad)
    options = databases.table_options("jdbc:x", "t", partition_column="id", bounds=(0, 9), partitions=4)
    assert options["numPartitions"] == "4" and options["lowerBound"] == "0"


def test_a_half_written_project_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "p")
    a = spark.range(3).toDF("id")
    run = store.save_project(root, {"t": a}, saved_at=datetime(2024, 1, 1))
    spark.range(9).write.parquet(f"{root}/runs/unfinished/t")
    assert store.published_run(spark, root) == run and store.load_project(spark, root)["t"].count() == 3
    with pytest.raises(ValueError):
        store.save_project(root, {"t": a}, gate_passed=False, saved_at=datetime(2024, 1, 2))
    assert store.add_new_columns(a, a.withColumn("x", F.lit(1))).where("x is null").count() == 3


def test_snapshots_and_relationships(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "k string, snapshot_date string")
    store.replace_snapshot(path, rows)
    store.replace_snapshot(path, rows.where("k = 'b'").withColumn("k", F.lit("c")))
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == ["a", "c"]


# --- number claims ------------------------------------------------------------------

TEXTS = {
    "a": "Revenue was $1,299.50 in 2024. Top 5 products sold 1234 units over 30 days; margin 23.4% and 2.5M orders.",
    "b": "1. First point\n2) 77 things\nsee section 3 and 12 recommendations. Average order value 41.2, 41.2 again.",
    "c": "no numbers here", "d": "-7.5 and €3K, 1,2,3 and 99%",
}


def brute(text):
    """The rules read out in plain Python."""
    out = {}
    for m in re.finditer(r"([$€£])?\s*(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)\s*([KkMmBb])?\s*(%)?", text):
        value = float(m.group(2).replace(",", "")) * {"k": 1e3, "m": 1e6, "b": 1e9}.get((m.group(3) or "").lower(), 1)
        kind = "currency" if m.group(1) else "percent" if m.group(4) else "number"
        line = text[text.rfind("\n", 0, m.start(2)) + 1:m.start(2)]
        after = text[m.end():m.end() + 24]
        if kind == "number" and (
            (value == int(value) and 1900 <= value <= 2100) or re.search(cl.BEFORE_STRUCTURE, line[-24:]) or re.match(cl.AFTER_TIME_UNIT, after)
            or re.match(cl.AFTER_ENUMERATION, after) or (value == int(value) and 0 <= value <= 99 and not line.strip() and re.match(cl.AFTER_ORDINAL, after))
        ):
            continue
        out.setdefault((kind, round(value, 4)), 0)
        out[kind, round(value, 4)] += 1
    return out


def test_claims_against_brute_force(spark):
    long = " ".join(f"word{i} {i * 7} items at {i}.5% for ${i},000" for i in range(400))
    texts = {**TEXTS, "long": long}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got: dict = {}
    for r in cl.extract_claims(docs, "doc_id", "text").collect():
        got.setdefault(r["doc"], {})[r["kind"], r["value"]] = r["times"]
    assert got == {d: brute(t) for d, t in texts.items() if brute(t)}


def sig(v, n):
    return 0.0 if v == 0 else round(v, -int(math.floor(math.log10(abs(v)))) + n - 1)


def test_matching_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    known = [round(rng.choice([-1, 1]) * 10 ** rng.uniform(-2, 6), 2) for _ in range(300)] + [0.0, 12345.0, 0.234]
    wanted = sorted({round(k * rng.uniform(0.96, 1.04), 2) for k in known} | {12300.0, 12000.0, 10000.0, 0.0, 0.3, -0.4})
    fits = lambda c, k: abs(c - k) <= max(0.5, 0.02 * max(abs(c), abs(k))) or abs(c - sig(k, 2)) <= 1e-9 or abs(c - sig(k, 3)) <= 1e-9
    c = spark.createDataFrame([("number", v) for v in wanted] + [("percent", 23.4)], "kind string, value double")
    k = spark.createDataFrame(list(enumerate(known)), "position long, figure double")
    got = {(r["kind"], r["value"]): r["matched_value"] for r in cl.match_figures(c, k).collect()}
    assert {v: got["number", v] for v in wanted} == {v: next((x for x in known if fits(v, x)), None) for v in wanted}
    assert got["percent", 23.4] == next(x for x in known if fits(23.4, x) or fits(23.4, x * 100))


def test_a_number_belongs_to_the_name_before_it(spark):
    docs = spark.createDataFrame([("ok", "The average order value was 41.17 last week."), ("bad", "average order value: 9,000"), ("far", "average order value 41.17 and then 9,000")],
                                 "doc_id string, text string")
    labels = spark.createDataFrame([("average order value", 41.17), ("order value", 9000.0)], "label string, expected double")
    known = spark.createDataFrame([(0, 41.17), (1, 9000.0)], "position long, figure double")
    rows = {(r["doc"], r["value"]): r["basis"] for r in cl.check_texts(docs, "doc_id", "text", known, labels).collect()}
    assert rows["ok", 41.17] in ("semantic", "magnitude") and rows["bad", 9000.0] == "unverified" and rows["far", 9000.0] == "magnitude"
    status = {r["doc"]: r["status"] for r in cl.verdicts(docs, "doc_id", cl.check_texts(docs, "doc_id", "text", known, labels)).collect()}
    assert status["bad"] == "weak" and status["far"] == "clean"


def test_names_with_digits_and_other_scripts(spark):
    texts = ["Brand#1 sales 500", "chiffre d'été: 500", "مبيعات 500", "total gross revenue of the whole group was 500", "presales 500", "sales 40, then 500"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    names = ["Brand#1 sales", "chiffre d'ÉTÉ", "مبيعات", "total gross revenue of the whole group", "sales"]
    labels = spark.createDataFrame([(n, 500.0) for n in names], "label string, expected double")
    numbers = cl.material_numbers(docs, "doc_id", "text").where("value = 500")
    got = {r["doc"]: (r["label"], r["satisfied"]) for r in cl.label_verdicts(numbers, labels).collect()}
    assert got == {i: (n.lower(), True) for i, n in enumerate(names[:4])}


def test_json_forms_mixed_in_a_folder(spark, tmp_path):
    write(tmp_path / "lines.json", '{"id": 1}\n{"id": 2}\n')
    write(tmp_path / "array.json", '[{"id": 3},\n {"id": 4}]')
    write(tmp_path / "doc.json", '{"records": [\n{"id": 5, "a": {"b": 1}}]}')
    assert sorted(r["id"] for r in files.read_json(spark, [str(tmp_path / f"{n}.json") for n in ("lines", "array")]).collect()) == [1, 2, 3, 4]
    assert files.read_json(spark, str(tmp_path / "doc.json")).columns == ["a.b", "id"]


def test_exact_roundings(spark):
    known = spark.createDataFrame([(0, "rev", 640675.46), (1, "loss", -7540.26)], "position long, key string, figure double")
    c = spark.createDataFrame([("number", v) for v in (640675.0, 641000.0, 639000.0, 7540.26)], "kind string, value double")
    got = {r["value"]: (r["figure_key"], r["basis"]) for r in cl.exact_matches(c, known).collect()}
    assert got == {640675.0: ("rev", "rounded"), 641000.0: ("rev", "rounded"), 639000.0: (None, "unverified"), 7540.26: ("loss", "exact")}


def test_citations_signs_and_worth(spark):
    docs = spark.createDataFrame([("d", "Sales fell by {{chg}} to {{rev}}, {{ none }}.\n- **What it's worth:** {{rev}}\n- **What it's worth:** {{scn_x}}")], "doc_id string, text string")
    shown = spark.createDataFrame([("chg", "-5.00"), ("rev", "10.00")], "key string, display string")
    got = cl.render_citations(docs, "doc_id", "text", shown).first()
    assert got["text"].startswith("Sales fell by -5.00 to 10.00, [figure unavailable: none].") and got["unknown"] == ["none", "scn_x"]
    known = spark.createDataFrame([("chg", -5.0), ("rev", 10.0)], "key string, figure double")
    assert [(r["verb"], r["key"]) for r in cl.wrong_signs(docs, "doc_id", "text", known).collect()] == [("fell by", "chg")]
    assert [r["problem"] for r in cl.uncited_values(docs, "doc_id", "text").collect()] == ["cites a level"]


# --- streams ------------------------------------------------------------------------


def batches(spark, tmp_path, groups):
    source = tmp_path / "in"
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(source))
        import time

        for name in os.listdir(source):  # files are taken in the order of their time
            if name.endswith(".parquet") and os.path.getmtime(source / name) > time.time() - 5:
                os.utime(source / name, (1_700_000_000 + i * 100,) * 2) if os.path.getmtime(source / name) > 1_750_000_000 else None
    schema = spark.read.parquet(str(source)).schema
    return streams.file_stream(spark, str(source), schema, files_per_batch=1)


def event(i, user, day, hour=0, kind="view"):
    return (i, user, kind, 1.0, datetime(2024, 1, day, hour))


def test_cooldown_does_not_depend_on_batches(spark, tmp_path):
    groups = [[event(1, 1, 1), event(2, 1, 1, 5)], [event(3, 1, 1, 9), event(4, 2, 9)], [event(8, 4, 10)], [event(5, 1, 10)], [event(7, 3, 20), event(9, 3, 21)]]
    for name, split in (("many", groups), ("one", [[e for g in groups for e in g]])):
        folder = tmp_path / name
        folder.mkdir()
        out = str(folder / "out")
        streams.deliver_alerts(streams.alerts_of(batches(spark, folder, split)), out)
        assert sorted(r["event_id"] for r in spark.read.parquet(f"{out}/alerts").collect()) == [1, 4, 5, 7, 8, 9]


def folded(rows, cooldown):
    """Alerts delivered when all are judged in time order."""
    last, out = {}, []
    for i, user, kind, _, at in sorted(rows, key=lambda e: (e[4], e[0])):
        if (user, kind) not in last or at - last[user, kind] >= cooldown:
            last[user, kind] = at
            out.append(i)
    return sorted(out)


def test_cooldown_of_files_out_of_order(spark, tmp_path):
    """One file, ten files, and files shuffled within the delay give the same alerts; what lies a cooldown behind is counted."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(6), "view", 1.0, datetime(2024, 1, 1) + timedelta(hours=2 * i)) for i in range(120)]
    end = [(999, 99, "view", 1.0, datetime(2024, 3, 1))]  # lets everything before it be judged
    ten = [rows[k:k + 12] for k in range(0, 120, 12)]
    mixed = [ten[k] for k in (1, 0, 2, 4, 3, 6, 5, 8, 7, 9)]
    want = folded(rows, timedelta(days=1))
    for name, split in (("one", [rows]), ("ten", ten), ("mixed", mixed)):
        folder = tmp_path / name
        folder.mkdir()
        out = str(folder / "out")
        streams.deliver_alerts(streams.alerts_of(batches(spark, folder, [*split, end])), out, delay_seconds=3 * 86_400)
        got = sorted(r["event_id"] for r in spark.read.parquet(f"{out}/alerts").collect())
        assert [i for i in got if i != 999] == want and streams.late_alerts(spark, out) == 0, name
    streams.deliver_alerts(streams.alerts_of(batches(spark, tmp_path, [rows[60:], rows[:12]])), str(tmp_path / "late"))
    assert streams.late_alerts(spark, str(tmp_path / "late")) == 12
    state = Buckets(spark, str(tmp_path / "late/last"), ["fingerprint"]).read()
    last = max(r[4] for r in rows)
    assert state.where(F.col("__last") <= int((last - timedelta(days=2)).replace(tzinfo=timezone.utc).timestamp() * 1e6)).count() <= 6


def test_buckets_read_what_a_batch_touches(spark, tmp_path):
    """Ten batches of other keys: what a batch reads follows its keys, not the history; a replay changes nothing."""
    table = Buckets(spark, str(tmp_path / "t"), ["k"], buckets=16)
    add = lambda both: both.groupBy("k").agg(F.sum("n").alias("n"))
    want, read = {}, []
    for batch in range(10):
        keys = [1, 2, 3] if batch else list(range(500))
        rows = spark.createDataFrame([(k, 1) for k in keys], "k long, n long")
        before = table.published(batch)
        read.append(sum(os.path.getsize(os.path.join(d, f)) for d in table.paths({b: g for b, g in (before[1] if before else {}).items() if b in table.touched(rows)}) for f in os.listdir(d)))
        for _ in range(2 if batch in (4, 9) else 1):
            table.upsert(rows, batch, add, facts={"batch": str(batch)})
        for k in keys:
            want[k] = want.get(k, 0) + 1
        assert {r["k"]: r["n"] for r in table.read().collect()} == want
    assert 0 < max(read[1:]) <= 1.2 * min(read[1:]) and table.published()[2] == {"batch": "9"}
    assert len(os.listdir(tmp_path / "t/manifest")) == 2 and len(os.listdir(tmp_path / "t/data")) <= 3
    whole = sum(os.path.getsize(os.path.join(d, f)) for d in table.paths(table.published()[1]) for f in os.listdir(d))
    assert max(read[1:]) < 0.4 * whole
    table.upsert(rows.limit(0), 10, add)
    assert table.read().count() == 500
    table.upsert(rows, 11, lambda both: both.where("k = 1"))  # a merge may empty buckets
    assert Buckets(spark, str(tmp_path / "none"), ["k"]).read() is None


def test_half_written_batch_is_not_seen(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), ["k"], buckets=4)
    rows = spark.createDataFrame([(i, 1) for i in range(20)], "k long, n long")
    table.upsert(rows, 0, newest(["k"]))

    def broken(both):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        table.upsert(rows.withColumn("n", F.lit(2).cast("long")), 1, broken)
    rows.withColumn("n", F.lit(3).cast("long")).withColumn("__bucket", F.lit(0)).write.partitionBy("__bucket").parquet(str(tmp_path / "t/data/gen=1"))
    assert {r["n"] for r in table.read().collect()} == {1}
    table.upsert(rows.withColumn("n", F.lit(2).cast("long")).where("k < 5"), 1, newest(["k"]))
    assert {r["k"]: r["n"] for r in table.read().collect()} == {i: 2 if i < 5 else 1 for i in range(20)}


def test_windows_drop_and_count_late_rows(spark, tmp_path):
    groups = [[event(1, 1, 1), event(2, 1, 2)], [event(3, 1, 12)], [event(6, 1, 12, 1)], [event(4, 1, 1)], [event(5, 1, 20)]]
    out = str(tmp_path / "out")
    query = streams.run(streams.metric_windows(batches(spark, tmp_path, groups)).writeStream.outputMode("append").format("parquet").option("path", f"{out}/w"), out)
    assert {str(r["start"])[:10]: r["n"] for r in spark.read.parquet(f"{out}/w").collect()} == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-12": 2}
    assert streams.late_rows(query) == 1


def test_counters_and_distinct_orders_over_batches(spark, tmp_path):
    groups = [[event(1, 1, 1), event(2, 2, 1)], [event(3, 1, 3, kind="buy")], [event(4, 1, 2)]]
    stream = batches(spark, tmp_path, groups)
    streams.keep_counters(streams.customer_counters(stream), str(tmp_path / "c"))
    assert {r["customer"]: (r["last"].day, r["events"]) for r in streams.current_counters(spark, str(tmp_path / "c")).collect()} == {1: (3, 3), 2: (1, 1)}
    streams.keep_distinct_orders(stream, str(tmp_path / "d"), key="user_id", order="event_type")
    assert {r["customer"]: r["orders"] for r in streams.distinct_orders(spark, str(tmp_path / "d")).collect()} == {1: 2, 2: 1}


def test_appending_and_freshness(spark, tmp_path):
    stream = batches(spark, tmp_path, [[event(1, 1, 1)], [event(2, 1, 5)]])
    streams.append_files(stream, str(tmp_path / "f"))
    got = streams.appended(spark, str(tmp_path / "f"))
    assert got.count() == 2 and got.select("_source_file").distinct().count() == 2
    streams.watch_freshness(stream, str(tmp_path / "w"), lambda batch: datetime(2024, 1, 9))
    assert sorted(r["severity"] for r in spark.read.parquet(str(tmp_path / "w/checks")).collect()) == ["critical", "high"]
