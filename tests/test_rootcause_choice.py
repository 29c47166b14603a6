"""The choice of slices as one fold against picking and filtering step by step, and drill paths that count their own steps only."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import rootcause as rc

SCHEMA = "slice string, conditions array<struct<dimension:string,value:string>>, concentration double, score double, robust boolean"


def candidates(seed, n):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        conditions = sorted((d, rng.choice("xyz")) for d in rng.sample("abcd", rng.randint(1, 3)))
        name = " & ".join(f"{d}={v}" for d, v in conditions)
        out[name] = (name, conditions, rng.choice([1.0, 2.0, 2.4, 2.6, 4.0]), rng.choice([0.1, 0.5, 0.9, None]), rng.choice([True, False, None]))
    return list(out.values())


def step_by_step(pool, k):
    chosen = []
    while pool and len(chosen) < k:
        best = min(pool, key=lambda r: (0 if r[4] else 1, r[3] is None, -(r[3] or 0), r[0]))
        chosen.append(best[0])
        mine = set(best[1])
        pool = [r for r in pool if not (set(r[1]) <= mine or (mine < set(r[1]) and r[2] <= best[2] * rc.REFINEMENT_GAIN))]
    return chosen


@pytest.mark.parametrize("seed", range(5))
def test_fold_equals_picking(spark, seed):
    rows = candidates(seed, 60)
    got = rc.select_top(spark.createDataFrame(rows, SCHEMA).repartition(4), k=5)
    assert [r["slice"] for r in got.orderBy("rank").collect()] == step_by_step(rows, 5)
    assert got.columns == [*SCHEMA.replace(" array<struct<dimension:string,value:string>>", "").replace(" string", "").replace(" double", "").replace(" boolean", "").split(", "), "rank"]


def test_nothing_to_choose(spark):
    assert rc.select_top(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("key", ["revenue", "customers"])
def test_drill_path_counts_what_the_slices_count(spark, key):
    from datetime import date, datetime, timedelta

    from ledgerlark.roles import Roles

    rng = random.Random(2)
    rows = [(f"o{i}", f"c{rng.randrange(80)}", datetime(2024, 4 + i % 2, 1) + timedelta(days=rng.randrange(28)), rng.choice("xy"), rng.choice("pq"), rng.choice("mn"), rng.uniform(1, 9)) for i in range(800)]
    roles = Roles(time="ts", revenue="money", order="o", customer="c")
    df = spark.createDataFrame(rows, "o string, c string, ts timestamp_ntz, a string, b string, d string, money double")
    current, prior = rc.Period("m", "current", date(2024, 5, 1), date(2024, 5, 31)), rc.Period("m", "prior", date(2024, 4, 1), date(2024, 4, 30))
    work, m = rc.measure(rc.in_window(df, roles, current, prior), roles, key)
    dims = ["a", "b", "d"]
    cell = rc.materialise(rc.cells(work, m, dims))
    whole = rc.totals(cell, m)
    every = {r["slice"]: r for n in (1, 2, 3) for r in rc.explain(rc._sliced(cell, m, dims, n).withColumn("depth", F.lit(n)).withColumn("bound", F.lit(0.0)), whole, additive=m.additive).collect()}
    chosen = spark.createDataFrame([(1, [("a", "x"), ("b", "q"), ("d", "m")]), (2, [("a", "x")])], "rank int, conditions array<struct<dimension:string,value:string>>")
    got = {(r["rank"], r["step"]): r for r in rc.drill_path(chosen, cell, m, dims, whole).collect()}
    assert {k: r["slice"] for k, r in got.items()} == {(1, 1): "a=x", (1, 2): "a=x & b=q", (1, 3): "a=x & b=q & d=m", (2, 1): "a=x"}
    assert all(r["delta"] == pytest.approx(every[r["slice"]]["delta"], abs=0.006) for r in got.values())
    assert rc.drill_path(chosen.limit(0), cell, m, dims, whole).collect() == []


def exhaustive(cell, m, dims, whole, **limits):
    """Every combination of every depth counted by grouping sets, then the same tests."""
    floor, out, parents = abs(whole["v1"] - whole["v0"]) * limits["prune_floor"], [], None
    for depth in (1, 2, 3):
        level = rc._sliced(cell, m, dims, depth).withColumn("bound", rc._bound(m)).withColumn("depth", F.lit(depth))
        level = level.where((F.col("rows0") + F.col("rows1") >= limits["min_rows"]) & (F.col("bound") >= floor))
        parents = rc.materialise(level if parents is None else rc._not_redundant(level, parents))
        out += parents.select(rc.slice_label().alias("s"), "v0", "v1", "rows0", "rows1").collect()
    return {r["s"]: tuple(r)[1:] for r in out}


@pytest.mark.parametrize("key", ["money", "keys"])
def test_levels_by_candidates_equal_grouping_sets(spark, key):
    rng = random.Random(7)
    dims = [f"d{i}" for i in range(7)]
    rows = [(*[rng.choice("abc"[:1 + i % 3] + "x" * 4) for i in range(7)], rng.randrange(2), float(rng.randint(-3, 9)), f"k{rng.randrange(90)}") for _ in range(900)]
    df = spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", _p int, money double, k string")
    m = rc.Measure("money", "currency", value=F.col("money")) if key == "money" else rc.Measure("keys", "count", distinct=F.col("k"))
    cell = rc.materialise(rc.cells(df, m, dims))
    whole = rc.totals(cell, m)
    limits = {"min_rows": 30, "prune_floor": 0.5 if key == "money" else 0.2}
    got = {r["s"]: tuple(r)[1:] for r in rc.slices(cell, m, dims, whole, **limits).select(rc.slice_label().alias("s"), "v0", "v1", "rows0", "rows1").collect()}
    want = exhaustive(cell, m, dims, whole, **limits)
    assert got == want and sum(s.count("&") == 2 for s in got) > 5


def test_twenty_dimensions_copy_a_cell_for_its_sound_pairs_only(spark):
    """With few sound pairs the third level reads few copies of the cells, not one for each of 1,140 combinations."""
    rng = random.Random(3)
    dims = [f"d{i}" for i in range(20)]
    rows = [(*[rng.choice("ab") if i < 3 else str(rng.randrange(40)) for i in range(20)], rng.randrange(2), 1.0) for _ in range(600)]
    df = spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", _p int, money double")
    m = rc.Measure("money", "currency", value=F.col("money"))
    cell = rc.materialise(rc.cells(df, m, dims))
    folded = rc._fold(cell, m, dims, rc._sliced(cell, m, dims, 1).where("rows0 + rows1 >= 60"))
    pairs = rc._sliced(folded, m, dims, 2).where("rows0 + rows1 >= 60").where(~F.exists("conditions", lambda c: c["value"] == rc._OTHER))
    found = rc._candidates(pairs, pairs, dims)
    assert pairs.count() == 12 and found.count() == 8
    counted = rc._extended(folded, m, dims, pairs, found)
    assert counted.agg(F.sum("rows0") + F.sum("rows1")).first()[0] == 600 and counted.count() == 8
