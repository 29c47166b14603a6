"""Root cause of a change: which slices of the business carry it.

Rows of both periods are summed once to the finest combination of the
dimensions; every slice of one to three conditions is then a grouping set over
those cells.  Support and the magnitude bound only shrink with added
conditions, so values that fail alone are folded together before the next
level and no slice that could still qualify is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlark.functions.numbers import rnd, rounded
from ledgerlark.functions.scale import materialise, union_all
from ledgerlark.operators.decision import Period, comparison_periods, last_complete_month, with_line_profit
from ledgerlark.operators.kpi import number
from ledgerlark.operators.quality import type_label
from ledgerlark.roles import Roles

MIN_ROWS, PRUNE_FLOOR, MIN_POWER, MIN_SIGNAL, TOP_K, MAX_DEPTH = 12, 0.04, 0.08, 2.0, 6, 3
REDUNDANT_SHARE, REFINEMENT_GAIN, ALPHA, MIN_PERIOD_ROWS = 0.98, 1.25, 0.05, 20
_OTHER = "\u0000other"


# --- dimensions, measures, windows --------------------------------------------


def dimensions(df: DataFrame, roles: Roles, *, max_values: int = 300, max_codes: int = 50, max_ratio: float = 0.5) -> DataFrame:
    """Which columns can be sliced, and why the others cannot.

    Distinct values are estimated for all columns in one pass; only columns near
    a limit are counted exactly.
    """
    fields = [f for f in df.schema.fields if not f.name.startswith("_")]
    kinds = {f.name: type_label(f.dataType) for f in fields}
    sliceable = [c for c in kinds if kinds[c] in ("string", "integer", "boolean")]
    rough = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in sliceable]).first().asDict()
    rows = rough["__rows"]
    limits = (2, max_codes, max_values, rows * max_ratio)
    near = [c for c in sliceable if rough[c] <= max_values * 1.2 or any(0.8 * m <= rough[c] <= 1.2 * m for m in limits)]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first().asDict() if near else {}
    out = []
    for c, kind in kinds.items():
        n = exact.get(c, rough.get(c))
        if c in (roles.time, roles.order, roles.quantity):
            reason = "date, quantity or order key"
        elif kind == "float" or c == roles.revenue:
            reason = "continuous measurement"
        elif kind == "datetime":
            reason = "timestamp"
        elif n < 2:
            reason = "fewer than two values"
        elif kind == "integer" and n > max_codes:
            reason = "numeric with too many values"
        elif n > max_values:
            reason = "too many values"
        elif rows and n / rows > max_ratio:
            reason = "nearly unique"
        else:
            reason = None
        shown = n if kind in ("string", "integer", "boolean") and n <= max_values else None
        out.append((c, reason is None, "numeric_code" if kind == "integer" and reason is None else "categorical" if reason is None else None, shown, reason))
    return df.sparkSession.createDataFrame(out, "column_name string, usable boolean, kind string, n_values long, reason string")


def slicing_key(df: DataFrame, c: str) -> Column:
    """Value as text: whole codes without decimals, missing named."""
    kind = type_label(df.schema[c].dataType)
    v = F.col(c).cast("long").cast("string") if kind in ("integer", "float") else F.col(c).cast("string")
    return F.coalesce(v, F.lit("(missing)"))


def weekday(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "EEEE"), F.lit("(unknown)"))


@dataclass(frozen=True)
class Measure:
    """A measure is a summed value or a counted distinct key."""

    key: str
    unit: str
    value: Column | None = None
    distinct: Column | None = None

    @property
    def additive(self) -> bool:
        return self.value is not None


def measure(df: DataFrame, roles: Roles, key: str) -> tuple[DataFrame, Measure]:
    """The measure over *df* (gross profit adds its proven profit column)."""
    if key == "revenue" and roles.revenue:
        return df, Measure(key, "currency", value=number(roles.revenue))
    if key == "units" and roles.quantity:
        return df, Measure(key, "count", value=number(roles.quantity))
    if key == "gross_profit" and roles.revenue:
        out, basis = with_line_profit(df, roles)
        if basis != "not proven":
            return out, Measure(key, "currency", value=F.coalesce("line_profit", F.lit(0.0)))
    if key == "orders" and roles.order:
        return df, Measure(key, "count", distinct=F.col(roles.order).cast("string"))
    if key == "customers" and roles.customer:
        return df, Measure(key, "count", distinct=F.col(roles.customer).cast("string"))
    if key == "transactions":
        return df, Measure(key, "count", value=F.lit(1.0))
    raise ValueError(f"measure '{key}' is not available for these columns")


MEASURES = ["revenue", "units", "gross_profit", "orders", "customers", "transactions"]


def available_measures(df: DataFrame, roles: Roles) -> DataFrame:
    rows = []
    for key in MEASURES:
        try:
            _, m = measure(df, roles, key)
            rows.append((key, m.unit, m.additive, True))
        except ValueError:
            rows.append((key, None, None, False))
    return df.sparkSession.createDataFrame(rows, "measure string, unit string, additive boolean, available boolean")


def windows(first: date, last: date, mode: str = "auto", custom: tuple[date, date, date, date] | None = None) -> tuple[Period, Period]:
    """(current, prior): calendar month, else rolling 30 days, else halves, or custom."""
    if mode == "custom":
        if custom is None or custom[0] > custom[1] or custom[2] > custom[3]:
            raise ValueError("a custom comparison needs two periods whose start is not after their end")
        return Period("custom", "current", custom[0], custom[1]), Period("custom", "prior", custom[2], custom[3])
    known = {(p.basis, p.side): p for p in comparison_periods(first, last)}
    for basis in ["last_month", "rolling_30d"] if mode == "auto" else [mode]:
        if (basis, "current") in known and last_complete_month(last)[0] <= last:
            return known[basis, "current"], known[basis, "prior"]
    span = (last - first).days + 1
    if mode not in ("auto", "halves") or span < 4:
        raise ValueError("the data does not cover two periods to compare")
    half = first + timedelta(days=span // 2)
    return Period("halves", "current", half, last), Period("halves", "prior", first, half - timedelta(days=1))


def windows_table(spark, first: date, last: date) -> DataFrame:
    rows = []
    for mode in ("auto", "last_month", "rolling_30d", "halves"):
        try:
            rows += [(mode, p.basis, p.side, p.start, p.end) for p in windows(first, last, mode)]
        except ValueError:
            continue
    return spark.createDataFrame(rows, "mode string, basis string, side string, start date, end date")


# --- slices -------------------------------------------------------------------


def in_window(df: DataFrame, roles: Roles, current: Period, prior: Period) -> DataFrame:
    """Rows of the two periods with ``_p`` = 1 (current) or 0 (prior)."""
    ts = F.col(roles.time)
    flag = F.when(current.holds(ts), 1).when(prior.holds(ts), 0)
    return df.where(current.holds(ts) | prior.holds(ts)).withColumn("_p", flag)


def cells(df: DataFrame, m: Measure, dims: list[str]) -> DataFrame:
    """Both periods side by side for every finest combination of the dimensions.

    A counted key keeps one row per cell and key, with how many rows of the key
    there are in the period at all, so that "all of it lies inside" can be told.
    """
    keys = [slicing_key(df, d).alias(d) for d in dims]
    if m.additive:
        v = m.value
        rows = df.select(*keys, "_p", v.alias("_v"))

        def both(name: str, expr: Column) -> list[Column]:
            return [F.sum(F.when(F.col("_p") == p, expr).otherwise(0.0)).alias(f"{name}{p}") for p in (0, 1)]

        x = F.col("_v")
        return rows.groupBy(*dims).agg(
            *both("v", x), *both("pos", F.greatest(x, F.lit(0.0))), *both("neg", F.least(x, F.lit(0.0))), *both("sq", x * x),
            *[F.count_if(F.col("_p") == p).alias(f"rows{p}") for p in (0, 1)])
    rows = df.select(*keys, "_p", m.distinct.alias("_k")).where("_k is not null")
    per = rows.groupBy(*dims, "_k", "_p").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("_k", "_p").agg(F.sum("n").alias("all"))
    return per.join(whole, ["_k", "_p"])


def _sliced(cell: DataFrame, m: Measure, dims: list[str], depth: int) -> DataFrame:
    """All slices of *depth* conditions as (conditions, values per period)."""
    sets = [list(c) for c in combinations(dims, depth)]
    pairs = F.array_compact(F.array(*[
        F.when(F.grouping(d) == 0, F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))) for d in dims]))
    cols = [F.col(d) for d in dims]
    if m.additive:
        names = [c for c in cell.columns if c not in dims]
        flat = cell.groupingSets([[F.col(d) for d in s] for s in sets], *cols).agg(
            pairs.alias("conditions"), *[F.sum(c).alias(c) for c in names])
        return flat.drop(*dims)
    keyed = cell.groupingSets([[*[F.col(d) for d in s], F.col("_k"), F.col("_p")] for s in sets], *cols, F.col("_k"), F.col("_p")).agg(
        pairs.alias("conditions"), F.sum("n").alias("n"), F.max("all").alias("all")).drop(*dims)
    return _counted(keyed)


def _counted(keyed: DataFrame) -> DataFrame:
    """Slices of a counted measure from one row per slice, key and period."""
    return keyed.groupBy("conditions").agg(
        *[F.count_if(F.col("_p") == p).cast("double").alias(f"v{p}") for p in (0, 1)],
        *[F.count_if((F.col("_p") == p) & (F.col("n") == F.col("all"))).cast("double").alias(f"inside{p}") for p in (0, 1)],
        *[F.coalesce(F.sum(F.when(F.col("_p") == p, F.col("n"))), F.lit(0)).alias(f"rows{p}") for p in (0, 1)])


def _named(cell: DataFrame, m: Measure, dims: list[str], wanted: list[list[tuple[str, str]]]) -> DataFrame:
    """The given slices (lists of conditions) and no other, as `_sliced` gives them."""
    def tag(conditions: list[tuple[str, str]]) -> Column:
        inside = F.lit(True)
        for d, v in conditions:
            inside = inside & (F.col(d) == v)
        return F.when(inside, F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value")) for d, v in conditions]))

    tagged = cell.withColumn("conditions", F.explode(F.array_compact(F.array(*map(tag, wanted)))))
    if m.additive:
        return tagged.groupBy("conditions").agg(*[F.sum(c).alias(c) for c in cell.columns if c not in dims])
    return _counted(tagged.groupBy("conditions", "_k", "_p").agg(F.sum("n").alias("n"), F.max("all").alias("all")))


def totals(cell: DataFrame, m: Measure) -> dict:
    if m.additive:
        return cell.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v0", "v1", "rows0", "rows1")]).first().asDict()
    per = cell.groupBy("_k", "_p").agg(F.sum("n").alias("n"))
    return per.agg(
        *[F.count_if(F.col("_p") == p).cast("double").alias(f"v{p}") for p in (0, 1)],
        *[F.coalesce(F.sum(F.when(F.col("_p") == p, F.col("n"))), F.lit(0)).alias(f"rows{p}") for p in (0, 1)]).first().asDict()


def _bound(m: Measure) -> Column:
    """The largest change any slice inside this one could still have."""
    if not m.additive:
        return F.greatest("v1", "v0")
    return F.greatest(F.col("pos1") - F.col("neg0"), F.col("pos0") - F.col("neg1"))


def slices(cell: DataFrame, m: Measure, dims: list[str], whole: dict, *, max_depth: int = MAX_DEPTH, min_rows: int = MIN_ROWS,
           prune_floor: float = PRUNE_FLOOR, beam: int | None = None) -> DataFrame:
    """Surviving slices of all depths.

    A slice is redundant when it holds 98 % of the rows of every surviving slice
    with one condition less.  *beam* optionally caps how many are extended, half
    by bound and half by score; by default the search is exhaustive.
    """
    floor = abs(whole["v1"] - whole["v0"]) * prune_floor
    out, parents, sound, folded = [], None, None, cell
    for depth in range(1, min(max_depth, len(dims)) + 1):
        if depth <= 2:  # values that fail on their own are folded by now, so every pair left is a candidate
            level = _sliced(folded, m, dims, depth)
        else:
            level = _extended(folded, m, dims, sound, _candidates(sound, parents, dims))
        level = level.withColumn("bound", _bound(m)).withColumn("depth", F.lit(depth))
        level = level.where((F.col("rows0") + F.col("rows1") >= min_rows) & (F.col("bound") >= floor))
        sound = materialise(level.where(~F.exists("conditions", lambda c: c["value"] == _OTHER)))  # every level reads the one before
        level = sound if parents is None else materialise(_not_redundant(sound, parents))
        out.append(level)
        parents = level if beam is None else _beam(level, whole, beam)
        if depth == 1:
            folded = _fold(cell, m, dims, level)
    return union_all(out)


def _candidates(sound: DataFrame, parents: DataFrame, dims: list[str]) -> DataFrame:
    """(conditions) of the next level: all slices with one condition less are sound, and one of them is a parent.

    Rows and bound only shrink when a condition is added, so no other slice can pass.  Two slices
    that share all conditions but the last are put together; conditions stand in the order of *dims*.
    """
    place = F.create_map(*[F.lit(x) for i, d in enumerate(dims) for x in (d, i)])
    size = F.size("conditions")
    split = sound.select(F.slice("conditions", F.lit(1), size - 1).alias("head"), F.element_at("conditions", -1).alias("tail"))
    both = split.join(split.withColumnRenamed("tail", "next"), "head").where(place[F.col("tail.dimension")] < place[F.col("next.dimension")])
    joined = both.select(F.concat("head", F.array("tail", "next")).alias("conditions"))
    subs = joined.select("conditions", F.explode("conditions").alias("gone")).select("conditions", F.filter("conditions", lambda c: c != F.col("gone")).alias("sub"))
    known = sound.select(F.col("conditions").alias("sub")).join(parents.select(F.col("conditions").alias("sub"), F.lit(1).alias("parent")), "sub", "left")
    checked = subs.join(known, "sub").groupBy("conditions").agg(F.count(F.lit(1)).alias("n"), F.count("parent").alias("parents"))
    return checked.where((F.col("n") == F.size("conditions")) & (F.col("parents") > 0)).select("conditions")


def _extended(cell: DataFrame, m: Measure, dims: list[str], sound: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate slices counted: cells are joined with the sound slices one condition shorter, then with one more of their own values.

    A cell is copied for the sound slices that it lies in, not for every combination of dimensions.
    """
    items = [F.when(F.col(d) != _OTHER, F.struct(F.lit(i).alias("place"), F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))) for i, d in enumerate(dims)]
    own = cell.withColumn("items", F.array_compact(F.array(*items)))
    pair = F.flatten(F.transform("items", lambda a: F.transform(F.filter("items", lambda b: b["place"] > a["place"]), lambda b: F.array(a, b))))
    inner = own.withColumn("held", F.explode(pair))
    bare = F.transform("held", lambda c: F.struct(c["dimension"].alias("dimension"), c["value"].alias("value")))
    depth = sound.select(F.size("conditions").alias("n")).agg(F.max("n")).first()[0] or 2
    inner = inner.withColumn("conditions", bare)
    for _ in range(2, depth):  # longer slices grow from pairs, one value at a time
        inner = _one_more(inner)
    inner = _one_more(inner.join(sound.select("conditions"), "conditions", "left_semi"))
    counted = inner.join(candidates, "conditions", "left_semi")
    if m.additive:
        return counted.groupBy("conditions").agg(*[F.sum(c).alias(c) for c in cell.columns if c not in dims])
    return _counted(counted.groupBy("conditions", "_k", "_p").agg(F.sum("n").alias("n"), F.max("all").alias("all")))


def _one_more(rows: DataFrame) -> DataFrame:
    """Each slice of a cell with one more of the cell's later values."""
    later = F.filter("items", lambda c: c["place"] > F.element_at("held", -1)["place"])
    out = rows.withColumn("__next", F.explode(later))
    out = out.withColumn("held", F.concat("held", F.array("__next")))
    return out.withColumn("conditions", F.concat("conditions", F.array(F.struct(F.col("__next.dimension").alias("dimension"), F.col("__next.value").alias("value"))))).drop("__next")


def _fold(cell: DataFrame, m: Measure, dims: list[str], singles: DataFrame) -> DataFrame:
    """Fold values that fail on their own; the kept lists are bounded by the dimensions' value caps."""
    kept = singles.select(F.explode("conditions").alias("c")).groupBy("c.dimension").agg(F.collect_set("c.value").alias("v"))
    lists = {r["dimension"]: r["v"] for r in kept.collect()}
    renamed = cell.withColumns({d: F.when(F.col(d).isin(lists.get(d, [])), F.col(d)).otherwise(F.lit(_OTHER)) for d in dims})
    if not m.additive:
        return renamed.groupBy(*dims, "_k", "_p").agg(F.sum("n").alias("n"), F.max("all").alias("all"))
    names = [c for c in cell.columns if c not in dims]
    return renamed.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in names])


def _not_redundant(level: DataFrame, parents: DataFrame) -> DataFrame:
    rows = F.col("rows0") + F.col("rows1")
    up = level.select("conditions", F.explode("conditions").alias("gone")).select(
        "conditions", F.array_except("conditions", F.array("gone")).alias("parent"))
    sizes = parents.select(F.col("conditions").alias("parent"), rows.alias("parent_rows"))
    largest = up.join(sizes, "parent").groupBy("conditions").agg(F.max("parent_rows").alias("parent_rows"))
    return level.join(largest, "conditions").where(rows < REDUNDANT_SHARE * F.col("parent_rows")).drop("parent_rows")


def _beam(level: DataFrame, whole: dict, width: int) -> DataFrame:
    scored = explain(level, whole, additive="sq0" in level.columns)
    half = max(1, width // 2)
    by_mass = scored.orderBy(F.desc("bound"), "slice").limit(half)
    by_score = scored.join(by_mass.select("slice"), "slice", "left_anti").orderBy(F.desc("score"), "slice").limit(width - half)
    kept = by_mass.select("conditions").unionByName(by_score.select("conditions"))
    return level.join(kept, "conditions", "left_semi")


def slice_label() -> Column:
    return F.array_join(F.transform("conditions", lambda c: F.concat(c["dimension"], F.lit("="), c["value"])), " & ")


def _js(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return (F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, 0.5 * q * F.log2(q / m)).otherwise(0.0))


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(z)) by a rational approximation of erfc (absolute error below 2e-7)."""
    x = F.least(z, F.lit(40.0)) / (2.0 ** 0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def explain(found: DataFrame, whole: dict, *, additive: bool = True) -> DataFrame:
    """Power, excess over the trend, focus, surprise, signal and score of every slice."""
    t0, t1 = float(whole["v0"]), float(whole["v1"])
    delta, rows = t1 - t0, float(whole["rows0"] + whole["rows1"])
    growth = F.lit(t1 / t0 if t0 else None).cast("double")
    change = F.col("v1") - F.col("v0")
    excess = F.col("v1") - F.col("v0") * growth
    if additive:
        variance = F.col("sq1") + growth * growth * F.col("sq0")
        signal = F.when(F.col("rows0") + F.col("rows1") < 2, None).when(variance <= 0, float("inf")).otherwise(
            F.abs(excess) / F.sqrt(F.nullif(variance, F.lit(0.0))))
        rest0, rest1 = F.lit(t0) - F.col("v0"), F.lit(t1) - F.col("v1")
    else:
        signal = F.lit(None).cast("double")
        rest0, rest1 = F.lit(t0) - F.col("inside0"), F.lit(t1) - F.col("inside1")
    out = found.select(
        slice_label().alias("slice"), "conditions", "depth", "bound", F.col("v0").alias("prior"), F.col("v1").alias("current"),
        change.alias("delta"), (change / F.nullif(F.col("v0"), F.lit(0.0)) * 100).alias("change_pct"),
        (change / delta if delta else F.lit(0.0)).alias("power"), (F.col("v0") * growth).alias("expected"), excess.alias("excess"),
        (excess / delta if delta else F.lit(0.0)).alias("excess_share"), F.col("rows0").alias("prior_rows"), F.col("rows1").alias("current_rows"),
        ((F.col("rows0") + F.col("rows1")) / rows).alias("rows_share"),
        _js(F.greatest(F.col("v0") / t0, F.lit(0.0)) if t0 else F.lit(0.0), F.greatest(F.col("v1") / t1, F.lit(0.0)) if t1 else F.lit(0.0)).alias("surprise"),
        signal.alias("signal"), rest0.alias("rest_prior"), rest1.alias("rest_current"), (rest1 - rest0).alias("rest_delta"),
        ((rest1 - rest0) / F.nullif(rest0, F.lit(0.0)) * 100).alias("rest_change_pct"))
    focus = F.abs("power") / F.col("rows_share")
    score = (F.least(F.abs("power"), F.lit(2.0)) * (0.5 + 0.5 * F.least(F.abs("excess_share"), F.lit(1.0)))
             / (1.0 + 0.15 * (F.col("depth") - 1)) * (0.35 + 0.65 * F.least(focus / 15.0, F.lit(1.0))))
    return out.withColumn("concentration", focus).withColumn("score", score)


def tested(explained: DataFrame, whole: dict, *, min_power: float = MIN_POWER, min_signal: float = MIN_SIGNAL) -> DataFrame:
    """Slices that move with the total and matter, with p-value and the Bonferroni verdict."""
    direction = 1 if whole["v1"] > whole["v0"] else -1
    material = explained.where((F.signum("delta") == direction) & (F.abs("power") >= min_power))
    n = material.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    p = two_sided_p(F.col("signal"))
    return material.withColumn("p_value", p).withColumn("robust", F.col("p_value") <= F.lit(ALPHA) / n).where(
        F.col("signal").isNull() | (F.col("signal") >= min_signal))


def select_top(candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best slices without repeats: a refinement must concentrate the change by
    a quarter more than the slice it refines; a coarser copy is dropped.

    The tested slices (few: each moves a sizeable share of the total) are ranked once, and one fold
    down the list takes a slice unless one taken before rules it out.
    """
    row = F.struct(*candidates.columns)
    order = [F.when(F.col("robust"), 0).otherwise(1).alias("a"), F.col("score").isNull().alias("b"), (-F.col("score")).alias("c"), F.col("slice").alias("d")]
    ranked = candidates.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, row.alias("x")))), lambda e: e["x"]).alias("l"))

    def out(b: Column, x: Column) -> Column:
        shared = F.size(F.array_intersect(x["conditions"], b["conditions"]))
        refines = (shared == F.size(b["conditions"])) & (F.size(x["conditions"]) > F.size(b["conditions"]))
        return (shared == F.size(x["conditions"])) | (refines & (x["concentration"] <= b["concentration"] * REFINEMENT_GAIN))

    def taken(done: Column, x: Column) -> Column:
        return F.when((F.size(done) < k) & ~F.exists(done, lambda b: F.coalesce(out(b, x), F.lit(False))), F.concat(done, F.array(x))).otherwise(done)

    chosen = ranked.select(F.posexplode(F.aggregate("l", F.slice("l", 1, 0), taken)).alias("i", "x"))
    return chosen.select("x.*", (F.col("i") + 1).alias("rank"))


def drill_path(chosen: DataFrame, cell: DataFrame, m: Measure, dims: list[str], whole: dict) -> DataFrame:
    """What each added condition of the chosen slices gained; only their own steps are counted."""
    steps = {(r["rank"], i + 1): [(c["dimension"], c["value"]) for c in r["conditions"][:i + 1]] for r in chosen.select("rank", "conditions").collect() for i in range(len(r["conditions"]))}
    if not steps:
        steps = {(0, 0): [(dims[0], "")]}  # nothing is chosen: no slice, and a table without rows
    wanted = [list(c) for c in dict.fromkeys(map(tuple, steps.values()))]
    table = explain(_named(cell, m, dims, wanted).withColumn("depth", F.size("conditions")).withColumn("bound", F.lit(0.0)), whole, additive=m.additive)
    places = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(step).alias("step"), F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value")) for d, v in c]).alias("prefix"))
                       for (rank, step), c in steps.items()])
    placed = table.withColumn("at", F.explode(F.filter(places, lambda x: x["prefix"] == F.col("conditions")))).where("at.rank > 0")
    return placed.select(
        "at.rank", "at.step", "slice", rnd(F.col("delta")).alias("delta"), rnd(F.col("power") * 100, 1).alias("power_pct"),
        rnd(F.col("rows_share") * 100, 1).alias("rows_share_pct"), rnd(F.col("concentration")).alias("concentration"))


def per_dimension(cell: DataFrame, m: Measure, dims: list[str], whole: dict) -> DataFrame:
    """Per dimension: divergence of its mix, and how few values explain two thirds."""
    t0, t1 = float(whole["v0"]), float(whole["v1"])
    delta = t1 - t0
    singles = _sliced(cell, m, dims, 1).select(
        F.col("conditions")[0]["dimension"].alias("dimension"), F.col("conditions")[0]["value"].alias("value"), "v0", "v1")
    work = singles.withColumn("d", F.col("v1") - F.col("v0")).withColumn("same", F.signum("d") == (1 if delta > 0 else -1))
    biggest = Window.partitionBy("dimension").orderBy(F.desc("same"), F.desc(F.abs("d")), "value")
    run = F.sum(F.when(F.col("same"), F.abs("d")).otherwise(0.0)).over(biggest.rowsBetween(Window.unboundedPreceding, 0))
    ranked = work.withColumn("rn", F.row_number().over(biggest)).withColumn("run", run)
    enough = F.min(F.when(F.col("same") & (F.col("run") >= abs(delta) * 2 / 3), F.col("rn")))
    p, q = F.greatest(F.col("v0") / t0, F.lit(0.0)) if t0 else F.lit(0.0), F.greatest(F.col("v1") / t1, F.lit(0.0)) if t1 else F.lit(0.0)
    return ranked.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_values"), rnd(F.sum(_js(p, q)), 5).alias("divergence"),
        F.coalesce(enough, F.nullif(F.count_if("same"), F.lit(0))).alias("elements_for_two_thirds"),
        F.max_by(F.when(F.col("same"), F.col("value")), F.when(F.col("same"), -F.col("rn"))).alias("top_element"),
        F.count_if(~F.col("same") & (F.col("d") != 0)).alias("offsetting_elements"))


def slice_bridge(df: DataFrame, roles: Roles, chosen: DataFrame) -> DataFrame:
    """Fewer orders or smaller orders, inside each chosen slice (at most top-k of them)."""
    rows = chosen.select("rank", "slice", "conditions").collect()
    value, parts = number(roles.revenue), []
    for r in rows:
        inside = F.lit(True)
        for c in r["conditions"]:
            inside = inside & (slicing_key(df, c["dimension"]) == c["value"])
        parts.append(F.when(inside, F.struct(F.lit(r["rank"]).alias("rank"), F.lit(r["slice"]).alias("slice"))))
    if not parts:
        parts = [F.lit(None).cast("struct<rank:int,slice:string>")]
    tagged = df.select(F.explode(F.array_compact(F.array(*parts))).alias("s"), "_p", F.col(roles.order).cast("string").alias("o"), value.alias("v"))
    orders = tagged.groupBy("s.rank", "s.slice", "_p", "o").agg(F.sum("v").alias("v"))
    def side(p: int, tag: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(F.col("_p") == p, F.col("v"))), F.lit(0.0)).alias(f"rev_{tag}"),
                F.count(F.when((F.col("_p") == p), F.col("o"))).alias(f"orders_{tag}")]
    wide = orders.groupBy("rank", "slice").agg(*side(1, "current"), *side(0, "prior")).where("orders_prior > 0 and orders_current > 0")
    ac, ap = F.col("rev_current") / F.col("orders_current"), F.col("rev_prior") / F.col("orders_prior")
    dn = F.col("orders_current") - F.col("orders_prior")
    volume, basket = dn * ap, (ac - ap) * F.col("orders_prior")
    return wide.select(
        "rank", "slice", "orders_prior", "orders_current", rounded(ap).alias("aov_prior"), rounded(ac).alias("aov_current"),
        rounded(volume).alias("volume_effect"), rounded(basket).alias("basket_effect"), rounded(dn * (ac - ap)).alias("interaction_effect"),
        F.when(F.abs(volume) >= F.abs(basket), "order count").otherwise("order size").alias("primary_driver"))


def weekday_imbalance(df: DataFrame, roles: Roles) -> DataFrame:
    """Weekdays of which the two periods hold a different number of days."""
    days = df.groupBy("_p", F.to_date(roles.time).alias("day")).agg(F.lit(1).alias("x"))
    counts = days.groupBy(F.date_format("day", "EEEE").alias("day_name")).agg(
        F.count_if(F.col("_p") == 1).alias("current_days"), F.count_if(F.col("_p") == 0).alias("prior_days"))
    return counts.where("current_days <> prior_days")


def analyse(df: DataFrame, roles: Roles, *, key: str = "revenue", dims: list[str] | None = None, mode: str = "auto",
            current: Period | None = None, prior: Period | None = None, first: date | None = None, last: date | None = None, **limits) -> dict:
    """The whole analysis: totals, slices, chosen causes, per-dimension view, warnings.

    Returns frames by name; ``summary`` is one row with the warnings as an array.
    """
    df, m = measure(df, roles, key)
    if current is None:
        if first is None:
            row = df.agg(F.to_date(F.min(roles.time)).alias("lo"), F.to_date(F.max(roles.time)).alias("hi")).first()
            first, last = row["lo"], row["hi"]
        current, prior = windows(first, last, mode)
    work = in_window(df, roles, current, prior)
    if dims is None:
        usable = dimensions(work.drop("_p"), roles).where("usable").orderBy("n_values", "column_name").collect()
        dims = [r["column_name"] for r in usable]
    cell = materialise(cells(work, m, dims))
    whole = totals(cell, m)
    warnings = []
    if min(whole["rows0"], whole["rows1"]) < MIN_PERIOD_ROWS:
        warnings.append("too few rows in one of the periods")
    if whole["v1"] == whole["v0"]:
        warnings.append("the measure did not change")
    if weekday_imbalance(work, roles).limit(1).count():
        warnings.append("the periods hold different numbers of some weekdays")
    found = slices(cell, m, dims, whole, **limits)
    candidates = tested(explain(found, whole, additive=m.additive), whole)
    empty = min(whole["rows0"], whole["rows1"]) < MIN_PERIOD_ROWS or whole["v1"] == whole["v0"]
    chosen = select_top(candidates.where(F.lit(not empty)))
    schema = T.StructType().add("measure", "string").add("basis", "string").add("prior", "double").add("current", "double").add(
        "prior_rows", "long").add("current_rows", "long").add("warnings", T.ArrayType(T.StringType()))
    summary = df.sparkSession.createDataFrame(
        [(key, current.basis, float(whole["v0"]), float(whole["v1"]), whole["rows0"], whole["rows1"], warnings)], schema)
    return {"summary": summary, "slices": found, "causes": chosen, "work": work, "cells": cell, "totals": whole, "measure": m, "dims": dims,
            "dimensions": per_dimension(cell, m, dims, whole)}
