"""Figures, evidence and findings of a run, against targets and earlier snapshots."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.numbers import SEVERITIES, figure_text, fingerprint, rnd, severity_from_share, severity_rank
from ledgerlark.functions.scale import union_all

FIGURE = ["key", "label", "value", "unit", "formula", "period"]
FINDING = ["project", "rule", "severity", "metric", "money_at_stake", "current_value", "prior_value", "change_pct", "fingerprint", "is_event", "sort_priority"]


# --- figures ------------------------------------------------------------------


def figures(section: DataFrame, spec: list[tuple[str, str, str, str, str]], period: str = "all data") -> DataFrame:
    """One row per (key, label, column, unit, formula) of a one-row section; missing values are left out."""
    rows = ", ".join(f"'{k}', '{label}', cast({col} as double), '{unit}', '{formula}'" for k, label, col, unit, formula in spec)
    return section.select(F.expr(f"stack({len(spec)}, {rows}) as (key, label, value, unit, formula)")).where("value is not null").withColumn(
        "period", F.lit(period))


def with_display(table: DataFrame) -> DataFrame:
    return table.withColumn("display", figure_text(F.col("value"), F.col("unit")))


def as_map(table: DataFrame) -> DataFrame:
    """All figures as one map row; a registry holds some hundred figures."""
    return table.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("f"))


# Order of the tags, and the least and most serious a tag can be.
TAGS = ["THREAT", "LEAK", "RISK", "OPPORTUNITY", "STRENGTH", "CAVEAT"]
TAG_FLOOR = {"THREAT": "medium", "LEAK": "medium", "RISK": "low", "OPPORTUNITY": "low", "STRENGTH": "info", "CAVEAT": "info"}
TAG_CEILING = {"RISK": "medium", "OPPORTUNITY": "low", "STRENGTH": "info", "CAVEAT": "info"}


def evidence(table: DataFrame) -> DataFrame:
    """(key, tag, section, money, is_event): which figures are worth a finding, and what is at stake."""
    def v(key: str) -> Column:
        return F.try_element_at("f", F.lit(key))

    pct, change = v("mon_revenue_change_pct"), v("mon_revenue_change")
    moved = F.abs(pct) >= 5
    margin, repeat, top, decile = v("gross_margin_pct"), v("repeat_rate_pct"), v("top_product_share"), v("top_decile_customer_share")
    rules = [
        ("period_move", F.when(change < 0, "THREAT").otherwise("OPPORTUNITY"), "what_changed", change, True, moved),
        ("period_stable", F.lit("STRENGTH"), "what_changed", change, True, F.abs(pct) < 5),
        ("product_concentration", F.lit("RISK"), "concentration", v("top_product_revenue"), False, top >= 25),
        ("product_pareto", F.lit("RISK"), "concentration", v("revenue_total") * 0.2, False, (top < 25) & v("products_for_80pct").isNotNull()),
        ("customer_concentration", F.lit("RISK"), "concentration", v("revenue_total") * decile / 100, False, decile >= 40),
        ("gross_margin", F.when(margin >= 30, "STRENGTH").otherwise("THREAT"), "standing", v("gross_profit"), False, margin.isNotNull()),
        ("margin_drag", F.lit("LEAK"), "decisions", v("margin_drag_uplift"), True, v("margin_drag_uplift") > 0),
        ("no_cost_data", F.lit("CAVEAT"), "blind_spots", F.lit(0.0), False, margin.isNull()),
        ("discount_leak", F.lit("LEAK"), "decisions", v("discount_given"), True, v("discount_share_of_gross") >= 3),
        ("weak_repeat", F.lit("OPPORTUNITY"), "decisions", v("second_purchase_upside"), True, repeat < 30),
        ("strong_repeat", F.lit("STRENGTH"), "working", v("repeat_revenue"), False, repeat >= 60),
        ("weekday_rhythm", F.lit("OPPORTUNITY"), "decisions", v("weak_weekday_uplift"), True, F.abs(v("best_weekday_uplift_pct")) >= 15),
    ]
    items = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(key).alias("key"), tag.alias("tag"), F.lit(section).alias("section"),
                              F.abs(F.coalesce(money, F.lit(0.0))).alias("money"), F.lit(event).alias("is_event")))
        for key, tag, section, money, event, test in rules]))
    return as_map(table).select(F.inline(items))


def ordered_evidence(items: DataFrame) -> DataFrame:
    tag = F.array_position(F.array(*map(F.lit, TAGS)), F.col("tag"))
    return items.withColumn("position", F.row_number().over(Window.orderBy(tag, F.desc("money"), "key")))  # a dozen rows


def _limit(severity: Column, tag: Column) -> Column:
    def table(d: dict[str, str], default: str) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), tag), F.lit(default))

    rank = F.least(severity_rank(severity), severity_rank(table(TAG_FLOOR, "info")))
    rank = F.greatest(rank, severity_rank(table(TAG_CEILING, "critical")))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (rank + 1).cast("int"))


# --- rules: (context) -> findings ---------------------------------------------


def _finding(df: DataFrame, rule: Column, severity: Column, metric: Column, finger: Column, *, money: Column | None = None, current: Column | None = None,
             prior: Column | None = None, change: Column | None = None, event: Column | bool = True, priority: int = 1, project: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("double")
    cols = {
        "project": project if project is not None else F.lit("default"), "rule": rule, "severity": severity, "metric": metric,
        "money_at_stake": money if money is not None else F.lit(0.0), "current_value": current if current is not None else null,
        "prior_value": prior if prior is not None else null, "change_pct": change if change is not None else null, "fingerprint": finger,
        "is_event": F.lit(event) if isinstance(event, bool) else event, "sort_priority": F.lit(priority)}
    return df.select(*[c.alias(n) for n, c in cols.items()])


def freshness_findings(last_row: DataFrame, as_of: date, warn: int = 3, critical: int = 7) -> DataFrame:
    """(last) -> a finding when the newest row is some days old."""
    days = F.date_diff(F.lit(as_of), F.to_date("last"))
    return _finding(last_row.where(days >= warn), F.lit("data_freshness"), F.when(days >= critical, "critical").otherwise("high"), F.lit("data_freshness"),
                    fingerprint("freshness", "default"), current=days.cast("double"), priority=0)


def evidence_findings(items: DataFrame, revenue: Column) -> DataFrame:
    kept = items.where(~F.col("tag").isin("STRENGTH", "CAVEAT"))
    severity = _limit(severity_from_share(F.col("money"), revenue), F.col("tag"))
    return _finding(kept, F.concat(F.lit("evidence."), F.lower("tag")), severity, F.col("section"), fingerprint("evidence", F.col("tag"), F.col("section"), F.col("key")),
                    money=F.col("money"), event=F.col("is_event"))


# Metrics watched from run to run, and those in money.
TRACKED = ["revenue", "orders", "total_customers", "aov"]
MONEY_METRICS = ["revenue", "aov"]


def delta_findings(current: DataFrame, previous: DataFrame, revenue: Column, threshold_pct: float = 10.0) -> DataFrame:
    """Moves of the headline metrics against the recorded snapshot; both (project, metric, value)."""
    both = current.where(F.col("metric").isin(TRACKED)).join(previous.select("project", "metric", F.col("value").alias("prior")), ["project", "metric"])
    change = (F.col("value") - F.col("prior")) / F.nullif(F.abs("prior"), F.lit(0.0)) * 100
    moved = both.withColumn("change", change).where(F.abs("change") >= threshold_pct)
    money = F.when(F.col("metric").isin(MONEY_METRICS) & (F.col("change") < 0), F.abs(F.col("value") - F.col("prior"))).otherwise(0.0)
    severity = F.when(F.col("change") > 0, "info").when(money > 0, severity_from_share(money, revenue)).otherwise("low")
    side = F.when(F.col("change") < 0, "down").otherwise("up")
    return _finding(moved, F.lit("snapshot_delta"), severity, F.col("metric"), fingerprint("snapshot_delta", F.col("metric"), side), money=money,
                    current=F.col("value"), prior=F.col("prior"), change=F.col("change"), project=F.col("project"))


def target_findings(current: DataFrame, targets: DataFrame, revenue: Column) -> DataFrame:
    """Breaches of the owner's bounds; targets are (metric, bound, limit)."""
    both = current.join(targets, "metric")
    breach = F.when(F.col("bound") == "min", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    gap = F.abs(F.col("value") - F.col("limit"))
    money = F.col("metric").isin(MONEY_METRICS)
    return _finding(both.where(breach), F.lit("target_breach"), F.when(money, severity_from_share(gap, revenue)).otherwise("high"), F.col("metric"),
                    fingerprint("target", F.col("metric"), F.col("bound")), money=F.when(money, gap).otherwise(0.0), current=F.col("value"), prior=F.col("limit"),
                    change=(F.col("value") - F.col("limit")) / F.nullif(F.abs("limit"), F.lit(0.0)) * 100, project=F.col("project"))


def quality_findings(report: DataFrame) -> DataFrame:
    """Missing cells and duplicate rows that are more than a trifle."""
    kept = report.where(F.col("check_name").isin("missing_values", "duplicate_rows") & F.col("severity").isin("medium", "high") & (F.col("n") > 0))
    value = F.when(F.col("check_name") == "missing_values", F.col("pct")).otherwise(F.col("n").cast("double"))
    return _finding(kept, F.lit("data_quality"), F.lit("medium"), F.col("check_name"), fingerprint("quality", F.col("check_name")), current=value, event=False)


RULES: list[Callable[[Mapping], DataFrame]] = [
    lambda c: freshness_findings(c["last"], c["as_of"]),
    lambda c: evidence_findings(c["evidence"], c["revenue"]),
    lambda c: delta_findings(c["metrics"], c["previous"], c["revenue"]),
    lambda c: target_findings(c["metrics"], c["targets"], c["revenue"]),
    lambda c: quality_findings(c["quality"]),
]


class Inputs(Mapping):
    """The context of a run: named inputs, each built when a rule first asks for it and once for all rules.

    *builders* map a name to a function of the inputs, so one input can start from another.
    """

    def __init__(self, builders: dict[str, Callable[[Inputs], object]]) -> None:
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str):
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    @property
    def built(self) -> list[str]:
        return list(self._built)


def evaluate(context: Mapping, rules: list[Callable[[Mapping], DataFrame]] | None = None) -> DataFrame:
    """The findings of all rules; a rule is any function from the context (a dict, or `Inputs`) to finding rows."""
    return union_all([rule(context) for rule in (rules or RULES)])


def _rank() -> list[Column]:
    return [F.asc("sort_priority"), severity_rank(F.col("severity")).asc(), F.desc(F.abs("money_at_stake")), F.asc("fingerprint")]


def ordered(findings: DataFrame) -> DataFrame:
    """Operational first, then severity, then money."""
    return findings.withColumn("position", F.row_number().over(Window.partitionBy("project").orderBy(*_rank())))


def deliver(findings: DataFrame, recent: DataFrame, *, min_severity: str = "medium", limit: int = 5) -> DataFrame:
    """Floor, cooldown and cap; what is held back keeps its reason.

    *recent* holds the fingerprints raised inside the cooldown.
    """
    seen = recent.select("fingerprint").distinct().withColumn("seen", F.lit(True))
    floor = SEVERITIES.index(min_severity)
    open_ = findings.join(seen, "fingerprint", "left").withColumn(
        "held", F.when(severity_rank(F.col("severity")) > floor, "below the severity floor").when(F.col("seen"), "inside the cooldown"))
    place = F.row_number().over(Window.partitionBy("project", F.col("held").isNull()).orderBy(*_rank()))
    return open_.withColumn("place", place).withColumn(
        "held_reason", F.coalesce("held", F.when(F.col("place") > limit, "over the limit of the run"))).drop("held", "seen", "place")


def money_at_stake(findings: DataFrame) -> DataFrame:
    """Only events add up; a standing condition is not lost again every day."""
    event = F.when(F.col("is_event"), F.abs("money_at_stake")).otherwise(0.0)
    return findings.groupBy("project").agg(F.count(F.lit(1)).alias("findings"), F.count_if("is_event").alias("events"), rnd(F.sum(event)).alias("money_at_stake"))


# --- snapshots ----------------------------------------------------------------

# The metrics a snapshot keeps.
SNAPSHOT_METRICS = ["revenue", "orders", "total_customers", "aov", "aov_median", "revenue_per_customer_avg", "avg_revenue_per_row"]


def long_metrics(row: DataFrame, columns: list[str], project: str = "default") -> DataFrame:
    """A one-row section as (project, metric, value) rows."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    return row.select(F.lit(project).alias("project"), F.expr(f"stack({len(columns)}, {pairs}) as (metric, value)")).where("value is not null")


def snapshot_before(snapshots: DataFrame, before: datetime) -> DataFrame:
    """The newest value of every (project, kind, metric) recorded before a moment."""
    return snapshots.where(F.col("captured_at") < F.lit(before)).groupBy("project", "kind", "metric").agg(
        F.max_by("value", "captured_at").alias("value"), F.max("captured_at").alias("captured_at"))


def as_of_join(probes: DataFrame, snapshots: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """For every probe the last snapshot value of its key strictly before it.

    The timelines are cut into days: inside a day one window per key and day, from
    earlier days one carried row per key and day.  A key with a third of all rows
    is spread over its days.
    """
    p = probes.select("*", F.to_date(ts).alias("__day"))
    s = snapshots.select(F.col(key), F.col(ts), F.col(value).alias("__v"), F.to_date(ts).alias("__day"))
    last = s.groupBy(key, "__day").agg(F.max_by("__v", ts).alias("__last"))
    days = p.select(key, "__day").distinct().join(last, [key, "__day"], "full")
    earlier = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("__carry", F.last("__last", ignorenulls=True).over(earlier)).select(key, "__day", "__carry")
    both = p.select("*", F.lit(None).cast(dict(s.dtypes)["__v"]).alias("__v"), F.lit(0).alias("__side")).unionByName(
        s.select("*", F.lit(1).alias("__side")), allowMissingColumns=True)
    # a probe comes before a snapshot of the same moment: strictly earlier ones count
    within = Window.partitionBy(key, "__day").orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, -1)
    filled = both.withColumn("__prev", F.last("__v", ignorenulls=True).over(within)).where("__side = 0")
    return filled.join(carried, [key, "__day"], "left").select(*probes.columns, F.coalesce("__prev", "__carry").alias(value + "_before"))


def latest_prior_run(runs: DataFrame, history: DataFrame, exclude: str | None = None) -> DataFrame:
    """The forecast rows of the newest run per metric, other than the given one."""
    usable = runs.where(F.col("run_id") != exclude) if exclude else runs
    newest = usable.groupBy("metric").agg(F.max_by("run_id", "created_at").alias("run_id"))
    return history.where("kind = 'forecast'").join(newest, ["metric", "run_id"], "left_semi")


def usage_rollup(events: DataFrame, user: str, ts: str, value: str) -> DataFrame:
    """Events per user and day with totals; a value of zero is unknown, not zero."""
    per = events.groupBy(F.col(user).alias("user"), F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.count_if(F.col(value) == 0).alias("unknown"))
    return per.rollup("user", "day").agg(F.sum("events").alias("events"), rnd(F.sum("total")).alias("total"), F.sum("unknown").alias("unknown"),
                                         F.grouping_id().cast("int").alias("level"))


def json_metrics(df: DataFrame, column: str) -> DataFrame:
    """(metric, value) rows of a JSON map of numbers."""
    return df.select(F.explode(F.from_json(column, "map<string,double>")).alias("metric", "value"))


def numeric_leaves(df: DataFrame, column: str) -> DataFrame:
    """(path, value) of every number inside nested structs, arrays and maps; booleans are no numbers."""
    from pyspark.sql import types as T

    parts: list[DataFrame] = []

    def walk(frame: DataFrame, c: str, kind: T.DataType, path: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(frame.withColumn("__x", F.col(c)[f.name]), "__x", f.dataType, F.concat_ws(".", path, F.lit(f.name)))
        elif isinstance(kind, T.ArrayType):
            inner = frame.select("*", path.alias("__p"), F.posexplode(c).alias("__i", "__e")) if "__p" not in frame.columns else frame.withColumn("__p", path).select(
                *[x for x in frame.columns if x not in ("__i", "__e", "__p")], "__p", F.posexplode(c).alias("__i", "__e"))
            walk(inner, "__e", kind.elementType, F.concat_ws(".", "__p", F.col("__i").cast("string")))
        elif isinstance(kind, T.MapType):
            inner = frame.withColumn("__p", path).select("__p", F.explode(c).alias("__k", "__v"))
            walk(inner, "__v", kind.valueType, F.concat_ws(".", "__p", "__k"))
        elif isinstance(kind, T.NumericType) or isinstance(kind, T.StringType):
            v = F.col(c).try_cast("double")
            parts.append(frame.select(path.alias("path"), v.alias("value")).where("value is not null and not isnan(value)"))

    walk(df.select(F.col(column).alias("__r")), "__r", df.schema[column].dataType, F.lit(""))
    return union_all([p.withColumn("path", F.ltrim(F.col("path"), F.lit("."))) for p in parts])


def order_value_histogram(values: DataFrame, column: str, p99: float, bins: int = 40) -> DataFrame:
    """Counts in equal bins from zero to the 99th percentile."""
    kept = values.where(F.col(column) <= p99)
    spot = F.least(F.lit(bins), F.width_bucket(F.col(column), F.lit(0.0), F.lit(p99), F.lit(bins)))
    return kept.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("orders"))
