"""Defect detectors: conditional aggregates per column, run together in one pass.

A detector is ``fn(Probe) -> Column`` giving one finding struct (or NULL) as an
aggregate over the table; own detectors are added with ``register``.  What a
detector needs to know beforehand (decimal separator, day order, quartiles) is
measured once for all columns and handed over in the probe.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlark.functions import text as tx
from ledgerlark.functions.numbers import rnd
from ledgerlark.functions.scale import exact_quantiles, union_all
from ledgerlark.operators import clean
from ledgerlark.operators.identities import identity_shares
from ledgerlark.operators.quality import duplicate_counts, type_label

# Name patterns that hint at the role of a column.
ID_NAME = r"(?i)(^|[\s_\-.])(id|ids|code|key|no|num|number|sku|ref|uuid|guid)($|[\s_\-.])"
DATE_NAME = r"(?i)(^|[\s_\-.])(date|datetime|timestamp|time|day|month|year|dob)($|[\s_\-.])"
NON_NEGATIVE_NAME = (
    r"(?i)(^|[\s_\-.])(qty|quantity|count|amount|price|cost|total|revenue|sales|units|stock|age|discount)($|[\s_\-.])"
)
BOOLEAN_NAME = r"(?i)(^|[\s_\-.])(is|has|was|flag|active|churn|paid|returned|cancelled)($|[\s_\-.])"
CURRENCY = r"(?i)[$€£¥₹﷼%]|\b(usd|eur|gbp|egp|sar|aed|kwd)\b|ج\.م|ر\.س|د\.إ"
YES = ["true", "t", "yes", "y", "1", "1.0", "نعم"]
NO = ["false", "f", "no", "n", "0", "0.0", "لا"]

FINDING = (
    "kind string, column_name string, severity string, n long, evidence array<string>, suggested_op string, "
    "suggested_params map<string,string>, auto_fixable boolean"
)
SEVERITY_ORDER = ["blocking", "high", "medium", "low", "info"]


@dataclass
class Probe:
    """One column as the detectors see it."""

    name: str
    kind: str  # integer, float, datetime, boolean or string
    is_key: bool = False
    separator: str = "."
    day_first: bool | None = False
    date_kind: str | None = None
    quartiles: tuple[float | None, float | None] = (None, None)
    sentinels: tuple[float, ...] = ()
    as_of: str | None = None

    @property
    def value(self) -> Column:
        return F.col(self.name)

    @property
    def text(self) -> Column:
        return F.col(f"__text_{self.name}")

    @property
    def placeholder(self) -> Column:
        return F.col(f"__void_{self.name}")

    @property
    def live(self) -> Column:
        """The text unless it only spells out "missing"."""
        return F.when(~self.placeholder, self.text)

    @property
    def number(self) -> Column:
        """The text read as a number."""
        return F.col(f"__num_{self.name}")

    @property
    def date(self) -> Column:
        """The text (or serial number) read as a date."""
        return F.col(f"__date_{self.name}")

    def named(self, pattern: str) -> bool:
        return re.search(pattern, self.name) is not None


Detector = Callable[[Probe], Column | None]
DETECTORS: dict[str, Detector] = {}


def register(name: str, fn: Detector) -> None:
    """Add a detector of one's own."""
    DETECTORS[name] = fn


def detector(name: str) -> Callable[[Detector], Detector]:
    def add(fn: Detector) -> Detector:
        register(name, fn)
        return fn

    return add


def finding(
    kind: str, probe: Probe, n: Column, *, severity: Column | str = "medium", op: str = "", params: dict | None = None,
    auto: Column | bool = True, when: Column | None = None, evidence: Column | None = None,
) -> Column:
    pairs = [F.lit(str(x)) for item in (params or {}).items() for x in item]
    struct = F.struct(
        F.lit(kind).alias("kind"), F.lit(probe.name).alias("column_name"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), n.cast("long").alias("n"),
        (evidence if evidence is not None else F.array().cast("array<string>")).alias("evidence"),
        F.lit(op).alias("suggested_op"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("suggested_params"),
        (F.lit(auto) if isinstance(auto, bool) else auto).alias("auto_fixable"),
    )
    return F.when((n > 0) if when is None else (when & (n > 0)), struct)


def _ends(hit: Column, value: Column) -> Column:
    """Two example values, the smallest and the largest that were hit."""
    shown = F.when(hit, value)
    return F.array_distinct(F.array_compact(F.array(F.min(shown), F.max(shown))))


@detector("placeholder_values")
def placeholders(p: Probe) -> Column | None:
    if p.kind != "string":
        return None
    hit = p.placeholder
    return finding("placeholder_values", p, F.count_if(hit), severity="high", op="standardize_null_placeholders",
                   evidence=_ends(hit, p.text))


@detector("untrimmed_whitespace")
def untrimmed(p: Probe) -> Column | None:
    if p.kind != "string":
        return None
    hit = p.value != tx.collapse_spaces(p.value)
    return finding("untrimmed_whitespace", p, F.count_if(hit), op="trim_whitespace", evidence=_ends(hit, p.value))


@detector("mixed_types")
def mixed_types(p: Probe) -> Column | None:
    """A text column that holds numbers, dates, flags and words side by side."""
    if p.kind != "string":
        return None
    numeric = p.number.isNotNull()
    date = ~numeric & p.date.isNotNull()
    flag = ~numeric & ~date & F.lower(p.text).isin(YES + NO)
    live = p.live.isNotNull()
    kinds = [F.count_if(live & k) for k in (numeric, date, flag, ~(numeric | date | flag))]
    mixed = sum((k > 0).cast("int") for k in kinds) >= 2
    return finding("mixed_types", p, F.count(p.live), when=mixed, auto=False)


@detector("numeric_stored_as_text")
def numeric_as_text(p: Probe) -> Column | None:
    if p.kind != "string" or p.named(DATE_NAME):
        return None
    parsed = F.when(p.live.isNotNull(), p.number)
    share = F.count(parsed) / F.nullif(F.count(p.live), F.lit(0))
    formatted = F.max(F.when(p.live.isNotNull(), F.rlike(p.text, F.lit(CURRENCY)) | F.contains(p.text, F.lit("%"))))
    wanted = (share >= 0.8) & (formatted | F.lit(not p.named(ID_NAME)))
    severity = F.when((share == 1.0) | formatted, "high").otherwise("medium")
    return finding("numeric_stored_as_text", p, F.count(parsed), severity=severity, op="parse_numeric", when=wanted)


@detector("date_stored_as_text")
def date_as_text(p: Probe) -> Column | None:
    if p.kind not in ("string", "integer", "float"):
        return None
    says_date = p.named(DATE_NAME)
    if not says_date and p.kind != "string":
        return None
    parsed = F.when(p.live.isNotNull(), p.date)
    share = F.count(parsed) / F.nullif(F.count(p.live), F.lit(0))
    wanted = share >= (0.6 if says_date else 0.9)
    if not says_date:
        separated = F.count_if(p.live.isNotNull() & F.rlike(p.text, F.lit(r"[/\-:]"))) / F.nullif(F.count(p.live), F.lit(0))
        wanted = wanted & (separated >= 0.8)
    ambiguous = F.lit(p.day_first is None) & (F.count_if(F.rlike(p.text, F.lit(tx.DAY_MONTH_YEAR))) > 0)
    return finding("date_stored_as_text", p, F.count(parsed), severity=F.when(ambiguous, "high").otherwise("medium"),
                   op="parse_datetime", auto=~ambiguous, when=wanted)


@detector("boolean_stored_as_text")
def boolean_as_text(p: Probe) -> Column | None:
    if p.kind in ("boolean", "datetime"):
        return None
    token = F.lower(p.text)
    yes, no = F.count_if(token.isin(YES)), F.count_if(token.isin(NO))
    only = (yes + no) == F.count(p.value)
    spot = F.array_position(F.array(*map(F.lit, YES + NO)), token)  # a bit for each word that occurs
    few = F.bit_count(F.coalesce(F.bit_or(F.when(spot > 0, F.call_function("shiftleft", F.lit(1), spot.cast("int")))), F.lit(0))) <= 4
    wanted = only & few
    if not p.named(BOOLEAN_NAME):
        digits = F.count_if(token.isin("0", "1", "0.0", "1.0")) == F.count(p.value)
        wanted = wanted & (yes > 0) & (no > 0) & ~digits
    return finding("boolean_stored_as_text", p, F.count(p.value), severity="low", op="parse_boolean", when=wanted)


@detector("numeric_sentinel")
def sentinels(p: Probe) -> Column | None:
    """Repeated codes far from everything else; the candidates were found beforehand."""
    if not p.sentinels:
        return None
    hits = F.count_if(p.text.try_cast("double").isin(list(p.sentinels)))
    shown = F.array(*[F.lit(str(int(s))) for s in p.sentinels])
    return finding("numeric_sentinel", p, hits, severity="high", op="replace_sentinels",
                   params={"values": ",".join(str(s) for s in p.sentinels)}, evidence=shown)


@detector("impossible_negative")
def negatives(p: Probe) -> Column | None:
    if not p.named(NON_NEGATIVE_NAME) or p.kind in ("datetime", "boolean"):
        return None
    hit = p.text.try_cast("double") < 0
    return finding("impossible_negative", p, F.count_if(hit), severity="high", op="flag_range_violation",
                   params={"min": "0.0"}, evidence=_ends(hit, p.text))


@detector("future_date")
def future_dates(p: Probe) -> Column | None:
    if p.kind != "datetime" or p.as_of is None:
        return None
    hit = p.value > F.lit(p.as_of).cast("timestamp_ntz")
    return finding("future_date", p, F.count_if(hit), auto=False, evidence=_ends(hit, p.text))


@detector("integer_stored_as_float")
def float_integers(p: Probe) -> Column | None:
    if p.kind != "float":
        return None
    whole = (F.count_if(F.isnan(p.value) | (p.value % 1 != 0)) == 0) & (F.lit(p.named(ID_NAME)) | (F.max(p.value) > 1000))
    return finding("integer_stored_as_float", p, F.count(p.value), severity="low", op="cast_integer", when=whole)


@detector("extreme_values")
def outliers(p: Probe) -> Column | None:
    q1, q3 = p.quartiles
    if p.kind not in ("integer", "float") or q1 is None or q3 <= q1:
        return None
    hit = (p.value < q1 - 3 * (q3 - q1)) | (p.value > q3 + 3 * (q3 - q1))
    return finding("extreme_values", p, F.count_if(hit), severity="info", op="flag_outliers",
                   params={"method": "iqr", "factor": "3.0"}, when=F.count(p.value) >= 8, evidence=_ends(hit, p.text))


@detector("missing_values")
def missing(p: Probe) -> Column | None:
    n, rows = F.count_if(p.value.isNull()), F.count(F.lit(1))
    if p.is_key:
        return finding("missing_in_key", p, n, severity="blocking", op="flag_missing", auto=False)
    mostly = finding("mostly_missing", p, n, severity="high", op="flag_missing", auto=False, when=(n > rows * 0.5) & (n < rows))
    strategy = "median" if p.kind in ("integer", "float") else "mode"
    some = finding("missing_values", p, n, op="impute", params={"strategy": strategy}, when=n <= rows * 0.5)
    return F.coalesce(mostly, some)


@detector("empty_column")
def empty(p: Probe) -> Column | None:
    return finding("empty_column", p, F.count(F.lit(1)), op="drop_column", when=F.count(p.value) == 0)


@detector("constant_column")
def constant(p: Probe) -> Column | None:
    same = F.min(p.value) == F.max(p.value)
    return finding("constant_column", p, F.count(p.value), severity="low", op="drop_column", auto=False,
                   when=same & (F.count(F.lit(1)) > 1))


def probes(df: DataFrame, *, keys: set[str] = frozenset(), as_of: str | None = None, wanted: set[str] | None = None) -> list[Probe]:
    """Measure, for all columns together, what the wanted detectors must know."""
    wanted = set(DETECTORS) if wanted is None else wanted
    fields = [f for f in df.schema.fields if not f.name.startswith("_")]
    out = {f.name: Probe(f.name, type_label(f.dataType), is_key=f.name in keys, as_of=as_of) for f in fields}
    texts = [p.name for p in out.values() if p.kind == "string"]
    if texts and wanted & {"numeric_stored_as_text", "mixed_types"}:
        row = df.agg(*[tx.decimal_separator(c).alias(c) for c in texts]).first()
        for c in texts:
            out[c].separator = row[c]
    if wanted & {"date_stored_as_text", "mixed_types"}:
        names = [p.name for p in out.values() if p.kind in ("string", "integer", "float")
                 and (p.kind == "string" or p.named(DATE_NAME))]
        for c, reading in (clean.date_reading(df, names) if names else {}).items():
            out[c].day_first, out[c].date_kind = reading["day_first"], reading["kind"]
    numbers = [p.name for p in out.values() if p.kind in ("integer", "float")]
    if numbers and "extreme_values" in wanted:
        for c, (q1, q3) in exact_quantiles(df, numbers, [0.25, 0.75]).items():
            out[c].quartiles = (q1, q3)
    if "numeric_sentinel" in wanted:
        for c, hits in sentinel_hits(df, [p.name for p in out.values() if p.kind in ("string", "integer", "float")]).items():
            out[c].sentinels = hits
    return list(out.values())


def sentinel_hits(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, ...]]:
    """Per column the codes that repeat, are a minority and lie over five standard
    deviations from the median of the other values."""
    numbers = df.select(*[F.col(c).cast("string").try_cast("double").alias(c) for c in columns])
    counts = numbers.agg(*[
        F.struct(F.count(c).alias("n"), *[F.count_if(F.col(c) == s).alias(f"s{i}") for i, s in enumerate(clean.SENTINELS)]).alias(c)
        for c in columns
    ]).first() if columns else None
    asked = [(c, s) for c in columns for i, s in enumerate(clean.SENTINELS)
             if counts[c]["n"] >= 5 and counts[c][f"s{i}"] >= 2 and counts[c][f"s{i}"] / counts[c]["n"] < 0.5]
    if not asked:
        return {}
    # the other values of every candidate as a column of its own
    names = [f"r{i}" for i in range(len(asked))]
    rest = numbers.select(*[F.when(F.col(c) != s, F.col(c)).alias(r) for r, (c, s) in zip(names, asked)])
    spreads, medians = rest.agg(*[F.stddev_samp(r).alias(r) for r in names]).first(), exact_quantiles(rest, names, [0.5])
    out: dict[str, tuple[float, ...]] = {}
    for r, (c, s) in zip(names, asked):
        if medians[r][0] is not None and abs(s - medians[r][0]) > 5 * (spreads[r] or 1.0):
            out[c] = (*out.get(c, ()), float(s))
    return out


def readings(df: DataFrame, found: list[Probe]) -> DataFrame:
    """Every column beside its text, number and date reading, each computed once
    per row; readings no detector asks for are pruned."""
    texts = df.select("*", *[F.trim(F.col(p.name).cast("string")).alias(f"__text_{p.name}") for p in found])

    def date(p: Probe) -> Column:
        if p.date_kind:
            return tx.timestamp_of_number(p.name, p.date_kind)
        return tx.parse_timestamp(p.text, bool(p.day_first))

    return texts.select(
        "*", *[tx.is_placeholder(p.text).alias(f"__void_{p.name}") for p in found],
        *[tx.parse_number(p.text, p.separator).alias(f"__num_{p.name}") for p in found],
        *[date(p).alias(f"__date_{p.name}") for p in found],
    )


def run_detectors(df: DataFrame, names: list[str] | None = None, *, keys: set[str] = frozenset(), as_of: str | None = None) -> DataFrame:
    """All findings of the named column detectors: one aggregate for each column, side by side in one job.

    A column's aggregate scans that column only, and its parsers fit a method that the JVM
    compiles (the readings of all columns in one aggregate did not).
    """
    chosen = names or list(DETECTORS)
    out = []
    for p in probes(df, keys=keys, as_of=as_of, wanted=set(chosen)):
        parts = [c for d in chosen if (c := DETECTORS[d](p)) is not None]
        if parts:
            out.append(readings(df.select(p.name), [p]).agg(F.array_compact(F.array(*parts)).alias("f")).select(F.inline("f")))
    return union_all(out) if out else df.sparkSession.createDataFrame([], FINDING)


# --- detectors over groups of rows or several columns -------------------------


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): every column counted in one shuffle, summed map-side first."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("cell"))
    return cells.groupBy("cell.column_name", "cell.value").agg(F.count(F.lit(1)).alias("n"))


def few_valued(df: DataFrame, columns: list[str], limit: int) -> list[str]:
    """Columns with at most *limit* distinct values; only those near it are counted exactly."""
    if not columns:
        return []
    rough = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first().asDict()
    near = [c for c in columns if limit * 0.8 <= rough[c] <= limit * 1.2]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first().asDict() if near else {}
    return [c for c in columns if exact.get(c, rough[c]) <= limit]


def case_variants(df: DataFrame, columns: list[str] | None = None, max_values: int = 200) -> DataFrame:
    """Columns whose categories are spelled in more than one way."""
    names = few_valued(df, columns or clean.string_columns(df), max_values)
    if not names:
        return df.sparkSession.createDataFrame([], FINDING)
    spellings = column_values(df, names).where("value is not null").withColumn("key", tx.category_key("value"))
    groups = spellings.groupBy("column_name", "key").agg(
        F.count(F.lit(1)).alias("ways"), F.sum("n").alias("n"), F.min("value").alias("a"), F.max("value").alias("b")
    ).where("ways > 1")
    found = groups.groupBy("column_name").agg(F.sum("n").alias("n"), F.min_by(F.array("a", "b"), "key").alias("evidence"))
    return found.select(
        F.lit("inconsistent_categories").alias("kind"), "column_name", F.lit("high").alias("severity"), "n", "evidence",
        F.lit("harmonize_categories").alias("suggested_op"),
        F.create_map().cast("map<string,string>").alias("suggested_params"), F.lit(True).alias("auto_fixable"),
    )


def duplicate_row_finding(df: DataFrame) -> DataFrame:
    copies = duplicate_counts(df, [c for c in df.columns if not c.startswith("_")])
    return copies.where("later_copies > 0").select(
        F.lit("duplicate_rows").alias("kind"), F.lit("").alias("column_name"), F.lit("high").alias("severity"),
        F.col("later_copies").alias("n"), F.array().cast("array<string>").alias("evidence"),
        F.lit("drop_duplicate_rows").alias("suggested_op"),
        F.create_map().cast("map<string,string>").alias("suggested_params"), F.lit(True).alias("auto_fixable"),
    )


def _canonical(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, T.StringType):
        return F.when(~tx.is_placeholder(c), tx.category_key(c))
    return F.col(c).cast("string")


def grain_columns(df: DataFrame, key: str) -> DataFrame:
    """Per other column: the share of repeated key groups in which it is constant,
    and in which it varies.  Min and max tell a constant group, so no group is gathered."""
    others = [c for c in df.columns if c != key and not c.startswith("_")]
    text = df.select(_canonical(df, key).alias("__k"), *[F.coalesce(_canonical(df, c), F.lit("\u0000")).alias(c) for c in others])
    groups = text.where(F.col("__k").isNotNull()).groupBy("__k").agg(
        F.count(F.lit(1)).alias("__n"), *[(F.min(c) == F.max(c)).alias(c) for c in others]).where("__n > 1")
    shares = groups.agg(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias("constant_share")) for i, c in enumerate(others)]).alias("s"))
    return shares.select(F.inline("s")).where("constant_share is not null").select(
        "position", "column_name", "constant_share", (1 - F.col("constant_share")).alias("varying_share"),
        F.when(F.col("constant_share") >= 0.9, "header").when(1 - F.col("constant_share") >= 0.5, "line").otherwise("other")
        .alias("grain"),
    )


def candidate_keys(df: DataFrame, declared: set[str]) -> list[str]:
    names = [c for c in df.columns if not c.startswith("_") and (c in declared or re.search(ID_NAME, c))]
    if not names:
        return []
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.count_distinct(c).alias("d")).alias(c) for c in names]).first()
    return sorted(c for c in names if row[c]["n"] and row[c]["d"] > max(1, row[c]["n"] * 0.5))


def duplicate_keys(df: DataFrame, declared: set[str] = frozenset()) -> DataFrame:
    """Repeated business keys, told apart from a table at line-item grain."""
    out = [df.sparkSession.createDataFrame([], FINDING)]
    others = len([c for c in df.columns if not c.startswith("_")]) - 1
    for key in candidate_keys(df, declared):
        grains = grain_columns(df, key).groupBy().agg(
            F.count_if(F.col("grain") == "header").alias("header"), F.count_if(F.col("varying_share") >= 0.5).alias("line"),
        ).first()
        lines = bool(grains["header"] and grains["line"] >= 2 and grains["line"] / max(others, 1) >= 1 / 3)
        copies = duplicate_counts(df.where(F.col(key).isNotNull()), [key]).where("later_copies > 0")
        out.append(copies.select(
            F.lit("line_item_grain" if lines else "duplicate_business_key").alias("kind"), F.lit(key).alias("column_name"),
            F.lit("info" if lines else "high").alias("severity"), F.col("later_copies").alias("n"),
            F.array().cast("array<string>").alias("evidence"),
            F.lit("" if lines else "flag_duplicate_keys").alias("suggested_op"),
            F.create_map().cast("map<string,string>").alias("suggested_params"), F.lit(False).alias("auto_fixable"),
        ))
    return union_all(out)


def arithmetic_violations(shares: DataFrame) -> DataFrame:
    """The first identity per result column that holds for most rows but not all."""
    most = shares.where("n >= 8 and share >= 0.75 and share < 1.0")
    first = Window.partitionBy("result").orderBy(F.when(F.col("operator") == "*", 0).otherwise(1), "left", "right")
    return most.withColumn("k", F.row_number().over(first)).where("k = 1").select(
        "result", "operator", "left", "right", rnd(F.col("share"), 4).alias("share"), (F.col("n") - F.col("hits")).alias("violations"))


def column_identities(shares: DataFrame) -> DataFrame:
    """Identities that hold for over 90 % of rows, one result per pair of inputs."""
    good = shares.where("n >= 5 and share > 0.9")
    first = Window.partitionBy("operator", "left", "right").orderBy("position")
    return good.withColumn("k", F.row_number().over(first)).where("k = 1").select(
        "result", "operator", "left", "right", rnd(F.col("share") * 100, 1).alias("match_pct"))


def detect_defects(df: DataFrame, *, keys: set[str] = frozenset(), as_of: str | None = None) -> DataFrame:
    """Every finding of a table, most severe first."""
    numbers = [c for c, k in df.dtypes if (k in ("double", "float", "int", "bigint", "smallint", "tinyint") or k.startswith("decimal")) and not c.startswith("_")]
    texts = [c for c, k in df.dtypes if k == "string" and not c.startswith("_")]
    if texts and len(numbers) + len(texts) >= 3:  # money written as text takes part, if four of five values read as numbers
        read = df.agg(*[F.try_divide(F.count(tx.parse_number(c, ".")), F.count(c)).alias(c) for c in texts]).first()
        numbers += [c for c in texts if (read[c] or 0.0) >= 0.8]
    found = [run_detectors(df, keys=keys, as_of=as_of), case_variants(df), duplicate_row_finding(df), duplicate_keys(df, keys)]
    if len(numbers) >= 3:
        broken = arithmetic_violations(identity_shares(df, numbers))
        found.append(broken.select(
            F.lit("arithmetic_violation").alias("kind"), F.col("result").alias("column_name"), F.lit("high").alias("severity"),
            F.col("violations").alias("n"),
            F.array(F.concat_ws(" ", "result", F.lit("="), "left", "operator", "right")).alias("evidence"),
            F.lit("flag_arithmetic_violation").alias("suggested_op"),
            F.create_map(F.lit("left"), "left", F.lit("right"), "right", F.lit("result"), "result", F.lit("operator"), "operator")
            .alias("suggested_params"), F.lit(False).alias("auto_fixable")))
    return by_severity(union_all(found))


def by_severity(findings: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("severity"))
    return findings.orderBy(rank, "column_name", "kind")


def plan_rows(findings: DataFrame) -> DataFrame:
    """The cleaning plan as rows: only fixable findings that change data, in safe order."""
    order = F.create_map(*[F.lit(x) for name, (spec, _) in clean.OPERATORS.items() for x in (name, spec.order)])
    usable = findings.where(
        (F.col("suggested_op") != "") & (F.col("severity") != "info")
        & (F.col("auto_fixable") | F.col("suggested_op").startswith("flag_")))
    dropped = usable.where("suggested_op = 'drop_column'").select(F.col("column_name").alias("__d")).distinct()
    kept = usable.join(dropped, F.col("column_name") == F.col("__d"), "left").where(
        "__d is null or suggested_op = 'drop_column'")
    return kept.select(
        F.try_element_at(order, F.col("suggested_op")).alias("step_order"), F.col("suggested_op").alias("op"), "column_name",
        F.col("suggested_params").alias("params"), "kind")


def plan_steps(findings: DataFrame) -> list[clean.Step]:
    """The plan as steps to run; one row per finding, so it is small."""
    rows = plan_rows(findings).orderBy("step_order", "column_name").collect()
    return [clean.Step(r["op"], (r["column_name"],) if r["column_name"] else (), _typed(dict(r["params"]))) for r in rows]


def _typed(params: dict[str, str]) -> dict:
    out: dict = dict(params)
    if "values" in out:
        out["values"] = [float(v) for v in out["values"].split(",")]
    for name in ("min", "max", "factor"):
        if name in out:
            out[name] = float(out[name])
    return out


# Operators that only change the form of a value.
LOSSLESS = ["standardize_null_placeholders", "trim_whitespace", "parse_numeric", "parse_datetime", "parse_boolean", "cast_integer"]


def verdict(findings: DataFrame) -> DataFrame:
    """Is the table clean, and does a person have to look at it?"""
    real = F.col("severity") != "info"
    return findings.agg(
        (F.count_if(real) == 0).alias("is_clean"),
        (F.count_if(real & ~F.col("suggested_op").isin(LOSSLESS)) > 0).alias("needs_review"),
        F.count(F.lit(1)).alias("findings"),
    )


# --- column profile ----------------------------------------------------------

# The name parts the profile reads a meaning from.
PROFILE_DATE_NAMES = ("date", "time", "year", "month", "day")
PROFILE_ID_NAMES = ("id", "code", "key", "ord", "sku", "ref")


def column_profile(df: DataFrame) -> DataFrame:
    """Type, missing, placeholders, distinct, mismatch, outliers and moments per column."""
    columns = [c for c in df.columns if not c.startswith("_")]
    kinds = {f.name: type_label(f.dataType) for f in df.schema.fields}
    texts = [c for c in columns if kinds[c] == "string"]
    numbers = [c for c in columns if kinds[c] in ("integer", "float")]
    quartiles = exact_quantiles(df, numbers, [0.25, 0.75]) if numbers else {}

    def moments(c: str) -> list[Column]:
        v = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        n = F.count(v)
        skew = F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
        q1, q3 = quartiles.get(c, (None, None))
        fence = 1.5 * (q3 - q1) if q1 is not None else 0
        far = F.max((v < q1 - fence) | (v > q3 + fence)) if fence else F.lit(False)
        return [F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                F.coalesce(F.stddev_samp(v), F.when(n == 1, 0.0)).alias("std"), skew.alias("skewness"),
                (F.coalesce(far, F.lit(False)) & (n >= 4)).alias("outliers")]

    stats = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.count(F.lit(1)).alias("rows"),
            F.count(F.col(c)).alias("present"),
            (F.count_if(tx.is_placeholder(c)) if c in texts else F.lit(0).cast("long")).alias("placeholders"),
            (F.count(F.col(c).try_cast("double")) if c in texts else F.lit(None).cast("long")).alias("numeric_texts"),
            (F.coalesce(F.round(F.avg(F.when(F.col(c).isNotNull(), tx.has_arabic(c).cast("int"))), 3), F.lit(0.0))
             if c in texts else F.lit(0.0)).alias("arabic_ratio"), *moments(c),
        ) for c in columns]).alias("s")).select(F.inline("s"))
    distinct = column_values(df, columns).where(F.col("value").isNotNull()).withColumn(
        "word", F.col("column_name").isin(texts) & tx.is_placeholder("value")).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("all_distinct"), F.count_if(~F.col("word")).alias("distinct"))
    share = F.col("numeric_texts") / F.nullif(F.col("present"), F.lit(0))
    ratio = F.col("all_distinct") / F.nullif(F.col("present"), F.lit(0))
    name = F.lower(F.trim("column_name"))

    def has(parts: tuple[str, ...]) -> Column:
        return F.rlike(name, F.lit("|".join(parts)))

    inferred = (
        F.when(has(PROFILE_DATE_NAMES), "date").when(has(PROFILE_ID_NAMES) & (ratio > 0.5), "id")
        .when(F.col("kind") == "boolean", "boolean").when(F.col("kind").isin("integer", "float"), "numeric")
        .when(F.col("present") == 0, "unknown").when((share > 0.8) & (F.col("all_distinct") > 2), "numeric")
        .when((ratio < 0.05) | (F.col("all_distinct") < 25), "categorical").otherwise("text"))
    missing_n = F.col("rows") - F.col("present") + F.col("placeholders")
    return stats.join(distinct, "column_name", "left").select(
        "column_name", inferred.alias("inferred_type"), missing_n.alias("missing_count"),
        rnd(missing_n / F.nullif(F.col("rows"), F.lit(0)) * 100, 2).alias("missing_pct"),
        F.col("placeholders").alias("placeholder_count"), F.coalesce("distinct", F.lit(0)).alias("unique_count"),
        F.coalesce((share > 0.3) & (share < 1.0), F.lit(False)).alias("type_mismatch"), F.col("outliers").alias("has_outliers"),
        *[rnd(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "std", "skewness")], "arabic_ratio")


def samples_per_column(df: DataFrame, limit: int = 5) -> DataFrame:
    """The smallest distinct real values of every column."""
    columns = [c for c in df.columns if not c.startswith("_")]
    first = Window.partitionBy("column_name").orderBy("value")
    return column_values(df, columns).where(F.col("value").isNotNull() & ~tx.is_placeholder("value")).withColumn(
        "k", F.row_number().over(first)).where(F.col("k") <= limit).select("column_name", "k", "value")


def profile_is_clean(profile: DataFrame, duplicate_rows: int) -> DataFrame:
    return profile.agg(
        (F.bool_and((F.col("missing_count") == 0) & (F.col("placeholder_count") == 0) & ~F.col("type_mismatch"))
         & F.lit(duplicate_rows == 0)).alias("is_clean"))
