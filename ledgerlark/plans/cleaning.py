"""Text functions, cleaning operators, detectors and invariants over a dirty view of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import text as tx
from ledgerlark.functions.numbers import rnd
from ledgerlark.functions.scale import dealt, materialise
from ledgerlark.operators import clean, detect, identities, invariants
from ledgerlark.operators.clean import Step
from ledgerlark.plans.registry import query
from ledgerlark.plans.tables import table

_PLAIN = "cast(cast(o_totalprice as decimal(18,2)) as {s})"

#: column -> (Spark expression, DuckDB expression); one string where both read it alike
DIRTY = {
    "_rid": "o_orderkey",
    "price": (
        "case o_orderkey % 8 when 0 then concat('$', format_number(o_totalprice, 2)) "
        "when 1 then concat('(', format_number(o_totalprice, 2), ')') when 2 then concat(" + _PLAIN.format(s="string") + ", ' USD') "
        "when 3 then concat(cast(o_orderkey % 50 as string), '%') when 4 then 'UNKNOWN' "
        "when 5 then concat('−', " + _PLAIN.format(s="string") + ") when 6 then concat('A', cast(o_custkey as string)) "
        "else " + _PLAIN.format(s="string") + " end",
        "case o_orderkey % 8 when 0 then '$' || format('{:,.2f}', o_totalprice) "
        "when 1 then '(' || format('{:,.2f}', o_totalprice) || ')' when 2 then " + _PLAIN.format(s="varchar") + " || ' USD' "
        "when 3 then cast(o_orderkey % 50 as varchar) || '%' when 4 then 'UNKNOWN' "
        "when 5 then '−' || " + _PLAIN.format(s="varchar") + " when 6 then 'A' || cast(o_custkey as varchar) "
        "else " + _PLAIN.format(s="varchar") + " end",
    ),
    "amount_text": ("concat('€', " + _PLAIN.format(s="string") + ")", "'€' || " + _PLAIN.format(s="varchar")),
    "when_text": (
        "case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd/MM/yyyy') "
        "when 2 then 'n/a' when 3 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') else date_format(o_orderdate, 'dd.MM.yyyy') end",
        "case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y') "
        "when 2 then 'n/a' when 3 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') else strftime(o_orderdate, '%d.%m.%Y') end",
    ),
    "day_text": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "serial": ("cast(datediff(o_orderdate, date'1899-12-30') as double)", "cast(cast(o_orderdate as date) - date '1899-12-30' as double)"),
    "is_paid": "case o_orderkey % 6 when 0 then 'Yes' when 1 then 'no' when 2 then ' TRUE' when 3 then '0' when 4 then 'نعم' else 'maybe' end",
    "active": "case when o_orderkey % 3 = 0 then 'Y' else 'n' end",
    "category": (
        "case o_orderkey % 7 when 0 then lower(o_orderpriority) when 1 then concat('  ', o_orderpriority, ' ') "
        "when 2 then concat(o_orderpriority, '!') else o_orderpriority end",
        "case o_orderkey % 7 when 0 then lower(o_orderpriority) when 1 then '  ' || o_orderpriority || ' ' "
        "when 2 then o_orderpriority || '!' else o_orderpriority end",
    ),
    "score": "case when o_orderkey % 40 = 0 then -999.0 else cast(o_custkey % 50 as double) + 0.5 end",
    "gap": "case when o_orderkey % 9 = 0 then null else o_totalprice end",
    "gap_text": "case when o_orderkey % 4 = 0 then null else o_orderstatus end",
    "arabic": (
        "case o_orderkey % 3 when 0 then concat('مُحَمَّد  ', 'إلى ٢٠٢', cast(o_orderkey % 10 as string)) "
        "when 1 then 'أحمـــد في القاهرة، ١٢٫٥' else 'plain text' end",
        "case o_orderkey % 3 when 0 then 'مُحَمَّد  ' || 'إلى ٢٠٢' || cast(o_orderkey % 10 as varchar) "
        "when 1 then 'أحمـــد في القاهرة، ١٢٫٥' else 'plain text' end",
    ),
    "customer_id": "cast(o_custkey as double)",
    "quantity": "cast(o_custkey % 10 + 1 as double)",
    "unit": "o_totalprice",
    "total": "case when o_orderkey % 10 = 0 then (o_custkey % 10 + 1) * o_totalprice * 1.5 else (o_custkey % 10 + 1) * o_totalprice end",
    "blank": ("cast(null as string)", "cast(null as varchar)"),
    "same": "'x'",
    "ordered_at": "o_orderdate",
}


def _spark(c: str) -> str:
    return DIRTY[c] if isinstance(DIRTY[c], str) else DIRTY[c][0]


def _duck(c: str) -> str:
    return DIRTY[c] if isinstance(DIRTY[c], str) else DIRTY[c][1]


def dirty(spark, sf, *columns):
    names = ["_rid", *columns] if columns else list(DIRTY)
    return table(spark, sf, "orders").select(*[F.expr(_spark(c)).alias(c) for c in names])


DIRTY_SQL = "d AS (SELECT " + ", ".join(f"{_duck(c)} AS {c}" for c in DIRTY) + " FROM orders)"
W = f"WITH {DIRTY_SQL}"

TOKENS = ", ".join("'" + t + "'" for t in tx.NULL_TOKENS)
_FOLD = "'أإآٱى٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹،؛؟٫٬'"
_FOLDED = "'ااااي01234567890123456789,;?.,'"


def norm(e: str) -> str:
    """Arabic normal form in DuckDB."""
    bare = f"regexp_replace({e}, '[\\x{{0610}}-\\x{{061A}}\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}\\x{{0640}}]', '', 'g')"
    return f"trim(regexp_replace(translate({bare}, {_FOLD}, {_FOLDED}), '\\s+', ' ', 'g'))"


def key(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({norm(e)}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def is_missing(e: str) -> str:
    return f"coalesce(lower({norm(e)}) IN ({TOKENS}), false)"


def number(e: str, european: str = "false") -> str:
    """Text to number in DuckDB."""
    raw = f"trim(replace({e}, '−', '-'))"
    inner = f"(CASE WHEN {raw} LIKE '(%)' THEN trim({raw}[2:-2]) ELSE {raw} END)"
    bare = f"trim(regexp_replace({inner}, '[$€£¥₹﷼%٪\\s]|\\b(usd|eur|gbp|egp|sar|aed|kwd|jod|qar|bhd|try|inr)\\b', '', 'gi'))"
    plain = f"(CASE WHEN {european} OR regexp_matches({bare}, '^[+-]?[0-9]+,[0-9]{{1,2}}$') THEN replace(replace({bare}, '.', ''), ',', '.') ELSE replace({bare}, ',', '') END)"
    value = f"(CASE WHEN regexp_matches({bare}, '^[+-]?[0-9.,]*[0-9][0-9.,]*([eE][+-]?[0-9]+)?$') AND NOT {is_missing(raw)} THEN TRY_CAST({plain} AS DOUBLE) END)"
    pct = f"(CASE WHEN contains({inner}, '%') THEN {value} / 100 ELSE {value} END)"
    return f"(CASE WHEN {raw} LIKE '(%)' THEN -{pct} ELSE {pct} END)"


def when(e: str, day_first: str = "true") -> str:
    """Text to timestamp in DuckDB."""
    order = f"CASE WHEN {day_first} THEN ['%d-%m-%Y', '%m-%d-%Y'] ELSE ['%m-%d-%Y', '%d-%m-%Y'] END"
    dashed = f"regexp_replace(trim({e}), '^(\\d{{1,4}})[/.](\\d{{1,2}})[/.]', '\\1-\\2-')"
    del order
    return (f"(CASE WHEN regexp_matches({dashed}, '^\\d{{4}}-') THEN coalesce(try_strptime({dashed}, '%Y-%m-%d'), try_strptime({dashed}, '%Y-%m-%d %H:%M:%S')) "
            f"ELSE CASE WHEN {day_first} THEN coalesce(try_strptime({dashed}, '%d-%m-%Y'), try_strptime({dashed}, '%m-%d-%Y')) "
            f"ELSE coalesce(try_strptime({dashed}, '%m-%d-%Y'), try_strptime({dashed}, '%d-%m-%Y')) END END)")


# --- scalar functions ---------------------------------------------------------


@query("H1_is_placeholder", f"{W} SELECT _rid, {is_missing('price')} AS price, {is_missing('when_text')} AS when_text, {is_missing('arabic')} AS arabic FROM d")
def is_placeholder(spark, sf):
    d = dirty(spark, sf, "price", "when_text", "arabic")
    return d.select("_rid", *[tx.is_placeholder(c).alias(c) for c in ("price", "when_text", "arabic")])


@query("H2_decimal_separator", f"""{W}, s AS (SELECT price AS a, CASE WHEN _rid % 3 = 0 THEN replace(replace(replace(price, ',', ';'), '.', ','), ';', '.')
  ELSE '1' END AS b FROM d)
SELECT CASE WHEN count(*) FILTER (WHERE regexp_matches(a, '{tx.EUROPEAN}')) > count(*) FILTER (WHERE regexp_matches(a, '{tx.ANGLO}')) THEN ',' ELSE '.' END AS price,
       CASE WHEN count(*) FILTER (WHERE regexp_matches(b, '{tx.EUROPEAN}')) > count(*) FILTER (WHERE regexp_matches(b, '{tx.ANGLO}')) THEN ',' ELSE '.' END AS european FROM s""")
def decimal_separator(spark, sf):
    d = dirty(spark, sf, "price").withColumn(
        "european", F.expr("case when _rid % 3 = 0 then translate(price, ',.', '.,') else '1' end"))
    return d.agg(tx.decimal_separator("price").alias("price"), tx.decimal_separator("european").alias("european"))


@query("H3_parse_number", f"{W} SELECT _rid, round({number('price')}, 4) AS price, round({number('amount_text')}, 4) AS amount FROM d")
def parse_number(spark, sf):
    d = dirty(spark, sf, "price", "amount_text")
    return d.select("_rid", rnd(tx.parse_number("price"), 4).alias("price"), rnd(tx.parse_number("amount_text"), 4).alias("amount"))


def _day_first_sql(c: str) -> str:
    a, b = (f"TRY_CAST(regexp_extract({c}, '{tx.DAY_MONTH_YEAR}', {i}) AS INT)" for i in (1, 2))
    return f"""CASE WHEN count(*) FILTER (WHERE {a} > 12 AND {b} <= 12) > 0 AND count(*) FILTER (WHERE {b} > 12 AND {a} <= 12) = 0 THEN true
      WHEN count(*) FILTER (WHERE {b} > 12 AND {a} <= 12) > 0 AND count(*) FILTER (WHERE {a} > 12 AND {b} <= 12) = 0 THEN false
      WHEN count(*) FILTER (WHERE regexp_matches({c}, '{tx.DAY_MONTH_YEAR}')) > 0 THEN NULL ELSE false END"""


@query("H4_day_first", f"""{W}, s AS (SELECT when_text AS a, strftime(ordered_at, '%m/%d/%Y') AS b, strftime(ordered_at, '%m/%m/%Y') AS c, day_text AS e FROM d)
SELECT {_day_first_sql('a')} AS european, {_day_first_sql('b')} AS american, {_day_first_sql('c')} AS ambiguous, {_day_first_sql('e')} AS iso FROM s""")
def day_first(spark, sf):
    d = dirty(spark, sf, "when_text", "day_text", "ordered_at")
    return d.agg(
        tx.day_first("when_text").alias("european"), tx.day_first(F.date_format("ordered_at", "MM/dd/yyyy")).alias("american"),
        tx.day_first(F.date_format("ordered_at", "MM/MM/yyyy")).alias("ambiguous"), tx.day_first("day_text").alias("iso"))


@query("H5_parse_timestamp", f"{W} SELECT _rid, {when('when_text')} AS mixed, CAST(ordered_at AS TIMESTAMP) AS serial FROM d")
def parse_timestamp(spark, sf):
    d = dirty(spark, sf, "when_text", "serial")
    reading = clean.date_reading(d, ["when_text", "serial"])
    return d.select("_rid", tx.parse_timestamp("when_text", reading["when_text"]["day_first"]).alias("mixed"),
                    tx.timestamp_of_number("serial", reading["serial"]["kind"]).alias("serial"))


_BOOL = """CASE WHEN lower(trim({0})) IN ('true', 't', 'yes', 'y', '1', '1.0', 'on', 'نعم', 'صح', 'صحيح') THEN true
WHEN lower(trim({0})) IN ('false', 'f', 'no', 'n', '0', '0.0', 'off', 'لا', 'خطا', 'خطأ') THEN false END"""


@query("H6_parse_boolean", f"{W} SELECT _rid, {_BOOL.format('is_paid')} AS is_paid, {_BOOL.format('active')} AS active FROM d")
def parse_boolean(spark, sf):
    return dirty(spark, sf, "is_paid", "active").select("_rid", tx.parse_boolean("is_paid").alias("is_paid"), tx.parse_boolean("active").alias("active"))


@query("H7_category_key", f"{W} SELECT _rid, {key('category')} AS category, {key('arabic')} AS arabic FROM d")
def category_key(spark, sf):
    return dirty(spark, sf, "category", "arabic").select("_rid", tx.category_key("category").alias("category"), tx.category_key("arabic").alias("arabic"))


@query("H8_normalize_arabic", f"{W} SELECT _rid, {norm('arabic')} AS arabic FROM d")
def normalize_arabic(spark, sf):
    return dirty(spark, sf, "arabic").select("_rid", tx.normalize_arabic("arabic").alias("arabic"))


@query("H9_arabic_ratio", f"""{W} SELECT round(avg(CASE WHEN regexp_matches(arabic, '\\p{{Arabic}}') THEN 1.0 ELSE 0 END), 3) AS arabic,
  round(avg(CASE WHEN regexp_matches(is_paid, '\\p{{Arabic}}') THEN 1.0 ELSE 0 END), 3) AS is_paid, 0.0::DOUBLE AS category FROM d""")
def arabic_ratio(spark, sf):
    return tx.arabic_ratios(dirty(spark, sf, "arabic", "is_paid", "category"), ["arabic", "is_paid", "category"])


@query("H10_normalize_columns", f"{W} SELECT _rid, {norm('arabic')} AS arabic, {norm('is_paid')} AS is_paid, category FROM d")
def normalize_columns(spark, sf):
    return tx.normalize_arabic_columns(dirty(spark, sf, "arabic", "is_paid", "category"))


@query("H11_remove_stop_words", f"""{W}, s AS (SELECT _rid, arabic, array_to_string(list_filter(string_split(trim(regexp_replace(arabic, '\\s+', ' ', 'g')), ' '),
  lambda w: w NOT IN ({', '.join("'" + t + "'" for t in tx.ARABIC_STOP_WORDS)})), ' ') AS kept FROM d)
SELECT _rid, CASE WHEN kept = '' THEN arabic ELSE kept END AS text FROM s""")
def remove_stop_words(spark, sf):
    return dirty(spark, sf, "arabic").select("_rid", tx.remove_stop_words("arabic").alias("text"))


@query("H12_key_normal_form", f"""{W} SELECT _rid, CAST(CAST(customer_id AS BIGINT) AS VARCHAR) AS customer_key, lower({norm('category')}) AS category_key,
  CAST(_rid AS VARCHAR) AS order_key FROM d""")
def key_normal_form(spark, sf):
    d = dirty(spark, sf, "customer_id", "category").withColumn("order_text", F.expr("concat(' ', cast(_rid as string), if(_rid % 2 = 0, '.0', ''))"))
    numeric = d.agg(*[tx.all_numeric(c).alias(c) for c in ("customer_id", "category", "order_text")]).first().asDict()
    form = {c: (tx.key_number if numeric[c] else tx.key_text)(c) for c in numeric}
    return d.select("_rid", form["customer_id"].alias("customer_key"), form["category"].alias("category_key"), form["order_text"].alias("order_key"))


# --- cleaning operators -------------------------------------------------------


def run(d, op, columns, **params):
    spec, fn = clean.OPERATORS[op]
    error = clean.step_error(Step(op, tuple(columns), params), d.columns)
    if error:
        raise ValueError(error)
    return fn(d, list(columns), params)


@query("I1_standardize_null_placeholders", f"""{W} SELECT _rid, CASE WHEN NOT {is_missing('price')} THEN price END AS price,
  CASE WHEN NOT {is_missing('when_text')} THEN when_text END AS when_text FROM d""")
def i1(spark, sf):
    return run(dirty(spark, sf, "price", "when_text"), "standardize_null_placeholders", ["price", "when_text"])


@query("I2_replace_sentinels", f"{W} SELECT _rid, CASE WHEN score <> -999 THEN score END AS score FROM d")
def i2(spark, sf):
    return run(dirty(spark, sf, "score"), "replace_sentinels", ["score"], values=[-999])


@query("I3_trim_whitespace", f"{W} SELECT _rid, trim(regexp_replace(category, '\\s+', ' ', 'g')) AS category, trim(regexp_replace(arabic, '\\s+', ' ', 'g')) AS arabic FROM d")
def i3(spark, sf):
    return run(dirty(spark, sf, "category", "arabic"), "trim_whitespace", ["category", "arabic"])


@query("I4_parse_numeric", f"{W} SELECT _rid, round({number('price')}, 4) AS price FROM d")
def i4(spark, sf):
    return run(dirty(spark, sf, "price"), "parse_numeric", ["price"]).withColumn("price", rnd(F.col("price"), 4))


@query("I5_parse_datetime", f"{W} SELECT _rid, {when('when_text')} AS when_text, CAST(ordered_at AS TIMESTAMP) AS day_text FROM d")
def i5(spark, sf):
    return run(dirty(spark, sf, "when_text", "day_text"), "parse_datetime", ["when_text", "day_text"])


@query("I6_parse_boolean", f"{W} SELECT _rid, {_BOOL.format('is_paid')} AS is_paid FROM d")
def i6(spark, sf):
    return run(dirty(spark, sf, "is_paid"), "parse_boolean", ["is_paid"])


@query("I7_cast_integer", f"{W} SELECT _rid, CAST(customer_id AS BIGINT) AS customer_id, score FROM d")
def i7(spark, sf):
    return run(dirty(spark, sf, "customer_id", "score"), "cast_integer", ["customer_id", "score"])


@query("I8_impute", f"""{W} SELECT _rid, coalesce(gap, (SELECT quantile_cont(gap, 0.5) FROM d)) AS median,
  round(coalesce(gap, (SELECT avg(gap) FROM d)), 4) AS mean, coalesce(gap, 0) AS constant,
  coalesce(gap_text, (SELECT gap_text FROM d WHERE gap_text IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, gap_text LIMIT 1)) AS mode, blank FROM d""")
def i8(spark, sf):
    d = dirty(spark, sf, "gap", "gap_text", "blank").select("_rid", F.col("gap").alias("median"), F.col("gap").alias("mean"),
                                                           F.col("gap").alias("constant"), F.col("gap_text").alias("mode"), "blank")
    for strategy in ("median", "mean", "mode"):
        d = run(d, "impute", [strategy, "blank"], strategy=strategy)
    return run(d, "impute", ["constant"], strategy="constant", value=0).withColumn("mean", rnd(F.col("mean"), 4))


@query("E13_fill_along", f"""{W} SELECT _rid, last_value(gap IGNORE NULLS) OVER (ORDER BY _rid ROWS UNBOUNDED PRECEDING) AS forward,
  first_value(gap_text IGNORE NULLS) OVER (ORDER BY _rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM d""")
def e13(spark, sf):
    d = dirty(spark, sf, "gap", "gap_text").withColumnsRenamed({"gap": "forward", "gap_text": "backward"})
    return run(run(d, "impute", ["forward"], strategy="ffill"), "impute", ["backward"], strategy="bfill")


@query("I9_flag_missing", f"{W} SELECT _rid, gap, gap IS NULL AS gap__is_missing FROM d")
def i9(spark, sf):
    return run(dirty(spark, sf, "gap"), "flag_missing", ["gap"])


@query("I10_harmonize_case", f"""{W} SELECT _rid, lower(category) AS lower_c, upper(category) AS upper_c,
  array_to_string(list_transform(regexp_extract_all(category, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title_c FROM d""")
def i10(spark, sf):
    d = dirty(spark, sf, "category").select("_rid", *[F.col("category").alias(f"{s}_c") for s in ("lower", "upper", "title")])
    for style in ("lower", "upper", "title"):
        d = run(d, "harmonize_case", [f"{style}_c"], style=style)
    return d


@query("I11_harmonize_categories", f"""{W}, k AS (SELECT category AS v, {key('category')} AS k, count(*) AS n FROM d WHERE category IS NOT NULL GROUP BY ALL),
m AS (SELECT k, arg_min(v, (-n, v)) AS canonical FROM k GROUP BY k HAVING count(*) > 1)
SELECT _rid, coalesce(canonical, category) AS category FROM d LEFT JOIN m ON m.k = {key('category')}""")
def i11(spark, sf):
    return run(dirty(spark, sf, "category"), "harmonize_categories", ["category"])


@query("I12_replace_values", f"{W} SELECT _rid, CASE gap_text WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE gap_text END AS gap_text FROM d")
def i12(spark, sf):
    return run(dirty(spark, sf, "gap_text"), "replace_values", ["gap_text"], mapping={"F": "finished", "O": "open"})


@query("I13_drop_duplicate_rows", f"{W} SELECT min(_rid) AS _rid, customer_id, gap_text FROM d GROUP BY customer_id, gap_text")
def i13(spark, sf):
    return run(dirty(spark, sf, "customer_id", "gap_text"), "drop_duplicate_rows", [])


@query("I14_drop_duplicate_keys", f"{W} SELECT * FROM (SELECT _rid, customer_id, unit FROM d) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _rid DESC) = 1")
def i14(spark, sf):
    return run(dirty(spark, sf, "customer_id", "unit"), "drop_duplicate_keys", ["customer_id"], keep="last")


@query("E12_keep_first", f"{W} SELECT * FROM (SELECT _rid, customer_id, unit FROM d) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _rid) = 1")
def e12(spark, sf):
    return run(dirty(spark, sf, "customer_id", "unit"), "drop_duplicate_keys", ["customer_id"], keep="first")


@query("I15_flag_duplicate_keys", f"""{W} SELECT _rid, customer_id, gap_text, count(*) OVER (PARTITION BY customer_id, gap_text) > 1 AS customer_id_gap_text__is_duplicate_key FROM d""")
def i15(spark, sf):
    return run(dirty(spark, sf, "customer_id", "gap_text"), "flag_duplicate_keys", ["customer_id", "gap_text"])


@query("E11_flag_duplicates_null_keys", f"{W} SELECT _rid, gap_text, count(*) OVER (PARTITION BY gap_text) > 1 AS copied FROM d")
def e11(spark, sf):
    return run(dirty(spark, sf, "gap_text"), "flag_duplicate_keys", ["gap_text"], flag_column="copied")


@query("I16_drop_column", f"{W} SELECT _rid, category FROM d")
def i16(spark, sf):
    return run(dirty(spark, sf, "category", "blank", "same"), "drop_column", ["blank", "same"])


@query("I17_flag_outliers", f"""{W}, q AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.75) AS b, avg(score) AS m, stddev_samp(score) AS s,
  quantile_cont(score, 0.5) AS med FROM d), mad AS (SELECT quantile_cont(abs(score - med), 0.5) AS mad FROM d, q)
SELECT _rid, score < a - 1.5 * (b - a) OR score > b + 1.5 * (b - a) AS iqr, abs(score - m) / s > 3 AS zscore,
  abs(0.6745 * (score - med) / mad) > 3 AS modified_zscore FROM d, q, mad""")
def i17(spark, sf):
    d = dirty(spark, sf, "score")
    for method in ("iqr", "zscore", "modified_zscore"):
        d = run(d, "flag_outliers", ["score"], method=method).withColumnRenamed("score__is_outlier", method)
    return d.drop("score")


@query("I18_clip_range", f"{W} SELECT _rid, CASE WHEN gap IS NULL THEN NULL ELSE least(greatest(gap, 50000), 300000) END AS gap FROM d")
def i18(spark, sf):
    return run(dirty(spark, sf, "gap"), "clip_range", ["gap"], min=50_000, max=300_000)


@query("I19_flag_range_violation", f"{W} SELECT _rid, gap, coalesce(gap < 50000 OR gap > 300000, false) AS gap__out_of_range FROM d")
def i19(spark, sf):
    return run(dirty(spark, sf, "gap"), "flag_range_violation", ["gap"], min=50_000, max=300_000)


_ID = {"left": "quantity", "right": "unit", "result": "total"}


@query("I20_flag_arithmetic_violation", f"{W} SELECT _rid, coalesce(abs(quantity * unit - total) / nullif(abs(total), 0) > 0.01, false) AS total__mismatch FROM d")
def i20(spark, sf):
    return run(dirty(spark, sf, "quantity", "unit", "total"), "flag_arithmetic_violation", [], **_ID).select("_rid", "total__mismatch")


@query("I21_recompute_arithmetic", f"""{W} SELECT _rid, round(CASE WHEN abs(quantity * unit - total) / nullif(abs(total), 0) > 0.01 THEN quantity * unit
  ELSE total END, 2) AS total FROM d""")
def i21(spark, sf):
    return run(dirty(spark, sf, "quantity", "unit", "total"), "recompute_arithmetic", [], **_ID).select("_rid", rnd(F.col("total")).alias("total"))


PLAN = [
    Step("standardize_null_placeholders", ("price", "when_text")), Step("trim_whitespace", ("category",)),
    Step("parse_numeric", ("price",)), Step("impute", ("gap",), {"strategy": "constant", "value": 0}),
    Step("drop_duplicate_keys", ("customer_id", "gap_text")), Step("parse_boolean", ("customer_id",)), Step("no_such_operator", ("gap",)),
]


def _planned(spark, sf):
    d = dirty(spark, sf, "price", "when_text", "category", "gap", "gap_text", "customer_id")
    return d, clean.apply_plan(d, PLAN, protected={"customer_id"})


@query("I22_plan_ledger", f"""{W}, k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY customer_id, gap_text ORDER BY _rid) = 1)
SELECT 'standardize_null_placeholders' AS op, true AS applied, (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM d) AS rows_after,
  count(*) FILTER (WHERE {is_missing('price')}) + count(*) FILTER (WHERE {is_missing('when_text')}) AS cells_changed, 0 AS nulls_filled,
  count(*) FILTER (WHERE {is_missing('price')}) + count(*) FILTER (WHERE {is_missing('when_text')}) AS nulls_introduced FROM d
UNION ALL SELECT 'trim_whitespace', true, count(*), count(*), count(*) FILTER (WHERE category <> trim(regexp_replace(category, '\\s+', ' ', 'g'))), 0, 0 FROM d
UNION ALL SELECT 'parse_numeric', true, count(*), count(*), count(*) FILTER (WHERE NOT {is_missing('price')} AND
  ({number('price')} IS NULL OR TRY_CAST(price AS DOUBLE) IS NULL OR TRY_CAST(price AS DOUBLE) <> {number('price')})), 0,
  count(*) FILTER (WHERE NOT {is_missing('price')} AND {number('price')} IS NULL) FROM d
UNION ALL SELECT 'drop_duplicate_keys', true, (SELECT count(*) FROM d), (SELECT count(*) FROM k), 0, 0, 0
UNION ALL SELECT 'impute', true, count(*), count(*), count(*) FILTER (WHERE gap IS NULL), count(*) FILTER (WHERE gap IS NULL), 0 FROM k
UNION ALL SELECT 'parse_boolean', false, (SELECT count(*) FROM k), (SELECT count(*) FROM k), 0, 0, 0
UNION ALL SELECT 'no_such_operator', false, (SELECT count(*) FROM k), (SELECT count(*) FROM k), 0, 0, 0""")
def plan_ledger(spark, sf):
    _, (_, ledger) = _planned(spark, sf)
    return ledger.select("op", "applied", "rows_before", "rows_after", "cells_changed", "nulls_filled", "nulls_introduced")


@query("C18_cell_diff", f"""{W}, k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY customer_id, gap_text ORDER BY _rid) = 1)
SELECT 'price' AS column_name, count(*) FILTER (WHERE {number('price')} IS NULL OR TRY_CAST(price AS DOUBLE) IS NULL OR TRY_CAST(price AS DOUBLE) <> {number('price')}) AS changed,
  0 AS filled, count(*) FILTER (WHERE {number('price')} IS NULL) AS nulled FROM k
UNION ALL SELECT 'when_text', count(*) FILTER (WHERE {is_missing('when_text')}), 0, count(*) FILTER (WHERE {is_missing('when_text')}) FROM k
UNION ALL SELECT 'category', count(*) FILTER (WHERE category <> trim(regexp_replace(category, '\\s+', ' ', 'g'))), 0, 0 FROM k
UNION ALL SELECT 'gap', count(*) FILTER (WHERE gap IS NULL), count(*) FILTER (WHERE gap IS NULL), 0 FROM k
UNION ALL SELECT 'gap_text', 0, 0, 0 UNION ALL SELECT 'customer_id', 0, 0, 0""")
def cell_diff(spark, sf):
    d, (cleaned, _) = _planned(spark, sf)
    return clean.cell_diff(d, cleaned).select("column_name", "changed", "filled", "nulled")


@query("I45_change_samples", f"""{W}, t AS (SELECT 0 AS p, _rid AS rid, 'category' AS column_name, category AS before, trim(regexp_replace(category, '\\s+', ' ', 'g')) AS after FROM d
  UNION ALL SELECT 1, _rid, 'gap_text', gap_text, CASE gap_text WHEN 'F' THEN 'finished' ELSE gap_text END FROM d)
SELECT rid, column_name, before, after FROM t WHERE before IS DISTINCT FROM after QUALIFY row_number() OVER (PARTITION BY p ORDER BY rid) <= 2 ORDER BY p, rid LIMIT 5""")
def change_samples(spark, sf):
    d = dirty(spark, sf, "category", "gap_text")
    cleaned, _ = clean.apply_plan(d, [Step("trim_whitespace", ("category",)), Step("replace_values", ("gap_text",), {"mapping": {"F": "finished"}})])
    return clean.change_samples(d, cleaned)


@query("I42_validation_report", f"""{W}, k AS (SELECT _rid, customer_id, coalesce(gap, 0) AS gap FROM d QUALIFY row_number() OVER (PARTITION BY customer_id, gap ORDER BY _rid) = 1),
x AS (SELECT 'customer_id' AS column_name, 0 AS nulls_before, 0 AS nulls_after UNION ALL
  SELECT 'gap', (SELECT count(*) FROM d WHERE gap IS NULL), 0)
SELECT column_name, nulls_before, nulls_after, nulls_before - nulls_after AS nulls_reduced, NULL::BIGINT AS rows_before, NULL::BIGINT AS rows_after,
  NULL::BIGINT AS duplicates_before, NULL::BIGINT AS duplicates_after FROM x
UNION ALL SELECT '(table)', CAST(sum(nulls_before) AS BIGINT), CAST(sum(nulls_after) AS BIGINT), CAST(sum(nulls_before - nulls_after) AS BIGINT), (SELECT count(*) FROM d), (SELECT count(*) FROM k),
  (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, gap FROM d)),
  (SELECT count(*) FROM k) - (SELECT count(*) FROM (SELECT DISTINCT customer_id, gap FROM k)) FROM x""")
def validation_report(spark, sf):
    d = dirty(spark, sf, "customer_id", "gap")
    steps = [Step("drop_duplicate_rows"), Step("impute", ("gap",), {"strategy": "constant", "value": 0})]
    return invariants.validation_report(d, clean.apply_plan(d, steps)[0])


@query("I41_invariants", f"""{W} SELECT 'unauthorized_value_change' AS rule, 'unit' AS column_name, count(*) FILTER (WHERE unit <> unit * 100 AND unit >= 20000) AS n FROM d
UNION ALL SELECT 'unauthorized_null_fill', 'gap', count(*) FILTER (WHERE gap IS NULL AND unit >= 20000) FROM d
UNION ALL SELECT 'unauthorized_row_removal', NULL, count(*) FILTER (WHERE unit < 20000) FROM d
UNION ALL SELECT 'unauthorized_column_drop', 'category', 1""")
def invariants_broken(spark, sf):
    raw = dirty(spark, sf, "unit", "gap", "category", "price")
    tampered = raw.where("unit >= 20000").select("_rid", (F.col("unit") * 100).alias("unit"), F.coalesce("gap", F.lit(1.0)).alias("gap"), "price")
    return invariants.check_invariants(raw, tampered, [Step("trim_whitespace", ("price",))])


@query("G3_unjustified_removals", f"""{W}, kept AS (SELECT * FROM d WHERE unit >= 200000)
SELECT _rid, customer_id, unit FROM d WHERE unit < 200000 AND customer_id NOT IN (SELECT customer_id FROM kept)""")
def unjustified(spark, sf):
    d = dirty(spark, sf, "customer_id", "unit")
    return invariants.unjustified_removals(d, d.where("unit >= 200000"), [["customer_id"]])


@query("G4_invented_rows", f"{W} SELECT _rid, unit FROM d WHERE unit < 50000")
def invented(spark, sf):
    d = dirty(spark, sf, "unit")
    return invariants.invented_rows(d.where("unit >= 50000"), d)


# --- detectors ----------------------------------------------------------------

_FOUND = "kind, column_name, severity, n, suggested_op, auto_fixable"


def _detector(name: str, columns: list[str], sql: str, number_name: str, as_of: str | None = None, keys=frozenset()):
    body = f"{W} SELECT {_FOUND} FROM ({sql}) WHERE n > 0"

    def fn(spark, sf):
        found = detect.run_detectors(dirty(spark, sf, *columns), [name], as_of=as_of, keys=keys)
        return found.select(*[c.strip() for c in _FOUND.split(",")])

    query(number_name, body)(fn)


def _row(kind: str, column: str, severity: str, n: str, op: str, auto: str = "true", having: str = "true") -> str:
    return (f"SELECT '{kind}' AS kind, '{column}' AS column_name, {severity} AS severity, {n} AS n, '{op}' AS suggested_op, "
            f"{auto} AS auto_fixable FROM d HAVING {having}")


_TEXTS = ["price", "when_text", "category"]
_detector("placeholder_values", _TEXTS, " UNION ALL ".join(
    _row("placeholder_values", c, "'high'", f"count(*) FILTER (WHERE {is_missing(c)})", "standardize_null_placeholders") for c in _TEXTS),
    "I23_detect_placeholders")
_detector("numeric_sentinel", ["score", "unit"], _row("numeric_sentinel", "score", "'high'", "count(*) FILTER (WHERE score = -999)", "replace_sentinels"),
          "I24_detect_sentinels")
_detector("numeric_stored_as_text", ["amount_text", "price", "category"], _row(
    "numeric_stored_as_text", "amount_text", "'high'", f"count({number('amount_text')})", "parse_numeric") + " UNION ALL " + _row(
    "numeric_stored_as_text", "price", "'high'", f"count({number('price')})", "parse_numeric"), "I25_detect_numeric_as_text")
_detector("date_stored_as_text", ["when_text", "day_text", "category"], _row(
    "date_stored_as_text", "day_text", "'medium'", "count(day_text)", "parse_datetime"), "I26_detect_date_as_text")
_detector("boolean_stored_as_text", ["active", "is_paid", "category"], _row(
    "boolean_stored_as_text", "active", "'low'", "count(*)", "parse_boolean"), "I27_detect_boolean_as_text")
_detector("untrimmed_whitespace", ["category", "arabic", "price"], " UNION ALL ".join(
    _row("untrimmed_whitespace", c, "'medium'", f"count(*) FILTER (WHERE {c} <> trim(regexp_replace({c}, '\\s+', ' ', 'g')))", "trim_whitespace")
    for c in ("category", "arabic", "price")), "I28_detect_untrimmed")
_detector("missing_values", ["gap", "gap_text", "unit"], _row("missing_in_key", "gap", "'blocking'", "count(*) - count(gap)", "flag_missing", "false")
          + " UNION ALL " + _row("missing_values", "gap_text", "'medium'", "count(*) - count(gap_text)", "impute"), "I30_detect_missing",
          keys={"gap"})
_detector("future_date", ["ordered_at"], _row("future_date", "ordered_at", "'medium'", "count(*) FILTER (WHERE ordered_at > TIMESTAMP '2000-06-30')", "", "false"),
          "I32_detect_future_dates", as_of="2000-06-30 00:00:00")
_detector("integer_stored_as_float", ["customer_id", "score", "quantity"], _row(
    "integer_stored_as_float", "customer_id", "'low'", "count(*)", "cast_integer"), "I33_detect_float_integers")
_detector("mixed_types", ["price", "when_text", "category", "day_text"], " UNION ALL ".join([
    _row("mixed_types", "price", "'medium'", f"count(*) FILTER (WHERE NOT {is_missing('price')})", "", "false")]), "I34_detect_mixed_types")
_detector("extreme_values", ["score", "unit", "quantity"], """SELECT 'extreme_values' AS kind, c AS column_name, 'info' AS severity,
  count(*) FILTER (WHERE v < a - 3 * (b - a) OR v > b + 3 * (b - a)) AS n, 'flag_outliers' AS suggested_op, true AS auto_fixable
  FROM (SELECT c, v, quantile_cont(v, 0.25) OVER (PARTITION BY c) AS a, quantile_cont(v, 0.75) OVER (PARTITION BY c) AS b FROM (
    SELECT 'score' AS c, score AS v FROM d UNION ALL SELECT 'unit', unit FROM d UNION ALL SELECT 'quantity', quantity FROM d)) GROUP BY c""",
          "I35_detect_outliers")


@query("I31_detect_negatives", f"{W} SELECT 'unit price' AS column_name, 'impossible_negative' AS kind, 'high' AS severity, count(*) FILTER (WHERE score < 0) AS n FROM d")
def negatives(spark, sf):
    d = dirty(spark, sf, "score", "quantity").withColumn("unit price", F.col("score"))
    return detect.run_detectors(d, ["impossible_negative"]).select("column_name", "kind", "severity", "n")


@query("I36_detect_empty_and_constant", f"""{W} SELECT 'empty_column' AS kind, 'blank' AS column_name, count(*) AS n, true AS auto_fixable FROM d
UNION ALL SELECT 'constant_column', 'same', count(*), false FROM d""")
def empty_and_constant(spark, sf):
    found = detect.run_detectors(dirty(spark, sf, "blank", "same", "category", "unit"), ["empty_column", "constant_column"])
    return found.select("kind", "column_name", "n", "auto_fixable")


@query("I29_detect_case_variants", f"""{W}, k AS (SELECT 'category' AS c, category AS v, count(*) AS n FROM d GROUP BY ALL UNION ALL
  SELECT 'is_paid', is_paid, count(*) FROM d GROUP BY ALL), g AS (SELECT c, {key('v')} AS k, sum(n) AS n, count(*) AS ways FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT 'inconsistent_categories' AS kind, c AS column_name, 'high' AS severity, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY c""")
def case_variants(spark, sf):
    return detect.case_variants(dirty(spark, sf, "category", "is_paid", "price")).select("kind", "column_name", "severity", "n")


_LINES = "l AS (SELECT l_orderkey AS order_id, o_custkey AS customer, o_orderpriority AS priority, l_partkey AS part, l_quantity AS quantity, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


_GRAIN_COLS = ["customer", "priority", "part", "quantity", "price"]


@query("E14_grain_columns", f"WITH {_LINES}, g AS (SELECT order_id, " + ", ".join(f"count(DISTINCT {c}) <= 1 AS {c}" for c in _GRAIN_COLS)
       + " FROM l GROUP BY 1 HAVING count(*) > 1), s AS (" + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS share FROM g" for c in _GRAIN_COLS)
       + ") SELECT column_name, round(share, 4) AS constant_share, CASE WHEN share >= 0.9 THEN 'header' WHEN 1 - share >= 0.5 THEN 'line' ELSE 'other' END AS grain FROM s")
def grain_columns(spark, sf):
    return detect.grain_columns(_lines(spark, sf), "order_id").select("column_name", rnd(F.col("constant_share"), 4).alias("constant_share"), "grain")


@query("I37_detect_duplicate_keys", f"""WITH {_LINES} SELECT 'duplicate_business_key' AS kind, 'ref' AS column_name, 'high' AS severity,
  (SELECT count(*) - count(DISTINCT CAST(o_orderkey - (o_orderkey % 5 = 0)::INT AS VARCHAR)) FROM orders) AS n
UNION ALL SELECT 'line_item_grain', 'order_id', 'info', count(*) - count(DISTINCT order_id) FROM l""")
def duplicate_keys(spark, sf):
    refs = table(spark, sf, "orders").select(F.expr("cast(o_orderkey - if(o_orderkey % 5 = 0, 1, 0) as string)").alias("ref"), "o_custkey", "o_totalprice")
    found = detect.duplicate_keys(refs)
    lines = _lines(spark, sf)
    shares = detect.grain_columns(lines, "order_id").agg(
        F.count_if(F.col("grain") == "header").alias("h"), F.count_if(F.col("grain") == "line").alias("l"))
    copies = detect.duplicate_counts(lines, ["order_id"])
    grain = copies.withColumn("s", shares.select(F.struct("h", "l")).scalar()).select(
        F.when((F.col("s.h") > 0) & (F.col("s.l") >= 2), "line_item_grain").otherwise("duplicate_business_key").alias("kind"),
        F.lit("order_id").alias("column_name"), F.when((F.col("s.h") > 0) & (F.col("s.l") >= 2), "info").otherwise("high").alias("severity"),
        F.col("later_copies").alias("n"))
    return found.select("kind", "column_name", "severity", "n").unionByName(grain)


def _shares_sql(columns):
    from itertools import combinations

    parts = []
    for op in ("*", "+"):
        for r in columns:
            for a, b in combinations(sorted(c for c in columns if c != r), 2):
                test = f"abs({a} {op} {b} - {r}) / abs({r}) <= 0.01"
                parts.append(f"SELECT {columns.index(r)} AS position, '{op}' AS operator, '{r}' AS result, '{a}' AS \"left\", '{b}' AS \"right\", "
                             f"count(*) FILTER (WHERE {r} <> 0) AS n, count(*) FILTER (WHERE {r} <> 0 AND {test}) AS hits FROM d2")
    return " UNION ALL ".join(parts)


_NUMS = ["quantity", "unit", "total", "net"]
_D2 = f"{W}, d2 AS (SELECT quantity, unit, total, total / quantity AS net FROM d), s AS ({_shares_sql(_NUMS)})"


def _shares(spark, sf):
    d = dirty(spark, sf, "quantity", "unit", "total").withColumn("net", F.expr("total / quantity")).drop("_rid")
    return identities.identity_shares(d, _NUMS)


@query("I38_detect_arithmetic_violations", f"""{_D2} SELECT result, operator, "left", "right", round(hits / n, 4) AS share, n - hits AS violations FROM s
WHERE n >= 8 AND hits / n >= 0.75 AND hits < n QUALIFY row_number() OVER (PARTITION BY result ORDER BY CASE operator WHEN '*' THEN 0 ELSE 1 END, "left", "right") = 1""")
def arithmetic_violations(spark, sf):
    return detect.arithmetic_violations(_shares(spark, sf))


@query("I39_column_identities", f"""{_D2} SELECT result, operator, "left", "right", round(hits / n * 100, 1) AS match_pct FROM s WHERE n >= 5 AND hits / n > 0.9
QUALIFY row_number() OVER (PARTITION BY operator, "left", "right" ORDER BY position) = 1""")
def column_identities(spark, sf):
    return detect.column_identities(_shares(spark, sf))


_SCAN = ["price", "category", "score", "gap", "is_paid", "ordered_at"]
_SCAN_SQL = f"""found AS (SELECT 'placeholder_values' AS kind, 'price' AS column_name, 'high' AS severity, count(*) FILTER (WHERE {is_missing('price')}) AS n, 'standardize_null_placeholders' AS op, true AS auto FROM d
UNION ALL SELECT 'mixed_types', 'price', 'medium', count(*) FILTER (WHERE NOT {is_missing('price')}), '', false FROM d
UNION ALL SELECT 'numeric_stored_as_text', 'price', 'high', count({number('price')}), 'parse_numeric', true FROM d
UNION ALL SELECT 'untrimmed_whitespace', 'category', 'medium', count(*) FILTER (WHERE category <> trim(regexp_replace(category, '\\s+', ' ', 'g'))), 'trim_whitespace', true FROM d
UNION ALL SELECT 'untrimmed_whitespace', 'is_paid', 'medium', count(*) FILTER (WHERE is_paid <> trim(is_paid)), 'trim_whitespace', true FROM d
UNION ALL SELECT 'mixed_types', 'is_paid', 'medium', count(*), '', false FROM d
UNION ALL SELECT 'inconsistent_categories', 'category', 'high', count(*), 'harmonize_categories', true FROM d
UNION ALL SELECT 'numeric_sentinel', 'score', 'high', count(*) FILTER (WHERE score = -999), 'replace_sentinels', true FROM d
UNION ALL SELECT 'extreme_values', 'score', 'info', count(*) FILTER (WHERE score = -999), 'flag_outliers', true FROM d
UNION ALL SELECT 'missing_values', 'gap', 'medium', count(*) - count(gap), 'impute', true FROM d
UNION ALL SELECT 'future_date', 'ordered_at', 'medium', count(*) FILTER (WHERE ordered_at > TIMESTAMP '2000-06-30'), '', false FROM d)"""


@query("F7_defects_by_severity", f"{W}, {_SCAN_SQL} SELECT kind, column_name, severity, n FROM found WHERE n > 0")
def all_defects(spark, sf):
    return _found(spark, sf).select("kind", "column_name", "severity", "n")


def _found(spark, sf):
    return detect.detect_defects(dirty(spark, sf, *_SCAN), as_of="2000-06-30 00:00:00")


@query("I40_plan_from_defects", f"""{W}, {_SCAN_SQL} SELECT op, column_name, kind FROM found WHERE n > 0 AND op <> '' AND severity <> 'info' AND (auto OR op LIKE 'flag_%')""")
def plan_from_defects(spark, sf):
    return detect.plan_rows(_found(spark, sf)).select("op", "column_name", "kind")


@query("I40_clean_verdict", f"""{W}, {_SCAN_SQL} SELECT count(*) FILTER (WHERE severity <> 'info') = 0 AS is_clean,
  count(*) FILTER (WHERE severity <> 'info' AND op NOT IN ('standardize_null_placeholders', 'trim_whitespace', 'parse_numeric', 'parse_datetime', 'parse_boolean', 'cast_integer')) > 0 AS needs_review,
  count(*) AS findings FROM found WHERE n > 0""")
def clean_verdict(spark, sf):
    return detect.verdict(_found(spark, sf))


_PROFILED = ["price", "category", "gap", "gap_text", "quantity", "is_paid", "ordered_at"]
_PROFILE_TYPES = {"price": "text", "category": "categorical", "gap": "numeric", "gap_text": "categorical", "quantity": "numeric",
                  "is_paid": "categorical", "ordered_at": "text"}


def _profile_sql(c: str) -> str:
    text = c in ("price", "category", "gap_text", "is_paid")
    num = c in ("gap", "quantity")
    word = f"count(*) FILTER (WHERE {is_missing(c)})" if text else "0"
    distinct = f"count(DISTINCT CASE WHEN NOT {is_missing(c)} THEN {c} END)" if text else f"count(DISTINCT {c})"
    stats = (f"round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness"
             if num else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS skewness")
    far = (f"(SELECT max(({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))::INT) = 1 FROM d, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM d))"
           if num else "false")
    share = f"count(TRY_CAST({c} AS DOUBLE)) / count({c})"
    mismatch = f"({share}) > 0.3 AND ({share}) < 1.0" if text else "false"
    ratio = f"CASE WHEN count(DISTINCT {c}) / count({c}) < 0.05 OR count(DISTINCT {c}) < 25 THEN 'categorical' ELSE 'text' END"
    kind = f"'{'numeric'}'" if num else "'date'" if c == "ordered_at" and False else ratio
    arabic = f"round(avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '\\p{{Arabic}}') THEN 1.0 ELSE 0.0 END), 3)" if text else "0.0::DOUBLE"
    return (f"SELECT '{c}' AS column_name, {kind} AS inferred_type, count(*) - count({c}) + {word} AS missing_count, "
            f"round((count(*) - count({c}) + {word}) / count(*) * 100, 2) AS missing_pct, {word} AS placeholder_count, {distinct} AS unique_count, "
            f"{mismatch} AS type_mismatch, {far} AS has_outliers, {stats}, {arabic} AS arabic_ratio FROM d")


@query("D7_column_profile", f"{W} " + " UNION ALL ".join(_profile_sql(c) for c in _PROFILED))
def column_profile(spark, sf):
    return detect.column_profile(dirty(spark, sf, *_PROFILED))


@query("D7_column_samples", f"{W}, v AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM d WHERE {c} IS NOT NULL AND NOT {is_missing(c)}" for c in ("price", "category", "gap_text"))
    + ") SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY value) AS k, value FROM v QUALIFY k <= 5")
def column_samples(spark, sf):
    return detect.samples_per_column(dirty(spark, sf, "price", "category", "gap_text"))


@query("I44_profile_is_clean", f"""{W} SELECT 'dirty' AS table_name, count(*) - count(gap) = 0 AS is_clean FROM d UNION ALL SELECT 'orders', true""")
def profile_clean(spark, sf):
    def one(name, df):
        copies = detect.duplicate_counts(df, [c for c in df.columns if c != "_rid"]).first()["later_copies"]
        return detect.profile_is_clean(detect.column_profile(df), copies).select(F.lit(name).alias("table_name"), "is_clean")

    whole = table(spark, sf, "orders")
    return one("dirty", dirty(spark, sf, "price", "gap")).unionByName(one("orders", whole))


@query("I43_clean_every_table", f"""SELECT 'orders' AS table_name, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS nulls FROM (
  SELECT DISTINCT CASE WHEN NOT {is_missing('price')} THEN {number('price')} END AS v FROM (SELECT {_duck('price')} AS price FROM orders))
UNION ALL SELECT 'customers', count(*), 0 FROM customer""")
def clean_every_table(spark, sf):
    tables = {"orders": dirty(spark, sf, "price"),
              "customers": table(spark, sf, "customer").select(F.col("c_custkey").alias("_rid"), F.concat(F.lit(" "), "c_name").alias("title"))}
    out = None
    for name, df in tables.items():
        df = materialise(dealt(df, df.count(), "_rid"))  # read in every pass of the detectors and steps
        cleaned, _ = clean.apply_plan(df, detect.plan_steps(detect.detect_defects(df)))
        value = [c for c in cleaned.columns if not c.startswith("_")][0]
        row = cleaned.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("nulls"))
        out = row if out is None else out.unionByName(row)
    return out
