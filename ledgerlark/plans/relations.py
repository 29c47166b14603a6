"""Role detection, joins, relationship discovery, keys and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions.numbers import rnd
from ledgerlark.operators import keys, relations, roledetect
from ledgerlark.operators.relations import Relationship
from ledgerlark.plans.registry import query
from ledgerlark.plans.tables import FACT_SQL, fact, table
from ledgerlark.roles import Roles
from ledgerlark.sources import files

W = f"WITH {FACT_SQL}"
LINE_RELATIONS = [
    Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"), Relationship("lineitem", "l_partkey", "part", "p_partkey"),
    Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"), Relationship("orders", "o_custkey", "customer", "c_custkey"),
]


def _tables(spark, sf, *names):
    return {n: table(spark, sf, n) for n in names}


@query("A9_largest_table", """SELECT arg_max(t, (n, t)) AS table_name, max(n) AS rows FROM (SELECT 'customer' AS t, count(*) AS n FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem)""")
def largest_table(spark, sf):
    return relations.largest_table(_tables(spark, sf, "customer", "orders", "lineitem"))


@query("A10_rank_fact_tables", """SELECT * FROM (VALUES ('lineitem', 3), ('orders', 1), ('customer', 0), ('part', 0)) t(table_name, uses)
WHERE (SELECT count(*) FROM lineitem) > 0 AND (SELECT count(*) FROM orders) > 0""")
def rank_fact_tables(spark, sf):
    tables = _tables(spark, sf, "lineitem", "orders", "customer", "part")
    return relations.rank_fact_tables({**tables, "empty": tables["part"].where("false")}, LINE_RELATIONS)


@query("A18_table_preview", "SELECT *, (SELECT count(*) FROM orders) AS table_rows FROM orders ORDER BY o_orderkey LIMIT 20")
def table_preview(spark, sf):
    df = table(spark, sf, "orders")
    return files.preview(df.orderBy("o_orderkey")).withColumn("table_rows", df.agg(F.count(F.lit(1))).scalar())


@query("A19_describe_table", """SELECT column_name, position, nullable, filled, (SELECT count(*) FROM orders) AS rows
FROM (SELECT column_name, row_number() OVER () AS position, "null" = 'YES' AS nullable FROM (DESCRIBE orders)) JOIN (UNPIVOT (SELECT count(COLUMNS(*)) FROM orders) ON COLUMNS(*) INTO NAME column_name VALUE filled) USING (column_name)""")
def describe_table(spark, sf):
    return files.describe(table(spark, sf, "orders")).drop("type")


@query("B1_safe_names", "SELECT o_orderpriority AS order_priority, round(sum(o_totalprice), 2) AS total_price, CAST(sum(o_custkey) AS BIGINT) AS total_price_2 FROM orders GROUP BY 1")
def safe_names(spark, sf):
    named = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("Order Priority"), F.col("o_totalprice").alias("Total-Price"), F.col("o_custkey").alias("total price"))
    tables, _, _ = relations.sanitize_all({"My Orders": named}, [])
    return tables["my_orders"].groupBy("order_priority").agg(rnd(F.sum("total_price")).alias("total_price"), F.sum("total_price_2").cast("long").alias("total_price_2"))


@query("C3_plan_combination", """SELECT 'join' AS strategy, 'lines' AS main_table, 'Order_ID' AS join_key, o_orderpriority AS priority, count(*) AS rows, round(sum(l_extendedprice), 2) AS price
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def combination(spark, sf):
    tables = {"headers": table(spark, sf, "orders").select(F.col("o_orderkey").alias("Order_ID"), F.col("o_orderpriority").alias("priority")),
              "lines": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("price"))}
    plan = relations.plan_combination(tables)
    return relations.combine(tables, plan).groupBy("priority").agg(F.count(F.lit(1)).alias("rows"), rnd(F.sum("price")).alias("price")).select(
        F.lit(plan.strategy).alias("strategy"), F.lit(plan.primary).alias("main_table"), F.lit(plan.joins[0][1]).alias("join_key"), "priority", "rows", "price")


@query("B3_equality_filters", f"{W} SELECT status, count(*) AS n, round(sum(revenue), 2) AS revenue FROM fact WHERE mktsegment = 'BUILDING' AND priority = '1-URGENT' GROUP BY 1")
def equality_filters(spark, sf):
    view = fact(spark, sf, "mktsegment", "priority", "status", "revenue")
    for column, value in {"mktsegment": "BUILDING", "priority": "1-URGENT"}.items():
        view = view.where(F.col(column) == value)
    return view.groupBy("status").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("revenue")).alias("revenue"))


# --- roles --------------------------------------------------------------------

_NAMED = {"order_date": "ts", "order_id": "order_id", "customer_id": "customer_id", "product_name": "product", "total_amount": "revenue", "unit_price": "unit_price",
          "quantity": "quantity", "product_category": "brand", "sales_channel": "priority", "customer_name": "customer_name"}
_KINDS = {"order_date": "datetime", "order_id": "integer", "customer_id": "integer", "total_amount": "float", "unit_price": "float", "quantity": "float"}


def _named(spark, sf):
    return fact(spark, sf, *dict.fromkeys(_NAMED.values())).select(*[F.col(c).alias(n) for n, c in _NAMED.items()])


def _roles_sql() -> str:
    cols = ", ".join(f"({i}, '{n}', '{n.replace('_', '')}', '{_KINDS.get(n, 'string')}')" for i, n in enumerate(_NAMED))
    words = ", ".join(f"('{r}', '{k.replace('_', '')}')" for r, ks in roledetect.KEYWORDS.items() for k in ks)
    strong = "|".join(k.replace("_", "") for k in roledetect.STRONG_REVENUE)
    return f"""WITH cols(position, column_name, plain, kind) AS (VALUES {cols}), words(role, word) AS (VALUES {words}),
s AS (SELECT position, column_name, plain, kind, role, sum(CASE WHEN starts_with(plain, word) OR ends_with(plain, word) THEN 3 ELSE 1 END) AS score FROM cols, words
  WHERE contains(plain, word) GROUP BY ALL), t AS (SELECT column_name, score AS t_score FROM s WHERE role = 'time'),
c AS (SELECT role, column_name, position, CAST(CASE WHEN role = 'revenue' AND regexp_matches(plain, '{strong}') THEN score + 6 ELSE score END AS BIGINT) AS score FROM s LEFT JOIN t USING (column_name)
  WHERE CASE WHEN role IN ('revenue', 'quantity') THEN kind IN ('integer', 'float') WHEN role = 'category' THEN kind = 'string'
    WHEN role = 'order' THEN kind <> 'datetime' AND coalesce(t_score, 0) < score ELSE true END)"""


@query("B10_role_candidates", f"{_roles_sql()} SELECT role, column_name, score FROM c WHERE (SELECT count(*) FROM lineitem) > 0")
def role_candidates(spark, sf):
    return roledetect.role_candidates(_named(spark, sf)).select("role", "column_name", "score")


@query("B10_best_roles", f"{_roles_sql()} SELECT role, arg_max(column_name, (score, -position)) AS column_name, max(score) AS score FROM c WHERE (SELECT count(*) FROM lineitem) > 0 GROUP BY role")
def best_roles(spark, sf):
    return roledetect.best_per_role(roledetect.role_candidates(_named(spark, sf)))


@query("B10_role_fallbacks", f"""{W} SELECT 'time' AS role, 'a' AS column_name, 1 AS score FROM fact HAVING count(TRY_CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP)) >= 0.9 * count(ts)
UNION ALL SELECT role, column_name, 0 FROM (VALUES ('revenue', 'b'), ('revenue', 'c'), ('quantity', 'c')) t(role, column_name)""")
def role_fallbacks(spark, sf):
    """Columns whose names say nothing."""
    lines = fact(spark, sf, "orderkey", "ts", "revenue", "linenumber", "brand")
    nameless = lines.select(F.col("orderkey").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("a"), F.col("revenue").alias("b"), F.col("linenumber").alias("c"), F.col("brand").alias("d"))
    return roledetect.role_candidates(nameless).select("role", "column_name", "score")


@query("B11_role_warnings", f"""{W} SELECT 'revenue_mostly_negative' AS warning, 'refund' AS column_name FROM fact HAVING avg(CASE WHEN -revenue < 0 THEN 1.0 ELSE 0.0 END) > 0.5
UNION ALL SELECT 'customer_unique_per_row', 'customer_id' FROM fact HAVING count(DISTINCT customer_id) = count(*) UNION ALL SELECT 'no_time_column', NULL""")
def role_warnings(spark, sf):
    d = fact(spark, sf, "customer_id", "revenue").withColumn("refund", -F.col("revenue"))
    return roledetect.role_warnings(d, Roles(revenue="refund", customer="customer_id"))


@query("B12_single_currency", f"{W} SELECT CASE WHEN count(DISTINCT nation) = 1 THEN min(nation) END AS currency FROM fact")
def single_currency(spark, sf):
    return roledetect.single_currency(fact(spark, sf, "nation"), "nation")


# --- joins --------------------------------------------------------------------


@query("C1_fact_view", """SELECT o_orderpriority, s_nationkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price, round(sum(p_retailprice), 2) AS retail
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def fact_view(spark, sf):
    view = relations.fact_view(_tables(spark, sf, "lineitem", "orders", "part", "supplier"), LINE_RELATIONS, "lineitem")
    return view.groupBy("o_orderpriority", "s_nationkey").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_extendedprice")).alias("price"), rnd(F.sum("p_retailprice")).alias("retail"))


@query("C2_star_join", """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) = 1)
SELECT o_orderkey AS order_id, o_totalprice, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity FROM orders LEFT JOIN d ON o_orderkey = l_orderkey""")
def star_join(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice")
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("Order_ID"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                                            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return relations.star_join(f, d, "Order_ID", ["line", "part", "quantity", "price"]).drop("price")


@query("C4_join_key_tests", """SELECT 'key' AS column_name, 1.0::DOUBLE AS uniqueness, round(count(c_custkey) / count(*), 6) AS coverage, count(c_custkey) / count(*) >= 0.5 AS accepted
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
UNION ALL SELECT 'kind', round((SELECT count(DISTINCT c_mktsegment) / count(*) FROM customer WHERE c_acctbal > 0), 6), 0.0, false""")
def join_key_tests(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("kind"))
    d = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("kind"))
    tests = relations.join_key_tests(f, d)
    return tests.select("column_name", rnd(F.col("uniqueness"), 6).alias("uniqueness"), rnd(F.col("coverage"), 6).alias("coverage"), "accepted")


_DISCOVER = {"customer": ["c_custkey", "c_name", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
             "region": ["r_regionkey", "r_name"]}


def _discover_tables(spark, sf):
    return {t: table(spark, sf, t).select(*cols) for t, cols in _DISCOVER.items()}


def _discover_sql() -> str:
    names, parts = list(_DISCOVER), []
    text = {"c_name", "n_name", "r_name"}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            for pa, ca in enumerate(_DISCOVER[a]):
                for pb, cb in enumerate(_DISCOVER[b]):
                    sim = relations.name_similarity(ca, cb)
                    if sim < 0.5 and not (keys.key_like(ca) or keys.key_like(cb)):
                        continue
                    same = (ca in text) == (cb in text)
                    match = "true" if same else "false"
                    parts.append(f"""SELECT '{a}' AS a, '{ca}' AS ca, '{b}' AS b, '{cb}' AS cb, {sim!r}::DOUBLE AS sim, {1.0 if same else 0.0} AS dt, {pa} AS pa, {pb} AS pb,
  (SELECT count(DISTINCT {ca}) / count({ca}) FROM {a}) AS ua, (SELECT count(DISTINCT {cb}) / count({cb}) FROM {b}) AS ub,
  (SELECT avg(CASE WHEN {match} AND {'x.' + ca if same else 'NULL'} IN (SELECT {cb if same else 'NULL'} FROM {b}) THEN 1.0 ELSE 0.0 END) FROM {a} x) AS cov_ab,
  (SELECT avg(CASE WHEN {match} AND {'x.' + cb if same else 'NULL'} IN (SELECT {ca if same else 'NULL'} FROM {a}) THEN 1.0 ELSE 0.0 END) FROM {b} x) AS cov_ba""")
    return f"""p AS ({' UNION ALL '.join(parts)}),
q AS (SELECT *, CASE WHEN ua >= ub THEN b ELSE a END AS table_a, CASE WHEN ua >= ub THEN cb ELSE ca END AS column_a, CASE WHEN ua >= ub THEN a ELSE b END AS table_b,
  CASE WHEN ua >= ub THEN ca ELSE cb END AS column_b, greatest(ua, ub) AS pku, CASE WHEN ua >= ub THEN cov_ba ELSE cov_ab END AS cov FROM p WHERE greatest(ua, ub) >= 0.5),
rel AS (SELECT table_a, column_a, table_b, column_b, round(0.25 * sim + 0.15 * dt + 0.3 * pku + 0.3 * cov, 4) AS confidence, round(sim, 3) AS sim, dt, round(pku, 3) AS pku, round(cov, 3) AS cov
  FROM q QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(0.25 * sim + 0.15 * dt + 0.3 * pku + 0.3 * cov, 4) DESC, pa, pb) = 1)"""


@query("C5_find_relationships", f"WITH {_discover_sql()} SELECT table_a, column_a, table_b, column_b, confidence, cov AS fk_coverage FROM rel")
def find_relationships(spark, sf):
    found = relations.find_relationships(_discover_tables(spark, sf))
    return found.select("table_a", "column_a", "table_b", "column_b", "confidence", F.col("evidence")["fk_coverage"].alias("fk_coverage"))


@query("C6_approval_buckets", f"""WITH {_discover_sql()} SELECT table_a, table_b, CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence >= 0.5 THEN 'review' ELSE 'manual' END AS bucket FROM rel""")
def approval_buckets(spark, sf):
    return relations.bucketed(relations.find_relationships(_discover_tables(spark, sf))).select("table_a", "table_b", "bucket")


@query("C7_review_stats", f"""WITH {_discover_sql()} SELECT table_a, column_a, table_b, column_b, pku AS pk_uniqueness, cov AS fk_coverage, round(1 - cov, 3) AS orphan_ratio, dt >= 0.6 AS dtype_compatible FROM rel""")
def review_stats(spark, sf):
    return relations.review_stats(relations.find_relationships(_discover_tables(spark, sf)))


def _rich(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 1000").withColumn("key_text", F.expr("concat(cast(c_custkey as string), '.0')"))


_RICH = "rich AS (SELECT * FROM customer WHERE c_acctbal > 1000)"


@query("C8_orphan_rate", f"""WITH {_RICH} SELECT count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM rich)) AS orphans,
  round(avg(CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM rich) THEN 1.0 ELSE 0.0 END), 4) AS orphan_rate FROM orders""")
def orphan_rate(spark, sf):
    return relations.orphan_rate(table(spark, sf, "orders"), "o_custkey", _rich(spark, sf), "key_text")


@query("C8_orphan_sample", f"WITH {_RICH} SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS raw FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM rich) ORDER BY 1 LIMIT 10")
def orphan_sample(spark, sf):
    return relations.orphan_sample(table(spark, sf, "orders"), "o_custkey", _rich(spark, sf), "key_text")


@query("C9_exact_orphans", f"""{W}, rich AS (SELECT c_name FROM customer WHERE c_acctbal > 1000) SELECT count(*) FILTER (WHERE customer_name NOT IN (SELECT c_name FROM rich)) AS orphans,
  round(avg(CASE WHEN customer_name NOT IN (SELECT c_name FROM rich) THEN 1.0 ELSE 0.0 END), 4) AS orphan_rate FROM fact""")
def exact_orphans(spark, sf):
    return relations.orphan_rate(fact(spark, sf, "customer_name"), "customer_name", _rich(spark, sf), "c_name", exact=True)


@query("C10_reconcile", f"""WITH {_RICH}, r AS (SELECT (SELECT avg(CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 1.0 ELSE 0.0 END) FROM orders) AS b,
  (SELECT avg(CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM rich) THEN 1.0 ELSE 0.0 END) FROM orders) AS a)
SELECT 'orders' AS table_a, 'o_custkey' AS column_a, 'customer' AS table_b, round(b, 4) AS rate_before, round(a, 4) AS rate_after, round(round(a, 4) - round(b, 4), 4) AS delta,
  a - b <= 0.02 AS within_tolerance FROM r""")
def reconcile(spark, sf):
    raw = _tables(spark, sf, "orders", "customer")
    return relations.reconcile([LINE_RELATIONS[3]], raw, {**raw, "customer": _rich(spark, sf)})


@query("C11_cardinality", f"""WITH {_RICH} SELECT 'orders' AS table_a, 'o_custkey' AS column_a, 'customer' AS table_b, 'c_custkey' AS column_b,
  count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM rich)) AS orphans, 'one_to_many' AS cardinality, false AS needs_bridge_table, true AS fk_will_be_enforced, true AS blocking FROM orders
UNION ALL SELECT 'lineitem', 'l_partkey', 'orders', 'o_custkey', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)), 'many_to_many', true, false, false
UNION ALL SELECT 'orders', 'o_orderkey', 'orders', 'o_orderkey', 0, 'one_to_one', false, true, false""")
def cardinality(spark, sf):
    tables = {**_tables(spark, sf, "orders", "lineitem"), "customer": _rich(spark, sf)}
    rels = [LINE_RELATIONS[3], Relationship("lineitem", "l_partkey", "orders", "o_custkey"), Relationship("orders", "o_orderkey", "orders", "o_orderkey")]
    return relations.relationship_checks(tables, rels, {"customer": ["c_custkey"], "orders": ["o_orderkey"]}).drop("orphan_rate")


@query("G1_append_files", """SELECT _source_file, count(*) AS n, round(sum(price), 2) AS price FROM (SELECT 'finished' AS _source_file, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'open', o_totalprice FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
def append_files(spark, sf):
    o = table(spark, sf, "orders")
    files = {"finished": o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("Order_ID"), F.col("o_totalprice").alias("Price")),
             "open": o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("PRICE"))}
    return relations.append_files(files).groupBy("_source_file").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("Price")).alias("price"))


# --- keys ---------------------------------------------------------------------

_KEYED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_CONFIRMED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


@query("D28_primary_keys", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CASE WHEN count(DISTINCT {c}) = count(*) THEN 'confirmed' ELSE 'candidate' END AS status, '{c}' AS key_column, 1.0::DOUBLE AS uniqueness, 0::BIGINT AS duplicate_count FROM {t}"
    for t, c in _CONFIRMED.items()) + """ UNION ALL SELECT 'lineitem', 'candidate', 'l_extendedprice', round(count(DISTINCT l_extendedprice) / count(*), 4),
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_extendedprice HAVING count(*) > 1)) FROM lineitem""")
def primary_keys(spark, sf):
    found = keys.primary_keys(_tables(spark, sf, *_KEYED))
    return found.select("table_name", "status", F.array_join("columns", "+").alias("key_column"), "uniqueness", "duplicate_count")


@query("D29_composite_key", """SELECT 'conversations' AS table_name, CASE WHEN count(*) = (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) THEN 'confirmed' ELSE 'none' END AS status,
  'conv_id+turn' AS key_column, true AS is_composite FROM conversations""")
def composite_key(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return keys.primary_key("conversations", talk).select("table_name", "status", F.array_join("columns", "+").alias("key_column"), "is_composite")


@query("D30_dtype_issues", """SELECT 'orders' AS table_name, 'ref' AS column_name, round(avg(CASE WHEN o_orderkey % 20 = 0 THEN 0.0 ELSE 1.0 END), 4) AS numeric_share,
  count(*) FILTER (WHERE o_orderkey % 20 = 0) AS mismatches FROM orders""")
def dtype_issues(spark, sf):
    o = table(spark, sf, "orders").select(F.expr("case when o_orderkey % 20 = 0 then concat('R', o_custkey) else cast(o_custkey as string) end").alias("ref"),
                                          "o_orderpriority", F.expr("cast(o_orderkey as string)").alias("number_text"))
    return keys.dtype_issues({"orders": o})


@query("D31_key_issues", """SELECT 'lineitem' AS table_name, 'l_orderkey+l_linenumber' AS key_columns, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_count,
  0::BIGINT AS null_count UNION ALL SELECT 'orders', 'status', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') + 0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')""")
def key_issues(spark, sf):
    tables = _tables(spark, sf, "lineitem", "customer")
    tables["orders"] = table(spark, sf, "orders").select(F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    found = keys.key_issues(tables, {"lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"], "orders": ["status"]})
    n = F.col("null_count")
    return found.select("table_name", F.array_join("columns", "+").alias("key_columns"),
                        F.when(F.col("table_name") == "orders", F.col("duplicate_count") - n).otherwise(F.col("duplicate_count")).alias("duplicate_count"), n)


@query("D32_integrity_report", f"""WITH {_RICH} SELECT NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM rich)) AS passed, 2 AS confirmed_keys, 0 AS key_issues, 1 AS relationships,
  CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM rich)) AS INT) AS blocking_relationships, 0 AS tables_with_duplicate_rows""")
def integrity_report(spark, sf):
    tables = {"orders": table(spark, sf, "orders"), "customer": _rich(spark, sf).drop("key_text")}
    return keys.integrity_report(tables, [LINE_RELATIONS[3]])


