"""The corpus operators as named queries over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import anchors, hmm, merkle, minhash, mixing, packing, pages, pivots, quality, rules, secrets, substring, wavelet
from ledgerlark.llm.common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, sql: str) -> None:
    """SQL that gives the rows of query *name*."""
    ORACLES[name] = sql


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


@_query
def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(_table(spark, sf_dir, "documents")), with_ids=False)


@_query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@_query
def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


@_query
def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_table(spark, sf_dir, "documents"))


@_query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(_table(spark, sf_dir, "documents"), changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, replaced={"text": lower})


@_query
def op12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


@_query
def op13_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.codes(_table(spark, sf_dir, "embeddings"))


def _parts_sql() -> str:
    """Per kind of secret the rows (r, kind, place, gap, match, last): lengths before, of, and within each match."""
    each = []
    for place, (kind, (pattern, least)) in enumerate(secrets.KINDS.items(), 1):
        quoted = "'" + pattern.replace("'", "''") + "'"
        group = 1 if "(" in pattern.replace("(?", "") else 0
        each.append(f"SELECT r, '{kind}' AS kind, {place} AS place, {least} AS least, string_split_regex(t, {quoted}) AS g, regexp_extract_all(t, {quoted}, 0) AS m, regexp_extract_all(t, {quoted}, {group}) AS x FROM d")
    return " UNION ALL ".join(each)


def _pairs_sql(table: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, many in table.items() for b in many)


_sql("op8_secrets", f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({_parts_sql()}),
i AS (SELECT r, kind, place, least, g, m, x, unnest(range(1, len(m) + 1)) AS n FROM f),
e AS (SELECT r, kind, place, least, length(m[n]) AS size, length(x[n]) AS inner_size, sum(length(g[n]) + length(m[n])) OVER (PARTITION BY r, kind ORDER BY n) AS stop FROM i),
p AS MATERIALIZED (SELECT r, kind, place, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e WHERE inner_size >= least),
parts(part, kind) AS (VALUES {_pairs_sql(secrets.PARTS)}), wanted(kind, part) AS (VALUES {_pairs_sql(secrets.NEEDS)}), needs AS (SELECT *, count(*) OVER (PARTITION BY kind) AS many FROM wanted), q AS (SELECT r, part, start, stop FROM p JOIN parts USING (kind)),
weak AS (SELECT p.r, p.kind, p.place, p.start, p.stop FROM p JOIN needs USING (kind) JOIN q ON q.r = p.r AND q.part = needs.part AND (q.start BETWEEN p.stop AND p.stop + {secrets.SCOPE} OR q.stop BETWEEN p.start - {secrets.SCOPE} AND p.start)
  GROUP BY ALL HAVING count(DISTINCT needs.part) = max(many)),
s AS (SELECT r, kind, place, start, stop, kind || ':' || start || ':' || stop AS span FROM (SELECT * FROM p WHERE kind IN ('assign', 'access', 'hex') UNION ALL SELECT r, kind, place, start, stop FROM weak)),
a AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, place, stop) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base, string_agg(span, ',' ORDER BY start, place, stop) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)""")

_RATES = ", ".join(f"sum(f_{r}) / sum(docs) AS m_{r}" for r in rules.RULES)
_SPREADS = ", ".join(f"sum(docs * pow(f_{r} / docs - m_{r}, 2)) / sum(docs) AS v_{r}" for r in rules.RULES)
_STRENGTHS = ", ".join(f"greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * hosts / n, 1e-6) - 1, 1.0) AS s_{r}" for r in rules.RULES)
_SHRUNK = ", ".join(f"(f_{r} + m_{r} * s_{r}) / (docs + s_{r}) AS q_{r}" for r in rules.RULES)
_FAILS = " OR ".join(f"q_{r} - 2 * sqrt(q_{r} * (1 - q_{r}) / (docs + s_{r} + 1)) > {rules.LIMIT}" for r in rules.RULES)
_sql("op10_rules", f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i FROM g WHERE (r, v) IN (SELECT (r, v) FROM (SELECT r, v FROM g GROUP BY ALL HAVING count(*) > 1))), range(5) t(k) GROUP BY r),
c AS MATERIALIZED (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN again USING (r)),
h AS (SELECT host, count(*)::DOUBLE AS docs, {", ".join(f"count(*) FILTER (WHERE {e})::DOUBLE AS f_{r}" for r, e in rules.RULES.items())} FROM c WHERE host IS NOT NULL GROUP BY 1),
m AS (SELECT sum(docs) AS n, count(*) AS hosts, {_RATES} FROM h), v AS (SELECT {_SPREADS} FROM h, m), s AS (SELECT m.*, {_STRENGTHS} FROM m, v),
q AS (SELECT host, docs, s.*, {_SHRUNK} FROM h, s), bad AS (SELECT host, {_FAILS} AS host_failed FROM q)
SELECT doc_id, c.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(host_failed, false) AS host_failed, NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM (SELECT *, {rules.RULES['short']} OR {rules.RULES['repeats']} AS base_failed FROM c) c LEFT JOIN bad ON c.host = bad.host""")


def _leaf_sql(text: str) -> str:
    fields = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({fields})"


def _climb_sql(name: str, base: str) -> str:
    """All nodes of the trees whose leaves *base* gives as (lev, key, idx, h, cnt)."""
    return f"""{name} AS ({base} UNION ALL SELECT lev + 1, key, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (cnt + 15) // 16 FROM {name} WHERE cnt > 1 GROUP BY lev, key, idx // 16, cnt)"""


def _fold_sql(name: str, base: str, nodes: str) -> str:
    """Rows (r, lev, key, idx, fold, proof, cnt) carried up to the root of their tree."""
    return f"""{name} AS ({base} UNION ALL SELECT f.r, f.lev + 1, f.key, f.idx // 16, sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.fold ELSE s.h END, '' ORDER BY s.idx)),
  any_value(f.proof) || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> f.idx), ''), (f.cnt + 15) // 16
  FROM {name} f JOIN {nodes} s ON s.lev = f.lev AND s.key = f.key AND s.idx // 16 = f.idx // 16 WHERE f.cnt > 1 GROUP BY f.r, f.lev, f.key, f.idx, f.cnt)"""


_sql("op11_merkle", f"""WITH RECURSIVE table_ AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS key, {_leaf_sql("text")} AS leaf, {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS lowered,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 5 = 0 AS changed FROM documents, table_),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS cnt FROM d),
{_climb_sql("n", "SELECT 0 AS lev, key, idx, leaf AS h, cnt FROM placed")},
s AS MATERIALIZED (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS cnt FROM n WHERE cnt = 1),
{_climb_sql("m", "SELECT 0 AS lev, '' AS key, idx, h, cnt FROM s")},
{_fold_sql("f", "SELECT r, 0 AS lev, key, idx, CASE WHEN changed THEN lowered ELSE leaf END AS fold, '' AS proof, cnt FROM placed", "n")},
{_fold_sql("g", "SELECT f.r, 0 AS lev, '' AS key, s.idx, f.fold, f.proof, s.cnt FROM f JOIN s ON s.key = f.key WHERE f.cnt = 1", "m")}
SELECT doc_id, leaf, s.h AS subroot, root, sha256(g.proof) AS proof_sha256, g.fold AS folded_root, g.fold = root AS verified
FROM d JOIN s USING (key) JOIN g ON g.r = d.r AND g.cnt = 1, (SELECT h AS root FROM m WHERE cnt = 1)""")


def _codes_sql() -> str:
    rounds = []
    for i in range(anchors.ROUNDS + 1):
        rounds.append(f"""a{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS near FROM (SELECT v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{i} b ON b.p = v.p AND b.j = v.j GROUP BY ALL) GROUP BY r, p)""")
        if i < anchors.ROUNDS:
            rounds.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN
  (SELECT v.p, a.near.e AS e, v.j, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM v JOIN a{i} a ON a.r = v.r AND a.p = v.p GROUP BY ALL) m ON m.p = b.p AND m.e = b.e AND m.j = b.j)""")
    last = anchors.ROUNDS
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding, len(embedding) // {anchors.PARTS} AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, j // w AS p, j % w AS j, CAST(floor({anchors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, w, unnest(embedding) AS x, unnest(range(len(embedding))) AS j FROM k)),
b0 AS (SELECT p, r AS e, j, x FROM v WHERE r < {anchors.ENTRIES}), {", ".join(rounds)},
c AS (SELECT vec_id, label, code, error FROM k JOIN (SELECT r, string_agg(printf('%02x', near.e), '' ORDER BY p) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{last} GROUP BY r) USING (r))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(x, ',' ORDER BY p, e, j)) FROM b{last}) AS codebooks_sha256 FROM c"""


_sql("op13_anchors", _codes_sql())
