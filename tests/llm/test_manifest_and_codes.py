"""The Merkle manifest and the vector codes against brute force and their SQL, and on odd rows."""

import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from conftest import LONG, SF
from pyspark.sql import functions as F

from ledgerlark.llm import anchors, merkle, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def lowered(row):
    changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
    return (*row[:4], row[4].translate(brute.LOWER)) if changed else row


def manifest(docs, **more):
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, changed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, replaced={"text": text}, **more)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("case", ["odd", "one source", "lone", "many sources", "several blocks"])
def test_merkle(shipped, case):
    rows = {
        "odd": [(1, None, None, None, None), (5, "", "a", 0, ""), (5, "", "a", 0, ""), (None, "b", "en", 3, "No id"), (None, "b", "en", 3, "Other"), (9, "é☃", "", 7, LONG), (0, "b", None, -4, "A-Z Ünï ÀB"), (4, "b", "x", 1, "AB"), (7, "B", "x", 1, "AB"), (4, "b", "x", 1, "AB")],
        "one source": [(i, "s", "en", i, f"Text {i}") for i in range(257)],
        "lone": [(5, None, "en", 1, "Lone")],
        "many sources": [(i, f"source {i % 290}", "en", i, f"Text {i}") for i in range(600)],
        "several blocks": [(i, "hot" if i % 9 else f"s{i % 4}", "en", i, f"Text {i}") for i in range(9500)],
    }[case]
    docs = shipped.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS idx", "2 AS key", "3 AS id", "4 AS digest", "5 AS row", "6 AS path").repartition(7)
    got = manifest(docs).collect()
    want = brute.merkle(rows, lowered)
    assert ordered(map(tuple, got)) == ordered((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert any(not r["verified"] for r in got) or case in ("odd", "lone")


def test_merkle_states_go_on():
    """A state before a slot, a replacement and the right siblings give the hash of all children."""
    children = [f"{i:064x}" for i in range(13)]
    parent = merkle.Parent(children)
    for slot in range(13):
        assert parent.fold(slot, "f" * 64) == merkle.Parent(children[:slot] + ["f" * 64] + children[slot + 1:]).digest
        packed = bytes([slot]) + bytes.fromhex(parent.others(slot))
        assert merkle.Ancestor(packed).fold(children[slot]) == parent.digest and merkle.Ancestor(packed).text == parent.others(slot)
    assert merkle.climb([]) == [] and merkle.climb(children[:1]) == [] and len(merkle.climb(children[:1], 3)) == 3 and len(merkle.climb(children * 2)) == 2


def test_merkle_proofs(documents):
    for r in merkle.manifest(documents, with_proof=True).collect():
        assert r["verified"] and merkle.fold_proof(r["leaf"], r["proof"]) == r["root"] and merkle.fold_proof("0" * 64, r["proof"]) != r["root"]


def test_merkle_empty(shipped):
    assert manifest(shipped.createDataFrame([], SCHEMA)).collect() == []


def codes(spark, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").selectExpr("*", "1 AS code", "2 AS part", "3 AS of").repartition(3)
    return sorted((tuple(r) for r in anchors.codes(df).collect()), key=str)


def vectors(n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, width))
    x = np.concatenate([rng.normal(size=(n // 3, width)), centre[rng.integers(0, 9, n // 3)] + rng.normal(size=(n // 3, width)) * 0.02, np.repeat(centre[:1], n // 3, axis=0)])
    return [(i, v.tolist(), None if i % 7 == 0 else i % 4) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("case", ["clusters and copies", "ties", "few", "negative", "wide numbers"])
def test_codes(shipped, monkeypatch, case):
    rows = {
        "clusters and copies": vectors(6000),
        "ties": [(i, [float((i * k) % 3) / 4096 for k in range(8)], i % 2) for i in range(900)],
        "few": vectors(9),
        "negative": [(i, [-(i % 5) - k / 3 for k in range(24)], 0) for i in range(700)],
        "wide numbers": [(i, [float((-1) ** i * 10.0 ** (i % 9)) + k for k in range(8)], i % 3) for i in range(400)],
    }[case]
    if case == "wide numbers":
        got, want = codes(shipped, rows, "array<double>"), brute.codes(rows)
    else:
        rows = [(i, np.array(v, np.float32).tolist(), n) for i, v, n in rows]
        got, want = codes(shipped, rows), brute.codes(rows)
    assert got == sorted(want, key=str)


def test_codes_on_odd_rows(shipped):
    some = vectors(300)
    odd = [(900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] + [0.0] * 15, 1), (903, [float("inf")] * 16, None), (904, [0.0] * 16, 1), (None, some[5][1], 2), (3, some[4][1], None), (3, some[4][1], None)]
    other = [(910, [1.0] * 8, 1), (911, [], 2)]
    got = codes(shipped, some + odd + other)
    want = [(*r[:4], r[4]) for r in brute.codes(some + odd)]
    assert got == sorted([*want, *[(i, None, None, next(w[3] for w, r in zip(want, [x for x in some + odd if x[1] and all(v is not None and np.isfinite(v) for v in x[1])]) if r[2] == n), want[0][4]) for i, _, n in other]], key=str)
    assert codes(shipped, []) == [] and codes(shipped, [(1, None, 1)]) == []
    assert [r[:3] for r in codes(shipped, [(None, [1.0] * 8, 1)])] == [(None, None, None)] and codes(shipped, [(1, [1.0] * 7, 1)])[0][1] is None


def test_balls_cache_their_points():
    x = np.floor(np.array([v for _, v, _ in vectors(1500)]).reshape(1500 - 1500 % 3, 8, -1) * 4096)
    forest = anchors._Forest()
    for p in range(8):
        forest.plant(p, x[:, p])
    assert Counter(n[3] < 0 for n in forest.nodes)[True] > 100
    for (part, first, last, left, right), radius, total in zip(forest.nodes, forest.radius, forest.sums, strict=True):
        points = x[forest.order[part][first:last], part]
        assert (points.sum(axis=0) == total).all() and np.sqrt(((points - total / len(points)) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-12)
        if left >= 0:
            assert (forest.nodes[left][1], forest.nodes[left][2], forest.nodes[right][2]) == (first, forest.nodes[right][1], last)
    for p in range(8):
        assert sorted(forest.order[p].tolist()) == list(range(len(x)))


def test_outliers_do_not_nest_without_end():
    x = np.concatenate([np.zeros((3000, 2)), np.array([[2.0 ** i, 1.0] for i in range(900)])])
    forest = anchors._Forest()
    forest.plant(0, x)
    assert len(forest.order[0]) == len(x)


@pytest.mark.parametrize("name", ["op11_merkle", "op13_anchors"])
def test_new_queries_against_sql(shipped, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](shipped, SF)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall()) and got.columns == rel.columns
