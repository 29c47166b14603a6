"""Identities between columns: pruning by exact counts loses none of those that comparing every triple finds."""

import numpy as np
import pytest

from ledgerlark.operators import detect, identities


def table(seed, rows=3000, columns=9):
    """Columns of different sizes and signs with zeros, ties and gaps, and identities that hold on shares around the limit."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(rng.uniform(-3, 3), rng.uniform(0.1, 2), rows) * 10.0 ** rng.integers(-2, 4) if rng.random() < 0.6 else rng.integers(-2, 6, rows).astype(float) for _ in range(columns)])
    for op in rng.choice(["*", "+"], 3):
        a, b, c = rng.choice(columns, 3, replace=False)
        holds = rng.random(rows) < rng.choice([0.7, 0.76, 0.8, 0.93, 1.0])
        x[c] = np.where(holds, (x[a] * x[b] if op == "*" else x[a] + x[b]) * rng.uniform(0.995, 1.005, rows), x[c])
    gaps = rng.random(x.shape) < rng.choice([0.0, 0.02, 0.3], columns)[:, None]
    return np.where(gaps, np.nan, x)


def brute(x, names):
    out = {}
    with np.errstate(all="ignore"):
        for op, c, a, b in identities.all_triples(names):
            live = ~np.isnan(x[[a, b, c]]).any(axis=0) & (x[c] != 0)
            expected = x[a] * x[b] if op == "*" else x[a] + x[b]
            hits = live & (np.abs(expected - x[c]) / np.abs(x[c]) <= 0.01)
            out[names[c], op, names[a], names[b]] = (int(live.sum()), int(hits.sum()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_pruning_loses_nothing(spark, seed):
    x = table(seed)
    names = [f"v{i}" for i in range(len(x))]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x.T], ", ".join(f"{n} double" for n in names))
    shares = identities.identity_shares(df, names)
    got = {(r["result"], r["operator"], r["left"], r["right"]): (r["n"], r["hits"]) for r in shares.collect()}
    want = brute(x, names)
    assert all(want[k] == v for k, v in got.items())
    held = {k for k, (n, hits) in want.items() if n and hits >= identities.LEAST_SHARE * n}
    assert held and held <= set(got)
    assert len(got) < len(want)
    broken = {r["result"]: (r["operator"], r["left"], r["right"], r["violations"]) for r in detect.arithmetic_violations(shares).collect()}
    first = {}
    for (c, op, a, b), (n, hits) in sorted(want.items(), key=lambda kv: (kv[0][1] != "*", kv[0][2:])):
        if n >= 8 and 0.75 <= hits / n < 1:
            first.setdefault(c, (op, a, b, n - hits))
    assert broken == first


def test_most_triples_of_unlike_columns_are_never_measured(spark):
    rng = np.random.default_rng(1)
    names = [f"v{i}" for i in range(16)]
    x = np.stack([rng.lognormal(3 * i, 0.3, 2000) for i in range(15)])
    x = np.concatenate([x, x[2:3] * x[5:6]])
    numbers = identities.numbers_of(spark.createDataFrame([tuple(map(float, r)) for r in x.T], ", ".join(f"{n} double" for n in names)), names)
    bounds, triples = identities.Bounds(numbers, 0.75), identities.all_triples(names)
    left = [t for t in triples if bounds.open(t)]
    assert ("*", 15, 2, 5) in [(op, c, *sorted((a, b))) for op, c, a, b in left] and len(left) < 0.2 * len(triples)


def test_texts_gaps_and_empty_tables(spark):
    rows = [("$2.00", 3.0, 6.0, None)] * 9 + [("x", 3.0, 6.0, float("nan"))]
    df = spark.createDataFrame(rows, "a string, b double, c double, d double")
    got = {(r["result"], r["operator"], r["left"], r["right"]): (r["n"], r["hits"]) for r in identities.identity_shares(df, list("abcd")).collect()}
    assert got["c", "*", "a", "b"] == (9, 9) and got["d", "+", "a", "b"] == (0, 0)
    assert {r["n"] for r in identities.identity_shares(df.limit(0), list("abcd")).collect()} == {0}
    assert identities.identity_shares(df, ["a", "b"]).collect() == []
    many = [f"v{i}" for i in range(9)]
    assert {r["n"] for r in identities.identity_shares(spark.createDataFrame([], ", ".join(f"{n} double" for n in many)), many).collect()} <= {0}
