"""What grows with the documents is not gathered in the driver, however small its files are."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import components, minhash


@pytest.fixture
def plans(shipped, monkeypatch):
    """The physical plans of the stored tables, as planned from the sizes of files alone."""
    seen = []
    for module in (minhash, components):
        def keep(df, real=module.stored):
            seen.append(df._jdf.queryExecution().sparkPlan().toString())
            return real(df)

        monkeypatch.setattr(module, "stored", keep)
    return seen


def _sent(plan: str) -> list[str]:
    return [line.strip(" :+-") for line in plan.split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoop" in line]


def test_blocks_around_a_hub_are_not_broadcast(shipped, plans):
    """Each node around a hub stands in as many rows as there are blocks on the other side, which no file size tells."""
    n, out = 2_000, 600
    around = minhash.stored(shipped.range(1, n + 1).select(F.lit(0).cast("long").alias("hub"), F.col("id").alias("node"), (F.col("id") <= out).alias("out")))
    pair = F.when(F.col("id") <= out, F.col("id") % 300).otherwise(-F.col("id"))  # of the first 600 nodes two and two are equal
    sets = minhash.stored(shipped.range(1, n + 1).select(F.col("id").alias("doc_id"), F.array(F.xxhash64(pair), F.xxhash64(pair, F.lit(1))).alias("members")))
    del plans[:]
    links = minhash._around_hubs(around, sets, 80)
    exploded = [p for p in plans if "Generate" in p]
    assert len(exploded) == 1 and not _sent(exploded[0]), exploded
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {i: (i - 1) % 300 + 1 for i in range(1, out + 1)}


def test_stored_edges_are_not_broadcast(shipped, plans):
    edges = shipped.range(1, 3_000).select(F.col("id").alias("a"), (F.col("id") - F.when(F.col("id") % 10 == 0, 0).otherwise(1)).alias("b"))
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {i: i // 10 * 10 for i in range(3_000)}
    assert len(plans) > 1 and not [x for p in plans for x in _sent(p)]


def test_candidate_pairs_are_not_broadcast(shipped, plans):
    sets = minhash.stored(shipped.range(400).select(F.col("id").alias("doc_id"), F.array(F.col("id") % 200, F.col("id") % 200 + 1000).alias("members")))
    pairs = minhash.stored(shipped.range(200, 400).select(F.col("id").alias("a"), (F.col("id") - F.when(F.col("id") < 300, 200).otherwise(199)).alias("b")))
    del plans[:]
    assert sorted(tuple(r) for r in minhash._confirmed(pairs, sets, 80).collect()) == [(i, i - 200) for i in range(200, 300)]
    assert len(plans) == 1 and not _sent(plans[0]), plans
