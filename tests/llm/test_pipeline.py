"""The pipeline: every stage on what its predecessor kept."""

import brute
from conftest import SF

import corpus_pipeline
from ledgerlark.llm import quality
from ledgerlark.llm.common import stored


def test_stages(shipped, documents, texts):
    docs, kept = documents, [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(shipped, docs, SF))
        assert docs.columns == documents.columns, name
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    first = {r["doc_id"] for r in quality.classify(documents, shipped.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert kept[1] == first
    _, component = brute.near_duplicates({i: texts[i] for i in first}, 5)
    assert kept[2] == kept[3] == {i for i, c in component.items() if i == c} and kept[4] <= kept[3]
    for r in docs.collect():
        assert not brute.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    pieces = corpus_pipeline.STAGES[-1][1](shipped, docs, SF).collect()
    assert sum(r["start"] == 0 for r in pieces) == docs.count()


def test_rows_go_by_their_own_verdict(shipped, documents):
    """A null id and a repeated id with one good and one bad text each, and unrelated, linked and equal rows under one id."""
    verdict = {r["doc_id"]: r["p_good"] for r in quality.classify(documents, shipped.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = {r["doc_id"]: r.asDict() for r in documents.collect()}
    good, bad = (rows[pick(verdict, key=verdict.get)] for pick in (max, min))
    more = shipped.createDataFrame([{**r, "doc_id": i} for i in (None, 900_001) for r in (good, bad)], documents.schema)
    left = corpus_pipeline.good_quality(shipped, documents.unionByName(more), SF).filter("doc_id IS NULL OR doc_id = 900001").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("900001", good["text"]), ("None", good["text"])]

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    made = [(1, a), (1, b), (2, a), (None, c), (None, d), (None, c), (None, b), (5, d + " more"), (3, ""), (3, ""), (4, ""), (None, ""), (None, None), (3, None)]
    got = corpus_pipeline.one_of_each_group(shipped, shipped.createDataFrame(made, "doc_id long, text string"), SF).collect()
    want = [(1, a), (1, b), (None, c), (5, d + " more"), (3, ""), (4, ""), (None, ""), (None, None), (3, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_stages_with_clashing_columns(shipped, documents):
    docs = documents.limit(60).selectExpr("*", "1 AS id", "2 AS spans", "3D AS rate", "4 AS copy", "'h' AS host", "5 AS row", "6 AS `_spans`")
    wanted = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(shipped, docs, SF))
        assert docs.columns == wanted and {r["spans"] for r in docs.collect()} == {2}, name
    assert corpus_pipeline.STAGES[-1][1](shipped, docs, SF).count() >= docs.count() > 0


def test_run_is_registered(shipped):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.run(shipped, SF).count() > 50
