"""Registered queries against their oracles and the pipeline from end to end, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from shapelake.llm import registry
from shapelake.plans.rounds import written

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in DATA.iterdir():
        c.sql(f"create view {f.stem} as select * from '{f}'")
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted(str([r[x] for x in columns]) for r in df.collect())
    found = c.sql(registry.oracle_sql()[name])
    at = [found.columns.index(x) for x in columns]
    assert ours == sorted(str([r[i] for i in at]) for r in found.fetchall())


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)}


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows, columns = [docs.count()], corpus_pipeline.COLUMNS
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, str(DATA)))
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name == "quality":
            assert not [i for i in ids if labels.get(i) == 0]
            lost = [i for i in before - ids if labels.get(i) == 1]
            assert len(lost) < 0.15 * sum(q == 1 for q in labels.values())
        rows.append(docs.count())
    pieces = corpus_pipeline.packing(spark, docs, str(DATA))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids


def test_stages_on_null_and_repeated_ids(spark):
    texts = [" ".join(f"{chr(97 + i)}word{k * (i + 3)}" for k in range(60)) for i in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[4]), (7, texts[5]), (7, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    got = corpus_pipeline.near_dedup(spark, docs, str(DATA))
    assert got.columns == corpus_pipeline.COLUMNS
    want = sorted([(0, texts[0]), (0, texts[1]), (0, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5])])
    assert key(got) == want
    got = corpus_pipeline.mixing(spark, docs, str(DATA))
    uses = Counter(key(got))
    held = Counter((i or 0, t) for i, t in rows)
    assert set(uses) == set(held) and all(n <= uses[x] <= 2 * n for x, n in held.items())
    assert abs(sum(uses.values()) - 1.5 * len(rows)) <= 0.5  # documents are of one size


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None, 0), (2, "", None, "a", 0, 0), (None, "x y z", "en", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uses int")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = written(stage(spark, table, str(DATA)))
        assert table.count() == 0
