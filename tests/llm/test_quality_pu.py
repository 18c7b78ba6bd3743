"""op11: held-out accuracy, the estimated prior, and rows out of the ordinary."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.llm import quality_pu as pu
from shapelake.llm.q_quality_pu import fold, op11_positive_unlabelled

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_held_out_documents(spark, labels):
    got = op11_positive_unlabelled(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q, _ in out if q == 1], [s for s, q, _ in out if q == 0]
    assert len(bad) >= 3
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([p == q for _, q, p in out]) > 0.93
    assert np.mean([p for _, q, p in out if q == 1]) > 0.97


def test_held_out_labels_and_negatives_do_not_matter(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    one = pu.learn(docs, labels, fold() != 0)
    other = labels.withColumn("quality", F.when(fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).where((fold() == 0) | (F.col("quality") == 1))
    two = pu.learn(docs.repartition(3), other, fold() != 0)
    assert one.prior == two.prior and (one.weights == two.weights).all()


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        p, u = rng.normal(2, 1, 5000), np.where(rng.random(5000) < share, rng.normal(2, 1, 5000), rng.normal(-2, 1, 5000))
        assert abs(pu.estimate_prior(p, u) - share) < 0.06


def test_non_negative_risk_does_not_call_everything_bad():
    rng = np.random.default_rng(2)
    make = lambda n, m: rng.normal(m, 1, (n, pu.WIDTH)).astype(np.float32)
    positive, unlabelled = make(600, 0.15), np.concatenate([make(450, 0.15), make(150, -0.15)])
    model = pu.fit(positive, unlabelled)
    assert (model.score(make(200, 0.15)) >= 0.5).mean() > 0.8
    assert (model.score(make(200, -0.15)) < 0.5).mean() > 0.8


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "one", "word " * 50_000, "It is. A line\n" * 30, "x" * 300_000, "\x00퟿ 😀"]
    rows = [(i if i != 3 else None, t, 0.5, 1) for i, t in enumerate(texts)] + [(1, "", 0.5, 1), (50, "again and again.", 0.1, 2), (50, "again and again.", 0.1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, 1), (50, 1), (50, 1), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    model = pu.learn(docs, labels, F.lit(True))
    got = pu.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got[:3]] == [0, 0, 0]
    assert pu.learn(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in pu.scored(docs, None).collect()} == {0.0, 0.5}
    assert pu.learn(docs.limit(0), labels, F.lit(True)) is None and pu.scored(docs.limit(0), None).count() == 0
