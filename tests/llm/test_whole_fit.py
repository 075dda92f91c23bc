"""Classifiers learn from every labelled document, however many there are."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import linear, quality, toxicity

#: More than the 12,000 and 10,000 rows that fits once stopped at; the last label is rare.
MANY = 13_000


def many(spark):
    ids = spark.range(MANY).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.concat_ws(" ", F.lit("word"), F.pmod(F.xxhash64("doc_id"), F.lit(97)), F.when(F.col("doc_id") % 50 == 0, "rare !! ##")))
    bad = F.col("doc_id") % 50 == 0
    return docs, ids.select("doc_id", (~bad).cast("int").alias("quality"), bad.cast("int").alias("toxic"))


def test_quality_learns_from_every_label(spark):
    docs, labels = many(spark)
    model = quality.fit(docs, labels, F.lit(True), steps=8)
    x = quality.features([bytes(r.text) for r in docs.select(F.col("text").cast("binary").alias("text")).collect()])
    assert np.allclose(model.mean, x.mean(0), rtol=1e-12, atol=1e-15)
    assert np.allclose(model.spread, x.std(0) + 1e-6, rtol=1e-9, atol=1e-12)
    got = quality.score(docs, model).select("doc_id", "good").join(labels, "doc_id").where("good <> quality").count()
    assert got <= 1  # the cut lies between the last document judged low and the next


def test_toxicity_learns_from_every_label(spark):
    docs, labels = many(spark)
    all_of_them, by_default = (toxicity.fit(docs, labels, F.lit(True), **given) for given in ({"sample": MANY}, {}))
    assert np.array_equal(by_default.slots, all_of_them.slots)
    assert np.allclose(by_default.weights, all_of_them.weights, atol=1e-3) and np.isclose(by_default.intercept, all_of_them.intercept, atol=1e-3)
    assert toxicity.score(docs, by_default).select("doc_id", F.col("toxic").alias("told")).join(labels, "doc_id").where("told <> toxic").count() == 0


def test_grams_are_counted_in_every_text(spark):
    docs, labels = many(spark)
    hits, counts = toxicity.gram_counts(linear.labelled_texts(docs, labels, "toxic", F.lit(True)))
    assert counts.tolist() == [MANY - MANY // 50, MANY // 50]
    assert hits[0].max() == counts[0] and hits[1].max() == counts[1]


def test_every_block_holds_the_rarer_label(spark):
    docs = np.array([990, 10])
    rows = spark.range(1000).select(F.xxhash64("id").alias("key"), (F.col("id") % 100 == 0).cast("int").alias("y"), F.lit(np.ones(len(quality.NAMES)).tobytes()).alias("x"), F.lit(b"").alias("f"))
    blocks, copies = quality.dealt(rows, docs, size=100)
    got = [quality.unpacked(r.asDict()) for r in blocks.df.collect()]
    assert len(got) == 10 and copies.tolist() == [1, 10]
    assert all((b.y == 1).sum() == 10 for b in got)
    assert sum((b.own & (b.y == 1)).sum() for b in got) == 10 and sum((b.y == 0).sum() for b in got) == 990


def test_quantile_and_least_point_are_exact(spark):
    values = np.r_[np.random.default_rng(1).normal(size=500), np.full(300, 0.25)]
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    for share in (0.0, 0.143, 0.6, 1.0):
        assert linear.quantile(df, share) == np.quantile(values, share)
    scale = np.arange(1.0, 8.0)
    found = linear.minimized(lambda x: (0.5 * float(scale @ (x - 3) ** 2), scale * (x - 3)), np.zeros(7), 60)
    assert np.allclose(found, 3, atol=1e-5)
