import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleflow.llm import toxicity

BAD = ["idiot", "scum", "lowlife"]


def text(rng, toxic):
    words = ["".join(rng.choice(["the", "an", "or", "ing", "ha"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
    for _ in range(2 * toxic):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    rows = [(k, k % 8 == 0) for k in range(1200)]
    docs = spark.createDataFrame([(k, text(rng, bad)) for k, bad in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(bad)) for k, bad in rows if k % 3 or bad], "doc_id long, toxic int")
    return docs, labels, dict(rows)


def test_held_out_documents(corpus):
    docs, labels, truth = corpus
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    classifier = toxicity.train(docs.where(learned), labels.where(learned))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, classifier).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert len(scores) > 200
    right = [(s >= 0.5) == truth[i] for i, s in scores.items()]
    assert np.mean(right) > 0.98
    assert set(toxicity.reject(docs, classifier).columns) == {"doc_id", "text"}


@pytest.mark.parametrize("hot_is_toxic", [False, True])
def test_copies_of_one_text_move_no_other(spark, corpus, hot_is_toxic):
    """One text a third of all rows: different documents are told apart as without it."""
    docs, labels, truth = corpus
    hot = text(random.Random(4), hot_is_toxic)
    copies = spark.range(5000, 5600).withColumnRenamed("id", "doc_id")
    more = docs.unionByName(copies.withColumn("text", F.lit(hot)))
    marked = labels.unionByName(copies.withColumn("toxic", F.lit(int(hot_is_toxic))))
    scores = {r.doc_id: r.score for r in toxicity.score(more, toxicity.train(more, marked)).collect()}
    right = {bad: np.mean([(scores[i] >= 0.5) == bad for i, own in truth.items() if own == bad]) for bad in (False, True)}
    assert min(right.values()) > 0.98, right
    assert (scores[5000] >= 0.5) == hot_is_toxic
    assert np.mean([scores[i] for i, own in truth.items() if not own]) < 0.1


def test_the_prior_counts_different_texts(spark):
    docs = spark.createDataFrame([(k, "hot") for k in range(60)] + [(100 + k, f"text {k}") for k in range(40)], "doc_id long, text string")
    every = docs.select("doc_id", F.when(F.col("text") == "hot", 1).when(F.col("doc_id") < 104, 1).otherwise(0).alias("toxic"))
    assert toxicity._share(docs, every) == pytest.approx(5 / 41)
    assert toxicity._share(docs, every.where("doc_id % 2 = 0")) == pytest.approx(2.5 / 20.5)
    assert toxicity._share(docs, every.where("doc_id > 999")) == 0.0


def test_the_bias_is_set_on_all_texts(corpus, monkeypatch):
    """The mean score of all different texts is the prior, however small the sample."""
    docs, labels, _ = corpus
    monkeypatch.setattr(toxicity, "UNLABELLED", 200)
    rows = toxicity.score(docs, toxicity.train(docs, labels, prior=0.2)).collect()
    assert np.mean([r.score for r in rows]) == pytest.approx(0.2, abs=1e-3)


def test_the_risk_does_not_go_negative():
    """Where the clean part's estimate is below zero, a step raises it."""
    x_p, x_u = np.ones((20, 1), np.float32), np.zeros((80, 1), np.float32)
    w, b, prior = np.array([3.0], np.float32), -6.0, 0.5

    def clean(w, b):
        return np.mean(np.logaddexp(0, x_u @ w + b)) - prior * np.mean(np.logaddexp(0, x_p @ w + b))

    b = -2.5
    assert clean(w, b) < 0
    g, g_b = toxicity._risk_step(x_p, x_u, w, b, prior)
    assert clean(w - 0.1 * g, b - 0.1 * g_b) > clean(w, b)


def test_nothing_to_learn_from(spark, odd_with_nulls, empty):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    classifier = toxicity.train(odd_with_nulls, no_labels)
    scored = toxicity.score(odd_with_nulls, classifier)
    assert scored.count() == odd_with_nulls.count() and scored.where("score >= 0.5").count() == 0
    odd_labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (9999, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd_with_nulls, toxicity.train(odd_with_nulls, odd_labels)).count() == odd_with_nulls.count()
    assert toxicity.score(empty, toxicity.train(empty, no_labels)).count() == 0
    kept = toxicity.with_score(odd_with_nulls, classifier)
    assert set(kept.columns) == set(odd_with_nulls.columns) and dict(kept.dtypes)["score"] == "double"


def test_training_reads_a_bounded_sample(corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "UNLABELLED", 50)
    docs, _, _ = corpus
    assert len(toxicity._sampled(docs, 50)) <= 50


def test_features():
    assert toxicity.features_of_text("") == set()
    assert toxicity.features_of_text("Loser loser") == set(toxicity.features_of_word("loser"))
    assert len(toxicity.features_of_word("abc")) == 1 and len(toxicity.features_of_word("abcde")) == 3
