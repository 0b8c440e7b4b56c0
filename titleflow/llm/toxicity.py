"""Toxicity by learning from positive and unlabelled text.

Only confirmed toxic documents are examples; everything else is text of unknown kind, of which a known share (the
class prior) is toxic. The classifiers minimise the non-negative estimate of the risk: with the logistic loss l,

    prior * E_positive[l(f)] + max(0, E_unlabelled[l(-f)] - prior * E_positive[l(-f)])

The second term estimates the risk on clean text and is kept from going below zero, where the
classifier would learn the unlabelled sample by heart; such a step goes back instead.

Different texts are the population, however many copies they have: the samples of bounded size that training sees, drawn
by hash from the whole tables, the class prior, and the histogram of all texts' log-odds that sets the bias. Scoring sees
every whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from titleflow.llm.common import fresh, id_and_text, per_batch, small_batches

#: Documents that training looks at, at most.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Features that a classifier weighs, at most; the deviation from chance, the number and the share of the positive
#: documents with it that admit one.
FEATURES, DEVIATION, LEAST, LEAST_SHARE = 1_000, 6.0, 4, 0.02
#: Classifiers whose log-odds are averaged; each leaves out another part of the samples.
CLASSIFIERS = 3
#: Beginnings of words, in characters, that count as features beside the words themselves.
BEGINNINGS = (4, 5)
REMEMBERED = 200_000
#: Bins of the histogram in a unit of log-odds, and the log-odds that it ends at.
BINS, ENDS = 256, 50

_WORD = re.compile(r"[^\W\d_]+")


def features_of_word(word: str) -> list[int]:
    names = [f"={word}", *(f"{k}{word[:k]}" for k in BEGINNINGS if len(word) >= k)]
    return [zlib.crc32(name.encode()) for name in names]


def features_of_text(text: str) -> set[int]:
    """Hashes of the words of a text and of their beginnings; how often they occur does not matter."""
    found: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        found.update(features_of_word(word))
    return found


@dataclass
class Classifier:
    """Log-odds are ``bias`` plus the weights of the features present."""

    bias: float
    weights: dict[int, float]

    def score(self, log_odds: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(log_odds, -500, 500))))


def _risk_step(x_p: np.ndarray, x_u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, float]:
    """The gradient of the risk, or the way back where its second term is below zero."""
    z_p, z_u = x_p @ w + b, x_u @ w + b
    s_p, s_u = 1 / (1 + np.exp(-np.clip(z_p, -30, 30))), 1 / (1 + np.exp(-np.clip(z_u, -30, 30)))
    negative = np.mean(np.logaddexp(0, z_u)) - prior * np.mean(np.logaddexp(0, z_p))
    g_p, g_u = prior * s_p / len(s_p), s_u / len(s_u)  # of the second term's parts
    if negative < 0:
        return x_p.T @ g_p - x_u.T @ g_u, float(g_p.sum() - g_u.sum())
    g = prior * (s_p - 1) / len(s_p) - g_p
    return x_p.T @ g + x_u.T @ g_u, float(g.sum() + g_u.sum())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, decay: float = 1e-5) -> Classifier:
    """From the feature hashes of the sampled documents. Without positive or unlabelled documents, or features
    that tell them apart, every text scores the prior."""
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Classifier(start, {})
    n_p, n_u = len(positive), len(unlabelled)
    ids_p, df_p = np.unique(np.concatenate(positive), return_counts=True)
    ids_u, df_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.searchsorted(ids_u, ids_p)
    known = (at < len(ids_u)) & (ids_u[np.minimum(at, len(ids_u) - 1)] == ids_p) if len(ids_u) else np.zeros(len(ids_p), bool)
    in_u = np.where(known, df_u[np.minimum(at, len(df_u) - 1)], 0) if len(ids_u) else np.zeros(len(ids_p))
    share_p, share_u = df_p / n_p, (in_u + 1) / (n_u + 2)
    deviation = (share_p - share_u) / np.sqrt(share_u * (1 - share_u) / n_p)
    best = np.argsort(-deviation, kind="stable")[:FEATURES]
    chosen = np.sort(ids_p[best[(deviation[best] >= DEVIATION) & (df_p[best] >= max(LEAST, LEAST_SHARE * n_p))]])
    if not len(chosen):
        return Classifier(start, {})

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen)), dtype=np.float32)
        for k, row in enumerate(rows):
            here = np.searchsorted(chosen, row)
            here = np.minimum(here, len(chosen) - 1)
            out[k, here[chosen[here] == row]] = 1
        return out

    x_p, x_u = matrix(positive), matrix(unlabelled)
    weights, bias = np.zeros(len(chosen)), 0.0
    for part in range(CLASSIFIERS):
        own_p = x_p[np.arange(n_p) % CLASSIFIERS != part] if n_p >= CLASSIFIERS else x_p
        own_u = x_u[np.arange(n_u) % CLASSIFIERS != part] if n_u >= CLASSIFIERS else x_u
        w, b = np.zeros(len(chosen), dtype=np.float32), start
        m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        for t in range(1, steps + 1):
            g, g_b = _risk_step(own_p, own_u, w, b, prior)
            gradient = np.append(g + decay * w, g_b)
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
        weights, bias = weights + w / CLASSIFIERS, bias + b / CLASSIFIERS
    return Classifier(bias, {int(i): float(x) for i, x in zip(chosen, weights) if x})


def _shift(log_odds: np.ndarray, counts: np.ndarray, prior: float) -> float:
    """What to add to the log-odds of the unlabelled texts, given with their numbers, so that their mean score is the prior."""
    low, high = -2.0 * ENDS, 2.0 * ENDS
    for _ in range(60):
        middle = (low + high) / 2
        if np.average(1 / (1 + np.exp(-np.clip(log_odds + middle, -500, 500))), weights=counts) > prior:
            high = middle
        else:
            low = middle
    return (low + high) / 2


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows that have an id, with the ``key`` of their text."""
    return docs.where("doc_id IS NOT NULL").withColumn("key", F.md5(F.col("text").cast("binary")))


def _sampled(df: DataFrame, most: int, wanted: DataFrame | None = None) -> list[np.ndarray]:
    """Feature hashes of ``most`` different texts at most, of the ``wanted`` ids where these are given, each once."""
    keyed = _keyed(df)
    narrow = keyed.select("doc_id", "key")  # an inner join, as a semi-join would be moved to the texts and shuffle them
    drawn = (narrow if wanted is None else narrow.join(wanted, "doc_id")).groupBy("key").agg(F.min("doc_id").alias("doc_id")).orderBy("key").limit(most)
    texts = keyed.join(F.broadcast(drawn), ["doc_id", "key"]).dropDuplicates(["key"])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.array(sorted(features_of_text(t)), dtype=np.uint32).view(np.int32) for t in batch["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["key"], pa.array(found, pa.list_(pa.int32()))], ["key", "features"])

        return step

    rows = texts.select("key", "text").mapInArrow(per_batch(make), "key string, features array<int>")
    table = rows.toArrow().sort_by("key")["features"].combine_chunks()
    return [np.array(row.values.to_numpy(), dtype=np.int32).view(np.uint32) for row in table]


def _share(docs: DataFrame, labels: DataFrame) -> float:
    """The share of toxic texts among different texts. A text counts by the part of its copies that is labelled, so that
    one with many copies, which is likelier to have a label at all, counts no more than others."""
    rows = _keyed(docs).select("doc_id", "key").join(labels, "doc_id", "left")
    texts = rows.groupBy("key").agg(F.count("*").alias("copies"), F.count("toxic").alias("labelled"), F.max("toxic").alias("toxic"))
    weight = (F.col("labelled") / F.col("copies")).cast("decimal(20,12)")  # sums do not depend on the order
    of_all, of_toxic = texts.where("labelled > 0").agg(F.sum(weight), F.sum(F.when(F.col("toxic") == 1, weight))).first()
    return float((of_toxic or 0) / of_all) if of_all else 0.0


def _histogram(docs: DataFrame, classifier: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds of all different texts, rounded and bounded, and how many texts have them."""
    scored = _with_log_odds(_keyed(docs).select("key", "text"), classifier, "odds", "text", drop_text=True)
    place = F.round(F.greatest(F.least("odds", F.lit(float(ENDS))), F.lit(-float(ENDS))) * BINS).cast("int")
    texts = scored.groupBy("key").agg(F.min(place).alias("place"))
    rows = texts.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    return np.array([r.place for r in rows]) / BINS, np.array([r.n for r in rows], dtype=float)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """From documents and their ``toxic`` labels; the caller leaves out rows that are held out.

    Confirmed examples are texts labelled 1; all different texts are the unlabelled text. Labels of 0 serve only
    to estimate the class prior, where none is given: the share of toxic ones among different texts. Ids and texts labelled
    twice count as toxic if any label says so; null ids and labels, and labels of ids that have no document, take no part.
    """
    small_batches(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col)
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = _share(docs, labels)
    positive = _sampled(docs, POSITIVES, labels.where("toxic = 1").select("doc_id"))
    prior = min(max(float(prior), 1e-4), 0.9)
    found = fit(positive, _sampled(docs, UNLABELLED), prior)
    if not found.weights:
        return found
    return Classifier(found.bias + _shift(*_histogram(docs, found), prior), found.weights)


def _with_log_odds(df: DataFrame, classifier: Classifier, name: str, text_col: str, scores: bool = False, drop_text: bool = False) -> DataFrame:
    """``df`` with the log-odds of every row's text, or their scores."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    kept = [k for k in range(len(df.columns)) if not drop_text or k != at]
    bias, weights = classifier.bias, classifier.weights

    def make():
        known: dict[str, tuple[int, ...]] = {}

        def one(text: str | None) -> float:
            present: set[int] = set()
            for word in set(_WORD.findall((text or "").lower())):
                own = known.get(word)
                if own is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    own = known[word] = tuple(f for f in features_of_word(word) if f in weights)
                if own:
                    present.update(own)
            odds = bias + sum(weights[f] for f in sorted(present))
            return classifier.score(odds) if scores else float(odds)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([one(t) for t in batch.column(at).to_pylist()], pa.float64())
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), found], [*(batch.schema.names[k] for k in kept), name])

        return step

    return df.mapInArrow(per_batch(make), StructType([*(df.schema.fields[k] for k in kept), StructField(name, DoubleType())]))


def with_score(df: DataFrame, classifier: Classifier, name: str = "score", text_col: str = "text") -> DataFrame:
    """``df`` with the score of every row, from its whole text alone; a null text is an empty one.

    Null and repeated ids stay as they are, row by row; an empty table gives an empty one. A column that bears
    the new name is replaced.
    """
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()))
    return _with_log_odds(df, classifier, name, text_col, scores=True)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row."""
    return with_score(id_and_text(docs, id_col, text_col), classifier).select("doc_id", "score")


def reject(df: DataFrame, classifier: Classifier, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below the threshold, with all their columns."""
    (name,) = fresh(df, "score")
    return with_score(df, classifier, name, text_col).where(F.col(name) < threshold).drop(name)
