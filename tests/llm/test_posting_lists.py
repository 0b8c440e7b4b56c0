import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleflow.llm import posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, queries, k=10):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.asarray(x, float) - np.asarray(v, float)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = near[:k]
    return out


def same(got, expected):
    return set(got) == set(expected) and all(
        [i for _, i in got[q]] == [i for _, i in expected[q]] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in expected[q]]) for q in got)


def found(df, **more):
    out = {}
    for r in posting_lists.search(df, F.col("vec_id") % 100 == 0, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def clustered():
    random = np.random.default_rng(3)
    centres = random.normal(size=(12, 16))
    return [(k, (centres[k % 12] + 0.5 * random.normal(size=16)).astype(np.float32).tolist(), 0) for k in range(3000)]


def test_recall(spark, clustered):
    df = spark.createDataFrame(clustered, SCHEMA)
    rows = [(i, v) for i, v, _ in clustered]
    exact = plain(rows, [r for r in rows if r[0] % 100 == 0])
    got = found(df)
    assert set(got) == set(exact)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in exact[q]}) for q in exact)
    assert hits >= 0.9 * 10 * len(exact)
    by = dict(rows)
    for q, near in got.items():
        for score, i in near:
            assert math.isclose(score, float(np.sqrt(((np.asarray(by[i], float) - np.asarray(by[q], float)) ** 2).sum())), rel_tol=1e-12)


def test_few_rows_are_searched_whole(spark, clustered):
    rows = [(i, v) for i, v, _ in clustered[:205]]
    assert same(found(spark.createDataFrame(clustered[:205], SCHEMA)), plain(rows, [r for r in rows if r[0] % 100 == 0]))


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0], 0) for k in range(0, 40)] + [(100, [0.0, 1.0], 0), (101, [0.0, -1.0], 0), (102, [2.0, 1.0], 0)]
    bad = [(200, None, 0), (300, [0.0, 0.0], 0), (400, [nan, 1.0], 0), (500, [inf, 1.0], 0), (600, [None, 1.0], 0), (700, [1.0], 0), (None, [1.0, 0.0], 0)]
    got = found(spark.createDataFrame(rows + bad + [rows[0]], SCHEMA).withColumn("list", F.lit(1)))
    assert same(got, plain([r[:2] for r in rows], [(0, [1.0, 0.0]), (100, [0.0, 1.0])]))
    assert [i for _, i in got[0]] == list(range(1, 11))


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [3.0], 0)], SCHEMA)
    assert found(df) == {0: [(2.0, 1)]}
    assert found(df.where("vec_id = 0")) == {} and found(df.where("false")) == {}


def test_long_lists_are_cut(spark, clustered, monkeypatch):
    monkeypatch.setattr(posting_lists, "PART", 20)
    rows = [(i, v) for i, v, _ in clustered[:205]]
    assert same(found(spark.createDataFrame(clustered[:205], SCHEMA)), plain(rows, [r for r in rows if r[0] % 100 == 0]))


def test_parts_are_balanced_and_the_graph_finds_the_nearest():
    random = np.random.default_rng(1)
    points = random.normal(size=(4000, 8))
    sizes = [len(p) for p in posting_lists.balanced_parts(points, 60)]
    assert sum(sizes) == 4000 and max(sizes) - min(sizes) <= 8
    centroids = posting_lists.fit(points, 500)
    queries = random.normal(size=(200, 8))
    ids, far = centroids.search(queries, 64)
    exact = np.argsort(((centroids.points[None] - queries[:, None]) ** 2).sum(axis=2), axis=1)
    assert np.mean(ids[:, 0] == exact[:, 0]) > 0.97
    assert (np.diff(far, axis=1) >= 0).all()


def test_a_query_that_is_a_centroid_reads_other_lists():
    points = np.random.default_rng(2).normal(size=(400, 8))
    centroids = posting_lists.fit(points, 200)
    probes = centroids.probes(centroids.points[:20].astype(float))
    assert min(map(len, probes)) >= centroids.probed()[0] == 14


def spread(kind, n, d=64, seed=3):
    random = np.random.default_rng(seed)
    if kind == "isotropic":
        return random.normal(size=(n, d)).astype(np.float32)
    return (random.normal(size=(n // 100, d))[random.integers(0, n // 100, n)] + 0.5 * random.normal(size=(n, d))).astype(np.float32)


def recall_by_lists(vectors, sample, lists, asked, k=10):
    """The share of the true nearest ones that lie on a list which their query reads, and the share of lists read."""
    centroids = posting_lists.fit(vectors[:sample], lists)
    hits, read = 0, []
    near = [np.argsort(((vectors - vectors[q]) ** 2).sum(axis=1))[1:k + 1] for q in asked]
    probes = centroids.probes(vectors[asked].astype(float))
    for own, top in zip(probes, near):
        read.append(len(own) / len(centroids.points))
        hits += sum(bool(set(held.tolist()) & set(own.tolist())) for held in centroids.lists_of(vectors[top].astype(float)))
    return hits / (k * len(asked)), float(np.mean(read))


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
@pytest.mark.parametrize("n,sample,lists,most", [(500, 500, 16, 0.5), (12_800, 12_800, 400, 0.25), (60_000, 50_000, 4000, 0.08)])
def test_recall_by_number_of_lists(kind, n, sample, lists, most):
    vectors = spread(kind, n)
    recall, read = recall_by_lists(vectors, sample, lists, list(range(0, n, max(1, n // 60))))
    print(kind, n, lists, "recall", recall, "read", read)
    assert recall >= 0.9 and read < most


def test_queries_over_pruned_lists(spark):
    """The whole query, on vectors without any clusters, far more lists than a query reads."""
    vectors = spread("isotropic", 4000, 32)
    got = found(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], SCHEMA).repartition(4))
    hits = 0
    for q in range(0, 4000, 100):
        far = ((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10].tolist()) & {i for _, i in got[q]})
    assert hits >= 0.9 * 10 * 40


def test_groups_are_bounded(spark, clustered, monkeypatch):
    """Hot queries and long spans are dealt into several groups, with the same result."""
    df = spark.createDataFrame(clustered[:1000], SCHEMA)
    whole = found(df)
    monkeypatch.setattr(posting_lists, "ASKED", 2)
    monkeypatch.setattr(posting_lists, "PART", 50)
    assert same(found(df), whole)


def test_lists_that_hold_too_few(spark, monkeypatch):
    """A query whose lists hold fewer than k vectors reads all lists."""
    monkeypatch.setattr(posting_lists, "LIST", 2)
    monkeypatch.setattr(posting_lists, "REPLICAS", 1)
    vectors = spread("isotropic", 101, 8)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)]
    assert all(len(near) == 10 for near in found(spark.createDataFrame(rows, SCHEMA)).values())
