import numpy as np
import pytest
from pyspark.sql import functions as F

from titleflow.llm import sign_hash

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.98):
    """{(id, position): (links, component, kept)} over all pairs of the rows with an id."""
    rows = [r for r in rows if r[0] is not None]

    def fine(r):
        return r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    near = [[] for _ in rows]
    for a, x in enumerate(rows):
        for b in range(a):
            y = rows[b]
            if fine(x) and fine(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = (np.asarray(r[1], dtype=float) / np.abs(r[1]).max() for r in (x, y))
                if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= cosine:
                    near[a].append(b)
                    near[b].append(a)
    lead = {}
    for a in range(len(rows)):
        if a not in lead:
            reached, todo = {a}, [a]
            while todo:
                new = set(near[todo.pop()]) - reached
                reached |= new
                todo += new
            least = min(rows[k][0] for k in reached)
            lead.update(dict.fromkeys(reached, least))
    return sorted((r[0], len(near[a]), lead[a], r[0] == lead[a]) for a, r in enumerate(rows))


def found(df, **more):
    return sorted(tuple(r) for r in sign_hash.classes(df, **more).collect())


def cluttered(n=400, d=24, seed=1):
    """Chains and balls of near vectors, of three labels."""
    random = np.random.default_rng(seed)
    centres = random.normal(size=(20, d))
    out = []
    for k in range(n):
        spread = (0.02, 0.08, 0.12, 1.0)[k % 4]
        out.append((k, (centres[k % 20] + spread * random.normal(size=d)).astype(np.float32).tolist(), k % 3))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    """Also where a bucket is dealt into many blocks."""
    monkeypatch.setattr(sign_hash, "BLOCK", block)
    rows = cluttered()
    # more and wider tables than usual, so that none of these pairs is missed
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), tables=40, bits=8) == plain(rows)


def test_a_hot_vector_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0, -0.0], 1) for k in range(50)] + [(60, [2.0, 0.0, 0.0], 1), (61, [1.0, 0.05, 0.0], 1), (62, [1.0, 0.0, 0.0], 2)]
    rows += [(70, None, 1), (71, [], 1), (72, [0.0, 0.0, 0.0], 1), (73, [nan, 1.0, 0.0], 1), (74, [inf, 0.0, 0.0], 1), (75, [None, 1.0, 0.0], 1)]
    rows += [(76, [1.0, 0.0, 0.0], None), (77, [1.0, 0.0, 0.0], None), (78, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1)]
    rows += [(3, [1.0, 0.0, 0.0], 1), (3, [0.0, 1.0, 0.0], 1), (80, [1e-30, 1e-30, 0.0], 1), (81, [3e30, 3e30, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2).withColumns({c: F.lit("other") for c in ("v", "g", "a", "b", "n", "root", "digest", "kept_id", "first")})
    assert found(df) == plain(rows)
    kept = sign_hash.dedup(df)
    assert kept.columns == df.columns
    lead = {i for i, _, _, own in plain(rows) if own}
    assert sorted(r.vec_id for r in kept.collect() if r.vec_id is not None) == sorted(r[0] for r in rows if r[0] in lead)
    assert kept.where("vec_id IS NULL").count() == 1
    assert found(df.where("false")) == []


def test_recall_with_the_production_tables():
    """The share of pairs at exactly the threshold that share a bucket."""
    random = np.random.default_rng(5)
    d, n = 64, 20_000
    one = random.normal(size=(n, d))
    one /= np.linalg.norm(one, axis=1)[:, None]
    other = random.normal(size=(n, d))
    other -= (other * one).sum(axis=1)[:, None] * one
    other /= np.linalg.norm(other, axis=1)[:, None]
    two = 0.98 * one + np.sqrt(1 - 0.98**2) * other
    same = [sign_hash.buckets(x, sign_hash.TABLES, sign_hash.BITS) for x in (one, two)]
    assert (same[0] == same[1]).any(axis=1).mean() > 0.999


def test_query_equals_all_pairs(spark):
    from titleflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_sign_hash"](spark, sf).collect()) == plain(rows)
