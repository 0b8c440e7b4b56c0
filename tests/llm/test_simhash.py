import random

import pytest

from tests.llm.brute import fingerprint, grouped, near
from titleflow.llm import components, simhash


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("text", ["", " \t", "One", "one TWO", "a b c", "É é a B c d", "x\x1cy z w", "日 本 語 a", "a " * 70_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_classes_of_odd_rows(odd_with_nulls, empty):
    rows = [(r.doc_id, r.text) for r in odd_with_nulls.collect() if r.doc_id is not None]
    got = simhash.classes(odd_with_nulls).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == near(rows)
    assert {r.component_id for r in got if r.doc_id in (300, 301, 302)} == {300}
    assert simhash.classes(empty).count() == 0


def test_dedup_keeps_one_of_each_class(odd_with_nulls):
    kept = simhash.dedup(odd_with_nulls)
    assert kept.columns == odd_with_nulls.columns
    lead = {c for c in near([(r.doc_id, r.text) for r in odd_with_nulls.collect() if r.doc_id is not None]).values()}
    assert {r.doc_id for r in kept.collect()} == lead | {None}


@pytest.mark.parametrize("crowd", [2048, 40])
def test_links_of_crowded_fingerprints(spark, monkeypatch, crowd):
    """Balls of near values: many share a half, so buckets are cut again."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    random.seed(1)
    values = set()
    for centre in (random.getrandbits(64), 0, (1 << 64) - 1):
        for _ in range(400):
            value = centre
            for _ in range(random.randint(0, 7)):
                value ^= 1 << random.randrange(64)
            values.add(value)
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long").repartition(3)
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    expected = grouped({(signed(v), v) for v in values}, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {v: roots.get(v, v) for v, _ in expected} == {v: c for (v, _), c in expected.items()}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (7, 6), (7, 6)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 1000 for k in range(1000, 1300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
