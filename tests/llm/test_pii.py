import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import BASE, listed, private_base
from titleflow.llm import pii

TRAPS = [
    None, "", "a@b.c.d_e@f.g", "a.b@c.d.", "@@a@b", "a@b.co,c@d.ef g@h.ij", "1.2.3.4.5", "256.1.1.1 0255.1.1.01 000000.0.0.0", "1.1.1.1.1.1.1.1",
    "9.9.9.99999999999999999999", "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  1111 1111 1111", "5 -41111111111111111",
    "9" * 30, "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "12  34567890123456", "+1 (269) 555-3296 4524132264652876", "+1+1+12345678901",
    "+1 234-567-8901) and +12", "\U0001f600 a@b.co \U0001f600 +12345678901 é 1.2.3.4", "x" * 30_000 + "@", "1" * 30_000, "1 " * 20_000, "+1" * 9_000,
    "a." * 20_000 + "a@b.c", "1." * 20_000,
]


@pytest.fixture(scope="module")
def trees(spark):
    from titleflow.llm.common import documents

    return pii.train(documents(spark, "/root/testdata/sf0.01"))


def test_base_spans(spark, trees, odd_with_nulls):
    df = spark.createDataFrame(list(enumerate(TRAPS)), "doc_id long, text string")
    for rows in (df, odd_with_nulls):
        texts = Counter((r.doc_id, r.text) for r in rows.collect())
        found = pii.find(rows, trees).collect()
        assert Counter(r.doc_id for r in found) == Counter(i for i, _ in texts.elements())
        expected = Counter((i, listed(private_base(t))) for i, t in texts.elements())
        assert Counter((r.doc_id, listed([tuple(s) for s in r.base])) for r in found) == expected
        for r in found:
            base, spans = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
            assert set(base) <= set(spans) and spans == sorted(spans)


APART = [
    "41 11 11 11 11 11 11 11", "411 111 111 111 111 1", "4 1 1 1-1-1-1 1 1 1 1 1 1 1 1 1", "1 2 3 4 5 6 7 8 9 0 1 2 3 7", "x 41-11-11-11-11-11-11-11.",
    "41 11 11 11 11 11 11 11 " + "1 " * 20_000, "1 " * 20_000 + ", 41 11 11 11 11 11 11 11", "4111.1111.1111.1111", "41 11 11 11 11 11 11 12",
]


def test_cards_without_four_digits_in_a_row(spark, trees):
    df = spark.createDataFrame(list(enumerate(APART)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(df, trees).collect()}
    assert {i: listed([tuple(s) for s in r.base]) for i, r in found.items()} == {i: listed(private_base(t)) for i, t in enumerate(APART)}
    assert [len(found[i].base) for i in range(len(APART))] == [1, 1, 1, 1, 1, 0, 1, 0, 0]
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in found.values())
    assert {r.doc_id: r.text for r in pii.redact(df.where("doc_id IN (0, 4)"), trees).collect()} == {0: "[card]", 4: "x [card]."}


def test_further_spans_do_not_overlap(spark, trees):
    text = "call +1 (269) 555-3296 4524132264652876 now"
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), trees).first()
    assert row.base == [] and listed([tuple(s) for s in row.spans]) == "phone:5:22,card:23:39"


def test_hex_strings_are_left_alone(spark, trees):
    text = 'token = "4111111111111111ab" id=x4111111111111111 in-1234'
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), trees).first()
    assert [tuple(s) for s in row.spans] == private_base(text)


def test_redact(spark, trees):
    df = spark.createDataFrame([(1, "\U0001f600 a@b.co \U0001f600 +12345678901 é 1.2.3.4"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df, trees).collect()} == {1: "\U0001f600 [email] \U0001f600 [phone] é [ip]", 2: ""}


def test_trees_learn_and_thresholds_hold():
    table = [
        dict(zip(("kind", *pii.FEATURES), (2, g, 4, check, b, 0, 0, 0)), positive=p, negative=n)
        for g, check, b, p, n in ((0, 1, 0, 90, 0), (3, 1, 0, 90, 1), (3, 0, 2, 0, 60), (3, 1, 2, 0, 5))
    ]
    trees = pii.boost(table)
    values = [trees.value(r) for r in table]
    assert min(values[:2]) > trees.thresholds[2] > max(values[2:])
    assert trees.thresholds[0] == float("inf")
    assert pii.boost([]).trees == []


def test_luhn_and_patterns_are_native(spark, trees, empty):
    assert pii.find(empty, trees).count() == 0 and pii.train(empty).thresholds == [float("inf")] * 4
    plan = pii.find(empty, trees)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert [k for k, _ in BASE] == list(pii.KINDS)


def test_very_many_spans_in_one_text(spark, trees):
    """A log of one line per address: spans are never compared with all others, so twice as many take little more than twice as long."""
    import time

    def log(n):
        return "\n".join(f"user{k}@host{k}.example.org from 10.{k // 250 % 250}.{k % 250}.7 or u{k}(at)h{k}(dot)com" for k in range(n))

    seconds = {}
    for n in (200, 10_000, 20_000):
        df = spark.createDataFrame([(1, log(n))], "doc_id long, text string")
        start = time.perf_counter()
        row = pii.find(df, pii.Trees(trees.start, trees.trees, [-99.0] * 4)).first()
        seconds[n] = time.perf_counter() - start
        assert listed([tuple(s) for s in row.base]) == listed(private_base(log(n)))
        assert len(row.spans) >= 3 * n
    assert seconds[20_000] < 3 * seconds[10_000]


def test_context_reaches_over_earlier_matches(spark):
    """What stands before and after a match, also where matches follow each other closely."""
    text = "tel: 1.1.1.1,2.2.2.2 3.3.3.3;4.4.4.4" + "x" * 40 + "5.5.5.5"
    row = spark.createDataFrame([(text,)], "text string").select(pii._positions(F.col("text"), pii.BASE[pii.IP]).alias("p")).first()
    assert [(s.start, s.end, s.match) for s in row.p] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9](\.[0-9]){3}", text)]
    for s in row.p:
        assert s.before == text[max(0, s.start - pii.CONTEXT):s.start] and s.after == text[s.end:s.end + 1]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 1001])
def test_sums_of_what_precedes(spark, n):
    values = [k * 7919 % 101 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(pii._before(F.col("v"), F.lit(0), "int", lambda a, b: a + b).alias("s"), pii._before(F.col("v"), F.lit(0), "int", lambda a, b: F.greatest(a, b)).alias("m")).first()
    assert got.s == [sum(values[:k]) for k in range(n)] and got.m == [max(values[:k], default=0) for k in range(n)]
