import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from titleflow.llm import mixing


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def plain_mix(rows, max_epochs, seed="mix"):
    """(doc_id, source, tokens, epoch, block, block_rank, rank) by plain loops."""
    by = defaultdict(list)
    for doc, source, tokens in rows:
        by[source or ""].append((doc, tokens or 0))
    total = sum(t for own in by.values() for _, t in own)
    sums = {s: sum(t for _, t in own) for s, own in by.items()}
    shares = {s: n / total for s, n in sorted(sums.items()) if n}
    low, high = 0.0, 1.0
    for _ in range(50):
        a = (low + high) / 2
        ratios = [p**a / p for p in shares.values()]
        low, high = (a, high) if max(ratios) / min(ratios) > max_epochs else (low, a)
    out = []
    for s, own in by.items():
        blocks = math.ceil(math.sqrt(len(own)))
        whole, rest = 1, 0
        if sums[s]:
            quota = round(shares[s]**high * total / min(p**high / p for p in shares.values()))
            whole, rest = divmod(min(quota, math.floor(max_epochs * sums[s])), sums[s])
        dealt = defaultdict(list)
        for doc, t in own:
            name = "" if doc is None else doc
            dealt[int(md5(f"{seed}-block", name)[:15], 16) % blocks].append((doc, t))
        for epoch in range(whole + (rest > 0)):
            used = 0
            for block_rank, b in enumerate(sorted(dealt, key=lambda b: md5(seed, epoch, b)), start=1):
                for rank, (doc, t) in enumerate(sorted(dealt[b], key=lambda d: (md5(seed, epoch, "" if d[0] is None else d[0]), d[0] or 0, d[1])), start=1):
                    if epoch < whole or used < rest:
                        out.append((doc, s, t, epoch, b, block_rank, rank))
                    used += t
    return sorted(out, key=repr)


def mixed_rows(df):
    return df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("tokens"))


def test_mix_equals_a_plain_version(odd_with_nulls):
    rows = mixed_rows(odd_with_nulls)
    for most in (1.0, 1.5, 3.25):
        got = sorted((tuple(r) for r in mixing.mix(rows, max_epochs=most).collect()), key=repr)
        assert got == plain_mix([tuple(r) for r in rows.collect()], most)


def test_targets(spark):
    rows = spark.createDataFrame([(k, f"s{min(k % 20, 3)}", 10) for k in range(400)], "doc_id long, source string, tokens long")
    limited = {r.source: r for r in mixing.source_weights(rows, max_epochs=2).collect()}
    assert math.isclose(max(r.quota / r.n_tokens for r in limited.values()), 2, rel_tol=0.01)
    assert all(r.quota >= r.n_tokens for r in limited.values())
    assert math.isclose(sum(r.weight for r in limited.values()), 1)
    goal = 1.2
    reached = [r.weight for r in mixing.source_weights(rows, target_entropy=goal).collect()]
    assert math.isclose(-sum(w * math.log(w) for w in reached), goal, rel_tol=1e-6)
    flat = mixing.source_weights(rows, max_epochs=100, budget=800).collect()
    assert {r.quota for r in flat} == {200} and {r.exponent < 1e-9 for r in flat} == {True}
    taken = Counter(r.source for r in mixing.mix(rows, max_epochs=100, budget=800).collect())
    assert set(taken.values()) == {20}


@pytest.mark.parametrize("targets", [{}, {"max_epochs": 2, "target_entropy": 1.0}])
def test_one_target(spark, targets):
    with pytest.raises(ValueError):
        mixing.source_weights(spark.createDataFrame([], "source string, tokens long"), **targets)


def test_repeat_keeps_all_rows_and_columns(odd_with_nulls, empty):
    out = mixing.repeat(odd_with_nulls, max_epochs=2)
    assert out.columns == odd_with_nulls.columns
    before, after = (Counter((r.doc_id, r.text) for r in df.collect()) for df in (odd_with_nulls, out))
    assert set(before) == set(after) and all(after[k] in (n, 2 * n) for k, n in before.items())
    assert mixing.repeat(empty, max_epochs=2).count() == 0


def test_words(spark):
    texts = ["", None, " a\tb c\vd ", "x\x1cy z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(mixing.word_count(F.col("t")).alias("n")).collect()] == [
        len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_native(odd):
    plan = mixing.mix(mixed_rows(odd), max_epochs=2)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
