import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from titleflow.llm import placement


def plain(shards, size):
    orders = []
    for name in shards:
        offset, skip = placement._number(f"offset:{name}") % size, placement._number(f"skip:{name}") % (size - 1) + 1
        orders.append([(offset + k * skip) % size for k in range(size)])
    table = [-1] * size
    while -1 in table:
        for k, order in enumerate(orders):
            free = [slot for slot in order if table[slot] < 0]
            if free:
                table[free[0]] = k
    return table


def test_turns_equal_a_plain_version():
    assert placement.fill(["a", "b", "c"], 101) == plain(["a", "b", "c"], 101)


def test_shares_are_even_and_a_lost_shard_moves_little():
    names = [f"s{k}" for k in range(10)]
    table = placement.fill(names, 10_007)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = placement.fill(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.25 * 10_007
    twice = Counter(placement.fill(names, 10_007, {"s0": 2}))
    assert 1.9 < twice[0] / twice[1] < 2.1


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7), (["a"], 1_000_033)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        placement.fill(shards, size)


def test_placing_odd_rows(odd_with_nulls, empty):
    table = placement.fill(["a", "b", "c"], 101)
    placed = placement.place(odd_with_nulls, "doc_id", table)
    assert set(placed.columns) == set(odd_with_nulls.columns)
    rows = placed.collect()
    assert len(rows) == odd_with_nulls.count()
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])
    assert placement.place(empty, "doc_id", table).count() == 0


def test_shards_are_written_whole(spark, odd_with_nulls, empty):
    """Every row with all its columns, also those named like the operator's own; each shard in its folder only."""
    import os

    from titleflow.session import work_path

    path, table = work_path(spark, "shards"), placement.fill(["a", "b", "c"], 11)
    slot, shard = placement.write_shards(odd_with_nulls, "doc_id", table, path)
    assert (slot, shard) == ("slot_", "shard_")
    back = placement.read_shards(spark, path, odd_with_nulls)
    assert Counter(map(repr, back.drop(slot, shard).collect())) == Counter(map(repr, odd_with_nulls.collect()))
    for r in back.select("doc_id", F.col(slot).alias("s"), F.col(shard).alias("h")).collect():
        assert r.s == int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 11 and r.h == table[r.s]
    assert {f for f in os.listdir(path) if f.startswith(shard)} == {f"{shard}={k}" for k in {r[0] for r in back.select(shard).collect()}}
    plan = back.where(F.col(shard) == 1)._jdf.queryExecution().executedPlan().toString()
    assert f"({shard}#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    path = work_path(spark, "shards")
    placement.write_shards(empty, "doc_id", table, path)
    assert placement.read_shards(spark, path, empty).count() == 0
