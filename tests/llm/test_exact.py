from collections import defaultdict

from tests.llm.brute import sha
from titleflow.llm import exact


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, best):
    groups = defaultdict(list)
    for row in rows:
        groups[lowered(row[1])].append(row[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    return sorted(out, key=repr)


def test_classes_of_odd_rows(odd_with_nulls):
    rows = [(r.doc_id, r.text) for r in odd_with_nulls.collect()]
    for keep, best in (("smallest", min), ("largest", max)):
        assert sorted(map(tuple, exact.classes(odd_with_nulls, keep=keep).collect()), key=repr) == expected(rows, best)


def test_only_ascii_letters_fold(spark):
    df = spark.createDataFrame([(1, "É"), (2, "é"), (3, "Ⅷ A"), (4, "Ⅷ a"), (5, "\u212a"), (6, "k")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}


def test_dedup_keeps_one_row_of_each_text(odd):
    kept = exact.dedup(odd, keep="largest")
    assert kept.columns == odd.columns
    rows = [(r.doc_id, lowered(r.text)) for r in kept.collect()]
    assert len(rows) == len({t for _, t in rows}) == len({lowered(r.text) for r in odd.collect()})
    assert (200, lowered("the hot copy of " + odd.where("doc_id = 200").first().text[16:])) in rows


def test_empty(empty):
    assert exact.classes(empty).count() == 0 and exact.dedup(empty).count() == 0
