"""Registered queries against their SQL, and the pipeline against a plain version."""

import os
from collections import Counter

import pytest

from checks.run import compare, database
from tests.llm import test_mixing
from tests.llm.brute import near, sha
from tests.llm.test_exact import lowered

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_names():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


@pytest.mark.parametrize("name", ["op3_substring", "op5_exact_dedup", "op7_mixing", "op9_sharding", "op11_sign_hash", "op12_collocations"])
def test_query_equals_its_sql(spark, name):
    from titleflow.llm.queries import ORACLE, QUERIES

    assert compare(spark, database(SMALL), name, SMALL, QUERIES, ORACLE).startswith("ok")


def test_pipeline_equals_a_plain_version(spark):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from titleflow.llm import queries, toxicity
    from titleflow.llm.common import documents

    docs = documents(spark, SMALL)
    classifier = queries.toxicity_classifier(spark, docs, SMALL)
    rows = {}
    for r in docs.collect():
        odds = classifier.bias + sum(classifier.weights.get(f, 0.0) for f in toxicity.features_of_text(r.text or ""))
        if classifier.score(odds) < 0.5:
            rows[r.doc_id] = r
    last = {}
    for i in sorted(rows):
        last[lowered(rows[i].text)] = i
    rows = {i: rows[i] for i in last.values()}
    lead = set(near([(i, r.text) for i, r in rows.items()]).values())
    rows = {i: r for i, r in rows.items() if i in lead}
    words = [(i, r.source, len((r.text or "").split())) for i, r in rows.items()]
    times = Counter(m[0] for m in test_mixing.plain_mix(words, queries.MAX_EPOCHS))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter()
    for i, n in times.items():
        ids = library.encode(rows[i].text or "")
        expected[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] += n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == expected
    assert len(corpus_pipeline.STAGES) == 5


def test_rejected_documents_are_the_toxic_ones(spark):
    from titleflow.llm.common import documents
    from titleflow.llm.queries import QUERIES

    got = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01")
    held = got.where("held_out").join(documents(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    clean = held.where("toxic = 0")
    assert clean.where("predicted = 1").count() <= 0.02 * clean.count()
