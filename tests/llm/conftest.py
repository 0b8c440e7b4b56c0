import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = (
    "keep_id kept group_size hash sha at slot shard block epoch rank tokens fingerprint component_id minimizer run start ids part "
    "ordinal candidates base spans score features toxic key wanted gone list vector query_id root node id own sha rows times n of_slot"
).split()
LONG = " ".join(f"word{k % 997}" for k in range(30_000))
PASSAGE = " ".join(f"Passage{k}" for k in range(60))


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, hot copies."""
    random.seed(5)
    voices = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(random.choice(voices) + str(random.randrange(40)) for _ in range(random.randrange(1, 90))) for _ in range(30)]
    rows = [(k, t, "en", f"src{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(100 + k, "The Hot COPY of " + PASSAGE, "en", "src0", 9) for k in range(12)]
    rows += [(200, "the hot copy of " + PASSAGE.lower(), None, "src1", None)]
    rows += [(201, "before " + PASSAGE + " after", "en", None, 1), (202, f"x {PASSAGE} y {PASSAGE}", "de", "", 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "src0", 0), (302, " \t\n\v\f\r ", "en", "src9", 3)]
    rows += [(303, LONG, "en", "src2", len(LONG)), (304, "one", "en", "src2", 3), (305, "One two", "en", "src2", 7)]
    rows += [(306, " É Straße İ Σς 日本　語 \U0001f600 <|endoftext|> ▁ don't\x00", "fr", "src3", 5)]
    rows += [(307, "x" * 50_000, "en", "src3", 50_000), (308, "mail a.b@c.example.org or +1 (269) 555-3296 4111111111111111, 10.0.0.1", "en", "src3", 1)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with other columns whose names the operators use."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="session")
def odd_with_nulls(spark, odd):
    """Also rows without an id."""
    more = spark.createDataFrame([(None, "no id", "en", "src0", 5), (None, None, None, None, None)], COLUMNS)
    return odd.unionByName(more, allowMissingColumns=True)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
