"""One query per operator over the driver's tables, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleflow.llm import collocations, conversation_repair, exact, mixing, pii, piece_codec, placement, posting_lists, sign_hash, simhash, substring, token_files, toxicity
from titleflow.llm.common import documents, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: No source is passed more often than this in the mix of the registered query and of the pipeline.
MAX_EPOCHS = 2.0
#: Vocabulary files of the installed public tokenizers.
WORD_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "piece_bpe_32k.model"
SHARDS = [f"shard-{k:03d}" for k in range(128)]


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path, vocabulary(WORD_VOCABULARY))
    return token_files.summary(spark, path)


@query("op2_posting_lists")
def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_substring", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"kept_sha256": lambda kept: F.sha2(kept.cast("binary"), 256)}
    return substring.dedup(documents(spark, sf_dir), columns=digest)


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op5_exact_dedup", f"""
WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(documents(spark, sf_dir), keep="largest")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(piece_codec.round_trip(documents(spark, sf_dir), vocabulary(PIECE_VOCABULARY)))


def piece_digests(encoded: DataFrame) -> DataFrame:
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mix_sql(tokens: str, max_epochs: float, seed: str = "mix") -> str:
    """The mix of rows (doc_id, source, tokens) under a repetition limit, in DuckDB."""
    return f"""
WITH RECURSIVE d AS ({tokens}),
s AS (SELECT source, count(*) AS n_rows, sum(tokens)::BIGINT AS n_tokens FROM d GROUP BY source),
p AS (SELECT n_tokens / sum(n_tokens) OVER () AS share FROM s WHERE n_tokens > 0 ORDER BY source),
step(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN up THEN middle ELSE low END, CASE WHEN up THEN high ELSE middle END
  FROM (SELECT k, low, high, (low + high) / 2 AS middle,
               (SELECT max(pow(share, (low + high) / 2) / share) / min(pow(share, (low + high) / 2) / share) FROM p) > {max_epochs} AS up
        FROM step WHERE k < 50)),
a AS (SELECT high AS exponent FROM step WHERE k = 50),
w AS (SELECT source, n_rows, n_tokens,
             least(round(pow(n_tokens / (SELECT sum(n_tokens) FROM s), exponent) * (SELECT sum(n_tokens) FROM s)
                   / (SELECT min(pow(share, exponent) / share) FROM p)), floor({max_epochs} * n_tokens))::BIGINT AS quota
      FROM s, a WHERE n_tokens > 0
      UNION ALL SELECT source, n_rows, n_tokens, 0 FROM s WHERE n_tokens = 0),
q AS (SELECT source, ceil(sqrt(n_rows))::BIGINT AS blocks,
             CASE WHEN n_tokens > 0 THEN quota // n_tokens ELSE 1 END AS whole,
             CASE WHEN n_tokens > 0 THEN quota % n_tokens ELSE 0 END AS rest FROM w),
dealt AS (SELECT d.*, q.whole, q.rest, ('0x' || substr(md5('{seed}-block:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % q.blocks AS block
          FROM d JOIN q USING (source)),
b AS (SELECT source, block, any_value(whole) AS whole, any_value(rest) AS rest, sum(tokens)::BIGINT AS in_block FROM dealt GROUP BY ALL),
e AS (SELECT source, block, whole, rest, in_block, unnest(range(whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM b),
o AS (SELECT *, row_number() OVER v AS block_rank, sum(in_block) OVER v - in_block AS before
      FROM e WINDOW v AS (PARTITION BY source, epoch ORDER BY md5('{seed}:' || epoch || ':' || block), block)),
r AS (SELECT dealt.doc_id, dealt.source, dealt.tokens, o.epoch, o.block, o.block_rank, dealt.whole, dealt.rest,
             row_number() OVER v AS rank, o.before + sum(dealt.tokens) OVER v - dealt.tokens AS before
      FROM dealt JOIN o ON dealt.source = o.source AND dealt.block = o.block
      WINDOW v AS (PARTITION BY dealt.source, dealt.block, o.epoch
                   ORDER BY md5('{seed}:' || o.epoch || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, dealt.tokens
                   ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, tokens, epoch, block, block_rank, rank FROM r WHERE epoch < whole OR before < rest
"""


@query("op7_mixing", mix_sql(f"SELECT doc_id, coalesce(source, '') AS source, {WORDS} AS tokens FROM documents", MAX_EPOCHS))
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("tokens"))
    return mixing.mix(rows, max_epochs=MAX_EPOCHS)


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.train(docs))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def sharding_sql(table: list[int]) -> str:
    """Slots and shards of whole documents; the table itself is held against its rule by the tests."""
    return f"""
WITH t AS (SELECT string_split('{",".join(map(str, table))}', ',') AS shards),
d AS (SELECT doc_id, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {len(table)} AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1]::INTEGER AS shard, sha256(text) AS text_sha256 FROM d, t
"""


@query("op9_sharding", sharding_sql(placement.fill(SHARDS)))
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), work_path(spark, "shards")
    placement.write_shards(docs, "doc_id", placement.fill(SHARDS), path)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return placement.read_shards(spark, path, docs).select("doc_id", "slot", "shard", F.sha2(text, 256).alias("text_sha256"))


def held_out(doc_id):
    """A fifth of all documents, by id, whose labels nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Classifier:
    learned = ~held_out(F.col("doc_id"))
    return toxicity.train(docs.where(learned), documents(spark, sf_dir, "labels").select("doc_id", "toxic").where(learned))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_classifier(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_sign_hash", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT x, x AS y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.x LEFT JOIN n ON vec_id = n.x
""")
def op11_sign_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_hash.classes(documents(spark, sf_dir, "embeddings"))


def collocation_sql(least: int, report: int) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {LOWERED} AS t FROM documents),
piece AS (SELECT row_number() OVER () AS p, lang, t FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d)),
word AS (SELECT p, lang, w, i FROM (SELECT p, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i
         FROM (SELECT p, lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM piece))),
run AS (SELECT lang, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY p ORDER BY i)),
one AS (SELECT lang, a, count(*) AS f FROM run GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM run GROUP BY ALL),
two AS (SELECT lang, a, b, count(*) AS f FROM run WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
three AS (SELECT lang, a, b, c, count(*) AS f FROM run WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
longer AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three) GROUP BY ALL),
cut AS (
  SELECT two.lang, two.a || ' ' || two.b AS phrase, two.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM two JOIN one AS x ON x.lang = two.lang AND x.a = two.a JOIN one AS y ON y.lang = two.lang AND y.a = two.b
       LEFT JOIN longer ON longer.lang = two.lang AND longer.a = two.a AND longer.b = two.b
  WHERE longer.f IS NULL OR 100 * longer.f < 50 * two.f
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, x.f, y.f, 1
  FROM three AS t JOIN one AS x ON x.lang = t.lang AND x.a = t.a JOIN two AS y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, x.f, y.f, 2
  FROM three AS t JOIN two AS x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN one AS y ON y.lang = t.lang AND y.a = t.c),
scored AS (SELECT *, (1000000 * a::HUGEINT * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {report}
"""


@query("op12_collocations", collocation_sql(collocations.LEAST, collocations.REPORT))
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, there = conversation_repair.damaged(documents(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, present=there)
