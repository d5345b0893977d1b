"""Queries over the corpus tables, one per operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.llm import ann, brown, embedding_dedup, language_id, mixing, ngram_join, packing, secrets, substring, toxicity
from pelorus.llm.common import crc_bucket, read


def vocabulary_file() -> str:
    """The public word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary_file(), window=2048, end_id=1)


def op2_substring_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False))
    model, counts = brown.train(docs.where(~held_out))
    return brown.score(docs.withColumn("held_out", held_out), model, counts, keep=("doc_id", "held_out"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_ann_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), lambda v: v % 20 == 0, k=20)


def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


def op8_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_language_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    profiles = language_id.train(docs.where(~held_out))
    out = language_id.identify(docs.withColumn("held_out", held_out), profiles, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "distance")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.new_ledger(spark)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


# What SQL can tell of operators whose whole result it can't express.


def lm_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op3's counts and base score."""
    out = op3_brown_classes(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op4's sizes and targets, whether its source's words came within a block of the target, and no document above twice its size."""
    from pyspark.sql import Window

    out = op4_mix_sources(spark, sf_dir).withColumn("all", F.sum("taken").over(Window.partitionBy("source")))
    near = (F.abs(F.col("all") - F.col("target")) <= mixing.BLOCK_WORDS + 1) & (F.col("taken") <= 2 * F.col("size"))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), near.alias("near"))


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents op9 holds out, and to which it gives no language."""
    return op9_language_rank_order(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("und"))


def packed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op1's sequences: how many hold more than a window, have a gap, or share a place."""
    out = op1_pack_best_fit(spark, sf_dir).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"))
    return out.agg(F.count_if((F.col("n") > 2048) | (F.col("n") != F.col("end")) | (F.col("first") != 0)).alias("wrong"), (F.count("*") > 0).alias("some"))


def _secret_sql() -> str:
    def spans(rank: int, rule: secrets.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            's': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
            'n': length(m[i]), 'part': length(p[i])}})) AS x, {rule.least} AS least
          FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS p, string_split_regex(t, '{pattern}') AS g
                FROM d WHERE regexp_matches(t, '{pattern}'))"""

    parts = "\n UNION ALL ".join(spans(i, r) for i, r in enumerate(secrets.RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
      f AS (SELECT rid, rank, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM ({parts}) WHERE x.part >= least),
      g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
              string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(secrets.BASE_RULES)}) AS base,
              string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM f GROUP BY rid)
      SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pack_best_fit, op2_substring_suffix_tree, op3_brown_classes, op4_mix_sources, op5_ngram_jaccard, op6_ann_nn_descent, op7_toxicity_pu, op8_embedding_hnsw, op9_language_rank_order, op10_secret_ledger, lm_token_counts, mix_targets, language_folds, packed_lengths)
}

_WORDS_LOWER = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_LOWER} AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b USING (x)
          WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
  l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (na + nb - i)),
  c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id)
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
  FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)"""

_SUBSTRING_SQL = r"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  p AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM w WHERE len(w) >= 35),
  r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
  x AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM r),
  k AS (SELECT rid, doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM w),
  s AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n_kept FROM k ANTI JOIN x USING (rid, j) GROUP BY rid)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
  FROM w LEFT JOIN s USING (rid)"""

# crc32 of an id as text: the table of its bytes, then a fold over them
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""
_CRC_OF_ID = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295)"""

_COUNTS_SQL = f"""WITH {_CRC}, d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_CRC_OF_ID} % 7 = 2, false) AS held_out, list_append({_WORDS_LOWER}, '') AS w FROM documents, crc),
  e AS (SELECT rid, held_out, unnest(w) AS w FROM d), c AS (SELECT w, count(*) AS c FROM e WHERE NOT held_out GROUP BY w), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
  s AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS base FROM e LEFT JOIN c USING (w), n GROUP BY rid)
  SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 4) AS base_score FROM d JOIN s USING (rid), n"""

_TARGETS_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
  w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM s), a AS (SELECT 1.5::DOUBLE * sum(size) AS words FROM w),
  r(turn, i, w, size, left_, target) AS (SELECT 0, i, w, size, words, CAST(NULL AS DOUBLE) FROM w, a
    UNION ALL SELECT turn + 1, i, w, size, left_ - sum(CASE WHEN target IS NULL AND share > 2 * size THEN 2.0 * size ELSE 0 END) OVER (), CASE WHEN target IS NULL AND share > 2 * size THEN 2.0 * size ELSE target END
      FROM (SELECT *, left_ * w / sum(CASE WHEN target IS NULL THEN w END) OVER () AS share FROM r) WHERE turn < (SELECT count(*) FROM w)),
  f AS (SELECT i, coalesce(target, left_ * w / sum(CASE WHEN target IS NULL THEN w END) OVER ()) AS target FROM r WHERE turn = (SELECT count(*) FROM w))
  SELECT d.doc_id, d.size, CAST(s.size AS BIGINT) AS source_size, round(f.target, 4) AS target, true AS near FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source JOIN f USING (i)"""

_FOLDS_SQL = rf"""WITH {_CRC} SELECT doc_id, coalesce({_CRC_OF_ID} % 5 = 0, false) AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS und FROM documents, crc"""

_VECTORS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  g AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)"""

_NEAREST_SQL = f"""WITH {_VECTORS},
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS score
        FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

_COSINE_SQL = f"""WITH RECURSIVE {_VECTORS},
  n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM g),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.len * b.len) >= 0.98),
  c AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.vec_id),
  m AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY vec_id),
  k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
  SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)"""

ORACLE_SQL: dict[str, str] = {"op2_substring_suffix_tree": _SUBSTRING_SQL, "op5_ngram_jaccard": _JACCARD_SQL, "op6_ann_nn_descent": _NEAREST_SQL, "op8_embedding_hnsw": _COSINE_SQL, "op10_secret_ledger": _secret_sql(), "lm_token_counts": _COUNTS_SQL, "mix_targets": _TARGETS_SQL, "language_folds": _FOLDS_SQL, "packed_lengths": "SELECT 0 AS wrong, true AS some"}
