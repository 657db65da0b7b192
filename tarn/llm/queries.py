"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontamination, fingerprints, language_id, line_dedup, lm_scoring, minhash_dedup, packing, span_dedup, token_counts, training_order
from tarn.llm.common import NULL_ID, documents, fold_of, shared_dir


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprints.edited(documents(spark, sf_dir).select("doc_id", "text"))
    own, changed, other = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(changed).alias("edited_fingerprint"),
        fingerprints.resemblance(own, changed).alias("near_edited"),
        fingerprints.resemblance(own, other).alias("near_next"),
        fingerprints.containment(own, changed).alias("contained_in_edited"),
        fingerprints.distinct_shingles(own).alias("distinct_shingles"),
        fingerprints.distinct_shingles(fingerprints.merge(own, changed)).alias("shingles_of_both"),
    )


def op3_minhash_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_log_frequency_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold_of("doc_id", 5) == 1).alias("held_out"))
    path = shared_dir(spark)
    model = lm_scoring.train(docs.where(~F.col("held_out")), f"{path}/model")
    return lm_scoring.score(docs, model, path=path).drop("text")


def op5_run_merge_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op6_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, per_shard, length, key = documents(spark, sf_dir).select("doc_id", "text"), shared_dir(spark), 4096, 2048, 20240229
    manifest = training_order.plan(docs, f"{path}/manifest", length=length)
    rows, first, total = training_order.ordered(manifest, key=key, per_shard=per_shard, record=training_order.stride(length))
    training_order.write_shards(docs, first, total, f"{path}/shards", key=key, length=length, per_shard=per_shard)
    return rows


def op7_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold_of("doc_id", 4) == 2).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.classify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", language_id.accepted().alias("accepted"))


def op8_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op9_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_token_counts(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return span_dedup.dedup_spans(docs, min_words=12, alone=25).select("doc_id", "n_sentences", "n_removed", "repeats_of", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), owners AS (
  SELECT line_key, min(doc_id) AS owner FROM lines WHERE length(line_key) >= 10 GROUP BY line_key
), marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(o.owner < l.doc_id, false) AS gone
  FROM lines l LEFT JOIN owners o USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP3_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text, row_number() OVER () AS r FROM documents
  UNION ALL SELECT 'i', item_id, text, row_number() OVER () FROM benchmark
), words AS (
  SELECT side, id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts
), lengths AS (
  SELECT DISTINCT least(len(w), 5) AS n FROM words WHERE side = 'i' AND len(w) > 0
), runs AS (
  SELECT DISTINCT side, id, r, n, array_to_string(w[k : k + n - 1], ' ') AS run
  FROM (SELECT side, id, r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, lengths WHERE len(w) >= n AND (side = 'd' OR least(len(w), 5) = n))
), items AS (
  SELECT r, id, n, count(*) AS item_shingles FROM runs WHERE side = 'i' GROUP BY ALL
), found AS (
  SELECT d.r AS dr, d.id AS doc_id, i.r AS ir, count(*) AS shared FROM runs i JOIN runs d ON d.side = 'd' AND i.side = 'i' AND d.n = i.n AND d.run = i.run GROUP BY ALL
)
SELECT doc_id, id AS item_id, item_shingles, shared, shared / item_shingles AS containment
FROM found JOIN items ON items.r = found.ir WHERE 100 * shared >= 80 * item_shingles
"""
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda k: hash(w[k] || ' ' || w[k + 1]))) WHEN len(w) = 1 THEN [hash(w[1])] ELSE [] END AS s FROM words
), sized AS (
  SELECT doc_id, len(s) AS n FROM sets
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1
), grams AS (
  SELECT rep, n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), two_way AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS node, rep AS top FROM classes
  UNION SELECT two_way.b, reach.top FROM reach JOIN two_way ON two_way.a = reach.node
), found AS (
  SELECT node, min(top) AS component FROM reach GROUP BY node
)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sized LEFT JOIN (SELECT sets.doc_id, classes.rep FROM sets JOIN classes ON list_sort(sets.s) = classes.s) USING (doc_id) LEFT JOIN found ON found.node = rep
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_power_of_two_packing, op2_bottom_k_fingerprints, op3_minhash_containment_decontamination, op4_log_frequency_bloom_lm, op5_run_merge_line_dedup, op6_feistel_training_order, op7_compression_language_id, op8_hyperminhash_near_dedup, op9_rank_synchronous_token_counts, op10_sentence_span_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_containment_decontamination": OP3_SQL, "op5_run_merge_line_dedup": OP5_SQL, "op8_hyperminhash_near_dedup": OP8_SQL}
