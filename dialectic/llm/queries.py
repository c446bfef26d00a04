"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from dialectic.llm import bpe, decontaminate, filteraudit, hashing, language, lm, packing, pii, repair, ring, runs, simhash, urls
from dialectic.llm.frames import id_remainder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2).select(
        "doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                        end_id=2, with_ids=False)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = id_remainder("doc_id", 5)
    found = language.identify(docs.select("doc_id", "text"), docs.filter(rest != 0).select("text", "lang"))
    return found.select("doc_id", (rest == 0).alias("held_out"), F.col("_lang").alias("lang_pred"),
                        F.col("_score").alias("score"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_rows(table(spark, sf_dir, "documents"), shards=16)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read_shards(repair.write_shards(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with every word i >= a of a tenth of the texts replaced by
    word a + (i - a) mod p; such texts get single blanks."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    d = d.select("*", F.size("_w").alias("_n")).select("*", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).alias("_a"))
    p = 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))
    d = d.select("*", p.alias("_p"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    changed = F.transform("_w", lambda w, i: F.get("_w", place(i).cast("int")))
    return d.select("doc_id", F.when(F.col("_n") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), runs.strongest("runs").alias("_best"),
                         F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
                        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_pii, op3_packing, op4_language, op5_multi_index, op6_decontamination, op7_sharding,
    op8_language_model, op9_token_shards, op10_url_filter, op11_runs,
    op12_byte_bpe, op13_filter_audit)}

ORACLE = {
    "op13_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good,
                 coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substring(filter_order, step, 1) AS x, substring(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
cases AS (
  SELECT part, filter_order, step, x, n, good, toxic, fails = x AS alone, contains(fails, x) AS bad,
         len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AS earlier
  FROM sets, steps),
sums AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT bad AND NOT earlier THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN bad AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN bad AND earlier THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN bad AND NOT earlier THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN bad AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM cases GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM sums""",
    "op6_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item, w, least(10, len(w)) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
       FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS t FROM bp),
ls AS (SELECT DISTINCT l FROM win),
dp AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l),
hit AS (SELECT dp.r, dp.i, dp.l, win.item FROM dp JOIN win
        ON dp.l = win.l AND array_to_string(dp.w[dp.i:dp.i + dp.l - 1], ' ') = win.t),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN its ON d.r = its.r""",
}
