"""The query catalogue: every operator as a query over the given tables.

Each entry pairs a Spark query ``(spark, sf_dir) -> DataFrame`` with the
DuckDB SQL that states the same result (``None`` where SQL cannot). Doubles
are rounded to 6 places and integers cast to BIGINT on both sides; arrays
are returned flattened (one row per element) or joined into strings.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialectic.functions.mathx import r6
from dialectic.functions.text import contains_any, utf8_clean
from dialectic.operators import metrics as M
from dialectic.operators import preferences as P
from dialectic.operators import scoring as S
from dialectic.operators import textjobs as T
from dialectic.operators import threads as TH
from dialectic.plans.oracle_views import with_views
from dialectic.session import scratch_dir
from dialectic.sources import fixtures as FX
from dialectic.sources.readers import load_preferences, load_preferences_checked, read_csv
from dialectic.sources.schemas import HISTORY, THREAD
from dialectic.sources.sinks import append_log, stored_once, write_csv, write_json_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- fixed query parameters ---------------------------------------------------
LOOKUP_ID = "c0_1"
LOOKUP_IDS = ["c0_1", "c0_2"]
# The test text has no delta marker, so the checks add a common word to the
# marker list to exercise both outcomes of the predicate.
CHECK_DELTA_SYMBOLS = ["the", "!delta"]
SEED = 42
PICK = [15, 15, 3, -1]
HEAD_N = {"train": 150, "validation": 100}
RPO_ALPHA = 0.5
STEPS_PER_EPOCH = 4
TRUNCATE_AT = 1024
PACK_AT = 1024
# -----------------------------------------------------------------------------


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


# ----------------------------------------------------------------- scans/lookups

COMMENT_COLS = "id, author, body, parent_id, link_id, created_utc"


@register("scan_comments", with_views(["f_comments"], [], f"SELECT {COMMENT_COLS} FROM f_comments"))
def q_scan_comments(spark, d):
    return FX.f_comments(spark, d).select(*[c.strip() for c in COMMENT_COLS.split(",")])


@register("point_lookup", with_views(["f_comments"], [],
          f"SELECT {COMMENT_COLS} FROM f_comments WHERE id = '{LOOKUP_ID}'"))
def q_point_lookup(spark, d):
    return TH.lookup(FX.f_comments(spark, d), LOOKUP_ID).select(*[c.strip() for c in COMMENT_COLS.split(",")])


@register("in_lookup", with_views(["f_comments"], [],
          f"SELECT {COMMENT_COLS} FROM f_comments WHERE id IN ({', '.join(repr(i) for i in LOOKUP_IDS)}) "
          "ORDER BY created_utc"))
def q_in_lookup(spark, d):
    return TH.lookup(FX.f_comments(spark, d), LOOKUP_IDS).select(*[c.strip() for c in COMMENT_COLS.split(",")])


@register("strip_prefix", with_views(["f_comments"], [],
          "SELECT id, substring(link_id, 4) AS submission_id, substring(parent_id, 4) AS parent_ref FROM f_comments"))
def q_strip_prefix(spark, d):
    return TH.strip_prefixes(FX.f_comments(spark, d))


# Bodies arrive as bytes with invalid sequences around them; cleaning must
# give back exactly the original text.
@register("utf8_clean", with_views(["f_comments"], [], "SELECT id, chr(65533) || body || chr(1) AS clean_body FROM f_comments"))
def q_utf8_clean(spark, d):
    c = FX.f_comments(spark, d)
    raw = F.concat(F.lit(bytearray(b"\xff\xef\xbf\xbd")), F.encode("body", "UTF-8"), F.lit(bytearray(b"\x01\xc3")))
    return c.select("id", utf8_clean(raw).alias("clean_body"))


# ----------------------------------------------------------------------- threads

_OPS_SQL = """
    SELECT c.id AS comments_id, s.id AS submission_id, s.author AS submission_author,
           s.title AS submission_title, s.selftext AS submission_body
    FROM f_comments c JOIN f_submissions s
      ON substring(c.link_id, 4) = s.id AND c.author = s.author"""

_WALK_UP = """
    SELECT o.comments_id AS start_id, c.id, c.author, c.body, c.parent_id, c.link_id, c.created_utc, 0 AS depth
    FROM (SELECT DISTINCT comments_id FROM ops) o JOIN f_comments c ON c.id = o.comments_id
    UNION ALL
    SELECT w.start_id, c.id, c.author, c.body, c.parent_id, c.link_id, c.created_utc, w.depth + 1
    FROM walk w JOIN f_comments c ON c.id = substring(w.parent_id, 4)
    WHERE w.depth <= 1000"""

_WALK_DOWN = """
    SELECT o.comments_id AS start_id, c.id, c.author, c.body, c.parent_id, c.link_id, c.created_utc, 0 AS depth
    FROM (SELECT DISTINCT comments_id FROM ops) o JOIN f_comments c ON c.id = o.comments_id
    UNION ALL
    SELECT w.start_id, c.id, c.author, c.body, c.parent_id, c.link_id, c.created_utc, w.depth + 1
    FROM walk w JOIN f_comments c ON substring(c.parent_id, 4) = w.id
    WHERE w.depth <= 1000"""

_WALK_OUT = ("SELECT start_id, id, CAST(depth AS BIGINT) AS depth, author, body, parent_id, link_id, created_utc "
             "FROM walk")

_THREAD_AGG = """
    SELECT start_id,
           first(id ORDER BY created_utc, depth DESC, id) AS root_id,
           last(id ORDER BY created_utc, depth DESC, id) AS leaf_id,
           last(body ORDER BY created_utc, depth DESC, id) AS leaf_body,
           CAST(count(*) AS BIGINT) AS n_comments,
           string_agg(id, ',' ORDER BY created_utc, depth DESC, id) AS thread_ids
    FROM wr GROUP BY start_id"""


def _sql_delta(col: str, symbols: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{s}')" for s in symbols) + ")"


def _stored_ops(spark, d):
    return TH.store_op_comments(FX.f_comments(spark, d), FX.f_submissions(spark, d), "op_comments",
                                scratch_dir(spark, "op-comments"))


# The helper table as a stored table (dropped and created anew), then used.
@register("op_comments", with_views(["f_comments", "f_submissions"], [], _OPS_SQL))
def q_op_comments(spark, d):
    return _stored_ops(spark, d)


@register("op_comment_bodies", with_views(["f_comments", "f_submissions"], [("ops", _OPS_SQL)], """
    SELECT o.comments_id, o.submission_id, o.submission_author, c.created_utc, c.body
    FROM ops o JOIN f_comments c ON c.id = o.comments_id"""))
def q_op_comment_bodies(spark, d):
    return TH.op_replies(_stored_ops(spark, d), FX.f_comments(spark, d))


@register("thread_ancestors", with_views(["f_comments", "f_submissions"],
          [("ops", _OPS_SQL), ("walk", _WALK_UP)], _WALK_OUT, recursive=True))
def q_thread_ancestors(spark, d):
    c, s = FX.f_comments(spark, d), FX.f_submissions(spark, d)
    return TH.ancestor_walk(c, TH.op_comments(c, s).select("comments_id")).rows


@register("thread_descendants", with_views(["f_comments", "f_submissions"],
          [("ops", _OPS_SQL), ("walk", _WALK_DOWN)], _WALK_OUT, recursive=True))
def q_thread_descendants(spark, d):
    c, s = FX.f_comments(spark, d), FX.f_submissions(spark, d)
    return TH.descendant_walk(c, TH.op_comments(c, s).select("comments_id")).rows


_THREAD_BUILD_SQL = with_views(
    ["f_comments", "f_submissions"],
    [("ops", _OPS_SQL), ("walk", _WALK_UP),
     ("wr", "SELECT * FROM walk"),
     ("th", _THREAD_AGG)],
    f"""SELECT o.submission_id, o.submission_author, o.submission_title, o.submission_body,
               t.root_id AS comments_thread_root_comment_id, t.leaf_id AS comments_thread_leaf_comment_id,
               {_sql_delta('t.leaf_body', CHECK_DELTA_SYMBOLS)} AS comments_thread_is_delta,
               t.n_comments, t.thread_ids
        FROM ops o JOIN th t ON t.start_id = o.comments_id WHERE t.leaf_body IS NOT NULL""",
    recursive=True)


def _threads(spark, d):
    return TH.build_threads(FX.f_comments(spark, d), FX.f_submissions(spark, d),
                            delta_symbols=CHECK_DELTA_SYMBOLS)


@register("thread_build", _THREAD_BUILD_SQL)
def q_thread_build(spark, d):
    threads, _ = _threads(spark, d)
    return threads.select(
        "submission_id", "submission_author", "submission_title", "submission_body",
        "comments_thread_root_comment_id", "comments_thread_leaf_comment_id", "comments_thread_is_delta",
        F.size("comments_thread").cast("long").alias("n_comments"),
        F.array_join(F.transform("comments_thread", lambda x: x["comment_id"]), ",").alias("thread_ids"))


@register("stream_thread_build", _THREAD_BUILD_SQL)
def q_stream_thread_build(spark, d):
    from dialectic.plans.streaming_query import stream_threads_over
    # The replies come first, their ancestors (first turns) in the second file.
    late = F.regexp_extract("id", "_([0-9]+)$", 1).cast("int") > 2
    threads = stream_threads_over(spark, FX.f_comments(spark, d), FX.f_submissions(spark, d),
                                  CHECK_DELTA_SYMBOLS, [late])
    return threads.select(
        "submission_id", "submission_author", "submission_title", "submission_body",
        "comments_thread_root_comment_id", "comments_thread_leaf_comment_id", "comments_thread_is_delta",
        F.size("comments_thread").cast("long").alias("n_comments"),
        F.array_join(F.transform("comments_thread", lambda x: x["comment_id"]), ",").alias("thread_ids"))


@register("thread_json", with_views(
    ["f_comments", "f_submissions"],
    [("ops", _OPS_SQL), ("walk", _WALK_UP),
     ("wr", "SELECT * FROM walk"),
     ("th", _THREAD_AGG)],
    """SELECT o.submission_id, t.root_id AS comments_thread_root_comment_id,
              t.leaf_id AS comments_thread_leaf_comment_id,
              CAST(row_number() OVER (PARTITION BY o.comments_id ORDER BY w.created_utc, w.depth DESC, w.id) - 1
                   AS BIGINT) AS pos,
              w.id AS comment_id, w.author AS comment_author, w.body AS comment_body,
              w.parent_id AS comment_parent_id, w.link_id AS comment_link_id,
              w.created_utc AS comment_created_utc
       FROM ops o JOIN th t ON t.start_id = o.comments_id JOIN wr w ON w.start_id = o.comments_id
       WHERE t.leaf_body IS NOT NULL""", recursive=True))
def q_thread_json(spark, d):
    # The thread dataset file: nested records written as JSON lines, read
    # back with the declared schema, then flattened for the check.
    threads, _ = _threads(spark, d)
    path = scratch_dir(spark, "threads-json")
    write_json_lines(threads, path)
    flat = TH.explode_threads(spark.read.schema(THREAD).json(path))
    return flat.select("submission_id", "comments_thread_root_comment_id", "comments_thread_leaf_comment_id",
                       F.col("pos").cast("long").alias("pos"), "comment_id", "comment_author", "comment_body",
                       "comment_parent_id", "comment_link_id", "comment_created_utc")


# A chain that passes more comments than its conversation has goes round.
@register("thread_quarantine", with_views(
    ["f_faulty_comments", "f_submissions"],
    [("ops", _OPS_SQL.replace("f_comments", "f_faulty_comments")),
     ("held", "SELECT link_id, count(*) AS n FROM f_faulty_comments GROUP BY link_id"),
     ("walk", """
        SELECT o.comments_id AS start_id, c.id, c.parent_id, c.body, c.created_utc, h.n, 0 AS depth
        FROM (SELECT DISTINCT comments_id FROM ops) o JOIN f_faulty_comments c ON c.id = o.comments_id
        JOIN held h ON h.link_id = c.link_id
        UNION ALL
        SELECT w.start_id, c.id, c.parent_id, c.body, c.created_utc, w.n, w.depth + 1
        FROM walk w JOIN f_faulty_comments c ON c.id = substring(w.parent_id, 4) WHERE w.depth <= w.n"""),
     ("wr", "SELECT * FROM walk WHERE start_id NOT IN (SELECT start_id FROM walk WHERE depth > n)"),
     ("th", _THREAD_AGG)],
    """SELECT o.comments_id, 'null_leaf_body' AS reason FROM ops o JOIN th t ON t.start_id = o.comments_id
       WHERE t.leaf_body IS NULL
       UNION ALL
       SELECT o.comments_id, 'depth_limit' AS reason FROM ops o
       WHERE o.comments_id IN (SELECT start_id FROM walk WHERE depth > n)""",
    recursive=True))
def q_thread_quarantine(spark, d):
    _, quarantine = TH.build_threads(FX.f_faulty_comments(spark, d), FX.f_submissions(spark, d),
                                     delta_symbols=CHECK_DELTA_SYMBOLS)
    return quarantine


@register("delta_flag", f"SELECT doc_id, {_sql_delta('text', CHECK_DELTA_SYMBOLS)} AS is_delta FROM documents")
def q_delta_flag(spark, d):
    docs = FX.table(spark, d, "documents")
    return docs.select("doc_id", contains_any("text", CHECK_DELTA_SYMBOLS).alias("is_delta"))


# ------------------------------------------------------------------- preferences

_GROUP_SPLIT_CTES = [
    ("p", "SELECT DISTINCT prompt FROM f_preferences"),
    ("r", f"""SELECT prompt, row_number() OVER (ORDER BY md5('{SEED}|' || coalesce(prompt, '')), coalesce(prompt, ''),
                      prompt IS NULL) - 1 AS idx, count(*) OVER () AS g FROM p"""),
    ("gs", """SELECT f.*, r.idx AS split_rank, CASE WHEN r.idx < floor(CAST(0.6 AS DOUBLE) * r.g) THEN 'train'
                         WHEN r.idx < floor(CAST(0.6 AS DOUBLE) * r.g) + floor(CAST(0.2 AS DOUBLE) * r.g)
                         THEN 'validation' ELSE 'test' END AS split
              FROM f_preferences f JOIN r ON f.prompt IS NOT DISTINCT FROM r.prompt"""),
]


def _group_split(spark, d):
    return P.group_split(FX.f_preferences(spark, d), seed=SEED)


# Round trip through the JSON sink and the JSON source: records written in
# row order come back with a dense row_id in file/line order.
@register("load_preferences", with_views(["f_preferences"], [], """
    SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS row_id, prompt, chosen, rejected
    FROM f_preferences"""))
def q_load_preferences(spark, d):
    path = scratch_dir(spark, "preferences-json")
    prefs = FX.f_preferences(spark, d)
    write_json_lines(prefs.orderBy("row_id").select("prompt", "chosen", "rejected"), path)
    return load_preferences(spark, path)


# Every ninth record is cut short, has no prompt, or holds a byte that is not UTF-8.
@register("preference_faults", with_views(["f_preferences"], [
    ("n", "SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS record FROM f_preferences"),
    ("r", """SELECT *, CASE WHEN record % 9 = 3 THEN 'malformed_json' WHEN record % 9 = 5 OR prompt IS NULL THEN 'null_prompt'
                            WHEN record % 9 = 7 THEN 'invalid_utf8' END AS reason FROM n""")], """
    SELECT CAST(record AS BIGINT) AS record, reason, CASE WHEN reason IS NULL THEN
             CAST(row_number() OVER (PARTITION BY reason IS NULL ORDER BY record) - 1 AS BIGINT) END AS row_id,
           CASE WHEN reason IS NULL THEN prompt END AS prompt, CASE WHEN reason IS NULL THEN chosen END AS chosen,
           CASE WHEN reason IS NULL THEN rejected END AS rejected
    FROM r"""))
def q_preference_faults(spark, d):
    path = scratch_dir(spark, "preferences-faults")
    n = P.with_positions(FX.f_preferences(spark, d), "record")
    kind = F.col("record") % 9
    line = F.to_json(F.struct(F.when(kind != 5, F.col("prompt")).alias("prompt"), "chosen", "rejected"))
    broken = F.concat(F.lit(bytearray(b'{"x":"\xff",')), F.encode(F.expr("substring(line, 2)"), "UTF-8")).cast("string")
    faulty = F.when(kind == 3, F.expr("left(line, length(line) - 1)")).when(kind == 7, broken).otherwise(F.col("line"))
    n.withColumn("line", line).orderBy("record").select(faulty.alias("value")).write.text(path)
    good, bad = load_preferences_checked(spark, path)
    return good.select("record", F.lit(None).cast("string").alias("reason"), "row_id", "prompt", "chosen", "rejected").unionByName(
        bad.select("record", "reason"), allowMissingColumns=True)


@register("prompt_groups", with_views(["f_preferences"], [], """
    SELECT prompt, min(row_id) AS first_row_id, CAST(count(*) AS BIGINT) AS n_rows,
           CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS BIGINT) AS group_index
    FROM f_preferences GROUP BY prompt"""))
def q_prompt_groups(spark, d):
    return P.prompt_groups(FX.f_preferences(spark, d)).select("prompt", "first_row_id", "n_rows", "group_index")


@register("group_split", with_views(["f_preferences"], _GROUP_SPLIT_CTES, "SELECT row_id, prompt, split FROM gs"))
def q_group_split(spark, d):
    return _group_split(spark, d).select("row_id", "prompt", "split")


@register("split_leak_check", with_views(["f_preferences"], _GROUP_SPLIT_CTES, """
    SELECT CAST(count(*) AS BIGINT) AS n_prompts, CAST(coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0) AS BIGINT)
           AS n_leaking_prompts
    FROM (SELECT prompt, count(DISTINCT split) AS n FROM gs GROUP BY prompt)"""))
def q_split_leak_check(spark, d):
    return P.split_leak_check(_group_split(spark, d))


@register("split_counts", with_views(["f_preferences"], _GROUP_SPLIT_CTES, """
    SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT prompt) AS BIGINT) AS n_prompts
    FROM gs GROUP BY split"""))
def q_split_counts(spark, d):
    return P.split_counts(_group_split(spark, d))


@register("split_select", with_views(["f_preferences"], _GROUP_SPLIT_CTES,
          "SELECT row_id, prompt, chosen, rejected FROM gs WHERE split = 'test'"))
def q_split_select(spark, d):
    return P.select_split(_group_split(spark, d), "test").select("row_id", "prompt", "chosen", "rejected")


@register("row_split", with_views(["f_preferences"], [
    ("r", f"""SELECT row_id, row_number() OVER (ORDER BY md5('{SEED}|' || row_id), row_id) - 1 AS idx,
                     count(*) OVER () AS n FROM f_preferences"""),
    ("c", "SELECT *, ceil(CAST(0.2 AS DOUBLE) * n) AS n_test FROM r")],
    """SELECT row_id, CASE WHEN idx < n_test THEN 'test'
                           WHEN idx < n_test + ceil(CAST(0.25 AS DOUBLE) * (n - n_test)) THEN 'validation'
                           ELSE 'train' END AS split FROM c"""))
def q_row_split(spark, d):
    return P.row_split(FX.f_preferences(spark, d), seed=SEED).select("row_id", "split")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_text(s: str) -> str:
    """A SQL string expression for a Python string (newlines via chr(10))."""
    pieces = s.split("\n")
    return " || chr(10) || ".join(_sql_str(p) for p in pieces)


@register("template_prompts", with_views(["f_preferences"], _GROUP_SPLIT_CTES, f"""
    SELECT row_id, split, {_sql_text(P.DEFAULT_TEMPLATE_PREFIX)} || prompt || {_sql_text(P.DEFAULT_TEMPLATE_SUFFIX)} AS prompt
    FROM gs"""))
def q_template_prompts(spark, d):
    return P.preprocess(_group_split(spark, d), "template_edit_dataset").select("row_id", "split", "prompt")


@register("instruction_format", with_views(["f_preferences"], [], f"""
    SELECT row_id, {_sql_text('### Instruction:' + chr(10) + P.DEFAULT_INSTRUCTION_PREFIX + chr(10) + chr(10)
                              + '### Input:' + chr(10))}
           || prompt || {_sql_text(chr(10) + ' ' + chr(10) + '### Response:' + chr(10))} || chosen || chr(10) AS text
    FROM f_preferences"""))
def q_instruction_format(spark, d):
    return P.instruction_format(FX.f_preferences(spark, d)).select("row_id", "text")


@register("dedup_prompts", with_views(["f_preferences"], [], """
    SELECT CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS sample_index, row_id, prompt, chosen, rejected
    FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY row_id) AS rn FROM f_preferences) WHERE rn = 1"""))
def q_dedup_prompts(spark, d):
    return P.dedup_prompts(FX.f_preferences(spark, d))


_SPLIT_POS_SQL = """
    SELECT CAST(row_number() OVER (PARTITION BY split ORDER BY split_rank, row_id) - 1 AS BIGINT) AS pos,
           count(*) OVER (PARTITION BY split) AS n, split, row_id, prompt FROM gs"""


@register("pick_positions", with_views(["f_preferences"], _GROUP_SPLIT_CTES + [("q", _SPLIT_POS_SQL)], f"""
    SELECT q.pos, q.row_id, q.prompt
    FROM (SELECT unnest([{', '.join(map(str, PICK))}]) AS p) w
    JOIN q ON q.split = 'validation' AND q.pos = CASE WHEN w.p < 0 THEN w.p + q.n ELSE w.p END"""))
def q_pick_positions(spark, d):
    val = P.select_split(_group_split(spark, d), "validation")
    return P.pick_positions(val, PICK).select("pos", "row_id", "prompt")


@register("head_n", with_views(["f_preferences"], _GROUP_SPLIT_CTES + [("q", _SPLIT_POS_SQL)], " UNION ALL ".join(
    f"SELECT split, pos, row_id, prompt FROM q WHERE split = '{s}' AND pos < {n}" for s, n in HEAD_N.items())))
def q_head_n(spark, d):
    split = _group_split(spark, d)
    train, val = [P.head_n(P.select_split(split, s), n) for s, n in HEAD_N.items()]
    return train.unionByName(val).select("split", "pos", "row_id", "prompt")


@register("preference_pairs", with_views(["f_labeled_documents"], [
    ("neg", """SELECT prompt, doc_id, text, row_number() OVER (PARTITION BY prompt ORDER BY doc_id) - 1 AS k,
                      count(*) OVER (PARTITION BY prompt) AS n_neg FROM f_labeled_documents WHERE quality = 0"""),
    ("pos", f"""SELECT prompt, doc_id, text, ('0x' || substring(md5('{SEED}|' || doc_id), 1, 8))::BIGINT AS h
               FROM f_labeled_documents WHERE quality = 1""")],
    """SELECT p.prompt, p.doc_id AS chosen_id, p.text AS chosen, n.doc_id AS rejected_id, n.text AS rejected
       FROM pos p JOIN neg n ON n.prompt = p.prompt AND n.k = p.h % n.n_neg"""))
def q_preference_pairs(spark, d):
    return P.preference_pairs(FX.f_labeled_documents(spark, d), seed=SEED)


@register("stack_sides", with_views(["f_preferences"], [], """
    SELECT row_id, prompt, 'chosen' AS side, chosen AS text FROM f_preferences
    UNION ALL SELECT row_id, prompt, 'rejected' AS side, rejected AS text FROM f_preferences"""))
def q_stack_sides(spark, d):
    return P.stack_sides(FX.f_preferences(spark, d))


# ----------------------------------------------------------------------- scoring

_SOFTMAX_SQL = """
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings"""


@register("softmax_row", with_views([], [("e", _SOFTMAX_SQL),
    ("m", "SELECT *, list_max(a) AS mx FROM e"),
    ("s", "SELECT *, list_sum(list_transform(a, lambda x: exp(x - mx))) AS z FROM m")],
    """SELECT vec_id, round(exp(a[label + 1] - mx) / z, 6) AS p_gold, round(1.0 / z, 6) AS p_max FROM s"""))
def q_softmax_row(spark, d):
    sm = S.softmax_rows(FX.f_logits(spark, d))
    return sm.select("vec_id", r6(F.col("probs")[F.col("label")]).alias("p_gold"),
                     r6(F.array_max("probs")).alias("p_max"))


@register("argmax_token", """
    SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS pred_id, label,
           (list_position(embedding, list_max(embedding)) - 1) = label AS correct
    FROM embeddings""")
def q_argmax_token(spark, d):
    a = S.argmax_tokens(FX.f_logits(spark, d))
    return a.select("vec_id", "pred_id", "label", (F.col("pred_id") == F.col("label")).alias("correct"))


@register("decode_tokens", with_views(["f_token_scores", "f_vocab"], [], """
    SELECT t.seq_id, coalesce(string_agg(v.piece, '' ORDER BY t.pos), '') AS text
    FROM f_token_scores t LEFT JOIN f_vocab v ON v.token_id = t.label GROUP BY t.seq_id"""))
def q_decode_tokens(spark, d):
    toks = FX.f_token_scores(spark, d).select("seq_id", "pos", F.col("label").alias("token_id"))
    return S.decode_tokens(toks, FX.f_vocab(spark))


_LONG_SQL = [("m", "SELECT *, max(logit) OVER (PARTITION BY seq_id, pos) AS mx FROM f_long_logits")]


@register("long_token_nll", with_views(["f_long_logits"], _LONG_SQL, f"""
    SELECT seq_id, pos, label, CASE WHEN label <> {S.IGNORE_INDEX} THEN
             round(max(mx) + ln(sum(exp(logit - mx))) - max(CASE WHEN token = label THEN logit END), 6) END AS nll,
           CAST(min(CASE WHEN logit = mx THEN token END) AS BIGINT) AS pred_id, CAST(count(*) AS BIGINT) AS n_tokens
    FROM m GROUP BY seq_id, pos, label"""))
def q_long_token_nll(spark, d):
    return _round_doubles(S.long_token_nll(FX.f_long_logits(spark, d)))


@register("long_softmax", with_views(["f_long_logits"], _LONG_SQL, """
    SELECT seq_id, pos, CAST(token AS INTEGER) AS token,
           round(exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY seq_id, pos), 6) AS prob FROM m"""))
def q_long_softmax(spark, d):
    return _round_doubles(S.long_softmax(FX.f_long_logits(spark, d)))


@register("token_nll", """
    SELECT vec_id, label, round(ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))))
           - CAST(embedding[label + 1] AS DOUBLE), 6) AS nll FROM embeddings""")
def q_token_nll(spark, d):
    return S.token_nll(FX.f_logits(spark, d)).select("vec_id", "label", r6("nll").alias("nll"))


@register("sequence_logp", with_views(["f_token_scores"], [], """
    SELECT seq_id, round(coalesce(sum(CASE WHEN label <> -100 THEN logp END), 0), 6) AS logp_sum,
           CAST(count(CASE WHEN label <> -100 THEN 1 END) AS BIGINT) AS n_tokens
    FROM f_token_scores GROUP BY seq_id"""))
def q_sequence_logp(spark, d):
    return _round_doubles(S.sequence_logp(FX.f_token_scores(spark, d)))


@register("ipo_logp", with_views(["f_token_scores"], [], """
    SELECT seq_id, round(CASE WHEN count(CASE WHEN label <> -100 THEN 1 END) > 0
                         THEN coalesce(sum(CASE WHEN label <> -100 THEN logp END), 0)
                              / count(CASE WHEN label <> -100 THEN 1 END) END, 6) AS logp_avg
    FROM f_token_scores GROUP BY seq_id"""))
def q_ipo_logp(spark, d):
    return _round_doubles(S.ipo_logp(S.sequence_logp(FX.f_token_scores(spark, d))).select("seq_id", "logp_avg"))


@register("perplexity", with_views(["f_token_scores"], [], """
    SELECT seq_id, CAST(count(CASE WHEN label <> -100 THEN 1 END) AS BIGINT) AS n_tokens,
           round(CASE WHEN count(CASE WHEN label <> -100 THEN 1 END) > 0
                 THEN exp(-sum(CASE WHEN label <> -100 THEN logp END) / count(CASE WHEN label <> -100 THEN 1 END))
                 ELSE 0.0 END, 6) AS perplexity
    FROM f_token_scores GROUP BY seq_id"""))
def q_perplexity(spark, d):
    return _round_doubles(S.perplexity(FX.f_token_scores(spark, d)))


_PAIRS_SQL = """
    SELECT sample_id, run_id, type, step,
           max(CASE WHEN model = 'policy' AND side = 'chosen' THEN logp END) AS pc,
           max(CASE WHEN model = 'policy' AND side = 'rejected' THEN logp END) AS pr,
           max(CASE WHEN model = 'reference' AND side = 'chosen' THEN logp END) AS rc,
           max(CASE WHEN model = 'reference' AND side = 'rejected' THEN logp END) AS rr
    FROM f_pair_scores GROUP BY sample_id, run_id, type, step"""
_SCORED_SQL = """
    SELECT *, CAST(0.1 AS DOUBLE) * (pc - rc) AS cr, CAST(0.1 AS DOUBLE) * (pr - rr) AS rj,
           greatest(-(CAST(0.1 AS DOUBLE) * (pc - rc) - CAST(0.1 AS DOUBLE) * (pr - rr)), 0)
             + ln(1 + exp(-abs(CAST(0.1 AS DOUBLE) * (pc - rc) - CAST(0.1 AS DOUBLE) * (pr - rr)))) AS loss
    FROM pairs"""
_SCORE_CTES = [("pairs", _PAIRS_SQL), ("sc", _SCORED_SQL)]


def _scored(spark, d):
    return S.dpo_loss(S.pair_table(FX.f_pair_scores(spark, d)), beta=S.DEFAULT_BETA)


@register("dpo_rewards", with_views(["f_pair_scores"], _SCORE_CTES, """
    SELECT sample_id, run_id, type, step, round(cr, 6) AS chosen_reward, round(rj, 6) AS rejected_reward FROM sc"""))
def q_dpo_rewards(spark, d):
    r = S.dpo_rewards(S.pair_table(FX.f_pair_scores(spark, d)))
    return _round_doubles(r.select("sample_id", "run_id", "type", "step", "chosen_reward", "rejected_reward"))


@register("dpo_loss", with_views(["f_pair_scores"], _SCORE_CTES, """
    SELECT sample_id, round(loss, 6) AS loss, round(cr, 6) AS chosen_reward, round(rj, 6) AS rejected_reward,
           cr > rj AS reward_correct FROM sc"""))
def q_dpo_loss(spark, d):
    return _round_doubles(_scored(spark, d).select("sample_id", "loss", "chosen_reward", "rejected_reward",
                                                   "reward_correct"))


@register("reward_accuracy", with_views(["f_pair_scores"], _SCORE_CTES, """
    SELECT run_id, type, CAST(count(*) AS BIGINT) AS n_samples,
           round(avg(CASE WHEN cr > rj THEN 1.0 ELSE 0.0 END), 6) AS reward_accuracy FROM sc GROUP BY run_id, type"""))
def q_reward_accuracy(spark, d):
    return _round_doubles(M.reward_accuracy(_scored(spark, d)))


_SIDE_COLS = ", ".join(
    ["sum(CASE WHEN model = 'policy' AND side = '%s' THEN list_sum(logits) END) / "
     "sum(CASE WHEN model = 'policy' AND side = '%s' THEN len(logits) END) AS logits_%s" % (s, s, s) for s in S.SIDES]
    + ["coalesce(exp(avg(CASE WHEN model = '%s' AND side = '%s' THEN nll END)), 0) AS perplexity_%s_%s" % (m, s, m, s)
       for m in S.MODELS for s in S.SIDES]
    + ["avg(CASE WHEN model = 'policy' AND side = 'chosen' THEN nll END) AS nll_loss"])
_SIDE_CTES = [
    ("tok", """SELECT *, coalesce(lead(label) OVER (PARTITION BY sample_id, run_id, type, step, model, side ORDER BY pos),
                                  -100) AS gold FROM f_side_logits"""),
    ("nll", """SELECT *, CASE WHEN gold <> -100 THEN ln(list_sum(list_transform(logits, lambda x: exp(x))))
                              - logits[gold + 1] END AS nll FROM tok"""),
    ("sides", f"SELECT run_id, type, step, {_SIDE_COLS} FROM nll GROUP BY run_id, type, step")]
_SIDE_NAMES = [f"logits_{s}" for s in S.SIDES] + [f"perplexity_{m}_{s}" for m in S.MODELS for s in S.SIDES] + ["nll_loss"]
_SIDE_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in _SIDE_NAMES)


@register("batch_side_metrics", with_views(["f_side_logits"], _SIDE_CTES,
          f"SELECT run_id, type, step, {_SIDE_OUT} FROM sides"))
def q_batch_side_metrics(spark, d):
    return _round_doubles(S.side_metrics(FX.f_side_logits(spark, d)))


@register("rpo_loss", with_views(["f_pair_scores", "f_side_logits"], _SCORE_CTES + _SIDE_CTES, f"""
    SELECT s.sample_id, round(s.loss, 6) AS loss, round(n.nll_loss, 6) AS nll_loss,
           round(s.loss + CAST({RPO_ALPHA} AS DOUBLE) * n.nll_loss, 6) AS rpo_loss
    FROM sc s JOIN sides n USING (run_id, type, step)"""))
def q_rpo_loss(spark, d):
    sc = _scored(spark, d)
    r = S.rpo_loss(sc, S.side_metrics(FX.f_side_logits(spark, d)), RPO_ALPHA)
    return _round_doubles(r.select("sample_id", "loss", "nll_loss", "rpo_loss"))


# Batch objective ``mean(loss) + coef * aux``: the fixture has no router
# loss, so the batch's chosen-answer NLL stands in for the auxiliary term.
AUX_COEF = 0.01


@register("batch_objective", with_views(["f_pair_scores"], _SCORE_CTES, f"""
    SELECT run_id, type, step, round(avg(loss) + CAST({AUX_COEF} AS DOUBLE) * avg(-pc), 6) AS batch_loss
    FROM sc GROUP BY run_id, type, step"""))
def q_batch_objective(spark, d):
    sc = _scored(spark, d)
    aux = sc.groupBy("run_id", "type", "step").agg(F.avg(-F.col("policy_chosen_logps")).alias("aux_loss"))
    b = S.batch_loss(sc.join(aux, ["run_id", "type", "step"]), aux="aux_loss", aux_coef=AUX_COEF)
    return _round_doubles(b)


@register("attach_ref_scores", with_views(["f_pair_scores"], [], """
    SELECT p.sample_id, p.side, p.run_id, p.type, p.step, round(p.logp, 6) AS policy_logp,
           round(r.logp, 6) AS reference_logp
    FROM (SELECT * FROM f_pair_scores WHERE model = 'policy') p
    LEFT JOIN (SELECT * FROM f_pair_scores WHERE model = 'reference') r USING (sample_id, side)"""))
def q_attach_ref_scores(spark, d):
    ps = FX.f_pair_scores(spark, d)
    pol = ps.where(F.col("model") == "policy").drop("model")
    ref = ps.where(F.col("model") == "reference")
    out = S.attach_ref_scores(pol, ref, ["sample_id", "side"])
    return _round_doubles(out.select("sample_id", "side", "run_id", "type", "step", "policy_logp", "reference_logp"))


_PRED_CTES = [
    ("pt", """SELECT sample_id, model, side, coalesce(string_agg(v.piece, '' ORDER BY t.pos), '') AS text
              FROM f_side_logits t LEFT JOIN f_vocab v ON v.token_id = list_position(t.logits, list_max(t.logits)) - 1
              WHERE t.pos < 7 GROUP BY sample_id, model, side"""),
    ("pred", "SELECT sample_id, " + ", ".join(
        f"max(CASE WHEN model = '{m}' AND side = '{s}' THEN text END) AS {m}_{s}_pred_text"
        for m in S.MODELS for s in S.SIDES) + " FROM pt GROUP BY sample_id")]


@register("sample_log", with_views(["f_pair_scores", "f_preferences", "f_side_logits", "f_vocab"],
                                   _SCORE_CTES + _PRED_CTES, f"""
    SELECT s.sample_id, s.run_id, s.type, round(CAST(s.step AS DOUBLE) / {STEPS_PER_EPOCH}, 6) AS epoch, s.step,
           p.prompt, round(s.loss, 6) AS loss, round(s.cr, 6) AS chosen_reward, round(s.rj, 6) AS rejected_reward,
           round(s.pc, 6) AS policy_logps_chosen, round(s.pr, 6) AS policy_logps_rejected, p.chosen, p.rejected,
           t.policy_chosen_pred_text, t.reference_chosen_pred_text,
           t.policy_rejected_pred_text, t.reference_rejected_pred_text
    FROM sc s LEFT JOIN f_preferences p ON p.row_id = s.sample_id LEFT JOIN pred t ON t.sample_id = s.sample_id"""))
def q_sample_log(spark, d):
    # Appended to the run log (partitioned by run and type) and read back.
    path = scratch_dir(spark, "sample-log")
    pred = S.predicted_texts(FX.f_side_logits(spark, d), FX.f_vocab(spark))
    log = M.sample_log(_scored(spark, d), FX.f_preferences(spark, d), STEPS_PER_EPOCH, pred)
    append_log(log, path)
    back = spark.read.schema(log.schema).parquet(path)  # else run ids like 007 come back as numbers
    return _round_doubles(back.select(*log.columns))


_REF_PPL_CTES = [
    ("rt", f"""SELECT sample_id, side, logits,
                     coalesce(lead(label) OVER (PARTITION BY sample_id, side ORDER BY pos), {S.IGNORE_INDEX}) AS label
              FROM f_side_logits WHERE model = 'reference'"""),
    ("rn", f"""SELECT sample_id, side, CASE WHEN label <> {S.IGNORE_INDEX}
                     THEN ln(list_sum(list_transform(logits, lambda x: exp(x)))) - logits[label + 1] END AS nll FROM rt"""),
    ("ppl", "SELECT sample_id, " + ", ".join(
        f"coalesce(exp(avg(CASE WHEN side = '{s}' THEN nll END)), 0) AS reference_{s}_ppls" for s in S.SIDES)
     + " FROM rn GROUP BY sample_id")]


@register("reference_scores", with_views(["f_pair_scores", "f_side_logits", "f_vocab"],
                                         _SCORE_CTES + _PRED_CTES + _REF_PPL_CTES, """
    SELECT s.sample_id, s.run_id, s.type, s.step, round(s.pc, 6) AS policy_chosen_logps,
           round(s.pr, 6) AS policy_rejected_logps, round(s.rc, 6) AS reference_chosen_logps,
           round(s.rr, 6) AS reference_rejected_logps, round(l.reference_chosen_ppls, 6) AS reference_chosen_ppls,
           round(l.reference_rejected_ppls, 6) AS reference_rejected_ppls,
           t.reference_chosen_pred_text AS reference_chosen_predictions_texts,
           t.reference_rejected_pred_text AS reference_rejected_predictions_texts
    FROM pairs s LEFT JOIN ppl l USING (sample_id) LEFT JOIN pred t USING (sample_id)"""))
def q_reference_scores(spark, d):
    # Written by the first call; the second one finds the table and computes nothing.
    path, scores = scratch_dir(spark, "reference-scores"), FX.f_pair_scores(spark, d)
    ref = S.reference_scores(scores, FX.f_side_logits(spark, d), FX.f_vocab(spark))
    inputs = [scores, FX.f_side_logits(spark, d)]
    stored_once(ref, path, inputs)
    policy = S.pair_table(scores).drop("reference_chosen_logps", "reference_rejected_logps")
    return _round_doubles(policy.join(stored_once(ref, path, inputs), "sample_id", "left"))


_ROLLUP_SQL = """
    SELECT run_id, type, step, CAST(count(*) AS BIGINT) AS n_samples, round(avg(loss), 6) AS loss,
           round(avg(cr), 6) AS rewards_chosen, round(avg(rj), 6) AS rewards_rejected,
           round(avg(CASE WHEN cr > rj THEN 1.0 ELSE 0.0 END), 6) AS rewards_accuracies,
           round(avg(cr - rj), 6) AS rewards_margins"""


_METRIC_ROLLUP_SQL = with_views(["f_pair_scores", "f_side_logits"], _SCORE_CTES + _SIDE_CTES + [
    ("m", _ROLLUP_SQL + """, round(avg(pc), 6) AS logps_chosen, round(avg(pr), 6) AS logps_rejected,
           CASE WHEN type = 'eval' THEN 'eval_' ELSE '' END AS metric_prefix FROM sc GROUP BY run_id, type, step""")],
    f"SELECT m.*, {_SIDE_OUT} FROM m LEFT JOIN sides USING (run_id, type, step)")


@register("metric_rollup", _METRIC_ROLLUP_SQL)
def q_metric_rollup(spark, d):
    sides = S.side_metrics(FX.f_side_logits(spark, d))
    return _round_doubles(M.metric_rollup(_scored(spark, d), sides=sides))


@register("epoch_rollup", with_views(["f_pair_scores"], _SCORE_CTES + [
    ("b", "SELECT run_id, type, step, count(*) AS n, avg(loss) AS loss, "
          "avg(CASE WHEN cr > rj THEN 1.0 ELSE 0.0 END) AS acc FROM sc GROUP BY run_id, type, step")], """
    SELECT run_id, type, round(avg(loss), 6) AS loss_mean_of_batches, round(sum(loss * n) / sum(n), 6) AS loss_weighted,
           round(avg(acc), 6) AS rewards_accuracies, CAST(count(*) AS BIGINT) AS n_batches
    FROM b GROUP BY run_id, type"""))
def q_epoch_rollup(spark, d):
    return _round_doubles(M.epoch_rollup(M.metric_rollup(_scored(spark, d))))


_BETA_SQL = """
    SELECT beta, CAST(count(*) AS BIGINT) AS n_samples,
           round(avg(greatest(-(beta * ((pc - rc) - (pr - rr))), 0) + ln(1 + exp(-abs(beta * ((pc - rc) - (pr - rr)))))), 6)
             AS mean_loss,
           round(avg(CASE WHEN beta * ((pc - rc) - (pr - rr)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS reward_accuracy
    FROM pairs, (SELECT unnest([0.10, 0.15, 0.20, 0.25]::DOUBLE[]) AS beta) g GROUP BY beta"""


@register("beta_sweep", with_views(["f_pair_scores"], [("pairs", _PAIRS_SQL)], _BETA_SQL))
def q_beta_sweep(spark, d):
    return _round_doubles(M.beta_sweep(S.pair_table(FX.f_pair_scores(spark, d))))


@register("best_beta", with_views(["f_pair_scores"], [("pairs", _PAIRS_SQL), ("sw", _BETA_SQL)],
          "SELECT beta, mean_loss FROM sw ORDER BY mean_loss, beta LIMIT 1"))
def q_best_beta(spark, d):
    return M.best_beta(q_beta_sweep(spark, d))


# -------------------------------------------------------------------- run tables

@register("loss_history", with_views(["f_history"], [],
          "SELECT run_id, pos, round(loss, 6) AS loss, round(eval_loss, 6) AS eval_loss FROM f_history"))
def q_loss_history(spark, d):
    # Written as CSV with a header (the history file) and read back.
    path = scratch_dir(spark, "loss-history-csv")
    write_csv(FX.f_history(spark, d), path)
    back = read_csv(spark, path, HISTORY)
    return _round_doubles(back)


@register("last_eval_loss", with_views(["f_history"], [], """
    SELECT run_id, round(max_by(eval_loss, pos), 6) AS last_eval_loss, max(pos) AS last_eval_loss_pos
    FROM f_history WHERE eval_loss IS NOT NULL GROUP BY run_id"""))
def q_last_eval_loss(spark, d):
    return _round_doubles(M.last_eval_loss(FX.f_history(spark, d)))


@register("last_row", with_views(["f_history"], [],
          "SELECT run_id, pos, round(loss, 6) AS loss, round(eval_loss, 6) AS eval_loss FROM f_history ORDER BY pos DESC LIMIT 1"))
def q_last_row(spark, d):
    return _round_doubles(M.last_row(FX.f_history(spark, d)))


@register("best_trial", with_views(["f_trials"], [], """
    SELECT number, round(value, 6) AS value, wandb_run_id FROM f_trials
    ORDER BY coalesce(value, 'inf'::DOUBLE), number LIMIT 1"""))
def q_best_trial(spark, d):
    return _round_doubles(M.best_trial(FX.f_trials(spark, d)))


@register("study_results", with_views(["f_trials"], [
    ("b", "SELECT number AS best_number FROM f_trials ORDER BY coalesce(value, 'inf'::DOUBLE), number LIMIT 1")], """
    SELECT t.number, round(coalesce(t.value, 'inf'::DOUBLE), 6) AS value, t.wandb_run_id, b.best_number,
           t.number = b.best_number AS is_best
    FROM f_trials t, b"""))
def q_study_results(spark, d):
    # The study document: one JSON line per trial with the best one marked.
    path = scratch_dir(spark, "study-results")
    res = M.study_results(FX.f_trials(spark, d))
    write_json_lines(res, path)
    return _round_doubles(spark.read.schema(res.schema).json(path))


STUDY_DEFAULTS = {"lr": "1e-5", "batch": "2", "epochs": "3"}


@register("study_document", with_views(["f_trials"], [
    ("p", """SELECT *, CASE WHEN number % 5 <> 0 THEN concat('batch=', number % 3 + 1, ',beta=0.', number % 4 + 1, ',epochs=3,lr=1e-5')
                            ELSE 'batch=2,epochs=3,lr=1e-5' END AS params FROM f_trials"""),
    ("b", "SELECT * FROM p ORDER BY coalesce(value, 'inf'::DOUBLE), number LIMIT 1")], """
    SELECT CAST(floor(p.number / 100) AS BIGINT) AS part, p.number, round(coalesce(p.value, 'inf'::DOUBLE), 6) AS value, p.params,
           p.wandb_run_id, b.number AS best_number, b.params AS best_params, b.wandb_run_id AS best_run_id
    FROM p, b"""))
def q_study_document(spark, d):
    # Written as JSON documents of bounded parts and read back.
    path = scratch_dir(spark, "study-document")
    doc = M.study_document(FX.f_trials_params(spark, d), STUDY_DEFAULTS, part_trials=100)
    write_json_lines(doc, path)
    back = spark.read.schema(doc.schema).json(path).select("part", "best_trial", F.explode("all_trials").alias("t"))
    return _round_doubles(back.select(
        "part", "t.number", "t.value", M.params_text(F.col("t.params")).alias("params"), "t.wandb_run_id",
        F.col("best_trial.number").alias("best_number"), M.params_text(F.col("best_trial.params")).alias("best_params"),
        F.col("best_trial.wandb_run_id").alias("best_run_id")))


# --------------------------------------------------------------------- text jobs

# Generation: prompts of at most GEN_PROMPT tokens, outputs of at most GEN_LENGTH
# with the prompt and GEN_NEW without it.
GEN_PROMPT, GEN_LENGTH, GEN_NEW = 12, 20, 15
GEN_KWARGS = {"max_length": str(GEN_LENGTH), "max_new_tokens": str(GEN_NEW), "upper": "true"}


def _sql_generated(prompt: str) -> str:
    """SQL of the stand-in model's continuation of a prompt."""
    toks = f"list_filter(string_split_regex({prompt}, '\\s+'), lambda x: x <> '')[1:{GEN_PROMPT}]"
    n = f"greatest(least({GEN_NEW}, {GEN_LENGTH} - len({toks})), 0)"
    return (f"CASE WHEN {prompt} IS NOT NULL THEN upper(coalesce(array_to_string(list_transform("
            f"CASE WHEN len({toks}) > 0 THEN range({n}) ELSE [] END, lambda i: ({toks})[(i % len({toks})) + 1]), ' '), '')) END")


@register("truncate_tokens", f"""
    WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS toks FROM documents)
    SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(least(len(toks), {TRUNCATE_AT}) AS BIGINT) AS n_kept,
           len(toks) > {TRUNCATE_AT} AS truncated, array_to_string(toks[1:{TRUNCATE_AT}], ' ') AS text_truncated
    FROM t""")
def q_truncate_tokens(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id", "text")
    return T.truncate_tokens(docs, max_tokens=TRUNCATE_AT).select(
        "doc_id", "n_tokens", "n_kept", "truncated", "text_truncated")


@register("pack_sequences", f"""
    WITH t AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) + 1 AS span
               FROM documents),
    o AS (SELECT doc_id, span, coalesce(sum(span) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS st, sum(span) OVER () AS total FROM t),
    b AS (SELECT doc_id, st, st + span AS en, total,
                 unnest(range(CAST(floor(st / {PACK_AT}) AS BIGINT), CAST(floor((st + span - 1) / {PACK_AT}) AS BIGINT) + 1))
                 AS block_id FROM o)
    SELECT CAST(block_id AS BIGINT) AS block_id, doc_id,
           CAST(greatest(st, block_id * {PACK_AT}) - block_id * {PACK_AT} AS BIGINT) AS from_offset,
           CAST(least(en, (block_id + 1) * {PACK_AT}) - block_id * {PACK_AT} AS BIGINT) AS to_offset
    FROM b WHERE block_id < floor(total / {PACK_AT})""")
def q_pack_sequences(spark, d):
    docs = FX.table(spark, d, "documents").select("doc_id", "text")
    return T.pack_sequences(docs, seq_length=PACK_AT)


@register("truncate_pairs", with_views(["f_preferences"], [
    ("t", "SELECT row_id, " + ", ".join(f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '') AS {c}"
                                        for c in ("prompt", "chosen", "rejected")) + " FROM f_preferences"),
    ("k", "SELECT *, 20 - least(len(prompt), 8) AS budget FROM t")], """
    SELECT row_id, array_to_string(prompt[greatest(len(prompt) - 8 + 1, 1):], ' ') AS prompt,
           array_to_string(chosen[1:budget], ' ') AS chosen, array_to_string(rejected[1:budget], ' ') AS rejected FROM k"""))
def q_truncate_pairs(spark, d):
    return T.truncate_pair(FX.f_preferences(spark, d).select("row_id", "prompt", "chosen", "rejected"), 8, 20)


@register("pack_instructions", with_views(["f_preferences"], [
    ("x", f"""SELECT row_id, {_sql_text('### Instruction:' + chr(10) + P.DEFAULT_INSTRUCTION_PREFIX + chr(10) + chr(10)
                                         + '### Input:' + chr(10))}
                     || prompt || {_sql_text(chr(10) + ' ' + chr(10) + '### Response:' + chr(10))} || chosen || chr(10) AS text
              FROM f_preferences"""),
    ("t", "SELECT row_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) + 1 AS span FROM x"),
    ("o", """SELECT row_id, span, sum(span) OVER () AS total, coalesce(
                 sum(span) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t"""),
    ("b", f"""SELECT row_id, st, st + span AS en, total,
                 unnest(range(CAST(floor(st / {PACK_AT}) AS BIGINT), CAST(floor((st + span - 1) / {PACK_AT}) AS BIGINT) + 1))
                 AS block_id FROM o""")], f"""
    SELECT CAST(block_id AS BIGINT) AS block_id, row_id,
           CAST(greatest(st, block_id * {PACK_AT}) - block_id * {PACK_AT} AS BIGINT) AS from_offset,
           CAST(least(en, (block_id + 1) * {PACK_AT}) - block_id * {PACK_AT} AS BIGINT) AS to_offset
    FROM b WHERE block_id < floor(total / {PACK_AT})"""))
def q_pack_instructions(spark, d):
    formatted = P.instruction_format(FX.f_preferences(spark, d))
    return T.pack_sequences(formatted.select("row_id", "text"), key="row_id", seq_length=PACK_AT)


@register("batch_generate", with_views(["f_preferences"], [], f"""
    SELECT 'dialectic-run' AS wandb_run_name, 'run0' AS wandb_run_id, 'checkpoints/epoch-3' AS checkpoint_model_path,
           '03' AS checkpoint_epoch, 'all' AS dataset_to_gen_txt,
           CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS sample_index, prompt,
           {_sql_generated('prompt')} AS generated_text, chosen, rejected
    FROM f_preferences"""))
def q_batch_generate(spark, d):
    rows = P.with_positions(FX.f_preferences(spark, d), "sample_index")
    return T.batch_generate(rows, run_name="dialectic-run", run_id="run0", checkpoint_path="checkpoints/epoch-3",
                            checkpoint_epoch=3, split_name="all", kwargs=GEN_KWARGS, max_prompt_tokens=GEN_PROMPT)


@register("generated_samples", with_views(["f_preferences"], _GROUP_SPLIT_CTES, f"""
    SELECT 'run0' AS run_id, CAST(row_number() OVER (ORDER BY split_rank, row_id) - 1 AS BIGINT) AS eval_sample_index,
           CAST(1.0 AS DOUBLE) AS epoch, prompt, {_sql_generated('prompt')} AS generated_text, chosen, rejected
    FROM gs WHERE split = 'validation'"""))
def q_generated_samples(spark, d):
    val = P.select_split(_group_split(spark, d), "validation")
    rows = P.pick_positions(val, None)  # "all" mode
    # Half of the samples are in the log already; the rest is generated and appended.
    log = scratch_dir(spark, "generated-log")

    def make(r):
        return T.generated_samples(r, run_id="run0", epoch=1.0, kwargs=GEN_KWARGS, max_prompt_tokens=GEN_PROMPT)

    append_log(make(rows.where(F.col("pos") % 2 == 0)), log, partition_by=(), fmt="csv")
    return T.resume(rows, make, log, "pos", "eval_sample_index", {"run_id": "run0", "epoch": 1.0})


@register("generate_test_split", with_views(["f_preferences"], _GROUP_SPLIT_CTES + [
    ("t", f"""SELECT row_id, {_sql_text(P.DEFAULT_TEMPLATE_PREFIX)} || prompt || {_sql_text(P.DEFAULT_TEMPLATE_SUFFIX)}
                    AS prompt, chosen, rejected, split_rank FROM gs WHERE split = 'test'"""),
    ("f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY row_id) AS rn FROM t) WHERE rn = 1")],
    f"""SELECT 'dialectic-run' AS wandb_run_name, 'run0' AS wandb_run_id, 'checkpoints/epoch-3' AS checkpoint_model_path,
              '03' AS checkpoint_epoch, 'test' AS dataset_to_gen_txt,
              CAST(row_number() OVER (ORDER BY split_rank, row_id) - 1 AS BIGINT) AS sample_index, prompt,
              {_sql_generated('prompt')} AS generated_text, chosen, rejected
       FROM f"""))
def q_generate_test_split(spark, d):
    # The generation flow: group split -> template -> pick the split ->
    # first row per prompt, renumbered -> generate -> CSV file (and back).
    rows = P.preprocess(_group_split(spark, d), "template_edit_dataset")
    rows = P.dedup_prompts(P.select_split(rows, "test").drop("split"))
    def make(r):
        return T.batch_generate(r, run_name="dialectic-run", run_id="run0", checkpoint_path="checkpoints/epoch-3",
                                checkpoint_epoch=3, split_name="test", kwargs=GEN_KWARGS, max_prompt_tokens=GEN_PROMPT)

    # Appended to the output file; the second call finds every sample there.
    path = scratch_dir(spark, "generated-csv")
    same = {"wandb_run_id": "run0", "checkpoint_epoch": "03", "dataset_to_gen_txt": "test"}
    T.resume(rows, make, path, "sample_index", "sample_index", same)
    return T.resume(rows, make, path, "sample_index", "sample_index", same)


# --------------------------------------------------------------------- streaming

@register("stream_metric_rollup", _METRIC_ROLLUP_SQL)
def q_stream_metric_rollup(spark, d):
    from dialectic.plans.streaming_query import stream_rollup_over
    return _round_doubles(stream_rollup_over(spark, _scored(spark, d), FX.f_side_logits(spark, d)))
