"""Discussion threads: OP comments, recursive walks, nested thread records.

The per-seed recursive query of the original (one round trip per OP comment)
becomes ONE set-oriented walk for all seeds, by pointer doubling: comments
that agree in both ids are one numbered node, an edge table leads from node to
node, and ``operators.doubling`` finds all paths in ``log2(depth)`` rounds over
rows of three numbers. Nodes that lead into a cycle are marked once for all
seeds, before anything is walked. Authors and bodies are joined to the
reached nodes once, at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectic.functions.text import DELTA_SYMBOLS, contains_any, strip_type_prefix, utf8_clean
from dialectic.operators.doubling import HOT_KEY_MIN_ROWS, double_edges, expand, hot_keys, skew_join
from dialectic.session import checkpoint_dir, scratch_dir
from dialectic.sources.sinks import replace_table

__all__ = ["Walk", "ancestor_walk", "assemble_threads", "build_threads", "descendant_walk", "explode_threads",
           "hot_keys", "lookup", "op_comments", "op_replies", "quarantined", "store_op_comments", "strip_prefixes",
           "thread_records", "to_threads"]

COMMENT_ATTRS = ["author", "body", "parent_id", "link_id", "created_utc"]
# No bound on the depth unless a caller sets one.
DEFAULT_MAX_DEPTH = None


def op_comments(comments: DataFrame, submissions: DataFrame,
                exclude_authors: list[str] | None = None) -> DataFrame:
    """Comments written by the author of the submission they sit under.

    Inner equi-join on ``(substring(link_id, 4), author) = (s.id, s.author)``.
    NULL authors never match. ``exclude_authors`` (e.g. ``["[deleted]"]``)
    drops placeholder authors that would otherwise match each other.
    """
    c = comments.select(F.col("id").alias("comments_id"),
                        strip_type_prefix("link_id").alias("submission_id"),
                        F.col("author").alias("submission_author"))
    s = submissions.select(F.col("id").alias("submission_id"),
                           F.col("author").alias("submission_author"),
                           F.col("title").alias("submission_title"),
                           F.col("selftext").alias("submission_body"))
    if exclude_authors:
        c = c.where(~F.col("submission_author").isin(exclude_authors))
    return c.join(s, ["submission_id", "submission_author"], "inner").select(
        "comments_id", "submission_id", "submission_author", "submission_title", "submission_body")


def store_op_comments(comments: DataFrame, submissions: DataFrame, name: str, path: str, buckets: int = 8) -> DataFrame:
    """The OP-comment table dropped and created anew as table ``name`` with its rows
    at ``path``, bucketed and sorted by ``comments_id``: later joins on that id (by
    as many shuffle partitions) read it without an exchange or a sort of this side."""
    return replace_table(op_comments(comments, submissions), name, path, (buckets, "comments_id"))


def op_replies(ops: DataFrame, comments: DataFrame) -> DataFrame:
    """Every comment with its OP comment's submission: a join with the stored table."""
    c = comments.select("id", "created_utc", "body")
    return ops.join(c, ops["comments_id"] == c["id"]).select(
        "comments_id", "submission_id", "submission_author", "created_utc", "body")


def strip_prefixes(comments: DataFrame) -> DataFrame:
    """Comment ids with the type prefix removed from link and parent refs."""
    return comments.select(
        "id",
        strip_type_prefix("link_id").alias("submission_id"),
        strip_type_prefix("parent_id").alias("parent_ref"),
    )


def lookup(comments: DataFrame, ids, order: bool = True) -> DataFrame:
    """Comments by id: one id, a short list (pushed into the scan as an
    IN filter), or a DataFrame of ids (left-semi join, any size)."""
    if isinstance(ids, DataFrame):
        key = ids.columns[0]
        res = comments.join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    elif isinstance(ids, (list, tuple, set)):
        res = comments.where(F.col("id").isin(list(ids)))
    else:
        res = comments.where(F.col("id") == F.lit(ids))
    return res.orderBy("created_utc", "id") if order else res


@dataclass
class Walk:
    """Result of a recursive walk.

    ``rows``: ``(start_id, id, depth)`` + comment attributes, one row per
    reached comment per seed (bag semantics, like ``UNION ALL``).
    ``stuck``: ``(start_id, depth)`` of seeds whose walk goes round, or is longer
    than ``max_depth`` (``depth``: how far it was followed); they have no rows.
    ``levels``: rounds of doubling.
    """

    rows: DataFrame
    stuck: DataFrame
    levels: int


def _node_table(comments: DataFrame, base: str) -> tuple[DataFrame, int]:
    """``node, id, parent_id, n``: comments that agree in both ids are one node
    with their number ``n``, so duplicate ids behave like UNION ALL over rows."""
    slim = comments.where(F.col("id").isNotNull()).groupBy("id", "parent_id").agg(F.count(F.lit(1)).alias("n"))
    path = f"{base}/nodes"
    slim.select(F.monotonically_increasing_id().alias("node"), "id", "parent_id", "n").write.parquet(path)
    nodes = comments.sparkSession.read.schema("node long, id string, parent_id string, n long").parquet(path)
    return nodes, nodes.count()


def _walk(comments: DataFrame, seeds: DataFrame, direction: str, max_depth: int | None,
          hot_key_rows: int = HOT_KEY_MIN_ROWS) -> Walk:
    spark = comments.sparkSession
    base = scratch_dir(spark, f"walk-{direction}")
    nodes, n = _node_table(comments, base)
    parent = strip_type_prefix("parent_id")
    want, key = (parent, F.col("id")) if direction == "up" else (F.col("id"), parent)
    here = nodes.select(F.col("node").alias("src"), F.col("n").alias("copies"), want.alias("_want"))
    there = nodes.select(F.col("node").alias("dst"), key.alias("_key"))
    edges = skew_join(here, there, "_want", "_key", n, n, hot_key_rows)
    jumps = double_edges(edges, f"{base}/jumps", None if max_depth is None else max_depth + 1, hot_key_rows)

    seeds = seeds.select(F.col(seeds.columns[0]).alias("start_id")).distinct()
    starts = seeds.join(nodes, seeds["start_id"] == nodes["id"]).select("start_id", "node")
    stuck = spark.createDataFrame([], "start_id string, depth long")
    if jumps.round is not None:
        caught = starts.join(jumps.round, starts["node"] == F.col("src"), "left_semi").select("start_id").distinct()
        caught = caught.withColumn("depth", F.lit(2 << len(jumps.levels) >> 1).cast("long"))
        caught.write.parquet(f"{base}/stuck")
        stuck = spark.read.schema("start_id string, depth long").parquet(f"{base}/stuck")
        starts = starts.join(stuck.select("start_id"), "start_id", "left_anti")
    reached = expand(starts.select("start_id", "node", F.lit(0).cast("long").alias("depth"),
                                   F.lit(1).cast("long").alias("copies")), jumps, f"{base}/reached", hot_key_rows)
    if max_depth is not None:
        far = (reached.where(F.col("depth") > max_depth).groupBy("start_id")
               .agg(F.lit(max_depth + 1).cast("long").alias("depth")))
        stuck = stuck.unionByName(far)
        reached = reached.join(far.select("start_id"), "start_id", "left_anti")
    # The wide columns, once: each comment row of a reached node counts as often
    # as paths lead to the node.
    known = nodes.select("node", "id", F.col("parent_id").alias("_parent"))
    c = comments.select(F.col("id").alias("_id"), *COMMENT_ATTRS)
    rows = (reached.join(known, "node").join(c, (F.col("id") == F.col("_id")) & F.col("_parent").eqNullSafe(c["parent_id"]))
            .select("start_id", "id", "depth", *[c[a] for a in COMMENT_ATTRS],
                    F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_k"))
            .drop("_k"))
    return Walk(rows=rows, stuck=stuck, levels=len(jumps.levels))


def ancestor_walk(comments: DataFrame, seeds: DataFrame, max_depth: int | None = DEFAULT_MAX_DEPTH,
                  hot_key_rows: int = HOT_KEY_MIN_ROWS) -> Walk:
    """Each seed plus all its ancestors up to the top-level comment
    (the parent that is no comment — the submission — ends the chain).

    ``seeds``: one-column DataFrame of comment ids.
    """
    return _walk(comments, seeds, "up", max_depth, hot_key_rows)


def descendant_walk(comments: DataFrame, seeds: DataFrame, max_depth: int | None = DEFAULT_MAX_DEPTH,
                    hot_key_rows: int = HOT_KEY_MIN_ROWS) -> Walk:
    """Each seed plus every reply below it, at any depth."""
    return _walk(comments, seeds, "down", max_depth, hot_key_rows)


def _thread_struct() -> F.Column:
    # Text fields are decoded leniently (invalid UTF-8 dropped); ids are not.
    return F.struct(
        F.col("id").alias("comment_id"), utf8_clean("author").alias("comment_author"),
        utf8_clean("body").alias("comment_body"), F.col("parent_id").alias("comment_parent_id"),
        F.col("link_id").alias("comment_link_id"), F.col("created_utc").alias("comment_created_utc"),
    )


def assemble_threads(walk_rows: DataFrame) -> DataFrame:
    """One row per seed: the walked comments as an array ordered by time.

    Ties on ``created_utc`` are broken by distance from the root (ancestors
    first), then id, so the leaf — which decides the delta flag — is
    deterministic. Array size is bounded by the walk depth.
    """
    keyed = F.struct(F.col("created_utc").alias("k1"), (-F.col("depth")).alias("k2"),
                     F.col("id").alias("k3"), _thread_struct().alias("c"))
    g = walk_rows.groupBy("start_id").agg(F.sort_array(F.collect_list(keyed)).alias("_arr"))
    return g.select("start_id", F.transform("_arr", lambda x: x["c"]).alias("comments_thread"))


def thread_records(comments: DataFrame, submissions: DataFrame, seeds_from: DataFrame,
                   max_depth: int | None = DEFAULT_MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """``(records, stuck)`` for the OP comments among ``seeds_from``, walked over
    all ``comments``. ``records``: ``comments_id``, the submission's columns, root,
    leaf, the leaf's body and the thread; ``stuck``: ``comments_id`` of walks that
    go round or exceed ``max_depth``."""
    # The OP-comment table feeds the walk (seeds) and the final record join;
    # it is computed once and kept as files in the shared checkpoint folder
    # (the original materialized it as a table for the same reason).
    checkpoint_dir(comments.sparkSession)
    ops = op_comments(seeds_from, submissions).checkpoint(eager=True)
    walk = ancestor_walk(comments, ops.select("comments_id"), max_depth=max_depth)
    arr = assemble_threads(walk.rows)
    leaf = F.element_at("comments_thread", -1)
    rec = arr.select(
        "start_id",
        F.element_at("comments_thread", 1)["comment_id"].alias("comments_thread_root_comment_id"),
        leaf["comment_id"].alias("comments_thread_leaf_comment_id"),
        leaf["comment_body"].alias("_leaf_body"),
        "comments_thread",
    )
    ops_clean = ops.select("comments_id", "submission_id",
                           *[utf8_clean(c).alias(c) for c in
                             ("submission_author", "submission_title", "submission_body")])
    stuck = ops.join(walk.stuck, ops["comments_id"] == walk.stuck["start_id"], "left_semi").select("comments_id")
    return ops_clean.join(rec, ops_clean["comments_id"] == rec["start_id"]).drop("start_id"), stuck


def to_threads(records: DataFrame, delta_symbols: list[str] | None = None, keep_id: bool = False) -> DataFrame:
    """The thread records with a leaf body, in the nested thread schema (behind
    their OP comment's id if ``keep_id``)."""
    symbols = DELTA_SYMBOLS if delta_symbols is None else delta_symbols
    return records.where(F.col("_leaf_body").isNotNull()).select(
        *(["comments_id"] if keep_id else []),
        "submission_id", "submission_author", "submission_title", "submission_body",
        "comments_thread_root_comment_id", "comments_thread_leaf_comment_id",
        contains_any("_leaf_body", symbols).alias("comments_thread_is_delta"),
        "comments_thread",
    )


def quarantined(records: DataFrame, stuck: DataFrame) -> DataFrame:
    """``(comments_id, reason)`` of OP comments without a thread record."""
    bad_body = records.where(F.col("_leaf_body").isNull()).select(
        "comments_id", F.lit("null_leaf_body").alias("reason"))
    return bad_body.unionByName(stuck.select("comments_id", F.lit("depth_limit").alias("reason")))


def build_threads(comments: DataFrame, submissions: DataFrame,
                  delta_symbols: list[str] | None = None,
                  max_depth: int | None = DEFAULT_MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Thread records for every OP comment, plus the quarantine.

    Returns ``(threads, quarantine)``. ``threads`` follows the nested thread
    schema; ``quarantine`` holds ``(comments_id, reason)`` for seeds whose
    walk goes round (or hits ``max_depth``) or whose leaf comment has a NULL body
    (the original reported such records and moved on). Seeds whose walk is empty
    (seed id missing from comments) produce nothing, as before.
    """
    records, stuck = thread_records(comments, submissions, comments, max_depth)
    return to_threads(records, delta_symbols), quarantined(records, stuck)


def explode_threads(threads: DataFrame) -> DataFrame:
    """Flat view of thread records: one row per (thread, position)."""
    return threads.select(
        "submission_id", "comments_thread_root_comment_id", "comments_thread_leaf_comment_id",
        "comments_thread_is_delta", F.posexplode("comments_thread").alias("pos", "c"),
    ).select("*", "c.*").drop("c")
