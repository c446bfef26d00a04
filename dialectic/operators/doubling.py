"""Paths of any length over an edge table by pointer doubling.

``edges`` holds ``src, dst, copies``: one step leads from ``src`` to ``dst`` in
``copies`` ways. Round ``j`` joins the table of paths of ``2^j`` steps with
itself and gives those of ``2^(j+1)`` steps, so the longest path of ``d`` steps
takes ``log2(d)`` rounds, not ``d``. The tables shrink as paths end. Nodes
that lead into a cycle have paths of every length: they are found on the way
(see ``double_edges``), once for all starts. ``expand`` then lays the tables out
into one row per start and reached node: round ``j`` adds to every row reached
so far the row ``2^j`` steps further.

Every table is written to the shared checkpoint folder and read back: lineage
is cut per round, and a lost executor never replays earlier rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Skew handling: a join key is "hot" when it holds at least this many rows
# (and at least 1/MAX_HOT_KEYS of the side), so at most MAX_HOT_KEYS keys
# are ever hot; all rows here are a few numbers wide. The other side's rows for
# hot keys are broadcast only up to BROADCAST_MAX_ROWS rows (checked); beyond
# that AQE's skew split applies.
HOT_KEY_MIN_ROWS = 1 << 20
MAX_HOT_KEYS = 1 << 16
BROADCAST_MAX_ROWS = 1 << 20
MOST_COPIES = (1 << 63) - 1


@dataclass
class Jumps:
    """``levels[j]`` holds the paths of ``2^j`` steps; ``round`` the nodes
    (``src``) from which a cycle is reached, or None if there are none."""

    levels: list[DataFrame]
    round: DataFrame | None


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_KEY_MIN_ROWS, n: int | None = None) -> list:
    """Keys holding at least ``max(min_rows, rows / MAX_HOT_KEYS)`` rows.

    There can be at most ``MAX_HOT_KEYS`` such keys, so the list that comes
    back to the driver is bounded by construction. One count (cheap on
    written files; skipped when ``n`` is given) and, only when the side is
    large enough to hold a hot key, one partial aggregate.
    """
    n = df.count() if n is None else n
    threshold = max(int(min_rows), -(-n // MAX_HOT_KEYS))
    if n < threshold:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") >= threshold).select(key).collect()]


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n_left: int, n_right: int,
              hot_key_rows: int = HOT_KEY_MIN_ROWS) -> DataFrame:
    """Inner equi-join of two tables without common column names. Rows of a hot
    key stay where they are and meet the other side's rows by broadcast."""
    def small(df: DataFrame) -> bool:
        return df.limit(BROADCAST_MAX_ROWS + 1).count() <= BROADCAST_MAX_ROWS

    parts = []
    for hot, mine, many, few in ((hot_keys(left, left_key, hot_key_rows, n_left), left_key, "left", right_key),
                                 (hot_keys(right, right_key, hot_key_rows, n_right), right_key, "right", left_key)):
        if not hot:
            continue
        l_hot, r_hot = left.where(F.col(left_key).isin(hot)), right.where(F.col(right_key).isin(hot))
        if many == "left":
            parts.append((l_hot, F.broadcast(r_hot) if small(r_hot) else r_hot))
        else:
            parts.append((F.broadcast(l_hot) if small(l_hot) else l_hot, r_hot))
        left, right = left.where(~F.col(left_key).isin(hot)), right.where(~F.col(right_key).isin(hot))
    parts.append((left, right))
    res = None
    for a, b in parts:
        joined = a.join(b, F.col(left_key) == F.col(right_key))
        res = joined if res is None else res.unionByName(joined)
    return res


def _product(a: str, b: str) -> Column:
    return F.coalesce(F.try_multiply(F.col(a), F.col(b)), F.lit(MOST_COPIES))


def double_edges(edges: DataFrame, base: str, max_steps: int | None = None,
                 hot_key_rows: int = HOT_KEY_MIN_ROWS) -> Jumps:
    """The tables of paths of 1, 2, 4, ... steps, until none is that long (or they
    reach ``max_steps`` together).

    If more than ``2^j`` different nodes cannot be told apart from the count of
    paths of ``2^j`` steps, a path twice as long repeats a node: its first
    ``2^j + 1`` nodes all begin paths of ``2^j`` steps. So once ``2^j`` is at least
    that count, whatever still begins a path of ``2^(j+1)`` steps leads into a cycle,
    and the rounds end after at most ``log2(nodes)``.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        path = f"{base}/{name}"
        df.select("src", "dst", "copies").write.parquet(path)
        back = spark.read.schema("src long, dst long, copies long").parquet(path)
        return back, back.count()  # from file footers

    level, n = written(edges, "steps=1")
    levels: list[DataFrame] = []
    while n:
        levels.append(level)
        j = len(levels) - 1
        if max_steps is not None and (2 << j) - 1 >= max_steps:
            break
        far = level.select(F.col("src").alias("_mid"), F.col("dst").alias("_end"), F.col("copies").alias("_more"))
        near = level.select("src", F.col("dst").alias("_via"), "copies")
        step = skew_join(near, far, "_via", "_mid", n, n, hot_key_rows).select(
            "src", F.col("_end").alias("dst"), _product("copies", "_more").alias("copies"))
        n_before = n
        level, n = written(step, f"steps={2 << j}")
        if n > n_before:
            # Several ways lead between the same ends: merged, or the rows would
            # multiply from round to round. (With one way on from every node a
            # round cannot have more rows than the one before.)
            level, n = written(level.groupBy("src", "dst").agg(
                F.coalesce(F.try_sum("copies"), F.lit(MOST_COPIES)).alias("copies")), f"merged={2 << j}")
        if n and (1 << j) >= n_before:
            return Jumps(levels, level.select("src").distinct())
    return Jumps(levels, None)


def expand(starts: DataFrame, jumps: Jumps, base: str, hot_key_rows: int = HOT_KEY_MIN_ROWS) -> DataFrame:
    """``start_id, node, depth, copies`` for every node reached from ``starts``
    (the same columns, ``depth`` 0). Starts that lead into a cycle must be gone."""
    spark = starts.sparkSession
    schema = "start_id string, node long, depth long, copies long"
    paths: list[str] = []

    def add(df: DataFrame) -> int:
        path = f"{base}/part={len(paths)}"
        df.select("start_id", "node", "depth", "copies").write.parquet(path)
        paths.append(path)
        return spark.read.schema(schema).parquet(path).count()

    n = add(starts)
    for j, level in enumerate(jumps.levels):
        reached = spark.read.schema(schema).parquet(*paths)
        far = level.select("src", "dst", F.col("copies").alias("_more"))
        added = add(skew_join(reached, far, "node", "src", n, far.count(), hot_key_rows).select(
            "start_id", F.col("dst").alias("node"), (F.col("depth") + (1 << j)).alias("depth"),
            _product("copies", "_more").alias("copies")))
        if not added:
            break  # no start reaches 2^j steps, nor any more
        n += added
    return spark.read.schema(schema).parquet(*paths)
