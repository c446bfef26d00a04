"""How filters over documents overlap, by a sparse document-term matrix.

Words are encoded by one dictionary over the whole table, and each task's
slice of documents becomes a shard of the matrix in compressed rows: where
each row begins, the columns of its nonzero cells, and their counts. A row's
sum is its number of words, its nonzero cells are its different words. What
the other filters need is attached to the rows; documents are then counted by
the set of filters they fail, and every order of the filters is read off
those counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialectic.llm.frames import arrow_bytes, running_sums, slices, stored

#: Bytes of text in one shard and in one row of it; a longer text is a shard of its own.
SHARD_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Bytes that go to Python at once.
BATCH_BYTES = 4 << 20
#: A shard's lists are long: pages and row groups are measured at every row, not at every hundredth.
SMALL_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
               "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
               "parquet.block.size": str(16 << 20)}
#: Rows of words that are numbered together, and the most such buckets.
WORDS_PER_BUCKET, MAX_BUCKETS = 1 << 18, 1 << 16
#: Bits of a column's number beside its place in a shard.
COLUMN_BITS = 40
#: A text with more copies than a 4096th of the rows is "hot": at most 4096 are.
MAX_HOT = 4096

# --- fixed values: the five filters, in the order of their bits
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 50, 65, 5
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
# ---------------------------------------------------------------------------
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

INTS = T.ArrayType(T.IntegerType())


def _words_in_rows(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of every word of texts, and the words as a dictionary array."""
    cut = pc.ascii_split_whitespace(texts)
    rows = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False).astype(np.int32)
    flat = cut.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
    return rows[keep.to_numpy(zero_copy_only=False)], flat.filter(keep).dictionary_encode()


def compressed_pieces(pieces: list[pa.Array]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], pa.Array]:
    """``(starts, columns, counts)`` of each piece's texts, and the ``words`` of all:
    row ``r``'s cells are those from ``starts[r]`` to ``starts[r + 1]``, sorted by
    column; a column numbers a word of ``words``."""
    rows, coded = zip(*[_words_in_rows(texts) for texts in pieces])
    # The words of all pieces, and for each piece the place of its own words in them.
    whole = pa.concat_arrays([c.dictionary for c in coded]).dictionary_encode()
    words, places = whole.dictionary, np.split(whole.indices.to_numpy(), np.cumsum([len(c.dictionary) for c in coded])[:-1])
    n_words = max(1, len(words))
    uses = np.zeros(len(words), np.int64)
    for place, c in zip(places, coded):
        uses[place] += np.bincount(c.indices.to_numpy(), minlength=len(place))
    often = np.argsort(-uses, kind="stable")
    number = np.empty(len(often), np.int64)
    number[often] = np.arange(len(often))
    out = []
    for texts, row, place, c in zip(pieces, rows, places, coded):
        cells = number[place][c.indices.to_numpy()]
        cells += row.astype(np.int64) * n_words
        cells.sort()
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        counts, cells = np.diff(np.append(first, len(cells))), cells[first]
        starts = np.searchsorted(cells, np.arange(len(texts) + 1) * n_words)
        out.append((starts.astype(np.int32), (cells % n_words).astype(np.int32), counts.astype(np.int32)))
    return out, words.take(pa.array(often))


def compressed_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``(starts, columns, counts, words)`` of texts in one piece."""
    [rows], words = compressed_pieces([texts])
    return *rows, words


def _flags_and_digests(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Per text the bits of filters C and D, and its SHA-256."""
    flags, digests = [], []
    for t, n in zip(texts.cast(pa.binary()), pc.utf8_length(texts).to_pylist()):
        t = t.as_py()
        upper = len(t) - len(t.translate(None, UPPER))
        symbols = len(t.translate(None, SYMBOLS)) != len(t)
        flags.append((100 * upper > MOST_UPPER_PERCENT * n) * 4 + symbols * 8)
        digests.append(hashlib.sha256(t).digest())
    return pa.array(flags, pa.int32()), pa.array(digests, pa.binary())


def _local_shards(docs: DataFrame, part: str) -> DataFrame:
    """Shards whose columns are still numbered per shard, with their words and
    what the other filters need of each document. A shard is several rows, each
    with the cells of some of its documents and some of its words."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("doc_id", T.ArrayType(id_type)),
        T.StructField("part", T.ArrayType(T.StringType())), T.StructField("flags", INTS),
        T.StructField("digest", T.ArrayType(T.BinaryType())), T.StructField("starts", INTS),
        T.StructField("cols", INTS), T.StructField("counts", INTS), T.StructField("n_columns", T.LongType()),
        T.StructField("first_column", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def rows(shard: int, pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, words = compressed_pieces([p.column("text").cast(pa.large_string()) for p in pieces])
        words, bounds = words.cast(pa.string()), [i * len(words) // len(pieces) for i in range(len(pieces) + 1)]
        for piece, found, at, end in zip(pieces, cells, bounds, bounds[1:]):
            flags, digest = _flags_and_digests(piece.column("text"))
            lists = [piece.column("doc_id"), piece.column("part"), flags, digest, *map(pa.array, found), words[at:end]]
            *of, named = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), *of, pa.array([end - at]), pa.array([at], pa.int32()), named], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                size = pc.sum(pc.binary_length(piece.column("text"))).as_py() + piece.num_rows
                if pieces and held + size > SHARD_BYTES:
                    yield from rows(shard, pieces)
                    shard, pieces, held = shard + 1, [], 0
                pieces.append(piece)
                held += size
        if pieces:
            yield from rows(shard, pieces)

    slim = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    return slim.mapInArrow(run, schema)


def _numbered(local: DataFrame) -> DataFrame:
    """Every shard's words with their place in an order of all different words:
    ``shard, at, _bucket, _nth`` (from 1 on within a bucket of words) and ``word``
    in one row of each word (else null)."""
    total = local.agg(F.sum("n_columns")).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, 1 + total // WORDS_PER_BUCKET))
    words = local.select("shard", "first_column", F.posexplode("words").alias("at", "word"))
    words = words.withColumn("at", F.col("first_column") + F.col("at"))
    words = words.withColumn("_bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
    by_word = Window.partitionBy("_bucket").orderBy("word")
    seen = F.lag("word").over(by_word).eqNullSafe(F.col("word"))
    return stored(words.select("shard", "at", "_bucket", F.dense_rank().over(by_word).alias("_nth"),
                               F.when(~seen, F.col("word")).alias("word")), "numbered-words")


def term_matrix(docs: DataFrame, part: str = "source") -> tuple[DataFrame, DataFrame]:
    """The matrix and its dictionary.

    ``dictionary``: ``word, col``, all different words numbered from 0 on without
    gaps. ``shards``: ``shard``, which several rows may share, each with some of its
    documents; per document ``doc_id``, ``part``, ``flags`` and ``digest``;
    ``starts``, ``cols`` and ``counts`` of its row; ``first_column``, 0 in one of a shard's rows at least;
    ``columns``, by which ``columns_of`` maps the shard's own numbers in ``cols`` to
    those of the dictionary. Words are stretches without ASCII white space; a null text is
    empty and has an empty row. A word is one row per shard that holds it,
    however often; one bucket of words is numbered in one task.
    """
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        local = stored(_local_shards(docs, part), "local-shards", options=SMALL_PAGES)
    numbered = _numbered(local)
    sizes = numbered.groupBy("_bucket").agg(F.max("_nth").cast("long").alias("n"))
    before = running_sums(sizes, ["n"], [], "_bucket").select("_bucket", "n_before")
    numbered = numbered.join(F.broadcast(before), "_bucket").select(
        "shard", "at", "word", (F.col("n_before") + F.col("_nth") - 1).alias("col"))
    # One number holds place and column, so that a shard's list is a flat array.
    packed = F.sort_array(F.collect_list(F.shiftleft(F.col("at").cast("long"), COLUMN_BITS) + F.col("col")))
    columns = numbered.groupBy("shard").agg(packed.alias("columns"))
    shards = local.drop("words", "n_columns").join(columns, "shard", "left")
    shards = shards.withColumn("columns", F.coalesce("columns", F.array().cast("array<bigint>")))
    return shards, numbered.filter(F.col("word").isNotNull()).select("word", "col")


def columns_of(packed: np.ndarray) -> np.ndarray:
    """The dictionary's numbers of a shard's columns."""
    return packed & ((1 << COLUMN_BITS) - 1)


def matrix_rows(shards: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, part, digest``, ``n_words`` (its row's
    sum), ``n_distinct`` (its nonzero cells) and ``fails``, the bits of filters
    A to D."""
    id_type = shards.schema["doc_id"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("part", T.StringType()),
        T.StructField("digest", T.BinaryType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_distinct", T.LongType()), T.StructField("fails", T.IntegerType())])

    def run(shard: pa.Table) -> pa.Table:
        columns = columns_of(shard.column("columns").drop_null()[0].values.to_numpy(zero_copy_only=False))
        out = []
        for piece in shard.to_batches():
            for i in range(piece.num_rows):
                of = {n: piece.column(n)[i].values for n in piece.schema.names if n not in ("shard", "columns")}
                starts = of["starts"].to_numpy(zero_copy_only=False)
                cells = columns[of["cols"].to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                cells += row << COLUMN_BITS
                cells.sort()
                row = cells[np.flatnonzero(np.diff(cells, prepend=-1))] >> COLUMN_BITS
                sums = np.append(0, np.cumsum(of["counts"].to_numpy(zero_copy_only=False).astype(np.int64)))
                n_words, n_distinct = np.diff(sums[starts]), np.bincount(row, minlength=len(starts) - 1)
                fails = (of["flags"].to_numpy(zero_copy_only=False) + (n_words < LEAST_WORDS)
                         + 2 * (100 * n_distinct < LEAST_DISTINCT_PERCENT * n_words)).astype(np.int32)
                out.append(pa.RecordBatch.from_arrays(
                    [of["doc_id"], of["part"], of["digest"], pa.array(n_words), pa.array(n_distinct), pa.array(fails)],
                    names=schema.names))
        return pa.Table.from_batches(out)

    # Shard by shard, each with one copy of its columns, Python never gets more than a shard at once.
    once = shards.withColumn("columns", F.when(F.col("first_column") == 0, F.col("columns"))).drop("first_column")
    return once.groupBy("shard").applyInArrow(run, schema)


def failing(docs: DataFrame, part: str = "source") -> DataFrame:
    """``matrix_rows`` of ``docs`` with the bit of filter E (16) set where some
    row with a smaller id has the same text. A null id is smaller than none and
    has no smaller one."""
    shards = term_matrix(docs, part)[0]
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        rows = stored(matrix_rows(shards), "matrix-rows")
    first = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"))
    first = stored(first.filter(F.col("_n") > 1), "copies")
    # Texts with very many copies are broadcast (at most MAX_HOT rows), so that
    # no task gets all their documents; the others are joined by their digest.
    least = rows.count() // MAX_HOT
    hot = first.filter(F.col("_n") > least).select("digest", F.col("_first").alias("_hot"))
    marked = rows.join(F.broadcast(hot), "digest", "left")
    rest = (marked.filter(F.col("_hot").isNull())
            .join(first.filter(F.col("_n") <= least).select("digest", "_first"), "digest", "left"))
    both = marked.filter(F.col("_hot").isNotNull()).withColumn("_first", F.col("_hot")).unionByName(rest)
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return both.select(*rows.columns[:-1], (F.col("fails") + copy.cast("int") * 16).alias("fails"))


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the earlier filters)."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append((name, step, 1 << i, before))
            before |= 1 << i
    return out


def _table(rows: list[tuple], names: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])


def interactions(fails: DataFrame) -> DataFrame:
    """The audit of ``part, fails, good, toxic``: one row per part, order and step.

    Documents are counted per part and set of failed filters (at most 32 sets)
    before anything is multiplied; then per filter and set of earlier filters
    (80 of them), and only those sums are laid out over the 120 orders.
    """
    sets = fails.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("good").cast("long")).alias("_good"),
        F.sum(F.col("toxic").cast("long")).alias("_toxic"))
    orders = _orders()
    pairs = sorted({(bit, before) for _, _, bit, before in orders})
    cases = sets.select("*", F.explode(_table(pairs, ["bit", "before"])).alias("_c")).select("*", "_c.*").drop("_c")
    fails_it = F.col("fails").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("fails").bitwiseAND(F.col("before")) != 0
    here = fails_it & ~earlier
    filters = len(FILTERS)
    n_orders = len(orders) // filters

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    # A filter removes a document in the orders where it comes first of those
    # the document fails: one in bit_count of all.
    sums = cases.groupBy("part", "bit", "before").agg(
        total(~fails_it & ~earlier, F.col("_n")).alias("kept"), total(here, F.col("_n")).alias("removed"),
        total(fails_it & earlier, F.col("_n")).alias("redundant"),
        total(F.col("fails") == F.col("bit"), F.col("_n")).alias("unique_fails"),
        total(here, F.col("_good")).alias("good_lost"), total(here, F.col("_toxic")).alias("toxic_lost"),
        total(fails_it, F.col("_n") * (F.lit(n_orders) / F.bit_count("fails")).cast("long")).alias("shapley"))
    steps: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for name, step, bit, before in orders:
        steps.setdefault((bit, before), []).append((name, step))
    places = F.create_map(*[x for (bit, before), at in steps.items()
                            for x in (F.lit(bit * 64 + before), _table(at, ["filter_order", "step"]))])
    return (sums.select("*", F.explode(F.element_at(places, F.col("bit") * 64 + F.col("before"))).alias("_s"))
            .select("part", "_s.filter_order", F.col("_s.step").cast("int").alias("step"), *COUNTS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step; zeros included.

    ``part`` is a column of ``docs`` (null: empty string). A document without a
    label, or with a null id, is neither good nor toxic; several labels of an
    id count as good or toxic if one of them says so. Equal rows are documents
    of their own. An empty table has no parts and no rows.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failing(docs, part)
    joined = rows.join(marks, "doc_id", "left").select(
        "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return interactions(joined)
