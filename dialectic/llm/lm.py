"""Scoring documents by a recurrent language model and by exact word counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialectic.llm import gru
from dialectic.llm.frames import id_remainder, slices, stored, texts
from dialectic.llm.wordids import Hashes, Memo

#: Documents with this remainder are held out.
MODULUS, HELD_OUT = 7, 2
#: Most frequent words whose counts are broadcast; the others are joined.
HEAD_WORDS = 1 << 16
#: Words that a task counts before it sends them on; tokens scored side by side.
TASK_WORDS, GROUP_TOKENS = 1_000_000, 3 << 19
#: Parts that the training texts are dealt to; the model learns from one after
#: the other, averaged over the tasks after each. Every text is met once.
ROUNDS = 2
#: Weights that are averaged together.
BLOCK = 1 << 14
#: The two hashes of the end of a text; words have the hashes of their bytes.
END_KEY = (0, 0)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def tokens(raw: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, tokens per text): the 128-bit key of every word in two halves, a
    text's end last. Words are runs without ASCII white space, A-Z lower-cased."""
    data = np.frombuffer(b"\n" + b"\n".join([t.lower() for t in raw]) + b"\n", np.uint8)
    edge = np.diff((~_SPACE[data]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    a, b = hashes(data, start, end)
    ends = np.cumsum([len(t) + 1 for t in raw]) + 1
    upto = np.searchsorted(start, ends)
    return np.insert(a, upto, END_KEY[0]), np.insert(b, upto, END_KEY[1]), np.diff(np.concatenate(([0], upto))) + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def count_words(docs: DataFrame) -> DataFrame:
    """(a, b, n): exact counts of all tokens of ``docs`` (text). Every task
    counts its own rows first, so a word costs a task one row however often
    it occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, memo, held = Hashes(), Memo(), np.zeros(0, np.int64)
        keys: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(held[:memo.n])], names=["a", "b", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                a, b, _ = tokens(texts(part), hashes)
                found = memo.find(a, b)
                while (found < 0).any():
                    missing = np.flatnonzero(found < 0)
                    _, at = np.unique(a[missing], return_index=True)
                    new = missing[at]
                    memo.add(a[new], b[new])
                    keys.append((a[new], b[new]))
                    found[missing] = memo.find(a[missing], b[missing])
                if memo.n > len(held):
                    held = np.concatenate((held, np.zeros(max(len(held), memo.n - len(held)), np.int64)))
                held += np.bincount(found, minlength=len(held))
                if memo.n > TASK_WORDS:
                    yield flush()
                    memo, held, keys = Memo(), np.zeros(0, np.int64), []
        if memo.n:
            yield flush()

    return docs.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, limit: int = HEAD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) of the ``limit`` most frequent words (of equal counts, those of
    the smallest keys), most frequent first; the bounds come from histograms:
    of the counts in coarse bins, of the counts within the bin that runs over,
    and of the keys' first 16 bits within the count that does."""
    def over(values: DataFrame, value: Column, falling: bool, room: int) -> tuple[int | None, int]:
        hist = sorted((r["x"], r["count"]) for r in values.groupBy(value.alias("x")).count().collect())
        for x, n in hist[::-1] if falling else hist:
            if n > room:
                return x, room
            room -= n
        return None, room

    scale, key = F.floor(F.log2("n") * 16).cast("int"), F.shiftright("a", 48)
    taken, room = counts, limit
    if limit:
        bin_, room = over(counts, scale, True, room)
        if bin_ is not None:
            n, room = over(counts.filter(scale == bin_), F.col("n"), True, room)
            last, _ = over(counts.filter(F.col("n") == n), key, False, room)
            taken = counts.filter((F.col("n") > n) | ((F.col("n") == n) & (key <= last)))
    rows = taken.collect() if limit else []
    rows.sort(key=lambda r: (-r["n"], r["a"], r["b"]))
    a, b, n = (np.array([r[i] for r in rows[:limit]], np.int64) for i in range(3))
    return a.view(np.uint64), b.view(np.uint64), n


class Vocabulary:
    """Frequent words by key: their counts and their ids in the model (END for
    a text's end, OUTSIDE for words that are not among the most frequent). The
    model has as many ids as there are such words, at most ``gru.VOCAB``."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.memo, self.count = Memo(), n
        self.memo.add(a, b)
        end = (a == END_KEY[0]) & (b == END_KEY[1])
        words = np.flatnonzero(~end)[:gru.VOCAB - 2]
        self.id = np.full(len(a) + 1, gru.OUTSIDE, np.int64)
        self.id[np.flatnonzero(end)] = gru.END
        self.id[words] = 2 + np.arange(len(words))
        self.model_counts = np.zeros(2 + len(words), np.int64)
        self.model_counts[2:] = n[words]
        self.model_counts[gru.END] = int(n[end].sum())
        self.types = len(words) + 1

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the frequent words or -1, id in the model)."""
        found = self.memo.find(a, b)
        ids = self.id[found]
        ids[(a == END_KEY[0]) & (b == END_KEY[1])] = gru.END
        return found, ids


def training_texts(train: DataFrame, words: Vocabulary, rounds: int = 1) -> DataFrame:
    """One row per training text: its part (0 to rounds-1, in turn), and the ids
    of all its words, its end last. Long texts come first in a task's part, so
    that others run beside them up to their end."""
    shared = train.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = Hashes(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                a, b, n = tokens(texts(part), hashes)
                ids = pa.array(shared.value.look(a, b)[1].astype(np.int32))
                cut = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                of = pa.array(((met + np.arange(len(n))) % rounds).astype(np.int32))
                met += len(n)
                yield pa.RecordBatch.from_arrays([of, pa.ListArray.from_arrays(cut, ids)], names=["part", "ids"])

    return (train.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "part int, ids array<int>")
            .sortWithinPartitions("part", F.size("ids").desc()))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        col = batch.column("ids")
        at, ids = col.offsets.to_numpy(), col.values.to_numpy()
        yield from (ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))


def _mean(rows: pa.Table) -> pa.Table:
    """The mean of blocks of weights by number of words, and that number."""
    total, weight = 0.0, 0.0
    for w, v in zip(rows.column("w").to_pylist(), rows.column("v")):
        total, weight = total + w * np.frombuffer(v.as_buffer(), np.float32).astype(np.float64), weight + w
    return pa.table({"i": rows.column("i")[:1], "w": pa.array([weight]),
                     "v": pa.array([(total / weight).astype(np.float32).tobytes()])})


def fit(ids: DataFrame, start: gru.Params, vocab: int, rounds: int = ROUNDS) -> gru.Params:
    """Data-parallel training on ``ids`` (part, ids): for each part every task
    trains on its own texts from the same weights, and the new weights are
    averaged by number of words, in blocks and in two steps, so that a group
    holds about a square root of the tasks. Only the averaged model reaches
    the driver."""
    spark = ids.sparkSession
    now = gru.flatten(start).astype(np.float32)
    block = "i int, w double, v binary"
    for part in range(rounds):
        texts_ = ids.filter(F.col("part") == part).select("ids")
        fan = math.isqrt(texts_.rdd.getNumPartitions()) + 1
        shared = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, seen = gru.train(gru.unflatten(shared.value, vocab), _lists(batches))
            if seen:
                v = gru.flatten(model)
                for i, at in enumerate(range(0, len(v), BLOCK)):
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "w": pa.array([float(seen)]),
                                                      "v": pa.array([v[at:at + BLOCK].tobytes()])})

        means = texts_.mapInArrow(run, block).withColumn("g", F.spark_partition_id() % fan)
        means = means.groupBy("i", "g").applyInArrow(_mean, block).groupBy("i").applyInArrow(_mean, block)
        rows = means.select("i", "v").collect()
        if rows:
            now = np.concatenate([np.frombuffer(r["v"], np.float32) for r in sorted(rows, key=lambda r: r["i"])])
    return gru.unflatten(now, vocab)


SCORED = ("rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, model_log double, "
          "outside_log double, n_outside long, a array<long>, b array<long>, n array<int>")


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score (both log10).

    All training texts are counted. The model's words are the most frequent
    ones; the others share one id, and such a word adds its add-one share of
    the words outside the model, so ``score`` is the probability of the very
    text. Rare words' counts are joined by key: they are neither collected nor
    broadcast. Null text is empty: one token, its end. Without training
    documents all counts are 0. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    rem = id_remainder("doc_id", MODULUS)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (rem == HELD_OUT).alias("held_out"),
                       text.alias("text"))
    train = slim.filter(~F.col("held_out")).select("text")
    counts = stored(count_words(train.select(F.col("text").cast("binary").alias("text"))), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(sums["n"]), int(sums["v"])
    words = Vocabulary(*frequent_words(counts))
    # Tokens and types that the model does not know by name.
    n_out = n_all - int(words.model_counts.sum())
    v_out = v_all - int((words.model_counts > 0).sum())
    words.model_counts[gru.OUTSIDE] = n_out
    ids = stored(training_texts(train, words, rounds), "lm-texts", by="part")
    vocab = len(words.model_counts)
    model = fit(ids, gru.initial(words.model_counts), vocab, rounds)
    shared = spark.sparkContext.broadcast((words, gru.flatten(model).astype(np.float32)))
    base_floor, out_floor = np.log10(n_all + v_all + 1), np.log10(n_out + v_out + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = shared.value
        params, hashes = gru.unflatten(flat, vocab), Hashes()
        rid = TaskContext.get().partitionId() << 33
        cols: dict[str, list] = {}
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal rid
            ids, n, found, a, b = (np.concatenate([h[i] for h in held]) for i in range(5))
            doc = np.repeat(np.arange(len(n)), n)
            known, out = found >= 0, ids == gru.OUTSIDE
            log = np.log10(np.where(known, words.count[np.maximum(found, 0)] if len(words.count) else 0, 0) + 1.0)
            rare = np.flatnonzero(~known)
            # Rare words once per document, with their number.
            order = np.lexsort((b, a, doc[rare]))
            a, b, of = a[order], b[order], doc[rare][order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (of[1:] != of[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(fresh)
            cut = np.searchsorted(of[at], np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), v) for v in (
                _signed(a[at]), _signed(b[at]),
                pa.array(np.diff(np.append(at, len(order))).astype(np.int32)))]
            per = lambda x: pa.array(np.bincount(doc, x, len(n)))
            whole = lambda x: pa.array(np.bincount(doc, x, len(n)).astype(np.int64))
            arrays = [pa.array(rid + np.arange(len(n))), pa.concat_arrays(cols["doc_id"]),
                      pa.concat_arrays(cols["held_out"]), pa.array(n), whole(known), per(log * known),
                      pa.array(gru.score(params, ids, n) / np.log(10)), per(log * (known & out)), whole(out), *lists]
            rid += len(n)
            return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCORED.split(", ")])

        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                a, b, n = tokens(texts(part), hashes)
                found, ids = words.look(a, b)
                rare = found < 0  # only these keys leave the task
                held.append((ids.astype(np.int32), n, found, a[rare], b[rare]))
                for k in ("doc_id", "held_out"):
                    cols.setdefault(k, []).append(part.column(k))
                size += len(a)
                if size >= GROUP_TOKENS:
                    yield flush()
                    cols, held, size = {}, [], 0
        if held:
            yield flush()

    scored = stored(slim.select("doc_id", "held_out", F.col("text").cast("binary").alias("text"))
                    .mapInArrow(run, SCORED), "lm-scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("a", "b", "n")).alias("w")).select(
        "rid", F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.n").alias("tf"))
    c = F.coalesce(F.col("n"), F.lit(0))
    found = rare.join(counts, ["a", "b"], "left").groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(c + 1)).alias("rare_log"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"))
    out = scored.drop("a", "b", "n").join(found, "rid", "left").fillna(0, ["rare_log", "rare_known"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("rare_log") - F.col("n_tokens") * float(base_floor)).alias("base_score"),
        (F.col("model_log") + F.col("outside_log") + F.col("rare_log")
         - F.col("n_outside") * float(out_floor)).alias("score"))
