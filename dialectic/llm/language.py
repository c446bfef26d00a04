"""Language of documents by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialectic.llm.frames import free_name, slices, texts

#: Bounds of the training sample: labelled documents of a language (by hash of
#: their text), and characters of each (one stretch, placed by hash).
FIT_DOCS, FIT_CHARS = 200, 3000
#: Training sequences: their number, words, and words of a stretch in one language.
SEQUENCES, WORDS, STRETCH = 1200, 48, (4, 32)
EPOCHS, RATE, DECAY, SEED = 40, 0.25, 1e-4, 3
#: Words of a block in forward-backward.
BLOCK = 32
#: A text without letters has this language.
NONE = "und"
_LETTER = regex.compile(r"\p{L}")
_SIZES = (1 << 16, 1 << 17, 1 << 17, 1 << 17)  # pairs, triples and quadruples of bytes; whole words
_OFFSETS = np.concatenate(([0], np.cumsum(_SIZES)))


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # [feature, language]
    moves: np.ndarray  # [language before, language]


class Words(NamedTuple):
    """Words of several texts: byte grams (with the word's borders as a zero
    byte, so that affixes are grams) and a hash of the whole word."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    grams: tuple[np.ndarray, ...]
    gram_start: np.ndarray
    whole: np.ndarray


def words_of(docs: list[str]) -> Words:
    """Lower-cased runs of ASCII letters and non-ASCII characters."""
    raw = [t.lower().encode("utf-8", "replace") for t in docs]
    data = np.frombuffer(b"\n\n\n" + b"\n".join(raw) + b"\n", np.uint8)
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    b = np.where(letter, data, 0).astype(np.uint32)
    edge = np.diff(letter.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    held = letter.copy()
    held[end] = True  # the border after a word closes its last grams
    gram = np.zeros_like(b)
    gram[1:] = (b[:-1] << np.uint32(8)) | b[1:]
    two = gram[held]
    gram[2:] |= np.where(b[1:-1] > 0, b[:-2], 0) << np.uint32(16)
    three = gram[held]
    gram[3:] |= np.where((b[1:-2] > 0) & (b[2:-1] > 0), b[:-3], 0) << np.uint32(24)
    four = gram[held]
    before = np.cumsum(held)
    gram_start = before[start] - 1
    mixed = (four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint32(13)), gram_start, dtype=np.uint32) if len(start) else mixed[:0]
    grams = (two.astype(np.int64), _OFFSETS[1] + _spread(three), _OFFSETS[2] + _spread(four))
    ends = np.cumsum([len(x) + 1 for x in raw]) + 3
    return Words(np.searchsorted(ends, start, side="right"), start, end, grams, gram_start, _OFFSETS[3] + _spread(whole))


def _spread(x: np.ndarray) -> np.ndarray:
    """17 bits of a 32-bit number."""
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(15)).astype(np.int64)


def emissions(w: Words, weights: np.ndarray) -> np.ndarray:
    """[word, language] scores: mean weight of the word's grams plus its own."""
    if not len(w.start):
        return np.zeros((0, weights.shape[1]))
    n = np.diff(np.append(w.gram_start, len(w.grams[0])))
    out = np.empty((len(w.start), weights.shape[1]))
    for j in range(weights.shape[1]):
        own = np.ascontiguousarray(weights[:, j])
        total = own[w.grams[0]] + own[w.grams[1]]
        total += own[w.grams[2]]
        out[:, j] = np.add.reduceat(total, w.gram_start) / n + own[w.whole]
    return out


def marginals(scores: np.ndarray, doc: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """[word, language] probabilities by forward-backward over each document.

    Blocks of BLOCK words run side by side: first each block's transfer matrix,
    then the messages between the blocks of a document, then the messages
    inside all blocks. The result is the same as word by word.
    """
    n, k = scores.shape
    if not n:
        return scores
    e, m = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30, np.exp(moves - moves.max())
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(first, n))
    blocks = -(-size // BLOCK)
    head = np.cumsum(blocks) - blocks  # first block of each document
    rank = np.arange(n) - np.repeat(first, size)
    block = np.repeat(head, size) + rank // BLOCK
    nb = int(blocks.sum())
    # Blocks in order of falling length: those that have a word t come first.
    length = np.bincount(block, minlength=nb)
    by_length = np.argsort(-length, kind="stable")
    place = np.empty(nb, np.int64)
    place[by_length] = np.arange(nb)
    have = [int(x) for x in nb - np.searchsorted(np.sort(length), np.arange(BLOCK), side="right")]
    row, col = place[block], rank % BLOCK
    held = np.zeros((BLOCK, k, nb))
    held[col, :, row] = e
    opens = np.zeros(nb, bool)
    opens[place[head]] = True
    p = np.where(opens, 1.0 / k, m.T[:, :, None]) * held[0][:, None, :]  # [to, from, block]
    for t in range(1, BLOCK):
        h = have[t]
        if h:
            step = (m.T @ np.ascontiguousarray(p[:, :, :h]).reshape(k, -1)).reshape(k, k, h)
            p[:, :, :h] = step * held[t][:, None, :h]
    p /= p.max(axis=(0, 1))
    into, out = np.full((k, nb), 1.0 / k), np.ones((k, nb))
    for r in range(1, int(blocks.max())):
        at = head[blocks > r] + r
        v = np.einsum("jib,ib->jb", p[:, :, place[at - 1]], into[:, place[at - 1]])
        into[:, place[at]] = v / v.sum(axis=0)
    for r in range(int(blocks.max()) - 1, 0, -1):
        at = head[blocks > r] + r
        v = np.einsum("jib,jb->ib", p[:, :, place[at]], out[:, place[at]])
        out[:, place[at - 1]] = v / v.sum(axis=0)
    ahead = np.zeros((BLOCK, k, nb))
    a = into
    for t in range(BLOCK):
        h = have[t]
        step = m.T @ a[:, :h]
        if t == 0:
            step = np.where(opens, 1.0 / k, step)
        step *= held[t][:, :h]
        a = step / step.sum(axis=0)
        ahead[t, :, :h] = a
    z = out
    for t in range(BLOCK - 1, -1, -1):
        h = have[t]
        ahead[t, :, :h] *= z[:, :h]
        step = m @ (held[t][:, :h] * z[:, :h])
        z[:, :h] = step / step.sum(axis=0)
    g = ahead[col, :, row]
    return g / g.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, str]]) -> Model:
    """Fit on (language, text) pairs. Their words are strung into sequences that
    change language, so that the moves between languages are learned too;
    gradients come from the chain's forward-backward probabilities."""
    langs = sorted({lang for lang, _ in samples})
    k = len(langs)
    if not k:
        return Model([], np.zeros((int(_OFFSETS[-1]), 1), np.float32), np.zeros((1, 1)))
    rng = np.random.default_rng(SEED)
    w = words_of([t for _, t in samples])
    lang_of = np.array([langs.index(lang) for lang, _ in samples])[w.doc] if len(w.doc) else np.zeros(0, np.int64)
    pools = [np.flatnonzero(lang_of == i) for i in range(k)]
    have = [i for i in range(k) if len(pools[i])]
    weights, moves = np.zeros((int(_OFFSETS[-1]), k), np.float32), np.zeros((k, k))
    if not have:
        return Model(langs, weights, moves)
    pick = np.zeros((SEQUENCES, WORDS), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < WORDS:
            pool = pools[have[rng.integers(len(have))]]
            n = min(WORDS - at, int(rng.integers(*STRETCH)))
            begin = int(rng.integers(len(pool)))
            pick[s, at:at + n] = pool[(begin + np.arange(n)) % len(pool)]
            at += n
    used, place = np.unique(pick.ravel(), return_inverse=True)
    label = lang_of[pick.ravel()]
    gold = np.zeros((len(label), k))
    gold[np.arange(len(label)), label] = 1
    seq = np.repeat(np.arange(SEQUENCES), WORDS)
    n_grams = np.diff(np.append(w.gram_start, len(w.grams[0])))
    grams = [np.arange(a, a + n) for a, n in zip(w.gram_start[used], n_grams[used])]
    gram_word = np.repeat(np.arange(len(used)), n_grams[used])
    gram_at = np.concatenate(grams)
    feature = np.concatenate([g[gram_at] for g in w.grams] + [w.whole[used]])
    owner = np.concatenate([gram_word] * 3 + [np.arange(len(used))])
    value = np.concatenate([(1.0 / n_grams[used])[gram_word]] * 3 + [np.ones(len(used))])
    active, feature = np.unique(feature, return_inverse=True)
    local, seen = np.zeros((len(active), k)), np.full((len(active), k), 1e-2)
    seen_moves = np.full((k, k), 1e-2)
    inner = np.arange(len(label)).reshape(SEQUENCES, WORDS)
    before, after = inner[:, :-1].ravel(), inner[:, 1:].ravel()
    counted = np.zeros((k, k))
    np.add.at(counted, (label[before], label[after]), 1)
    for _ in range(EPOCHS):
        score = np.stack([np.bincount(owner, value * local[feature, j], minlength=len(used)) for j in range(k)], 1)[place]
        p = marginals(score, seq, moves)
        # Expected moves: pairwise marginals from the word marginals' chain.
        expected = _pairs(score, moves).sum(axis=0)
        off = np.stack([np.bincount(place, (gold - p)[:, j], minlength=len(used)) for j in range(k)], 1)
        grad = np.stack([np.bincount(feature, value * off[owner, j], minlength=len(active)) for j in range(k)], 1)
        grad = grad / SEQUENCES - DECAY * local
        seen += grad ** 2
        local += RATE * 4 * grad / np.sqrt(seen)
        step = (counted - expected) / SEQUENCES - DECAY * moves
        seen_moves += step ** 2
        moves += RATE * step / np.sqrt(seen_moves)
    weights[active] = local
    return Model(langs, weights, moves)


def _pairs(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """[sequence, language, language]: expected moves of each training sequence."""
    k = score.shape[1]
    e = np.exp(score - score.max(axis=1, keepdims=True)).reshape(SEQUENCES, WORDS, k)
    m = np.exp(moves - moves.max())
    a = np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for t in range(1, WORDS):
        x = (a[:, t - 1] @ m) * e[:, t]
        a[:, t] = x / x.sum(axis=1, keepdims=True)
    z, total = np.ones((SEQUENCES, k)), np.zeros((SEQUENCES, k, k))
    for t in range(WORDS - 1, 0, -1):
        right = e[:, t] * z
        pair = a[:, t - 1][:, :, None] * m[None] * right[:, None, :]
        total += pair / pair.sum(axis=(1, 2), keepdims=True)
        z = right @ m.T
        z /= z.sum(axis=1, keepdims=True)
    return total


def predict(docs: list[str], model: Model) -> list[tuple[str, float]]:
    """(language, score) per text: the language with the highest mean
    probability over the words, and that mean. No letter: ``und``, 0."""
    has = np.array([bool(_LETTER.search(t)) for t in docs])
    w = words_of(docs)
    if not model.langs:
        return [(NONE, 0.0)] * len(docs)
    p = marginals(emissions(w, model.weights), w.doc, model.moves)
    n = np.bincount(w.doc, minlength=len(docs))
    mean = np.stack([np.bincount(w.doc, p[:, j], minlength=len(docs)) for j in range(len(model.langs))], 1)
    mean = mean / np.maximum(n, 1)[:, None]
    best = mean.argmax(axis=1)
    return [(model.langs[b], min(1.0, float(mean[i, b]))) if has[i] else (NONE, 0.0) for i, b in enumerate(best)]


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, probability) for each word of one text."""
    w = words_of([text])
    p = marginals(emissions(w, model.weights), w.doc, model.moves)
    raw = b"\n\n\n" + text.lower().encode("utf-8", "replace")
    return [(raw[a:b].decode("utf-8", "replace"), model.langs[j], float(p[i, j]))
            for i, (a, b, j) in enumerate(zip(w.start, w.end, p.argmax(axis=1)))]


def training_sample(labelled: DataFrame) -> DataFrame:
    """(lang, text) of at most FIT_DOCS different texts of each language, by
    hash of the text, and of each one stretch of FIT_CHARS characters placed by
    hash. Only hashes are made distinct, and ranked in parts that follow the
    tasks, then in fewer, then as one; texts are then picked by hash, one of
    each group of copies, so no task gets a language or a group of copies whole."""
    size = F.char_length("text")
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(size - FIT_CHARS + 1, F.lit(1)))
    slim = labelled.filter("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    first = slim.select("lang", "h").distinct().withColumn("part", F.spark_partition_id())
    for parts in (4096, 64, 1):
        first = first.withColumn("part", F.pmod("part", F.lit(parts)))
        order = Window.partitionBy("lang", "part").orderBy("h")
        first = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIT_DOCS)
    return (slim.join(F.broadcast(first.select("lang", "h")), ["lang", "h"])
            .select("lang", "h", F.substr("text", (place + 1).cast("int"), F.lit(FIT_CHARS)).alias("text"))
            .groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text"))


def added_names(columns: list[str]) -> tuple[str, str]:
    """The names of the columns that ``identify`` adds to ``columns``."""
    return free_name(columns, "_lang"), free_name(columns, "_score")


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``_lang`` and ``_score`` (``added_names`` gives
    their names where ``docs`` has such columns); learned from ``labelled``
    (text, lang), predicted from text alone.

    Whole texts are scored. Null text or one without a letter: ``und``, 0, as is
    everything if nothing is labelled. Repeated rows get equal results.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        train([(r["lang"], r["text"]) for r in training_sample(labelled).toLocalIterator()]))
    lang, score = added_names(docs.columns)
    out = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = predict(texts(part), model.value)
                cols = {n: part.column(n) for n in part.schema.names}
                cols[lang] = pa.array([a for a, _ in found], part.schema.field(lang).type)
                cols[score] = pa.array([b for _, b in found], pa.float64())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return out.mapInArrow(run, out.schema)


def known(lang: Column) -> Column:
    """Whether a prediction names a language."""
    return lang != NONE
