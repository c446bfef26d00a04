"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Every token's bytes become one piece in an alphabet of 256 printable letters,
scored by its negative rank, so that the library's best-scored merge is the
merge of lowest rank. Texts are cut by the file's pattern, each match is
encoded for itself, and ids are decoded by the inverse alphabet.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dialectic.llm.frames import slices, texts
from dialectic.llm.wordids import _byte_letters

#: The memo of matches starts anew beyond so many characters.
MEMO_CHARACTERS = 8_000_000
# Scores are 32-bit floats: larger ranks would no longer be told apart.
MOST_RANKS = 1 << 24

# --- fixed values: field numbers and enum values of the model file format
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
UNKNOWN_TYPE = 2
MODEL_TYPE, BPE = 3, 2
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5
# ---------------------------------------------------------------------------
#: A model needs a piece for the unknown; no letter of the alphabet is in it.
UNKNOWN = "⁇"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one ``base64 rank`` line per token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path}: no token for the single bytes {missing}")
    if len(set(ranks.values())) != len(ranks) or max(ranks.values()) >= MOST_RANKS:
        raise ValueError(f"{path}: ranks must differ and stay under {MOST_RANKS}")
    return ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_file(tokens: list[tuple[str, int]]) -> bytes:
    """A sentencepiece BPE model of the pieces ``(letters, rank)``: piece 0 is
    the unknown one, piece ``i + 1`` the i-th; the text is taken as it is."""
    out = [_block(PIECES, _block(PIECE, UNKNOWN.encode()) + _number(TYPE, UNKNOWN_TYPE))]
    out += [_block(PIECES, _block(PIECE, letters.encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", -rank))
            for letters, rank in tokens]
    out.append(_block(TRAINER, _number(MODEL_TYPE, BPE)))
    out.append(_block(NORMALIZER, _block(NAME, b"identity") + _number(ADD_DUMMY_PREFIX, 0)
                      + _number(REMOVE_EXTRA_WHITESPACES, 0) + _number(ESCAPE_WHITESPACES, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = read_ranks(path)
        alphabet = _byte_letters()
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self._model = sentencepiece.SentencePieceProcessor(
            model_proto=model_file([("".join([alphabet[b] for b in token]), rank) for token, rank in by_rank]))
        self._rank_of_piece = np.array([-1] + [rank for _, rank in by_rank], "<i4")
        self._letter_of_byte = {b: letter for b, letter in enumerate(alphabet)}  # for latin-1 text
        byte_of_letter = {letter: b for b, letter in enumerate(alphabet)}
        self._bytes_of_rank = {int(rank): bytes([byte_of_letter[c] for c in self._model.id_to_piece(i)])
                               for i, rank in enumerate(self._rank_of_piece) if i}
        self._pattern = regex.compile(pattern)
        self._memo: dict[str, bytes] = {}
        self._memo_size = 0

    def _matches(self, text: str) -> list[str]:
        if self._pattern.groups:
            return [m.group() for m in self._pattern.finditer(text)]
        return self._pattern.findall(text)

    def _learn(self, new: list[str]) -> None:
        data = [x.encode() for x in new]
        merge = [(x, b) for x, b in zip(new, data) if b not in self.ranks]
        # A match that is a token is that token, whatever the merges would give.
        self._memo.update((x, struct.pack("<I", self.ranks[b])) for x, b in zip(new, data) if b in self.ranks)
        pieces = self._model.encode([b.decode("latin-1").translate(self._letter_of_byte) for _, b in merge],
                                    num_threads=1) if merge else []
        for (x, _), ids in zip(merge, pieces):
            self._memo[x] = self._rank_of_piece[ids].tobytes()
        self._memo_size += sum(map(len, new))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self._matches(t) for t in texts]
        if self._memo_size > MEMO_CHARACTERS:
            self._memo, self._memo_size = {}, 0
        new = list(set().union(*cut).difference(self._memo))
        if new:
            self._learn(new)
        memo = self._memo
        return [b"".join([memo[x] for x in c]) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind ids that are laid out as ``encode`` does; a number
        that is no id raises ``KeyError``."""
        of = self._bytes_of_rank
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The ``ByteBpe`` of a file, kept between the tasks of a reused worker."""
    kept = sys.modules.setdefault("_dialectic_worker", types.ModuleType("_dialectic_worker")).__dict__
    key = ("byte_bpe", path, pattern)
    if key not in kept:
        kept[key] = ByteBpe(path, pattern)
    return kept[key]


def _by_slices(df: DataFrame, column: str, schema: T.StructType,
               columns: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(part)], names=schema.names)

    return df.select("doc_id", column).mapInArrow(run, schema)


def _schema(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *fields])


def encode_texts(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids`` (``array<int>``) of every row's whole ``text``, in one map
    pass. Null and empty texts have no ids; equal rows and equal or null ids of
    documents stay rows of their own; other columns are not touched."""
    def columns(part: pa.RecordBatch) -> list[pa.Array]:
        ids = byte_bpe(path, pattern).encode(texts(part))
        ends = np.cumsum([0] + [len(x) // 4 for x in ids])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))]

    return _by_slices(docs, "text", _schema(docs, T.StructField("ids", T.ArrayType(T.IntegerType()))), columns)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, data`` (bytes) of every row's ``ids``; null ids give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, public_tokenizers.PATTERN)
        for batch in batches:
            data = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())],
                                             names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(
        run, _schema(encoded, T.StructField("data", T.BinaryType())))


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: its text
    encoded and its ids decoded in one pass, without arrays leaving the worker.
    Rows, nulls and empty texts as in ``encode_texts``."""
    def columns(part: pa.RecordBatch) -> list[pa.Array]:
        codec = byte_bpe(path, pattern)
        ids = codec.encode(texts(part))
        return [pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])]

    return _by_slices(docs, "text", _schema(
        docs, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())), columns)
