"""Token ids of many texts at once through a tokenizer file.

The files' merges work inside single words. Texts are cut into words with
array operations over code points, each different word goes through the
tokenizers library once, and its ids are kept in a bounded memo. Texts
with characters outside the plain tables below go through the library whole.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from dialectic.llm.frames import ragged

LETTER, NUMBER, SPACE, OTHER, BEYOND = range(5)
#: Code points above this one are left to the library.
TOP = 0x2060
#: The memo starts anew beyond so many words or ids.
MEMO_WORDS, MEMO_IDS = 600_000, 6_000_000

# --- fixed values: contractions that are words of their own
SHORT, LONG = "stmd", ("re", "ve", "ll")
# --- fixed values: the two word layouts that are cut here
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# ---------------------------------------------------------------------------


def _class(cp: int) -> int:
    """Class of a code point; everything that normalisation, case or different
    Unicode versions could touch is BEYOND."""
    c = chr(cp)
    kind = unicodedata.category(c)
    if cp in (9, 10, 13, 32, 0xA0):
        return SPACE
    if 0x250 <= cp < 0x2010 or kind[0] in "CZ" or kind[0] == "M" or len(c.lower()) != 1:
        return BEYOND
    return LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER


def _any_class(cp: int) -> int:
    """Class of any code point, for terms: ideographs and kana, written without
    blanks, are words of their own as digits are."""
    if cp < TOP and CLASS[cp] != BEYOND:
        return int(CLASS[cp])
    if 0x3040 <= cp < 0x3100 or 0x3400 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00 or 0x20000 <= cp < 0x40000:
        return NUMBER
    return {"L": LETTER, "M": LETTER, "N": NUMBER, "C": SPACE, "Z": SPACE}.get(unicodedata.category(chr(cp))[0], OTHER)


CLASS = np.array([_class(i) for i in range(TOP)] + [BEYOND], np.uint8)
LOWER = np.array([ord(chr(i).lower()) if CLASS[i] != BEYOND else i for i in range(TOP)] + [TOP], np.uint32)
_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 2 ** 64 - 1, (2, TOP + 1), np.uint64, endpoint=True)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Two 64-bit hashes of any segments of a code point array: sums of a random
    number per code point times a random number per place. (The places' numbers
    are no powers of a base: modulo 2^64 these give different words that follow a
    pattern, such as the Thue-Morse word and its complement, one hash in any base.)"""

    def __init__(self) -> None:
        self._places = np.zeros((2, 0), np.uint64)

    def __call__(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        longest = int(lengths.max(initial=0))
        if longest > self._places.shape[1]:
            n = max(1024, 1 << longest.bit_length())
            # The same generators give the same first numbers at every length.
            self._places = np.array([np.random.default_rng([20240301, j]).integers(0, 2 ** 64 - 1, n, np.uint64, endpoint=True)
                                     | np.uint64(1) for j in range(2)])
        filled = np.flatnonzero(lengths)
        first = (np.cumsum(lengths) - lengths)
        chars = cps[ragged(starts, lengths)]
        place = np.arange(len(chars)) - np.repeat(first, lengths)
        out = []
        for codes, places in zip(_CODES, self._places):
            total = np.zeros(len(lengths), np.uint64)
            if len(filled):
                total[filled] = np.add.reduceat(codes[chars] * places[place], first[filled])
            out.append(total)
        return out[0], out[1]


class Memo:
    """Open-addressing table from two hashes to a number from 0 on."""

    def __init__(self, bits: int = 16) -> None:
        self._make(bits)
        self.n = 0

    def _make(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.a, self.b = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)

    def _slot(self, a: np.ndarray) -> np.ndarray:
        x = a ^ (a >> np.uint64(31))
        return ((x * _MIX) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers, -1 where unknown."""
        at = self._slot(a)
        out = self.value[at]
        todo = np.flatnonzero((out >= 0) & ((self.a[at] != a) | (self.b[at] != b)))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            p = at[todo]
            out[todo] = self.value[p]
            todo = todo[(out[todo] >= 0) & ((self.a[p] != a[todo]) | (self.b[p] != b[todo]))]
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Number new, different pairs in their order."""
        if 2 * (self.n + len(a)) > self.mask:
            held = np.flatnonzero(self.value >= 0)
            old = self.a[held], self.b[held], self.value[held]
            self._make(max(16, int(np.ceil(np.log2(3 * (self.n + len(a)))))))
            self._put(*old)
        self._put(a, b, np.arange(self.n, self.n + len(a), dtype=np.int32))
        self.n += len(a)

    def _put(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        at, todo = self._slot(a), np.arange(len(a))
        while len(todo):
            p = at[todo]
            free = todo[self.value[p] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.a[at[won]], self.b[at[won]], self.value[at[won]] = a[won], b[won], value[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + n))
        n += b not in own
    return out


class WordIds:
    """Ids of texts for one tokenizer file; special tokens are plain text."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or [pre]
        normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.style = None
        if spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" \
                and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.style = "spaced"
        elif spec["model"]["type"] == "BPE" and normal == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 \
                and parts[0].get("pattern", {}).get("Regex") == WORD_PATTERN and parts[1].get("type") == "ByteLevel":
            self.style = "lower"
        self._letters = _byte_letters()
        self._hashes = Hashes()
        self._clear()

    def _clear(self) -> None:
        self.memo = Memo()
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _word(self, word: str) -> list[int]:
        letters = self._letters
        return [t.id for t in self.library.model.tokenize("".join([letters[b] for b in word.encode()]))]

    def _learn(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        new = [self._word(w) for w in words]
        lengths = np.array([len(x) for x in new], np.int64)
        n, total = self.memo.n, int(lengths.sum())
        while n + len(new) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + total] = [i for x in new for i in x]
        self.start[n:n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + len(new)] = lengths
        self.used += total
        self.memo.add(a, b)

    def words(self, cps: np.ndarray, first: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the words of texts laid end to end; ``first`` are
        the places where non-empty texts begin, ``kind`` the classes if any code
        point is beyond the plain table."""
        n = len(cps)
        kind = CLASS[cps] if kind is None else kind
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        new = begins.copy()
        new[1:n] |= kind[1:] != kind[:-1]
        if self.style == "spaced":
            at = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~begins[1:n]) + 1
            new[at - 1] = True  # the last white space leaves its run: a blank joins the word, others stand alone
            new[at] = cps[at - 1] != 32
        else:
            new[:n] |= kind == NUMBER
        q = np.flatnonzero((cps == 39) & new[:n])
        q = q[(q + 1 < n)]
        q = q[(kind[np.minimum(q + 1, n - 1)] == LETTER) & ~begins[q + 1]]
        if len(q):
            one = np.isin(cps[q + 1], [ord(c) for c in SHORT])
            after = np.minimum(q + 2, n - 1)
            more = (q + 2 < n) & ~begins[q + 2]
            two = more & np.logical_or.reduce([(cps[q + 1] == ord(x)) & (cps[after] == ord(y)) for x, y in LONG])
            end = np.where(one, q + 2, q + 3)[one | two]
            new[q[one | two] + 1] = False
            inside = end[(end < n)]
            inside = inside[(kind[inside] == LETTER) & ~begins[inside]]
            new[inside] = True
        starts = np.flatnonzero(new[:n])
        ends = np.append(starts[1:], n)
        if self.style == "lower":
            keep = kind[starts] != SPACE
            return starts[keep], ends[keep]
        return starts, ends

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text its ids (uint32) and its words' 64-bit hashes (uint64)."""
        ids: list = [None] * len(texts)
        terms: list = [None] * len(texts)
        fast = []
        if self.style:
            joined = "".join(texts)
            cps = np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), TOP)
            ends = np.cumsum([len(t) for t in texts])
            odd = np.unique(np.searchsorted(ends, np.flatnonzero(CLASS[cps] == BEYOND), side="right"))
            fast = np.setdiff1d(np.arange(len(texts)), odd)
        slow = sorted(set(range(len(texts))).difference(map(int, fast)))
        for i in slow:
            ids[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            terms[i] = self._terms(texts[i])
        if len(fast):
            if slow:
                joined = "".join([texts[i] for i in fast])
                cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            for i, x, y in zip(fast, *self._encode_plain([len(texts[i]) for i in fast], joined, cps)):
                ids[i], terms[i] = x, y
        return ids, terms

    def _terms(self, text: str) -> np.ndarray:
        """The words' hashes of a text with characters beyond the plain table.
        Plain words have the hashes they have in plain texts."""
        cps = np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "replace"), np.uint32)
        if not len(cps):
            return np.zeros(0, np.uint64)
        met, place = np.unique(cps, return_inverse=True)
        if self.style != "spaced":
            met = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in met.tolist()], np.uint32)
        kind = np.array([_any_class(c) for c in met.tolist()], np.uint8)[place]
        cps = met[place]
        starts, ends = self.words(cps, np.zeros(1, np.int64), kind)
        out = self._hashes(np.minimum(cps, TOP), starts, ends)[0]
        far = np.flatnonzero(cps >= TOP)
        of = np.searchsorted(starts, far, side="right") - 1
        inside = of >= 0
        far, of = far[inside], of[inside]
        inside = far < ends[of]
        far, of = far[inside], of[inside]
        np.add.at(out, of, cps[far].astype(np.uint64) * _MIX * (2 * (far - starts[of]) + 1).astype(np.uint64))
        return out

    def _encode_plain(self, sizes: list[int], joined: str, cps: np.ndarray):
        size = np.array(sizes, np.int64)
        first = np.cumsum(size) - size
        if not len(cps):
            return [np.zeros(0, np.uint32)] * len(sizes), [np.zeros(0, np.uint64)] * len(sizes)
        if self.style == "lower":
            cps = LOWER[cps]
        starts, ends = self.words(cps, first[size > 0])
        a, b = self._hashes(cps, starts, ends)
        if self.memo.n > MEMO_WORDS or self.used > MEMO_IDS:
            self._clear()
        found = self.memo.find(a, b)
        while (found < 0).any():
            missing = np.flatnonzero(found < 0)
            _, at = np.unique(a[missing], return_index=True)
            new = missing[at]
            words = [joined[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist())]
            self._learn([w.lower() for w in words] if self.style == "lower" else words, a[new], b[new])
            found[missing] = self.memo.find(a[missing], b[missing])
        lengths = self.length[found]
        flat = self.ids[ragged(self.start[found], lengths)]
        cut = np.searchsorted(starts, first[1:])
        return np.split(flat, np.concatenate(([0], np.cumsum(lengths)))[cut]), np.split(a, cut)


def word_ids(path: str) -> WordIds:
    """The ``WordIds`` of a file, kept between the tasks of a reused worker."""
    kept = sys.modules.setdefault("_dialectic_worker", types.ModuleType("_dialectic_worker"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordIds(path)
    return kept.__dict__[path]
