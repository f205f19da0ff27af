"""Texts as token arrays: whole Arrow batches are read by array operations, without Python code per word.

Numbers count as one sign, letters as lower case. A token is a word, an ideograph or a stop (the end of a sentence or
line); commas, colons, brackets and blanks only part words. Words and contexts are told apart by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD, SPACE, SOFT, STOP, HAN, END = range(6)
#: Stops, and signs that only part words.
STOPS, SOFTS, BRACKETS = ".!?。！？؟।\n", ",，;；:：、", "{}[]"
#: Signs handled at once.
SLICE = 1_500_000
_A = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    t = np.zeros(0x10000, np.uint8)
    t[0x2E80:0xA000] = HAN
    t[0xAC00:0xD7A4] = HAN
    for i in range(0x10000):
        if chr(i).isspace():
            t[i] = SPACE
    for signs, k in ((STOPS, STOP), (SOFTS, SOFT), (BRACKETS, SPACE), ("\0", END)):
        for s in signs:
            t[ord(s)] = k
    return t


_CLASS = _classes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.cumprod(np.full(256, np.uint64(0xD6E8FEB86659FD93)))]


def _powers(n: int) -> np.ndarray:
    if n > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(2 * n, np.uint64(0xD6E8FEB86659FD93)))
    return _POWERS[0]


#: Base of the hashes of beginnings, and what undoes it.
_BASE, _UNDO = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n."""
    if base not in _TABLES or len(_TABLES[base]) <= n:
        _TABLES[base] = np.cumprod(np.append(np.uint64(1), np.full(max(2 * n, SLICE), np.uint64(base))))
    return _TABLES[base]


class Beginnings:
    """Hashes of the first signs of any stretch of a text, of any length, in constant time each."""

    def __init__(self, c: np.ndarray):
        value = mix(c.astype(np.uint64) + _A)
        self.total = np.append(np.uint64(0), np.cumsum(value * _table(_BASE, len(c))[: len(c)]))
        self.undo = _table(_UNDO, len(c))

    def of(self, first: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return (self.total[first + size] - self.total[first]) * self.undo[first]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE signs each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def unquoted(text: str) -> str:
    """A text that holds a structure with its quoted texts on lines of their own."""
    if "{" not in text and text[:1] not in '["`':
        return text
    return text.replace('\\"', "'").replace("\\n", "\n").replace('"', "\n")


class Reader:
    """The tokens of texts (no nulls)."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts) + "\0"
        if joined.count("\0") != len(texts):
            joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
        c = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
        digit = (c >= 48) & (c <= 57)
        between = (c == 46) | (c == 44) | (c == 58)
        between[1:-1] &= digit[:-2] & digit[2:]
        between[[0, -1] if len(c) else []] = False
        run = digit | between
        first = run.copy()
        first[1:] &= ~run[:-1]
        self.c = np.where(first, np.uint32(57), c)[~run | first]
        self.k = k = _CLASS[np.minimum(self.c, 0xFFFF)]
        self.n = len(texts)
        word = k == WORD
        start = word.copy()
        start[1:] &= ~word[:-1]
        token = start | (k >= STOP)
        self.at = np.flatnonzero(token)
        self.kind = k[self.at]
        self.stop = (self.kind == STOP) | (self.kind == END)
        self.text = np.cumsum(self.kind == END) - (self.kind == END)
        signs = np.flatnonzero(word | (k == HAN))
        begins = np.flatnonzero(token[signs])
        self.hash = np.zeros(len(self.at), np.uint64)
        if len(begins):
            self.hash[~self.stop] = self._hashes(signs, begins)
        self.ends = np.flatnonzero(k == END)

    def _hashes(self, signs: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Hashes of runs of signs, that begin at these places of ``signs``."""
        size = np.diff(np.append(begins, len(signs)))
        offset = np.arange(len(signs)) - np.repeat(begins, size)
        value = mix(self.c[signs].astype(np.uint64) + _A) * _powers(int(size.max()))[offset]
        return mix(np.add.reduceat(value, begins))

    def contexts(self) -> np.ndarray:
        """Of each token the hash of its context: with the word before, or the three ideographs before, of its sentence."""
        out, alive = mix(self.hash), ~self.stop
        han = self.kind == HAN
        for j in (1, 2, 3):
            alive = alive.copy()
            alive[:j] = False
            alive[j:] &= ~self.stop[:-j]
            before = np.zeros_like(self.hash)
            before[j:] = self.hash[:-j]
            out = np.where(alive & (han | (j == 1)), mix(out * _A + before), out)
        return out

    def next_kind(self) -> np.ndarray:
        return np.append(self.kind[1:], END)

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the stretches of signs [first, last); 0 for empty ones."""
        size = np.maximum(last - first, 0)
        out = np.zeros(len(first), np.uint64)
        some = np.flatnonzero(size)
        if len(some):
            begins = np.cumsum(size[some]) - size[some]
            signs = np.repeat(first[some] - begins, size[some]) + np.arange(size.sum())
            out[some] = self._hashes(signs, begins)
        return out

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, first and last sign (exclusive) of every sentence or line, without blanks around."""
        c, k = self.c, self.k
        if not len(c):
            return (np.zeros(0, np.int64),) * 3
        blank = (k == SPACE) | (c == 10)
        wide = (c == 0x3002) | (c == 0xFF01) | (c == 0xFF1F)
        cut = np.zeros(len(c), bool)  # a sentence may begin here
        cut[0] = True
        before = c[:-1]
        cut[1:] = (before == 10) | (before == 0) | wide[:-1] | (blank[1:] & ((before == 46) | (before == 33) | (before == 63)))
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(c))
        solid = np.flatnonzero(~blank & (k != END))
        lo, hi = np.searchsorted(solid, first), np.searchsorted(solid, last)
        some = hi > lo
        first, last = solid[lo[some]], solid[hi[some] - 1] + 1
        return np.searchsorted(self.ends, first), first, last

    def string(self, first: int, last: int) -> str:
        return self.c[first:last].tobytes().decode("utf-32-le", "surrogatepass")
