"""Encoding of a corpus with a public byte-level BPE vocabulary by corpus-level merge replay.

A batch of texts is one array of code points. Array operations split it into words by the vocabulary's
pattern, equal words are found by two 64-bit polynomial hashes, and only words not seen before are merged:
an inverted index from token pair (by rank) to word positions applies every merge in rank order, updating
only the touched neighbours. The ids of a text are then gathered from its words.
"""
from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter of every function that reads them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points handled at once, distinct words a worker remembers before it starts anew, and bytes of new
#: words replayed at once: they bound a worker's memory and change no result.
WINDOW, REMEMBERED, REPLAYED = 1_500_000, 800_000, 1_200_000
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's classes are defined by the ``regex`` module."""
    global _CLASS
    if _CLASS is None:
        import regex

        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        every = points.astype("<u4").tobytes().decode("utf-32-le")
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start() : m.end()]] = kind
        _CLASS = table
    return _CLASS


def word_starts(c: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a word of the pattern starts; ``hard`` marks the texts' starts.

    The pattern: contractions ('s 't 're 've 'm 'll 'd), runs of letters, digits or other signs each with
    one blank before, and white space of which the last sign before a word stands apart."""
    n = len(c)
    k = _classes()[c]
    start = hard.copy()
    start[1:] |= k[1:] != k[:-1]
    run = start.copy()
    # the last white space before a word is a word of its own, or joins the next word if it is a blank
    last = np.flatnonzero((k[:-1] == SPACE) & (k[1:] != SPACE) & ~hard[1:])
    start[last] = True
    start[last[c[last] == 32] + 1] = False
    quote = np.flatnonzero((c == 39) & start & run)
    quote = quote[quote + 1 < n]
    quote = quote[(k[quote + 1] == LETTER) & ~hard[quote + 1]]
    one = c[quote + 1]
    short = quote[(one == 115) | (one == 116) | (one == 109) | (one == 100)]
    start[short + 1] = False
    start[short[short + 2 < n] + 2] = True
    pair = quote[quote + 2 < n]
    pair = pair[(k[pair + 2] == LETTER) & ~hard[pair + 2]]
    one, two = c[pair + 1], c[pair + 2]
    long = pair[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]
    start[long + 1] = False
    start[long + 2] = False
    start[long[long + 3 < n] + 3] = True
    return start


class Hasher:
    """Polynomial hashes (mod 2**64) of slices of a code point array."""

    BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
    MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

    def __init__(self) -> None:
        self.powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
        self.inverse: list[np.ndarray] = [np.ones(1, np.uint64)] * 2

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) > n:
            return
        for i, b in enumerate(self.BASES):
            p = np.full(n + 1, b, np.uint64)
            p[0] = 1
            self.powers[i] = np.cumprod(p, dtype=np.uint64)
            p[1:] = pow(b, -1, 2**64)
            self.inverse[i] = np.cumprod(p, dtype=np.uint64)

    def slices(self, c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        n = len(c)
        self._grow(n)
        out = []
        for i in range(2):
            v = c.astype(np.uint64) + np.uint64(i * 77 + 1)
            v *= np.uint64(self.MIX[i])
            v ^= v >> np.uint64(29)
            v *= self.powers[i][:n]
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(v, out=s[1:])
            h = (s[end] - s[begin]) * self.inverse[i][begin]
            h ^= h >> np.uint64(32)
            out.append(h)
        return out


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


class MergeReplay:
    """The merges of a vocabulary, replayed over many distinct words at once."""

    def __init__(self, vocabulary: bytes):
        ranks = read_ranks(vocabulary)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None:
                    b = ranks.get(token[cut:])
                    if b is not None:
                        left.append(a), right.append(b), merged.append(rank)
        key = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.array(merged, np.int64)[order], -1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it is no token."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << 20 | b, -1)
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], -1)

    def encode(self, raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, in order, and the number of ids of each; ``raw`` holds the words' bytes.

        The symbols of all words stand in one array with -1 between words. ``index`` maps the rank of a
        pair to the positions where it was seen; ranks are taken from a heap in ascending order, and a
        merge re-enters only the pairs it makes with its two neighbours."""
        n_words = len(length)
        place = np.arange(len(raw)) + np.repeat(np.arange(1, n_words + 1), length)
        n = len(raw) + n_words + 1
        symbol = np.full(n, -1, np.int32)
        symbol[place] = self.byte[raw]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        index: dict[int, list] = {}

        def enter(rank: np.ndarray, at: np.ndarray) -> None:
            ok = rank >= 0
            rank, at = rank[ok], at[ok]
            if len(rank) < 40:
                for r, p in zip(rank.tolist(), at.tolist()):
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(heap, r)
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            heads = rank[np.append(0, cut)].tolist()
            for r, group in zip(heads, np.split(at, cut)):
                if r in index:
                    index[r].extend(group.tolist())
                else:
                    index[r] = group.tolist()
                    heapq.heappush(heap, r)

        heap: list[int] = []
        enter(self.ranks(symbol[:-1], symbol[1:]), np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            p = np.unique(np.array(index.pop(rank), np.int64))
            p = p[symbol[p] >= 0]
            q = after[p]
            ok = self.ranks(symbol[p], symbol[q]) == rank
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            clash = np.flatnonzero(q[:-1] == p[1:])
            if len(clash):  # runs of overlapping pairs: the leftmost goes first
                keep = np.ones(len(p), bool)
                last = -2
                for i in clash.tolist():
                    if last != i:
                        keep[i + 1] = False
                        last = i + 1
                p, q = p[keep], q[keep]
            symbol[p] = rank
            symbol[q] = -2  # gone
            q = after[q]
            after[p] = q
            before[q] = p
            enter(self.ranks(symbol[p], symbol[q]), p)
            q = before[p]
            enter(self.ranks(symbol[q], symbol[p]), q)
        alive = symbol >= 0
        word = np.cumsum(symbol == -1) - 1
        return symbol[alive].astype(np.int32), np.bincount(word[alive], minlength=n_words).astype(np.int64)


class Encoder:
    """Encodes batches of texts; remembers the words it has merged."""

    def __init__(self, vocabulary: bytes):
        self.replay = MergeReplay(vocabulary)
        self.hasher = Hasher()
        self._forget()

    def _forget(self) -> None:
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.word = np.zeros(0, np.int64)  # of each known hash, in order of h1: its word
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.n_words = 0
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []

    def _words(self, c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of the word at each slice; new words are put down for the next replay."""
        h1, h2 = self.hasher.slices(c, begin, end)
        distinct, one, which = np.unique(h1, return_index=True, return_inverse=True)
        if (h2[one][which] != h2).any():  # two words with one first hash: tell them apart by both
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            one = order[new]
            distinct = h1[one]
        d2 = h2[one]
        at = np.searchsorted(self.h1, distinct)
        known = at < len(self.h1)
        at = np.minimum(at, max(len(self.h1) - 1, 0))
        if len(self.h1):
            known &= (self.h1[at] == distinct) & (self.h2[at] == d2)
        word = np.empty(len(distinct), np.int64)
        word[known] = self.word[at[known]] if len(self.h1) else 0
        new = np.flatnonzero(~known)
        if len(new):
            s = begin[one[new]]
            length = end[one[new]] - s
            joined = np.cumsum(length)
            self.pending.append((c[np.repeat(s - (joined - length), length) + np.arange(joined[-1])], length))
            word[new] = self.n_words + np.arange(len(new))
            self.n_words += len(new)
            h1s, h2s, ws = np.concatenate([self.h1, distinct[new]]), np.concatenate([self.h2, d2[new]]), np.concatenate([self.word, word[new]])
            order = np.argsort(h1s, kind="stable")
            self.h1, self.h2, self.word = h1s[order], h2s[order], ws[order]
        return word[which]

    def _replay(self) -> None:
        """Merge the words put down."""
        if not self.pending:
            return
        chars = np.concatenate([p[0] for p in self.pending])
        length = np.concatenate([p[1] for p in self.pending])
        self.pending = []
        size = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        edge = np.append(0, np.cumsum(length))
        upto = np.append(0, np.cumsum(size))
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        length = upto[edge[1:]] - upto[edge[:-1]]
        stops = np.cumsum(length)
        parts, sizes, a = [], [], 0
        while a < len(length):  # so many bytes of words at once
            b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + REPLAYED, side="right")))
            flat, size = self.replay.encode(raw[stops[a] - length[a] : stops[b - 1]], length[a:b])
            parts.append(flat), sizes.append(size)
            a = b
        self.flat = np.concatenate([self.flat, *parts])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.concatenate(sizes))])

    def batch(self, texts: pa.Array, only_counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts (0 for null and empty ones), and all ids in order."""
        arr = texts.cast(pa.large_string()).fill_null("")
        if arr.offset:
            arr = pa.concat_arrays([arr])
        n = len(arr)
        counts = np.zeros(n, np.int64)
        if n == 0:
            return counts, np.zeros(0, np.int32)
        if len(self.h1) > REMEMBERED:
            self._forget()
        off = np.frombuffer(arr.buffers()[1], np.int64, count=n + 1)
        data = arr.buffers()[2]
        windows: list[tuple[np.ndarray, np.ndarray]] = []  # text and word of each word start
        row = 0
        while row < n:
            # as many whole texts as fit, at least one
            stop = int(np.searchsorted(off, off[row] + WINDOW, side="right")) - 1
            stop = min(max(stop, row + 1), n)
            raw = np.frombuffer(data, np.uint8)[off[row] : off[stop]] if data is not None and off[stop] > off[row] else np.zeros(0, np.uint8)
            if not len(raw):
                row = stop
                continue
            c = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            if len(c) == len(raw):
                edge = off[row : stop + 1] - off[row]
            else:
                lead = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
                edge = lead[off[row : stop + 1] - off[row]]
            hard = np.zeros(len(c), bool)
            hard[edge[:-1][edge[:-1] < len(c)]] = True
            for a, b in self._pieces(c):
                flags = hard[a:b].copy()
                flags[0] = True
                begin = np.flatnonzero(word_starts(c[a:b], flags))
                word = self._words(c[a:b], begin, np.append(begin[1:], b - a))
                owner = np.searchsorted(edge, begin + a, side="right") - 1 + row
                windows.append((owner.astype(np.int32), word.astype(np.int32)))
            row = stop
        self._replay()
        parts: list[np.ndarray] = []
        for owner, word in windows:
            first = self.begin[word]
            size = self.begin[word + 1] - first
            counts += np.bincount(owner, weights=size, minlength=n).astype(np.int64)
            if not only_counts:
                total = np.cumsum(size)
                parts.append(self.flat[np.repeat(first - (total - size), size) + np.arange(total[-1])])
        return counts, np.concatenate(parts) if parts else np.zeros(0, np.int32)

    @staticmethod
    def _pieces(c: np.ndarray) -> Iterator[tuple[int, int]]:
        """A very long text in pieces. White space after another sign always starts a word, and what comes
        before never depends on what follows, so the cut changes no word."""
        a = 0
        while len(c) - a > 2 * WINDOW:
            step = WINDOW
            b = None
            while b is None and a + step < len(c):
                k = _classes()[c[a + step - WINDOW // 2 : a + step]] == SPACE
                cut = np.flatnonzero(k[1:] & ~k[:-1])
                b = a + step - WINDOW // 2 + 1 + int(cut[-1]) if len(cut) else None
                step += WINDOW // 2
            if b is None:
                break
            yield a, b
            a = b
        yield a, len(c)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the ids of every text, without special tokens (their strings are ordinary text).

    Null and empty texts have the empty list. Narrow: no shuffle; texts are handled whole, whatever their
    length; repeated rows come out as often as they come in; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())  # the file, under 1 MB
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for b in batches:
            counts, ids = enc.batch(b.column(1))
            offsets = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts, out=offsets[1:])
            step = max(1, int(len(counts) * 2_000_000 / max(len(ids), 1)))
            for a in range(0, len(counts), step):
                z = min(a + step, len(counts))
                part = pa.ListArray.from_arrays(pa.array((offsets[a : z + 1] - offsets[a]).astype(np.int32)), pa.array(ids[offsets[a] : offsets[z]]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), part], names=["key", "ids"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens``: as ``encode``, but only the numbers leave the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for b in batches:
            counts, _ = enc.batch(b.column(len(keep)), only_counts=True)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(counts)], names=[*keep, "n_tokens"])

    src = docs.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("__text"))
    return src.mapInArrow(run, f"{fields}, n_tokens bigint")
