"""Text garbled by a wrong character encoding: finding the spans, and restoring them where possible.

For every pair (encoding the bytes were in, encoding they were read as) the garbled sequences are computed
beforehand and found by one multi-pattern automaton: of the signs of UTF-8 read as a one-byte encoding, the pairs of
bytes of Cyrillic and Chinese encodings read as Western ones, and the sign for a lost character; and of the corpus' own words in one one-byte encoding read as another. The words are a distributed table of any size; their
garbled forms are made on the workers and joined with what the texts hold. Only matched spans are replaced.
"""
from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.session import ensure_checkpoint_dir

#: Encodings that UTF-8 is mistaken for.
WRONG = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866"]
#: Wrong encodings whose garbled pairs of signs also occur in sound text; they need company.
NEEDS_COMPANY = {"cp1251", "koi8-r", "cp866"}
LATIN_TRUE, LATIN_READ = ["cp1252", "cp1250", "iso8859-2", "mac_roman", "cp850"], ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8-r", "cp866"]
CYRILLIC_TRUE, CYRILLIC_READ = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"], ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "koi8-r", "cp866"]
#: Words learned from the corpus: those of at least MIN_DOCS texts.
MIN_DOCS = 3
#: So many garbled words, as the texts really hold, are broadcast at most; beyond, they are joined to the texts.
SHARED_FORMS = 20_000
#: Texts garbled several times are restored so often.
ROUNDS = 3
#: A garbled word counts if the sound word occurs in so many times more texts.
FREQUENCY_RATIO = 4
#: Pieces of a text that hold a sign beyond ASCII: with the signs that cling to a word, and the bare words.
_PIECE = re.compile("[A-Za-z\u0080-\u2e7f\ua000-\ufefe]+")
_CLINGING = re.compile("[’‘“”„«»…–—¡¿·]+")
LOST = "\ufffd"
_BEYOND = re.compile("[^\x00-\x7f]+")


def _read_as(raw: bytes, wrong: str) -> str:
    """Bytes read in the wrong encoding; bytes it leaves undefined come out as C1 controls, as browsers do."""
    try:
        return raw.decode(wrong)
    except UnicodeDecodeError:
        return "".join(_one(b, wrong) for b in raw)


def _one(b: int, wrong: str) -> str:
    try:
        return bytes([b]).decode(wrong)
    except UnicodeDecodeError:
        return chr(b)


def alphabet() -> list[str]:
    """The signs whose garbled forms are looked for, by rule: Latin and Cyrillic letters, common
    punctuation and symbols, emoji, and the characters of GB 2312."""
    points = [*range(0x80, 0x180), 0x218, 0x219, 0x21A, 0x21B, *range(0x400, 0x460), *range(0x490, 0x492), *range(0x200B, 0x2011), *range(0x2012, 0x2028), *range(0x2030, 0x203B), 0x20AC, 0x2116, 0x2122, *range(0x2190, 0x219A), 0x2212, 0x2713, 0x2714, 0xFEFF, *range(0x1F300, 0x1F650), *range(0x1F680, 0x1F6C0), *range(0x1F900, 0x1FA00), *range(0x3000, 0x3018), *range(0xFF01, 0xFF5F), 0xFFFD]
    signs = [chr(p) for p in points]
    for high in range(0xB0, 0xF8):
        for low in range(0xA1, 0xFF):
            try:
                signs.append(bytes([high, low]).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return signs


def _latin(w: str) -> bool:
    return all(ord(ch) < 0x250 for ch in w)


def _cyrillic(w: str) -> bool:
    return all(0x400 <= ord(ch) < 0x530 for ch in w)


STRONG, WEAK, WORDS = 0, 1, 2
#: A Cyrillic sign that touches a Latin letter.
_INSIDE_LATIN = re.compile("[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff\u2500-\u257f\u0080-\u00bf][A-Za-z]")
_TWICE = re.compile("[РС][Ђ-Џђ-џҐґµ]")
_FOREIGN = re.compile("[\u0370-\u03ff\u2020\u2021\u207f\u2190-\u25ff]")


def patterns(vocabulary: dict[str, int]) -> dict[str, tuple[int, str | None]]:
    """Garbled sequence -> (strength, sound text)."""
    out: dict[str, tuple[int, str | None]] = {}
    for sign in alphabet():
        raw = sign.encode("utf-8")
        for wrong in WRONG:
            g = _read_as(raw, wrong)
            spelt = len(g) > 2 and g.isalpha() and wrong in NEEDS_COMPANY
            if spelt and ord(sign) >= 0x2E80:
                continue  # spelt like a word; only sequences with other signs tell
            weak = spelt or len(g) < 3 and (wrong in NEEDS_COMPANY or (wrong == "mac_roman" and g[0] in "–—’‘") or (wrong == "cp1250" and not g[0] in "ĂÂâĐŃ"))
            old = out.get(g)
            if old is None or (old[0] == WEAK and not weak):
                out[g] = (WEAK if weak else STRONG, sign)
    out[LOST] = (STRONG, None)
    for b in [*range(0x80, 0x85), *range(0x86, 0xA0)]:  # Windows' own signs read as Latin-1
        try:
            out.setdefault(chr(b), (STRONG, bytes([b]).decode("cp1252")))
        except UnicodeDecodeError:
            out.setdefault(chr(b), (STRONG, None))
    for word, n in vocabulary.items():
        for g, home in word_forms(word, n):
            if any(vocabulary.get(x, 0) * FREQUENCY_RATIO > n for x in home):
                continue
            old = out.get(g)
            if old is None or (old[0] == WORDS and vocabulary.get(old[1], 0) < n):
                out[g] = (WORDS, word)
    return out


def word_forms(word: str, n: int) -> Iterator[tuple[str, list[str]]]:
    """The garbled forms of a word that n texts hold; each with the pieces it is made of, itself among them,
    none of which may be at home in the corpus."""
    if not word.isalpha() or _TWICE.search(word):
        return  # no word, or garbled itself
    if _latin(word):
        pairs = [(t, r) for t in LATIN_TRUE for r in LATIN_READ if t != r]
    elif _cyrillic(word):
        pairs = [(t, r) for t in CYRILLIC_TRUE for r in CYRILLIC_READ if t != r]
    else:
        return
    made = set()
    for true, read in pairs:
        try:
            g = _read_as(word.encode(true), read)
        except UnicodeEncodeError:
            continue
        if g in made or g.casefold() == word.casefold() or g.isascii() or any(ch.isspace() for ch in g):
            continue
        if len(word) < 3 and (n < 5 * MIN_DOCS or not _FOREIGN.search(g)):
            continue  # too short to tell, unless it holds a sign no Latin text has inside a word
        made.add(g)
        yield g, list({g, *(x for p in re.findall(r"[^\W\d_]+", g) for x in (p, p.casefold()) if not x.isascii())})


def byte_pairs() -> list[str]:
    """All pairs of upper bytes as they are read in a Western encoding: what a run of Cyrillic or Chinese bytes is made of."""
    signs = [_one(b, "cp1252") for b in range(0x80, 0x100)]
    signs += [chr(b) for b in range(0x80, 0xA0) if chr(b) not in signs]
    return [x + y for x in signs for y in signs]


_LETTERS = re.compile("[À-ÿ]")


def _run_text(run: str) -> str | None:
    """A run of upper Latin-1 signs as the Cyrillic or Chinese text its bytes spell, if they do."""
    if len(set(_LETTERS.findall(run))) < 3:
        return None
    raw = bytearray()
    for ch in run:
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return None
            raw.append(ord(ch))
    found = []
    if all(b >= 0xC0 or b in (0xA8, 0xB8) for b in raw):
        found.append(bytes(raw).decode("cp1251"))
    if len(raw) % 2 == 0:
        try:
            t = bytes(raw).decode("gb2312")
        except UnicodeDecodeError:
            t = ""
        if t and all("一" <= ch <= "鿿" or "　" <= ch <= "〿" or "＀" <= ch <= "￯" or ch == "·" for ch in t):
            found.append(t)
    if not found:
        return None
    # mostly lower-case Cyrillic is a better reading than Chinese spelt by the same bytes
    cyr = [t for t in found if _cyrillic(t) and sum(ch.islower() for ch in t) >= len(t) - 1]
    return (cyr or found[::-1])[0]


def _free(left: str, right: str) -> bool:
    """Whether a word may stand between these signs."""
    if left.isalnum() or right.isalnum():
        return False
    return not (ord(left) > 0x2FF and not left.isspace() and unicodedata.category(left)[0] != "P" or (ord(right) > 0x2FF and unicodedata.category(right)[0] != "P"))


class Finder:
    """The automaton and the rules of one worker; with a small vocabulary also its garbled words."""

    def __init__(self, vocabulary: dict[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.patterns = patterns(vocabulary)
        for g, (strength, sound) in self.patterns.items():
            self.automaton.add_word(g, (len(g), strength, sound, False))
        for g in byte_pairs():
            strength, sound = self.patterns.get(g, (None, None))
            self.automaton.add_word(g, (2, strength, sound, True))
        self.automaton.make_automaton()
        # but for words, all sequences are of signs beyond ASCII, so only stretches of these are searched
        self.stretches = not any(strength == WORDS for strength, _ in self.patterns.values())

    def _matches(self, text: str) -> Iterator[tuple[int, tuple]]:
        if not self.stretches:
            yield from self.automaton.iter(text)
            return
        for m in _BEYOND.finditer(text):
            at = m.start()
            for end, hit in self.automaton.iter(m.group()):
                yield at + end, hit

    def spans(self, text: str, words: dict[str, str] | None = None) -> tuple[list[tuple[int, int, str | None]], bool]:
        """Garbled spans (begin, end, sound text or None) from left to right, and whether they are a case.
        ``words``: the garbled words the text holds, with the sound ones."""
        hits = []
        n = len(text)
        free = lambda begin, end: _free(text[begin - 1] if begin else " ", text[end] if end < n else " ")
        for g, sound in (words or {}).items():
            at = -1 if g in self.patterns else text.find(g)
            while at >= 0:
                if free(at, at + len(g)):
                    hits.append((at, -len(g), WORDS, sound))
                at = text.find(g, at + 1)
        runs: list[list[int]] = []  # pairs of bytes that overlap, as runs
        for end, (length, strength, sound, pair) in self._matches(text):
            begin = end + 1 - length
            if pair:
                if runs and runs[-1][1] == end:
                    runs[-1][1] = end + 1
                else:
                    runs.append([begin, end + 1])
            if strength is None or (strength == WORDS and not free(begin, end + 1)):
                continue
            hits.append((begin, -length, strength, sound))
        for begin, end in runs:
            sound = _run_text(text[begin:end]) if end - begin >= 4 else None
            if sound is not None:
                hits.append((begin, begin - end, STRONG, sound))
        hits.sort(key=lambda h: (h[0], h[2] == WORDS, h[1]))
        out: list[tuple[int, int, str | None]] = []
        kinds: list[int] = []
        upto = 0
        for begin, minus, strength, sound in hits:
            if begin < upto:
                continue
            upto = begin - minus
            out.append((begin, upto, sound))
            kinds.append(strength)
        case = False
        points = 0.0
        keep = []
        for i, (begin, end, _) in enumerate(out):
            if kinds[i] == STRONG:
                case = True
                keep.append(i)
            elif kinds[i] == WORDS:
                points += 1.0 if end - begin >= 4 or _FOREIGN.search(text, begin, end) else 0.5
                keep.append(i)
            elif _INSIDE_LATIN.search(text, max(0, begin - 1), end + 1):
                case = True
                keep.append(i)
            elif (i and out[i - 1][1] == begin and kinds[i - 1] == WEAK) or (i + 1 < len(out) and out[i + 1][0] == end and kinds[i + 1] == WEAK):
                case = True
                keep.append(i)
        case = case or points >= 1
        return [out[i] for i in keep], case

    def replaced(self, text: str, words: dict[str, str] | None = None) -> tuple[str, int, bool]:
        """The text with its garbled spans replaced once, the number of these, and whether it is a case."""
        spans, case = self.spans(text, words)
        live = [x for x in spans if case and x[2] is not None]
        parts, at = [], 0
        for begin, end, sound in live:
            parts += [text[at:begin], sound]
            at = end
        return "".join(parts) + text[at:], len(live), case

    def restore(self, text: str, rounds: int = ROUNDS) -> tuple[str, int, bool]:
        """The text with its garbled spans replaced (again, where it was garbled twice), the number of
        spans, and whether none was lost for good."""
        count = 0
        for _ in range(rounds):
            text, n, _ = self.replaced(text)
            count += n
            if not n:
                break
        lost = text.count(LOST)
        return text, count + lost, lost == 0


_COMMON_WORDS: list[tuple[dict[str, str], object]] = []


def _words_of(common: dict[str, str]):
    """What finds the shared garbled words in a text: one automaton per worker and table."""
    import ahocorasick

    if not _COMMON_WORDS or _COMMON_WORDS[0][0] is not common:
        automaton = ahocorasick.Automaton()
        for g in common:
            automaton.add_word(g, g)
        automaton.make_automaton()
        _COMMON_WORDS[:] = [(common, automaton)]
    automaton = _COMMON_WORDS[0][1]
    # a garbled word holds no white space and a sign beyond ASCII
    return lambda text: {g: common[g] for _, g in automaton.iter(" ".join({w for w in text.split() if not w.isascii()}))}


_FINDER: list[Finder] = []


def _finder() -> Finder:
    if not _FINDER:
        _FINDER.append(Finder({}))
    return _FINDER[0]


def pieces(token: str) -> list[str]:
    """The pieces with a sign beyond ASCII of a text without white space, and the bare words in them."""
    out = []
    for p in _PIECE.findall(token):
        if p.isascii():
            continue
        out.append(p)
        words = _CLINGING.split(p)
        if len(words) > 1:
            out += [w for w in words if w and not w.isascii() and w.isalpha()]
    return out


def candidates(token: str, longest: int) -> list[str]:
    """Whatever in a text without white space may be a garbled word: its stretches of letters and signs, not
    all ASCII, between which and their neighbours a word may end; no longer than the corpus' longest word (of a word
    in a one-byte encoding the garbled form is as long as the word)."""
    out = []
    for p in _PIECE.findall(token):
        if p.isascii():
            continue
        if p.isalnum():
            if len(p) <= longest:
                out.append(p)
            continue
        ends = [j for j in range(1, len(p) + 1) if j == len(p) or _free(" ", p[j])]
        for i in range(len(p)):
            if i == 0 or _free(p[i - 1], " "):
                out += [p[i:j] for j in ends[bisect_right(ends, i) : bisect_right(ends, i + longest)] if not p[i:j].isascii()]
    return out


def held(text: str, longest: int) -> set[str]:
    return {c for t in set(text.split()) if not t.isascii() for c in candidates(t, longest)}


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n``: words and pieces with a sign beyond ASCII and the number of texts each occurs in, over all
    texts; those in at least MIN_DOCS texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens: Counter = Counter()
            for t in b.column(0).to_pylist():
                tokens.update({w for w in t.split() if not w.isascii()})
            words: Counter = Counter()
            for t, n in tokens.items():
                for p in set(pieces(t)):
                    words[p] += n
            yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    counted = texts.select("text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)


def garbled_words(texts: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """``garbled, sound``: of the garbled forms of all counted words those that the texts hold and that are not
    made of pieces at home in the corpus, each with the most frequent word it may stand for."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = {w for t in b.column(0).to_pylist() for w in t.split() if not w.isascii()}
            yield pa.RecordBatch.from_arrays([pa.array({c for t in tokens for c in candidates(t, longest)}, pa.string())], names=["garbled"])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(g, w, n, home) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g, home in word_forms(w, n)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())))], names=["garbled", "sound", "n", "home"])

    made = counts.select("word", "n").mapInArrow(forms, "garbled string, sound string, n bigint, home array<string>")
    met = made.join(texts.select("text").mapInArrow(hold, "garbled string").distinct(), "garbled")
    at_home = counts.select("word", F.col("n").alias("n_home"))
    known = met.select("garbled", "sound", "n", F.explode("home").alias("word")).join(at_home, "word", "left")
    known = known.groupBy("garbled", "sound", "n").agg(F.coalesce(F.max("n_home"), F.lit(0)).alias("n_home")).where(F.col("n_home") * FREQUENCY_RATIO <= F.col("n"))
    return known.groupBy("garbled").agg(F.min_by("sound", F.struct(-F.col("n"), "sound")).alias("sound"))


def _with_words(texts: DataFrame, counts: DataFrame, longest: int) -> tuple[DataFrame, Broadcast]:
    """``key, text, n_spans, words``, the garbled words each text holds; or, where there are few in all, null
    for ``words`` and all of them as a broadcast."""
    found = garbled_words(texts, counts, longest).checkpoint()
    few = found.limit(SHARED_FORMS + 1).collect()
    share = texts.sparkSession.sparkContext.broadcast
    if len(few) <= SHARED_FORMS:
        return texts.select("key", "text", "n_spans", F.lit(None).cast("map<string,string>").alias("words")), share({r["garbled"]: r["sound"] for r in few})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in held(t, longest)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "garbled"])

    # texts with the same hash only see each other's words as well
    asked = texts.select(F.xxhash64("text").alias("id"), "text").mapInArrow(ask, "id bigint, garbled string")
    told = asked.join(found, "garbled").groupBy("id").agg(F.collect_set(F.struct("garbled", "sound")).alias("words"))
    return texts.withColumn("id", F.xxhash64("text")).join(told, "id", "left").select("key", "text", "n_spans", F.map_from_entries("words").alias("words")), share({})


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", restore: bool = False) -> DataFrame:
    """``key`` of the texts with a garbled passage; with ``restore`` also ``restored, n_spans, complete``.

    Null, empty and pure ASCII texts are never cases. Texts are searched whole, whatever their length; a
    text that is stored again is a case again. Other columns are not read, so their names cannot clash.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).alias("n_spans"))
    counts = word_counts(picked).checkpoint()
    longest = counts.where(F.col("word").rlike(r"^\p{L}+$")).agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]

    def searched(texts: DataFrame, again: bool) -> DataFrame:
        """The cases among the texts, with ``restore`` after one round of replacements; all texts if ``again``."""
        texts, shared = _with_words(texts, counts, longest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder, common = _finder(), shared.value
            find = _words_of(common) if common else None
            for b in batches:
                hit, rows = [], []
                for i, (t, n, own) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                    words = dict(own) if own else find(t) if find else None
                    body, now, case = finder.replaced(t, words) if restore else (None, 0, finder.spans(t, words)[1])
                    if case or again:
                        hit.append(i)
                        rows.append((body, n + now, now > 0))
                arrays = [b.column(0).take(pa.array(hit, pa.int64()))]
                if restore:
                    arrays += [pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "text", "n_spans", "live"][: len(arrays)])

        return texts.mapInArrow(run, f"key {kind}" + (", text string, n_spans int, live boolean" if restore else ""))

    rows = searched(picked, False)
    if restore:
        for _ in range(ROUNDS - 1):
            rows = rows.checkpoint()
            live = rows.where("live")
            if live.isEmpty():
                break
            rows = rows.where("not live").unionByName(searched(live.drop("live"), True))
        lost = F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))
        rows = rows.select("key", F.col("text").alias("restored"), (F.col("n_spans") + lost).alias("n_spans"), (lost == 0).alias("complete"))
    return rows.withColumnRenamed("key", key)
