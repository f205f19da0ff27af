"""Defective prompt and response pairs: noisy labelling functions combined by an EM label model.

Every pair gets votes from three labelling functions per defect (for, against, or none); no defect silences another.
For each defect a two-class model with independent functions is fitted by expectation-maximization over the counts of
vote patterns; a pair carries every defect whose posterior exceeds that defect's cutoff, which is validated on cases
planted in every pair that seems sound. Language is told by script, by common words and by character trigrams, refusals
by phrases, by what else is said and by a word model; both models are fitted here on all texts, whose labels are those
of the simple functions. What the driver sees of the texts are sums by slot, language state, score step and vote
pattern, whose number does not grow with the data. All functions work on whole batches of texts.
"""
from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.llm import truncation
from frameledger.llm.reading import END, HAN, WORD, Reader, mix, slices
from frameledger.session import deliveries, ensure_checkpoint_dir

DEFECTS = ["empty", "refusal", "copy", "other_language", "truncated"]
#: Labelling functions per defect, in the order of their votes.
FUNCTIONS = {"empty": ["no_letters", "placeholder", "hollow_structure"], "refusal": ["phrases", "nothing_else", "word_model"], "copy": ["same_text", "nothing_added", "overlap"], "other_language": ["script", "words", "trigrams"], "truncated": ["at_limit", "open", "ending"]}
#: Cutoffs tried, and the share of planted pairs of a defect that must pass the one taken.
CUTOFFS, FOUND_SHARE = np.arange(0.05, 0.96, 0.05), 0.95
ROUNDS = 200
#: Share of sound pairs that a function is believed to vote against; the belief weighs half as much as the data, so that
#: a defect that only one function sees stays told apart.
FALSE_VOTES = 0.0003
#: Cases are planted in pairs whose halves have more signs than this.
PLANTED_FROM = 40
#: Refusal scores are told apart in steps of one over this.
STEPS = 1024

#: What stands for no answer.
PLACEHOLDERS = ["n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "tbd", "todo", "no answer", "empty", "answer", "no response", "blank", "not available", "placeholder", "无", "暂无", "没有回答", "sin respuesta", "keine antwort", "pas de réponse"]
#: Phrases that decline, by language, as patterns on lower-case text without accents.
DECLINES = [
    r"\b(?:can(?:no|')?t|cannot|unable to|not able to|won't|will not|would not|must|have to|prefer not to|rather not|refuse to|decline to)\b[^.!?。]{0,40}?\b(?:help|assist|answer|answering|comment|commenting|discuss|describe|describing|provide|providing|comply|process|extract|convert|turn this|restructure|view|judge|analy[sz]e|share|respond|decline)",
    r"\b(?:no comment|declin(?:e|ed|ing)|inappropriate|my guidelines|against (?:the|my|our) (?:policy|guidelines|rules)|don't feel comfortable|not comfortable|can't be discussed|cannot be discussed|not permitted|not allowed|as an? (?:ai|assistant)|refus(?:e|ed|al)|unanswered)\b",
    r"\b(?:no puedo (?:ayudar|responder|comentar|contestar|describir|atender)|prefiero no|no me (?:esta permitido|es posible)|lo siento, (?:pero )?no|me niego|no estoy (?:autorizado|en condiciones)|debo rechazar|no sera posible|como asistente)\b",
    r"\b(?:je ne (?:peux|puis|suis|pourrai) pas|je prefere ne|impossible de repondre|je refuse|je dois (?:decliner|refuser)|desole, (?:mais )?je|en tant qu'assistant|il m'est impossible|ne suis pas (?:autorise|en mesure))\b",
    r"(?:kann ich (?:leider )?nicht|nicht helfen|ablehnen|nicht beantworten|moechte ich nicht|mochte ich nicht|ich darf (?:leider )?(?:nicht|keine)|als assistent|keine auskunft|verweiger|nicht moglich|keine angaben)",
    r"(?:恕不|无法(?:回答|提供|协助|帮助|描述|评论)|不能(?:回答|描述|提供|协助|评论)|不便(?:回答|评论|透露)|拒绝|请换一个|不予|抱歉)",
]
_DECLINES = re.compile("|".join(DECLINES))
#: Common words by language.
WORDS = {
    "en": "the and of to is in on at while before with a an into from after near so as for which what how where who does not by this that it are was under up between during behind although",
    "es": "el la los las de del que y en con por un una hacia mientras antes al se su para como cuando según dos detrás qué cómo dónde es entre junto",
    "fr": "le la les de des du et un une à au vers pendant avant après sur que qui dans son sa quand même près où est entre derrière ne pas se",
    "de": "der die das und ein eine den dem des zum zur mit nach vor in auf während bevor hinter als wie wo ist sich nicht im von obwohl zwischen beim entlang",
}
LANGUAGES = list(WORDS)
#: Codes of a text's language: unknown, one of LANGUAGES, Chinese, Cyrillic.
UNKNOWN, CHINESE, CYRILLIC = -1, len(LANGUAGES), len(LANGUAGES) + 1
#: How an answer that is handed on may be framed.
_FRAME = r"^(?:question|answer|output|result|json|text|frage|antwort|pregunta|respuesta|réponse|问题|回答)+|(?:answer|json|antwort|respuesta|réponse|回答)+$"
_MARKUP = r"<[^<>]*>|```[A-Za-z0-9_]*|\\[nt]"
_GUARD = re.compile(r"^\s*(?:```\w*\n?|output:|answer:|question:|q:|a:|result:|>+)\s*", re.I)
_STRUCTURE = r'^\s*(?:```[A-Za-z]*\s*)?[\[{]|\{\s*"'
_ACCENT = re.compile("[\u0300-\u036f]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n")
SLOTS = 1 << 16
#: Trigrams from which on a text's language is told by them, and by how much (log odds each, on average) it must lead.
LEAST_TRIGRAMS, LEAD_TRIGRAM = 16, 0.2
FOR, AGAINST, NONE = 1, 2, 0


def plain(s: str) -> str:
    """Lower case, no accents, single blanks, straight quotes."""
    if s.isascii():
        return re.sub(r"\s+", " ", s).strip().lower()
    s = unicodedata.normalize("NFKD", s).replace("’", "'").replace("‘", "'")
    return re.sub(r"\s+", " ", _ACCENT.sub("", s)).strip().lower()


def declines(s: str) -> bool:
    return bool(_DECLINES.search(plain(s)))


def _matches(texts: list[str], pattern: str) -> np.ndarray:
    return pc.match_substring_regex(pa.array(texts, pa.string()), pattern).to_numpy(zero_copy_only=False)


def _strings(texts: list[str] | pa.Array) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


def prose(texts: pa.Array) -> pa.Array:
    """The running text: of a structure without lead-in, member names, one-word values and constants, its strings on lines
    of their own."""
    held = pc.or_(pc.match_substring_regex(texts, _STRUCTURE), pc.match_substring_regex(texts, r'^\s*"'))

    def inner(t: pa.Array) -> pa.Array:
        t = pc.replace_substring_regex(pc.replace_substring(t, '\\"', "'"), r'^[^\[{"]*', " ")
        t = pc.replace_substring_regex(t, r'([\]}])[^\[\]{}"]*$', r"\1")  # a remark behind it
        t = pc.replace_substring_regex(t, r'"[A-Za-z0-9_./-]*"\s*:?|\b(?:null|true|false)\b', " ")
        return pc.replace_substring(pc.replace_substring(t, "\\n", "\n"), '"', "\n")

    return _partly(texts, held.to_numpy(zero_copy_only=False), inner)


def _partly(texts: pa.Array, mask: np.ndarray, f) -> pa.Array:
    """``f`` applied to the texts under the mask, the others as they are."""
    if not mask.any():
        return texts
    if mask.all():
        return f(texts)
    return pc.replace_with_mask(texts, pa.array(mask), f(texts.filter(pa.array(mask))))


def structured(texts: pa.Array) -> np.ndarray:
    """Whether a text is an object or list (a fence or lead-in aside)."""
    return pc.match_substring_regex(texts, _STRUCTURE).to_numpy(zero_copy_only=False)


def bare(texts: pa.Array) -> pa.Array:
    """Letters and digits only, for comparing texts that differ in dress."""
    return _partly(_partly(texts, wide := ~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False), _bare), ~wide, _ascii_bare)


_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])


def _ascii_bare(texts: pa.Array) -> pa.Array:
    t = pc.replace_substring(pc.ascii_lower(texts), "\\n", " ")
    at = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1]
    signs = np.frombuffer(t.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    kept = _ALNUM[signs]
    ends = np.append(0, np.cumsum(kept))[at - at[0]].astype(np.int32)
    return pa.StringArray.from_buffers(len(t), pa.py_buffer(ends), pa.py_buffer(signs[kept]))


def _bare(texts: pa.Array) -> pa.Array:
    t = pc.replace_substring(pc.utf8_lower(pc.utf8_normalize(texts, "NFKC")), "ß", "ss")
    return pc.replace_substring_regex(pc.replace_substring(t, "\\n", " "), r"[^\p{L}\p{N}]+", "")


class Voice:
    """The words of a batch of texts, and what they tell about language and refusal."""

    def __init__(self, texts: pa.Array):
        self.r = r = Reader(texts.to_pylist())
        self.n = r.n
        self.words = np.flatnonzero(~r.stop)
        self.of = r.text[self.words]  # text of each word
        self.sign_of = np.cumsum(r.k == END) - (r.k == END)

    def _count(self, signs: np.ndarray) -> np.ndarray:
        return np.bincount(self.sign_of[signs], minlength=self.n)

    def script(self) -> np.ndarray:
        """Chinese or Cyrillic where these signs prevail (a letter of theirs counts as four Latin ones), else unknown."""
        han = self._count(self.r.k == HAN)
        cyrillic = self._count((self.r.c >= 0x400) & (self.r.c < 0x530))
        letters = self._count((self.r.k == WORD) & (self.r.c > 57)) - cyrillic
        out = np.full(self.n, UNKNOWN)
        out[(han >= 2) & (4 * han > letters) & (han >= cyrillic)] = CHINESE
        out[(cyrillic >= 4) & (4 * cyrillic > letters) & (cyrillic > han)] = CYRILLIC
        return out

    def by_words(self) -> np.ndarray:
        """Language by common words, where one leads."""
        known, share = _common()
        at = np.minimum(np.searchsorted(known, self.r.hash[self.words]), len(known) - 1)
        hit = known[at] == self.r.hash[self.words]
        score = np.stack([np.bincount(self.of[hit], weights=share[at[hit], j], minlength=self.n) for j in range(len(LANGUAGES))], 1)
        return _leader(score, 1.0)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all trigrams of letters (a blank between words), and their texts."""
        c = self.r.c.astype(np.uint64)
        letter = (self.r.k == WORD) & (self.r.c > 64)
        c = np.where(letter, c, np.uint64(32))
        code = (c[:-2] * np.uint64(0x1F35B) + c[1:-1] * np.uint64(0x2A7D1) + c[2:] * np.uint64(0x9E3B5)) if len(c) > 2 else np.zeros(0, np.uint64)
        use = (self.sign_of[:-2] == self.sign_of[2:]) & (letter[:-2] | letter[2:]) & letter[1:-1] if len(c) > 2 else np.zeros(0, bool)
        return (mix(code[use]) % np.uint64(SLOTS)).astype(np.int64), self.sign_of[:-2][use] if len(c) > 2 else np.zeros(0, np.int64)

    def by_trigrams(self, model: np.ndarray | None) -> np.ndarray:
        if model is None:
            return np.full(self.n, UNKNOWN)
        slot, of = self.trigrams()
        score = np.stack([np.bincount(of, weights=model[j][slot], minlength=self.n) for j in range(len(LANGUAGES))], 1)
        seen = np.bincount(of, minlength=self.n)
        score = score - score.min(1, keepdims=True)
        order = np.sort(score, 1)
        clear = (seen >= LEAST_TRIGRAMS) & (order[:, -1] - order[:, -2] >= np.maximum(3.0, LEAD_TRIGRAM * seen))
        return np.where(clear, score.argmax(1), UNKNOWN)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all words and contexts, and their texts."""
        both = np.concatenate([self.r.hash[self.words], self.r.contexts()[self.words]])
        return (both % np.uint64(SLOTS)).astype(np.int64), np.concatenate([self.of, self.of])

    def refusal_steps(self, model: np.ndarray | None) -> np.ndarray:
        """Mean log odds of a text's words and contexts, in STEPS."""
        if model is None:
            return np.zeros(self.n, np.int32)
        slot, of = self.features()
        return np.rint(STEPS * np.bincount(of, weights=model[slot], minlength=self.n) / np.maximum(np.bincount(of, minlength=self.n), 1)).astype(np.int32)


_COMMON: list[tuple[np.ndarray, np.ndarray]] = []


def _common() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common words, sorted, and the share of each language in them."""
    if not _COMMON:
        words = sorted({w for ws in WORDS.values() for w in ws.split()})
        r = Reader(words)
        h = r.hash[~r.stop]
        share = np.array([[w in WORDS[lang].split() for lang in LANGUAGES] for w in words], float)
        order = np.argsort(h)
        _COMMON.append((h[order], (share / share.sum(1, keepdims=True))[order]))
    return _COMMON[0]


def _leader(score: np.ndarray, least: float) -> np.ndarray:
    """The column that leads by a fifth of its score, of those with the least score; else UNKNOWN."""
    order = np.sort(score, 1)
    return np.where((order[:, -1] >= least) & (order[:, -1] - order[:, -2] > 0.2 * order[:, -1]), score.argmax(1), UNKNOWN)


def language(texts: list[str], model: np.ndarray | None = None) -> list[int]:
    v = Voice(prose(_strings(texts)))
    s, w = v.script(), v.by_words()
    return np.where(s >= 0, s, w if model is None else v.by_trigrams(model)).tolist()


def tally(side: Side) -> np.ndarray:
    """Sums over texts by slot: per language the trigrams of the texts whose common words name it, the words and contexts
    of the texts that do not (but one) decline and say nothing else, and of those that do; the last row begins with the
    number of the latter."""
    out = np.zeros((len(LANGUAGES) + 3, SLOTS), np.int64)
    v = side.voice
    named = np.where(side.script >= 0, UNKNOWN, side.by_words)
    slot, of = v.trigrams()
    for k in range(len(LANGUAGES)):
        out[k] = np.bincount(slot[named[of] == k], minlength=SLOTS)
    phrases, rest = side.said
    whole = (phrases == FOR) & (rest == FOR)
    slot, of = v.features()
    for k in (0, 1):
        out[len(LANGUAGES) + k] = np.bincount(slot[whole[of] == bool(k)], minlength=SLOTS)
    out[-1, 0] = whole.sum()
    return out


def models_of(sums: np.ndarray) -> dict:
    """Trigram log odds by language and word log odds of refusals; from which score on a text counts as a refusal, all
    texts' scores must tell (see ``refusal_from``)."""
    out: dict = {"language": None, "refusal": None, "refusal_from": np.inf}
    if not sums.any():
        return out
    counts, slots = sums[: len(LANGUAGES)].T + 0.02, sums[len(LANGUAGES) : -1]
    share = np.log(counts / counts.sum(0))
    out["language"] = np.ascontiguousarray((share - share.mean(1, keepdims=True)).T.astype(np.float32))
    if sums[-1, 0] >= 5:
        p = (slots + 0.2) / (slots + 0.2).sum(1, keepdims=True)
        # a word that neither class has tells nothing
        out["refusal"] = np.where(slots.sum(0) > 0, np.clip(np.log(p[1] / p[0]), -6, 6), 0.0).astype(np.float32)
    return out


def _quantile(counts: dict[int, int], q: float) -> float:
    """The quantile (linear between neighbours, as numpy's) of numbers that occur so often."""
    at = sorted(counts)
    upto = np.cumsum([counts[k] for k in at])
    place = q * (int(upto[-1]) - 1)
    lo, hi = (at[int(np.searchsorted(upto, i, "right"))] for i in (np.floor(place), np.ceil(place)))
    return lo + (hi - lo) * (place - np.floor(place))


def refusal_from(scores: dict[tuple[bool, int], int]) -> float:
    """The score from which on a text counts as a refusal, by the number of texts that decline or not, and score (in STEPS):
    half way from what one of a thousand texts without such phrases reaches to what most with them do."""
    calm, says = ({k: n for (d, k), n in scores.items() if d == x} for x in (False, True))
    low = _quantile(calm, 0.999) / STEPS if calm else 0.0
    return max(0.5, low, (low + _quantile(says, 0.05) / STEPS) / 2)


def _scores(side: Side, models: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether texts decline, their scores (in STEPS), and how many texts do so."""
    both = 2 * side.steps(models).astype(np.int64) + (side.said[0] == FOR)
    known, n = np.unique(both, return_counts=True)
    return known % 2 > 0, known // 2, n


def fit_models(texts: list[str]) -> dict:
    """The models of texts that are at hand (of tables: ``fit_tables``)."""
    sides = [Side(pa.array(texts[i:j], pa.string())) for i, j in slices(texts)]
    models = models_of(sum(map(tally, sides), np.zeros((len(LANGUAGES) + 3, SLOTS), np.int64)))
    if models["refusal"] is not None:
        scores: Counter = Counter()
        for side in sides:
            for d, k, n in zip(*(x.tolist() for x in _scores(side, models))):
                scores[d, k] += n
        models["refusal_from"] = refusal_from(scores)
    return models


def _said(answer: str) -> tuple[int, int]:
    """Votes by phrases that decline, and by whether anything else is said."""
    if not declines(answer):
        return AGAINST, NONE
    sentences = [x for x in _SENTENCE.split(answer) if x.strip()]
    left = [x for x in sentences if not declines(x) and sum(map(str.isalnum, _GUARD.sub("", x))) > 25]
    return FOR, AGAINST if left else FOR


def _pick(cond, one, other):
    return np.where(cond, one, other).astype(np.int8)


_NO_CONTENT = re.compile("(?:" + "|".join(sorted(map(re.escape, PLACEHOLDERS), key=len, reverse=True)) + r"|[\W_])*")
_FILLERS: list[np.ndarray] = []


def _fillers() -> np.ndarray:
    """Hashes of the words that texts without content may hold."""
    if not _FILLERS:
        r = Reader([*PLACEHOLDERS, "output result q a json text n t"])
        _FILLERS.append(np.unique(r.hash[~r.stop]))
    return _FILLERS[0]


def _bodies(texts: pa.Array, held: np.ndarray) -> list[np.ndarray]:
    bodies = pc.utf8_trim_whitespace(pc.utf8_lower(pc.replace_substring_regex(pc.replace_substring_regex(texts, _MARKUP, " "), r"^\s*(?:answer|output|result|q|a)\s*:", " ")))
    core = pc.replace_substring_regex(bodies, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")
    stands = pc.is_in(core, pa.array([*PLACEHOLDERS, ""])).to_numpy(zero_copy_only=False)
    values = pc.replace_substring_regex(pc.replace_substring_regex(bodies, r"^[^\[{]*", " "), r'"[^"\\]*"\s*:', " ")
    bodies = pc.if_else(pa.array(held), values, bodies)
    letters = pc.match_substring_regex(bodies, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
    words = pc.match_substring_regex(bodies, r"[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
    hollow = held & np.array([_NO_CONTENT.fullmatch(x) is not None for x in values.to_pylist()], bool)
    # a word or two may still stand for no answer
    return [_pick(letters, _pick(words, AGAINST, NONE), FOR), _pick(stands, FOR, _pick(hollow, NONE, AGAINST)), _pick(held, _pick(hollow, FOR, AGAINST), NONE)]


def _empty(texts: pa.Array, held: np.ndarray, voice: Voice) -> list[np.ndarray]:
    """Only texts all of whose words may stand for nothing (or that hold markup) are read more closely."""
    fill = _fillers()
    h = voice.r.hash[voice.words]
    real = np.bincount(voice.of, weights=fill[np.minimum(np.searchsorted(fill, h), len(fill) - 1)] != h, minlength=voice.n)
    close = (real == 0) | (np.bincount(voice.of, minlength=voice.n) <= 2) | pc.match_substring(texts, "<").to_numpy(zero_copy_only=False)
    out = [np.full(voice.n, AGAINST, np.int8), np.full(voice.n, AGAINST, np.int8), _pick(held, AGAINST, NONE)]
    if close.any():
        for whole, part in zip(out, _bodies(texts.filter(pa.array(close)), held[close])):
            whole[close] = part
    return out


#: Signs of a refusal in any of the languages, coarser than DECLINES: texts without one are not read sentence by sentence.
_SCREEN = r"(?i)can.?t|cannot|able to|won.?t|will not|would not|must|have to|prefe|prefie|rather|refus|declin|unanswered|no comment|appropriate|guidelines|against|comfortable|permitted|allowed|as an? a|no puedo|no me |siento|niego|autorizad|condiciones|rechazar|no ser|asistente|je ne|je pr|impossible|je dois|d.{1,2}sol|assistant|suis pas|ich (?:leider )?nicht|helfen|ablehnen|beantworten|chte ich|ich darf|assistent|auskunft|verweiger|nicht m|angaben|恕|无法|不能|不便|拒绝|请换|不予|抱歉"


def _refusal(a: Side, models: dict) -> list[np.ndarray]:
    score = a.steps(models) / STEPS
    return [*a.said, _pick(score > models["refusal_from"], FOR, _pick(score < 0.5 * models["refusal_from"], AGAINST, NONE)) if models["refusal"] is not None else np.zeros(len(score), np.int8)]


def _copy(a: pa.Array, o: pa.Array, held: np.ndarray, mine: Voice, theirs: Voice) -> list[np.ndarray]:
    """Votes on letters and digits (``a``, ``o``: see ``bare``) and words; a structure adds something."""
    free = ~held & (pc.utf8_length(o).to_numpy(zero_copy_only=False) >= 2) & (pc.utf8_length(a).to_numpy(zero_copy_only=False) >= 2)
    same = pc.or_(pc.equal(a, o), pc.equal(pc.replace_substring_regex(a, _FRAME, ""), o)).to_numpy(zero_copy_only=False) & free
    whole = same.copy()
    at = np.flatnonzero(free & ~same)
    for i, x, y in zip(at, a.take(pa.array(at)).to_pylist(), o.take(pa.array(at)).to_pylist()):
        whole[i] = y in x and not re.sub(_FRAME, "", x.replace(y, ""))
    # shares of the words of either half that the other has; of halves too unlike in number these cannot be large
    n_a, n_o = np.bincount(mine.of, minlength=mine.n), np.bincount(theirs.of, minlength=mine.n)
    like = free & (np.minimum(n_a, n_o) >= 0.3 * np.maximum(n_a, n_o))

    def words(v: Voice) -> tuple[np.ndarray, np.ndarray]:
        use = like[v.of]
        h, i = np.unique(mix(v.r.hash[v.words[use]] + v.of[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        return h, v.of[use][i]

    (ha, of_a), (ho, of_o) = words(mine), words(theirs)
    shared = np.bincount(of_a, weights=np.isin(ha, ho, assume_unique=True), minlength=mine.n)
    most = np.maximum(np.bincount(of_a, minlength=mine.n), np.bincount(of_o, minlength=mine.n))
    least = shared / np.maximum(most, 1)
    vote = lambda yes, no=AGAINST: _pick(free, _pick(yes, FOR, no), _pick(held, AGAINST, NONE))
    return [vote(same, _pick(whole, NONE, AGAINST)), vote(whole), vote(least >= 0.8, _pick(least >= 0.6, NONE, AGAINST))]


def _other_language(a: np.ndarray, o: np.ndarray) -> list[np.ndarray]:
    """Votes on the language states of both halves (see ``Side.tongue``)."""
    (script_a, latin_a, *told_a), (script_o, latin_o, *told_o) = _told(a), _told(o)
    both = (script_a >= 0) & (script_o >= 0)
    differs = (both & (script_a != script_o)) | ((script_a >= 0) & (latin_o > 0)) | ((latin_a > 0) & (script_o >= 0))
    out = [_pick(differs, FOR, _pick(both & (script_a == script_o), AGAINST, NONE))]
    for x, y in zip(told_a, told_o):
        out.append(_pick((x >= 0) & (y >= 0), _pick(x != y, FOR, AGAINST), NONE))
    return out


def _told(tongue: np.ndarray) -> list[np.ndarray]:
    """Script, whether Latin, language by words and by trigrams of a language state."""
    return [tongue // 98 % 7 - 1, tongue // 49 % 2, tongue // 7 % 7 - 1, tongue % 7 - 1]


def _truncated(evidence: np.ndarray) -> list[np.ndarray]:
    """Votes from the truncation operator's evidence, one bit each: at_limit, is_open, bare, whole_end, cut."""
    at, opened, ends_bare, whole, cut = ((evidence >> i) & 1 > 0 for i in range(5))
    limit_cut = at & cut  # the limit decides, however the last words read
    return [_pick(at, _pick(cut, FOR, NONE), _pick(cut, NONE, AGAINST)), _pick(opened, FOR, _pick(limit_cut | ends_bare, NONE, AGAINST)), _pick(limit_cut, NONE, _pick(ends_bare, _pick(whole, AGAINST, FOR), _pick(opened, NONE, AGAINST)))]


class Side:
    """One half of a batch of pairs: its texts, and what is read from them once."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        # a text that is one JSON string counts as what it spells
        spelt = pc.match_substring_regex(texts, r'^\s*"[\s\S]*"\s*$').to_numpy(zero_copy_only=False)

        def read(t: pa.Array) -> pa.Array:
            out = t.to_pylist()
            for i, x in enumerate(out):
                try:
                    v = json.loads(x)
                except ValueError:
                    continue
                out[i] = v if isinstance(v, str) else x
            return pa.array(out, pa.string())

        self.texts = pc.replace_substring_regex(_partly(texts, spelt, read), "^[\\s\\p{Z}\u200b\u200c\u200d\ufeff\u2060]+|[\\s\\p{Z}\u200b\u200c\u200d\ufeff\u2060]+$", "")
        self.held = structured(self.texts)
        self.run = prose(self.texts)
        self.voice = Voice(self.run)
        self._tongue: np.ndarray | None = None
        self._steps: np.ndarray | None = None

    @cached_property
    def bare(self) -> pa.Array:
        return _partly(_partly(self.texts, ~self.held, bare), self.held, lambda t: pa.array([""] * len(t), pa.string()))

    @cached_property
    def script(self) -> np.ndarray:
        return self.voice.script()

    @cached_property
    def by_words(self) -> np.ndarray:
        return np.where(self.script >= 0, self.script, self.voice.by_words())

    @cached_property
    def said(self) -> tuple[np.ndarray, np.ndarray]:
        """Votes by phrases that decline, and by whether anything else is said."""
        phrases, rest = np.full(len(self.run), AGAINST, np.int8), np.full(len(self.run), NONE, np.int8)
        at = np.flatnonzero(pc.match_substring_regex(self.run, _SCREEN).to_numpy(zero_copy_only=False))
        # the array operation sees no ends of words between letters of two scripts, so it passes more
        at = at[_matches([plain(x) for x in self.run.take(pa.array(at)).to_pylist()], "|".join(DECLINES))]
        for i in at.tolist():
            phrases[i], rest[i] = _said(self.run[i].as_py())
        return phrases, rest

    def steps(self, models: dict) -> np.ndarray:
        if self._steps is None:
            self._steps = self.voice.refusal_steps(models["refusal"])
        return self._steps

    def tongue(self, models: dict) -> np.ndarray:
        """What is known of the texts' language, as one number each (see ``_told``): with a script of its own all
        tell that, else there are five answers by words and five by trigrams, so 52 in all."""
        if self._tongue is None:
            latin = (self.script < 0) & (self.voice._count((self.voice.r.k == WORD) & (self.voice.r.c > 57)) >= 8)
            tri = np.where(self.script >= 0, self.script, self.voice.by_trigrams(models["language"]))
            self._tongue = (((self.script + 1) * 2 + latin) * 7 + self.by_words + 1) * 7 + tri + 1
        return self._tongue


def votes(answer: pa.Array | Side, other: pa.Array | Side, evidence: np.ndarray, models: dict) -> np.ndarray:
    """Votes (rows x all functions) on pairs; a null other half gives no vote on copying or language."""
    a, o = (x if isinstance(x, Side) else Side(x) for x in (answer, other))
    cols = _empty(a.texts, a.held, a.voice) + _refusal(a, models) + _copy(a.bare, o.bare, a.held, a.voice, o.voice) + _other_language(a.tongue(models), o.tongue(models)) + _truncated(evidence)
    return np.stack(cols, 1)


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Posteriors of the vote patterns of one defect.

    EM over the pattern counts: class prior and, per class, each function's share of votes for among those it gives. Prior counts (a defect is
    rare, its functions vote for it more often than sound pairs get such votes) keep the classes apart also
    where a table has no defect at all. It starts from the majority of the votes."""
    v = np.array([p for p, _ in patterns], int)
    n = np.array([c for _, c in patterns], float)
    up, down = (v == FOR).sum(1), (v == AGAINST).sum(1)
    post = np.where(up > down, 0.95, np.where((up == down) & (up > 0), 0.4, 0.01))
    for _ in range(ROUNDS):
        w1, w0 = n * post, n * (1 - post)
        prior = (w1.sum() + 0.5) / (n.sum() + 10.0)
        l1, l0 = np.full(len(n), np.log(prior)), np.full(len(n), np.log(1 - prior))
        for j in range(v.shape[1]):
            # a function that does not vote tells nothing
            f1 = np.bincount(v[:, j], weights=w1, minlength=3)[1:] + [2.0, 0.5]
            f0 = np.bincount(v[:, j], weights=w0, minlength=3)[1:] + n.sum() / 2 * np.array([FALSE_VOTES, 1 - FALSE_VOTES])
            l1 = l1 + np.append(0.0, np.log(f1 / f1.sum()))[v[:, j]]
            l0 = l0 + np.append(0.0, np.log(f0 / f0.sum()))[v[:, j]]
        new = 1 / (1 + np.exp(np.clip(l0 - l1, -500, 500)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post


#: Answers without content, and what a text handed on may look like; planted as cases.
HOLLOW = ["", " ", "--", "N/A", "{}", "[]", '{"text": ""}', "(none)", "```json\n```", "<answer></answer>"]
FRAMES = ["{}", "> {}\n\nAnswer:", "Output: {}", '"{}"', "{0}\n{0}", "Question: {}"]


def _handed_on(texts: list[str | None], ids: np.ndarray) -> list[str]:
    """Each text in one of the frames and cases, by the hash of its record's id; nothing for nulls."""
    kind = (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(3 * len(FRAMES))).tolist()
    return ["" if t is None else (str.upper, str.lower, str)[k % 3](FRAMES[k // 3].format(t)) for t, k in zip(texts, kind)]


def foreign(tongues: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray] | None:
    """Votes, and their weights, on the first answer of every pair with, in place of the second, the second ones of all
    pairs whose first is in another language: by the number of pairs of each two language states."""
    asked, given = Counter(), Counter()
    for (one, two), n in tongues.items():
        spoken = one % 7 - 1  # by trigrams, or script
        if spoken >= 0:
            asked[one] += n
            given[spoken, two] += n
    rows = []
    for one, n in asked.items():
        others = [(two, m) for (spoken, two), m in given.items() if spoken != one % 7 - 1]
        total = sum(m for _, m in others)
        rows += [(two, one, n * m / total) for two, m in others]
    if not rows:
        return None
    two, one, weight = (np.array(x) for x in zip(*rows))
    return np.stack(_other_language(two, one), 1), weight


def planted(counts: dict[tuple[str, str, str], int]) -> dict[str, tuple[np.ndarray, np.ndarray | None] | None]:
    """Votes, and their weights, on the cases planted, per defect; from the counts of ``field, defect, pattern``.

    A case of each defect is planted in every pair of long answers that does not decline. Votes on emptiness and refusal
    see the planted text alone: it is any of HOLLOW, and any first answer of the table that only declines."""
    copies = {p: n for (_, d, p), n in counts.items() if d == "planted copy"}
    if not copies:
        return {}
    hollow = Side(pa.array(HOLLOW))
    refusals = {p: n for (f, d, p), n in counts.items() if (f, d) == ("raw_output", "refusal") and p.startswith(f"{FOR}{FOR}")}
    split = lambda of: (np.array([list(map(int, p)) for p in of]), np.array(list(of.values()))) if of else None
    tongues = {tuple(map(int, p.split("/"))): n for (_, d, p), n in counts.items() if d == "planted other_language"}
    return {"empty": (np.stack(_empty(hollow.texts, hollow.held, hollow.voice), 1), None), "refusal": split(refusals), "copy": split(copies), "other_language": foreign(tongues)}


def cutoff(posterior: dict[tuple[int, ...], float], cases: tuple[np.ndarray, np.ndarray | None] | None) -> float:
    """The highest of CUTOFFS that FOUND_SHARE of the planted cases (their votes, and weights if these differ) pass whose
    pattern the model knows; a half where there are none."""
    if cases is None:
        return 0.5
    weight = np.ones(len(cases[0])) if cases[1] is None else cases[1]
    told = np.array([[posterior[k], w] for k, w in zip(map(tuple, cases[0].tolist()), weight) if k in posterior]).reshape(-1, 2)
    good = [c for c in CUTOFFS if len(told) and told[told[:, 0] > c, 1].sum() / told[:, 1].sum() >= FOUND_SHARE]
    return float(max(0.5, good[-1])) if good else 0.5


FIELDS = ["raw_output", "structurer_raw_response"]


def halves(records: DataFrame, prompts: DataFrame, question: str = "question_text") -> tuple[DataFrame, DataFrame]:
    """Records, and questions by sample_id and protocol_id, each once."""
    once = deliveries(records.select("record_id", "model_name", "sample_id", "protocol_id", *FIELDS, "written_at"), "record_id", "written_at").drop("written_at")
    q = prompts.groupBy("sample_id", "protocol_id").agg(F.min_by(question, F.struct(F.col("written_at").isNull(), "written_at")).alias("question"))
    return once, q.checkpoint()  # read by the models, the scores and the votes


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a million signs each."""
    part = np.cumsum(sizes) // 1_000_000
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    return zip(cuts, cuts[1:])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[Side]:
    """The texts of batches of one column, without nulls, in slices."""
    for b in batches:
        for lo, hi in _cuts(pc.utf8_length(b.column(0)).to_numpy(zero_copy_only=False)):
            yield Side(b.column(0).slice(lo, hi - lo))


def fit_tables(once: DataFrame, q: DataFrame) -> dict:
    """The models of all answers and questions, but for ``refusal_from``. The driver sees a sum per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES) + 3, SLOTS), np.int64)
        for side in _sides(batches):
            total += tally(side)
        row, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[row, slot])], names=["row", "slot", "n"])

    texts = once.select(F.explode(F.array(*FIELDS)).alias("text")).unionByName(q.select(F.col("question").alias("text"))).where("text <> ''")
    got = texts.mapInArrow(run, "row int, slot int, n bigint").groupBy("row", "slot").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((len(LANGUAGES) + 3, SLOTS), np.int64)
    row, slot, n = (got.column(c).to_numpy() for c in ("row", "slot", "n"))
    sums[row, slot] = n
    return models_of(sums)


def refusals_from(voted: DataFrame, q: DataFrame, models: dict) -> float:
    """``refusal_from`` by the scores of all answers and questions; the driver sees a count per score."""
    shared = q.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side in _sides(batches):
            says, step, n = _scores(side, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(says), pa.array(step.astype(np.int32)), pa.array(n.astype(np.int64))], names=["says", "step", "n"])

    says = F.substring("votes", _vote_at("refusal", "phrases"), 1) == str(FOR)
    asked = q.select("question").where("question <> ''").mapInArrow(run, "says boolean, step int, n bigint")
    told = voted.select(says.alias("says"), "step", F.lit(1).cast("bigint").alias("n")).unionByName(asked)
    return refusal_from({(r["says"], r["step"]): r["n"] for r in told.groupBy("says", "step").agg(F.sum("n").alias("n")).collect()})


def _vote_at(defect: str, function: str) -> int:
    """Place (from 1) of a function's vote in ``votes``."""
    return sum(len(FUNCTIONS[d]) for d in DEFECTS[: DEFECTS.index(defect)]) + FUNCTIONS[defect].index(function) + 1


def vote_table(once: DataFrame, q: DataFrame, models: dict) -> DataFrame:
    """``record_id, field, votes, step, copied, tongue, tongue_2``: every non-null answer of both kinds of pairs with its
    votes and its refusal score in STEPS (the vote on it waits for ``refusal_from``), and with the first answer, where
    cases are planted, the votes on it handed on and the language states of both answers.

    Records and questions are joined on sample_id and protocol_id; a record without its prompt keeps its answer (no vote
    on copying or language)."""
    evidence = truncation.judged(truncation.stacked(once, "record_id", "model_name", FIELDS))
    bits = sum((F.col(c).cast("int") * (1 << i) for i, c in enumerate(["at_limit", "is_open", "bare", "whole_end", "cut"])), F.lit(0))
    evidence = evidence.groupBy("record_id").agg(*[F.max(F.when(F.col("field") == f, bits)).alias(f"e{i}") for i, f in enumerate(FIELDS)])
    joined = once.drop("model_name").join(evidence, "record_id", "left").join(q, ["sample_id", "protocol_id"], "left")
    shared = once.sparkSession.sparkContext.broadcast(models)  # two tables of SLOTS rows
    schema = pa.schema([("record_id", pa.int64()), ("field", pa.string()), ("votes", pa.string()), ("step", pa.int32()), ("copied", pa.string()), ("tongue", pa.int32()), ("tongue_2", pa.int32())])

    def told(v: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        text = np.ascontiguousarray((v + 48).astype(np.uint8)).view(f"S{v.shape[1]}").ravel().astype(str)
        return pa.array(text, pa.string(), mask=mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            size = [pc.fill_null(pc.utf8_length(b.column(c)), 0).to_numpy(zero_copy_only=False) for c in FIELDS]
            long = (size[0] > PLANTED_FROM) & (size[1] > PLANTED_FROM)
            for lo, hi in _cuts(size[0] + size[1]):
                s = b.slice(lo, hi - lo)
                question, raw, response = (Side(s.column(c)) for c in ("question", *FIELDS))
                sound = long[lo:hi] & (raw.said[0] == AGAINST)
                copies = Side(pa.array(_handed_on([t if x else None for t, x in zip(s.column(FIELDS[0]).to_pylist(), sound)], pc.fill_null(s.column("record_id"), 0).to_numpy(zero_copy_only=False)), pa.string()))
                copied = told(np.stack(_copy(copies.bare, raw.bare, copies.held, copies.voice, raw.voice), 1), ~sound)
                tongues = [pa.array(x.tongue(models).astype(np.int32), mask=~sound) for x in (raw, response)]
                for field, one, other, e, more in ((FIELDS[0], raw, question, "e0", [copied, *tongues]), (FIELDS[1], response, raw, "e1", [pa.nulls(s.num_rows, t) for t in (pa.string(), pa.int32(), pa.int32())])):
                    there = pa.array(np.asarray(pc.is_valid(s.column(field))))
                    v = told(votes(one, other, pc.fill_null(s.column(e), 8).to_numpy(zero_copy_only=False), models))
                    step = pa.array(one.steps(models))
                    yield pa.RecordBatch.from_arrays([x.filter(there) for x in (s.column("record_id").cast(pa.int64()), pa.array([field] * s.num_rows), v, step, *more)], schema=schema)

    return joined.select("record_id", "question", *FIELDS, "e0", "e1").mapInArrow(run, "record_id bigint, field string, votes string, step int, copied string, tongue int, tongue_2 int")


def _with_scores(voted: DataFrame, least: float) -> DataFrame:
    """The votes with that of the word model, as ``_refusal`` gives it."""
    score = F.col("step") / F.lit(float(STEPS))
    vote = F.when(score > least, str(FOR)).when(score < 0.5 * least, str(AGAINST)).otherwise(str(NONE))
    return voted.withColumn("votes", F.overlay("votes", vote, _vote_at("refusal", "word_model"), 1))


def _by_defect(table: DataFrame) -> DataFrame:
    """``field, defect, pattern, n``."""
    parts, at = [], 1
    for d in DEFECTS:
        parts.append(F.struct(F.lit(d).alias("defect"), F.substring("votes", at, len(FUNCTIONS[d])).alias("pattern")))
        at += len(FUNCTIONS[d])
    return table.select("*", F.explode(F.array(*parts)).alias("p")).select("*", "p.*").drop("p")


def label_pairs(records: DataFrame, prompts: DataFrame) -> DataFrame:
    """``record_id, field, defects array<struct<defect, posterior>>`` of the pairs with at least one defect.

    Null answers have no pair, repeated records count once. Beside the models' sums (see ``fit_tables``, ``refusals_from``)
    the driver sees one count per field, defect and vote pattern (at most 27 each) and per two language states (52 each),
    whatever the data."""
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    once, q = halves(records, prompts)
    models = fit_tables(once, q)
    table = vote_table(once, q, models).checkpoint()
    if models["refusal"] is not None:
        table = _with_scores(table, refusals_from(table, q, models))
    pattern = lambda d, p: table.where("copied is not null").select("field", F.lit(f"planted {d}").alias("defect"), p.alias("pattern"))
    told = _by_defect(table).select("field", "defect", "pattern").unionByName(pattern("copy", F.col("copied"))).unionByName(pattern("other_language", F.concat_ws("/", "tongue", "tongue_2")))
    seen = {(r["field"], r["defect"], r["pattern"]): r["n"] for r in told.groupBy("field", "defect", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    cases = planted(seen)
    rows = []
    for field in sorted({f for f, _, _ in seen}):
        for d in DEFECTS:
            pats = sorted((tuple(map(int, p)), n) for (f, x, p), n in seen.items() if (f, x) == (field, d))
            post = {p: float(x) for (p, _), x in zip(pats, fit(pats))}
            least = cutoff(post, cases.get(d))
            rows += [(field, d, "".join(map(str, p)), x) for p, x in post.items() if x > least]
    labels = spark.createDataFrame(rows, "field string, defect string, pattern string, posterior double")
    # at most 27 rows per field and defect (see above)
    hit = _by_defect(table).join(F.broadcast(labels), ["field", "defect", "pattern"])
    order = F.array(*[F.lit(d) for d in DEFECTS])
    told = F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("defect")).alias("at"), "defect", "posterior")))
    return hit.groupBy("record_id", "field").agg(told.alias("d")).select("record_id", "field", F.transform("d", lambda x: F.struct(x["defect"].alias("defect"), x["posterior"].alias("posterior"))).alias("defects"))


def one_defect(labelled: DataFrame) -> DataFrame:
    """The one defect of each defective answer: the first of DEFECTS that holds."""
    return labelled.select("record_id", "field", F.col("defects")[0]["defect"].alias("defect"))
