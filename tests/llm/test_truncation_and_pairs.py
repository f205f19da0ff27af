import json
import random

import numpy as np
import pytest

from frameledger.llm import pairs, reading, truncation

SUBJECTS = ["The captain", "The runner in blue", "Player 7", "The referee"]
VERBS = ["slides", "turns sharply", "steps back"]
PLACES = ["towards the near post", "along the outer lane", "under the crossbar"]
TAILS = ["after a short pause", "and the crowd reacts", "before passing the disc"]


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(PLACES)} {r.choice(TAILS)}."


def text(r, n):
    return " ".join(sentence(r) for _ in range(n))


@pytest.mark.parametrize("value,kind", [("All is well.", truncation.CLOSED), ("x\nBox: [1, 2, 3, 4]", truncation.CLOSED), ("x\nBox: [1, 2,", truncation.OPEN), ('{"a": [1, 2]}', truncation.CLOSED), ('{"a": [1, 2', truncation.OPEN), ('{"a": "text', truncation.OPEN), ('{"a": "b",}', truncation.CLOSED), ("```json\n{}\n```", truncation.CLOSED), ("```json\n{}", truncation.OPEN), ("and then he", truncation.BARE), ("", truncation.CLOSED), ("  ", truncation.CLOSED), ("他跳到近门柱。", truncation.CLOSED), ("他跳到近", truncation.BARE), ("(no detail)", truncation.CLOSED), ("Here, after a lead-in of more than sixty signs, is the structure that was asked for: {\"a\": [1", truncation.OPEN), ("“Go!” ", truncation.CLOSED), ('""', truncation.CLOSED), ("…", truncation.CLOSED), ("waits…", truncation.BARE), ("a {b} c", truncation.BARE)])
def test_ends(value, kind):
    assert truncation.end_of(value) == kind


RECORD = "record_id long, model_name string, raw_output string, structurer_raw_response string, written_at timestamp, sample_id string, protocol_id string, text string, field string"
FIELDS = ["raw_output", "structurer_raw_response"]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(0)
    rows, cut = [], set()
    for i in range(600):
        t = text(r, r.randint(1, 5))
        source = "short" if i % 2 else "free"
        if source == "short" and len(t) > 150:
            t = t[:150]
            if t[-1] != ".":
                cut.add((i, "raw_output"))
        elif i % 40 == 0:
            t = t[: len(t) // 2 + 7].rstrip(".")
            cut.add((i, "raw_output"))
        elif i % 46 == 0:
            t = "Team in white"
        elif i % 50 == 0:
            t = t.rstrip(".")  # whole, without a full stop
        s = json.dumps({"text": text(r, 2), "box": [1, 2]})
        if i % 30 == 0:
            s = s[: len(s) - r.randint(3, 40)]
            cut.add((i, "structurer_raw_response"))
        elif i % 31 == 0:
            s += "\nDone"
        rows.append((i, source, None if i % 97 == 0 else t, s, None, f"s{i}", "main", "clash", "clash"))
        if i % 97 == 0:
            cut.discard((i, "raw_output"))
    return rows, cut


def test_planted_cuts(spark, corpus):
    rows, cut = corpus
    df = spark.createDataFrame(rows + rows[:40], RECORD)
    got = truncation.judged(truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at"))
    found = {(r["record_id"], r["field"]) for r in got.where("cut").collect()}
    assert len(found - cut) <= 0.01 * len(cut) + 1
    assert len(cut - found) <= 0.04 * len(cut)  # some cuts fall on the end of a sentence
    rates = {(r["source"], r["field"]): r for r in truncation.truncation_rates(got).collect()}
    assert rates["short", "raw_output"]["rate"] > rates["free", "raw_output"]["rate"]
    assert sum(r["n_cut"] for r in rates.values()) == sum(r["n_limit"] + r["n_transfer"] for r in rates.values()) == len(found)
    assert rates["short", "raw_output"]["n_limit"] > 0 == rates["free", "raw_output"]["n_limit"]


def test_spikes(spark, corpus):
    df = spark.createDataFrame(corpus[0], RECORD)
    s = truncation.length_spikes(truncation.profile(truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at"))).collect()
    assert {(r["source"], r["field"], r["measure"], r["length"]) for r in s} == {("short", "raw_output", m, 150) for m in ("chars", "bytes")}


@pytest.mark.parametrize("limit", [9, 40])
def test_limits_of_any_size_in_words(spark, limit):
    # a limit in words, also one far below any sentence; texts that recur are no limit
    r = random.Random(limit)
    rows = []
    for i in range(3000):
        t = " ".join(f"w{r.randrange(400)}" for _ in range(r.randint(2, 2 * limit))) + "."
        rows.append(" ".join(t.split()[:limit]))
    rows += ["Team in white", "Yes"] * 500
    df = spark.createDataFrame([(i, None if i % 3 else "m", t, None, None, f"s{i}", "main", "", "") for i, t in enumerate(rows)], RECORD)
    got = truncation.judged(truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at"))
    found = {r["record_id"] for r in got.where("evidence = 'limit'").collect()}
    want = {i for i, t in enumerate(rows) if len(t.split()) == limit and not t.endswith(".")}
    assert found == want


def test_reader_against_plain_python():
    r = random.Random(5)
    texts = ["".join(r.choice("ab Z9.,\n甲乙。!é\x00{}") for _ in range(r.randint(0, 40))) for _ in range(400)]
    import re

    got = reading.Reader(texts)
    text, first, last = got.sentences()
    for i, t in enumerate(texts):
        plain = re.sub(r"[0-9]+(?:[.,:][0-9]+)*", "9", t.replace("\0", " ").lower())
        words = re.findall(r"[甲乙]|[^\s甲乙.,。!{}]+", plain)
        mine = got.text == i
        assert sum(mine & ~got.stop) == len(words)
        wanted = [x.strip(" {}\n") for x in re.split(r"(?<=[.!?])(?=[\s{}])|(?<=[。！？])|\n", plain)]
        assert [got.string(a, z) for a, z in zip(first[text == i], last[text == i])] == [x for x in wanted if x]
    h = {}
    for i in np.flatnonzero(~got.stop):
        w = got.string(got.at[i], got.at[i + 1] if got.kind[i] == reading.HAN else got.at[i] + 1)
        h.setdefault(int(got.hash[i]), w)
    assert len(set(h.values())) <= len(h)


def test_limits_are_alike_with_and_without_shipped_begins(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus[0], RECORD)
    values = truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at")
    found = lambda: {(r["record_id"], r["field"]) for r in truncation.judged(values).where("cut").collect()}
    one = found()
    monkeypatch.setattr(truncation, "SHIPPED_BEGINS", 0)
    assert found() == one


def test_empty_tables(spark):
    df = spark.createDataFrame([], RECORD)
    assert truncation.judged(truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at")).count() == 0
    prompts = spark.createDataFrame([], "sample_id string, protocol_id string, question_text string, written_at timestamp")
    assert pairs.label_pairs(df, prompts).count() == 0


LINES = {"en": "The captain turns to the left and waits", "es": "La capitana espera y corta hacia la esquina libre", "fr": "Le joueur avance vers le poteau et lève les deux bras", "de": "Der Läufer springt über die Mitte und hebt beide Arme"}


def test_language():
    said = pairs.language([*LINES.values(), "队长滑向边线附近", "9-9", "", '{"text": "Der Läufer springt über die Mitte", "label": "Red"}'])
    assert said == [pairs.LANGUAGES.index(k) for k in LINES] + [pairs.CHINESE, -1, -1, pairs.LANGUAGES.index("de")]


def test_trigrams_tell_languages_without_common_words():
    r = random.Random(2)
    nouns = {"en": "captain runner keeper winger crowd whistle", "es": "capitana corredor portera árbitro público silbato", "fr": "capitaine coureur gardienne arbitre spectateurs sifflet", "de": "Kapitänin Läufer Torhüterin Schiedsrichter Zuschauer Pfeife"}
    texts = []
    for k, line in LINES.items():
        for _ in range(150):
            words = line.split() + r.sample(nouns[k].split(), 3)
            r.shuffle(words)
            texts.append(" ".join(words))
    models = pairs.fit_models(texts)
    bare = [" ".join(nouns[k].split()) for k in LINES]
    assert pairs.language(bare) == [-1] * 4 and pairs.language(bare, models["language"]) == [0, 1, 2, 3]
    assert pairs.fit_models([])["language"] is None and pairs.language(["x"], None) == [-1]


def test_word_model_finds_refusals_beyond_the_phrases():
    r = random.Random(3)
    subjects = ["this clip", "that player", "the footage", "the score"]
    known = [f"I cannot answer questions about {r.choice(subjects)}, please ask about another scene." for _ in range(60)]
    texts = known + [text(r, 2) for _ in range(2000)]
    models = pairs.fit_models(texts)
    beyond = "Questions about that player, please ask about another scene."
    assert pairs._said(beyond) == (pairs.AGAINST, pairs.NONE)
    import pyarrow as pa

    v = pairs.votes(pa.array([beyond, text(r, 2)]), pa.array([None, None], pa.string()), np.array([8, 8]), models)
    assert v[:, 5].tolist() == [pairs.FOR, pairs.AGAINST]


def test_votes_on_texts_of_any_length():
    import pyarrow as pa

    other = "Where is the first player placed?"
    answers = ["N/A", "<div>" + " " * 500 + "n/a" + " " * 500 + "</div>", '{"text": "", "notes": ["n/a", null]}', '{"text": "", "bbox": [1]}', "x" * 70, "Question: " + other, other.upper() + "\n" + other, "Here, after a lead-in of far more than sixty signs of text, is the structure you asked for: {\"text\": \"\"}"]
    v = pairs.votes(pa.array(answers), pa.array([other] * len(answers)), np.full(len(answers), 8), pairs.fit_models([]))
    empty = [[x for x in row[:3]] for row in v.tolist()]
    assert all(2 not in e for e in empty[:2]) and all(1 in e for e in empty[:3]) and 1 not in empty[3] and 1 not in empty[4] and empty[7][2] == 1
    assert v[5, 7] == v[6, 7] == pairs.FOR and v[0, 7] != pairs.FOR


def test_label_model_recovers_planted_classes():
    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.05
    votes = np.stack([np.where(y, np.where(r.random(len(y)) < hit, 1, 2), np.where(r.random(len(y)) < false, 1, 2)) for hit, false in ((0.95, 0.01), (0.9, 0.02), (0.8, 0.05))], 1)
    keys, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = pairs.fit([(tuple(k), int(c)) for k, c in zip(keys.tolist(), counts)])
    said = post[inverse.ravel()] > 0.5
    assert (said & y).sum() / y.sum() > 0.9 and (said & ~y).sum() / said.sum() < 0.1
    assert pairs.fit([((2, 2, 2), 5)]).max() < 0.01 and pairs.fit([((0, 0, 0), 50), ((2, 2, 2), 5000)]).max() < 0.05
    assert pairs.fit([((0, 1, 0), 28), ((2, 2, 2), 1172)])[0] > 0.9 and pairs.fit([((0, 1, 0), 104), ((2, 2, 2), 95_000)])[0] > 0.5
    assert pairs.cutoff({(1, 1): 0.97, (1, 2): 0.7}, (np.array([[1, 1]] * 9 + [[1, 2]]), None)) == pytest.approx(0.65)
    assert pairs.cutoff({}, None) == 0.5


def test_planted_defects(spark):
    r = random.Random(1)
    questions = ["What happens while camera 4 is active?", "Where is the first player placed in round 3?", "Which team scores next on the board?"]
    rows, prompts, truth = [], [], {}
    declines = ["I'm sorry, but I can't help with this clip.", "No comment on that player.", "Lo siento, no puedo ayudar con esa petición.", "关于该视频,恕不作答。", "Es tut mir leid, dabei kann ich nicht helfen."]
    foreign = "La capitana se desliza hacia la esquina libre antes de pasar el disco. El árbitro espera y corta por el centro de la pista."
    for i in range(1200):
        q, a = r.choice(questions), text(r, 3)
        kind = {0: "empty", 1: "refusal", 2: "copy", 3: "other_language", 4: "truncated"}.get(i % 20)
        if kind == "empty":
            a = r.choice(["", " ", "N/A", "--", "null", "(no answer)", "<answer></answer>", "\xa0"])
        elif kind == "refusal":
            a = r.choice(declines)
        elif kind == "copy":
            a = r.choice([q, q.upper(), f"“{q}”", f"> {q}\n\nAnswer:", f"{q}\n{q}", f"Question: {q}"])
        elif kind == "other_language":
            a = foreign
        elif kind == "truncated":
            a = a[: len(a) // 2 + 20].rstrip(".")
        elif i % 20 == 5:
            a = f"{q} {a}"  # echoes, then answers
        elif i % 20 == 6:
            a = "Sorry for the brief reply. " + a
        elif i % 20 == 7:
            a = "I cannot see the whole clip, but this part is clear. " + a
        elif i % 20 == 8:
            a = "Team in white"
        elif i % 20 == 9:
            a += " A fan shouts «¡Vamos, la capitana!»."
        s = json.dumps({"text": text(r, 2)})
        if i % 33 == 0:
            s, truth[i, "structurer_raw_response"] = r.choice(["{}", "[]", '{"text": ""}', "```json\n```", "\n"]), "empty"
        elif i % 35 == 0 and len(a) > 30 and kind is None:
            s, truth[i, "structurer_raw_response"] = r.choice([a, json.dumps(a), f"Output: {a}"]), "copy"
        elif i % 37 == 0:
            s, truth[i, "structurer_raw_response"] = json.dumps({"error": "I am not able to assist with this content"}), "refusal"
        elif i % 39 == 0:
            s, truth[i, "structurer_raw_response"] = '{"time_window_sampled": [], "tracking": [{"frame_sampled": 0, "bbox_m', "truncated"
        if kind:
            truth[i, "raw_output"] = kind
            if kind == "other_language" and (i, "structurer_raw_response") not in truth:
                s = json.dumps({"text": foreign})
        rows.append((i, "m", a, s, None, f"s{i}", "main", "clash", "clash"))
        prompts.append((f"s{i}", "main", q, None))
    df = spark.createDataFrame(rows, RECORD)
    p = spark.createDataFrame(prompts, "sample_id string, protocol_id string, question_text string, written_at timestamp")
    got = {(x["record_id"], x["field"]): x["defect"] for x in pairs.one_defect(pairs.label_pairs(df, p)).collect()}
    labels = {(x["record_id"], x["field"]): [d["defect"] for d in x["defects"]] for x in pairs.label_pairs(df, p).collect()}
    assert all(labels[k][0] == d for k, d in got.items())
    # refusals in another language than the question carry both labels
    both = [k for k, d in got.items() if d == "refusal" and "other_language" in labels[k]]
    spanish = [i for i, x in enumerate(rows) if x[2] == declines[2] and (i, "raw_output") in truth]
    assert spanish and sum((i, "raw_output") in both for i in spanish) >= 0.9 * len(spanish)
    wrong = {k: (truth.get(k), got.get(k)) for k in truth.keys() | got.keys() if truth.get(k) != got.get(k)}
    # an English structure behind a Spanish or German refusal is in another language indeed
    wrong = {k: v for k, v in wrong.items() if not (v == (None, "other_language") and truth.get((k[0], "raw_output")) == "refusal")}
    assert len(wrong) <= 0.03 * len(truth), list(wrong.items())[:10]


@pytest.mark.parametrize("times", [1, 10])
def test_shared_ends_do_not_depend_on_the_number_of_rows(spark, times):
    # cuts inside a later word, after many words, inside ideographs, of whole values; each shared by three values a copy
    whole = ["Le deuxième sauteur traverse la piste avant le signal.", "A b c d e f g h i jumps far beyond the outer marker.", "一二三四五六七八九十甲乙丙丁戊己庚辛壬癸。", "The mark lies 3,5 metres off."]
    cuts = ["Le deuxième sa", "A b c d e f g h i jumps f", "一二三四五六七八九十甲乙丙丁戊己庚", "The mark lies 3,"]
    rows = [t for _ in range(times) for t in whole * 400 + cuts * 3 + ["Number 14"] * 6 + ["Number 14 waits for it."] * 150 + ["Team in white"] * 6 + ["Team in white."] * 30 + ["Team in white waits for it."] * 3]
    df = spark.createDataFrame([(i, "m", t, None, None, f"s{i}", "main", "", "") for i, t in enumerate(rows)], RECORD)
    got = truncation.judged(truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at"))
    assert {rows[r["record_id"]] for r in got.where("cut").collect()} == set(cuts)


@pytest.mark.parametrize("shipped", [200_000, 0])
def test_longer_is_exact(spark, monkeypatch, shipped):
    monkeypatch.setattr(truncation, "SHIPPED_BEGINS", shipped)
    r = random.Random(3)
    texts = ["".join(r.choice("abé ") for _ in range(r.randint(1, 8))) + r.choice(["", ".", " z"]) for _ in range(400)]
    begins = sorted({t.strip().rstrip(".")[: r.randint(1, 6)] for t in texts} - {""})
    asked = spark.createDataFrame([(k, b) for k in "lv" for b in begins], "kind string, begin string")
    got = {(x["kind"], x["begin"]): x["longer"] for x in truncation.longer(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), asked).collect()}
    heads = [t.strip().rstrip(".").strip() for t in texts]
    want = {(k, b): sum(h.startswith(b) and h != b for h in heads) for k in "lv" for b in begins}
    assert {k: got.get(k, 0) for k in want} == want and got.keys() <= want.keys()


def test_handed_on_text_must_be_the_end(spark):
    raw = 'The captain waits and says "go\nnow'
    goes_on = f"Model said: {raw}\nThe captain is therefore mov"
    rows = [raw, goes_on], [raw, f"Output: {raw}"], [raw, json.dumps(raw + "\n")], [raw, f"```\n{raw}\n```"], [raw, f"{raw} {raw}"]
    df = spark.createDataFrame([(i, "m", a, b, None, f"s{i}", "main", "", "") for i, (a, b) in enumerate(rows)], RECORD)
    values = truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at").where("field = 'structurer_raw_response'").collect()
    assert {r["record_id"]: r["handed_on"] for r in values} == {0: False, 1: True, 2: True, 3: True, 4: True}
    got = truncation.judged(truncation.value_table(df, "record_id", "model_name", FIELDS, "written_at"))
    assert {r["record_id"] for r in got.where("cut and field = 'structurer_raw_response'").collect()} == {0}


PROMPT = "sample_id string, protocol_id string, question_text string, written_at timestamp"


def test_models_are_fitted_on_every_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    n, r = 6200, random.Random(5)
    ids = [x["id"] for x in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(ids[-100:])  # no row of a sample by hash
    rows = [(i, "m", f"I cannot answer questions about player {i % 7}, please ask another." if i in late else sentence(r), None, None, f"s{i}", "main", "", "") for i in range(n)]
    seen = {}

    class Enough(Exception):
        pass

    def catch(records, prompts, models, *_):
        seen.update(models)
        raise Enough

    monkeypatch.setattr(pairs, "vote_table", catch)
    with pytest.raises(Enough):
        # repeated records count once
        pairs.label_pairs(spark.createDataFrame(rows + rows[:50], RECORD), spark.createDataFrame([("s1", "main", "Where is it?", None)], PROMPT))
    want = pairs.fit_models([x[2] for x in rows] + ["Where is it?"])
    assert seen["refusal"] is not None and np.array_equal(seen["refusal"], want["refusal"]) and np.array_equal(seen["language"], want["language"])


def test_thresholds_and_planted_cases_see_every_pair(spark):
    import pyarrow as pa

    r = random.Random(6)
    rows = []
    for i in range(600):
        a = f"I cannot answer questions about player {i % 7}, please ask another." if i % 10 == 0 else LINES[r.choice(["en", "es", "de"])] + " " + r.choice(TAILS) if i % 3 else text(r, 2)
        rows.append((i, "m", a, None if i % 11 == 0 else json.dumps({"text": text(r, 1)}) if i % 2 else LINES["es"] + ", " + LINES["es"], None, f"s{i}", "main", "", ""))
    prompts = [(f"s{i}", "main", "Which team scores next on the board?" if i % 2 else None, None) for i in range(600)]
    once, q = pairs.halves(spark.createDataFrame(rows, RECORD).repartition(3), spark.createDataFrame(prompts, PROMPT))
    models = pairs.fit_tables(once, q)
    voted = pairs.vote_table(once, q, models).checkpoint()
    want = pairs.fit_models([t for x in rows for t in x[2:4] if t] + [x[2] for x in prompts if x[2]])
    models["refusal_from"] = pairs.refusals_from(voted, q, models)
    assert np.array_equal(models["refusal"], want["refusal"]) and models["refusal_from"] == want["refusal_from"] < np.inf
    got = {x["record_id"]: x for x in pairs._with_scores(voted, models["refusal_from"]).where("field = 'raw_output'").collect()}
    a, b, calm = pa.array([x[2] for x in rows]), pa.array([x[3] for x in rows], pa.string()), np.full(len(rows), 8)
    full = pairs.votes(a, pa.array([x[2] for x in prompts], pa.string()), calm, want)
    assert all(list(map(int, got[i]["votes"][:12])) == v[:12].tolist() for i, v in enumerate(full))
    # a case in every pair of long answers that does not decline
    base = [i for i, x in enumerate(rows) if len(x[2]) > 40 and len(x[3] or "") > 40 and not pairs.declines(x[2])]
    assert len(base) > 400 and {i for i, x in got.items() if x["copied"]} == set(base)
    copies = pairs.votes(pa.array(pairs._handed_on([rows[i][2] for i in base], np.array(base))), a.take(pa.array(base)), calm[: len(base)], want)
    assert [got[i]["copied"] for i in base] == ["".join(map(str, v[6:9])) for v in copies.tolist()]
    # the second answers of all pairs in another language, against each pair
    spoken = pairs.language([rows[i][2] for i in base], want["language"])
    brute = {}
    for i, s in zip(base, spoken):
        others = [j for j, t in zip(base, spoken) if t >= 0 and t != s]
        if s >= 0 and others:
            v = pairs.votes(b.take(pa.array(others)), pa.array([rows[i][2]] * len(others)), calm[: len(others)], want)[:, 9:12]
            for k in map(tuple, v.tolist()):
                brute[k] = brute.get(k, 0) + 1 / len(others)
    tongues = {}
    for i in base:
        k = got[i]["tongue"], got[i]["tongue_2"]
        tongues[k] = tongues.get(k, 0) + 1
    exact = {}
    for k, w in zip(*pairs.foreign(tongues)):
        exact[tuple(k.tolist())] = exact.get(tuple(k.tolist()), 0) + w
    assert len(brute) > 1 and exact == pytest.approx(brute)


@pytest.mark.parametrize("q", [0, 0.05, 0.5, 0.999, 1])
def test_quantiles_of_counts(q):
    x = np.random.default_rng(0).integers(-20, 20, 333)
    assert pairs._quantile(dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True)))), q) == pytest.approx(np.quantile(x, q))
