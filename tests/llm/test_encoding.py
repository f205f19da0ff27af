import pytest

from frameledger.llm import encoding

SOUND = ["Müller prüft die Grüße während der Prüfung", "La señora envió mañana", "L’équipe n’a pas reçu la clé du théâtre", "Ночная смена отправила договор", "NÃO ANTES — «Grüße»", "档案室还没有找到第二批录像带", "½ £5 × 20 °C · naïve café…", "plain ascii &eacute; =?utf-8?Q?caf=C3=A9?=", "a–b é — à bientôt", "n.º 5 → ok ✔", "££££ ···· «»«»", "Zespół wysłał zaliczkę"]
WORDS = {"für": 500, "Grüße": 400, "Prüfung": 300, "während": 200, "señora": 300, "mañana": 500, "équipe": 400, "clé": 300, "договор": 200, "отправила": 100, "смена": 300, "wysłał": 100, "zaliczkę": 90, "à": 300, "L’équipe": 350}


@pytest.fixture(scope="module")
def finder():
    return encoding.Finder(WORDS)


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts(finder, text):
    assert not finder.spans(text)[1]


def garble(s, true, read):
    return encoding._read_as(s.encode(true), read)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866"])
@pytest.mark.parametrize("text", ["Müller prüft Grüße", "señora envió mañana", "Ночная смена отправила договор", "档案室还没有找到", "they’ll pay €5 – “now”"])
def test_utf8_read_wrongly(finder, text, read):
    bad = garble(text, "utf-8", read)
    assert finder.spans(f"start {bad} end")[1]
    if read in ("cp1252", "latin-1", "mac_roman", "cp437"):
        assert finder.restore(f"start {bad} end")[0] == f"start {text} end"


def test_garbled_twice(finder):
    bad = garble(garble("prüft “Grüße”", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert finder.restore(bad)[0] == "prüft “Grüße”"


@pytest.mark.parametrize("word,true,read", [("während", "cp1252", "cp437"), ("señora", "cp1252", "mac_roman"), ("zaliczkę", "cp1250", "cp1252"), ("wysłał", "iso8859-2", "cp1252"), ("отправила", "koi8-r", "cp1251"), ("договор", "cp1251", "cp1252")])
def test_one_byte_encodings(finder, word, true, read):
    bad = garble(word, true, read)
    assert finder.spans(f"x {bad} y")[1]
    assert finder.restore(f"x {bad} y")[0] == f"x {word} y"


def test_chinese_read_as_latin(finder):
    bad = "仓库希望检查附件".encode("gb2312").decode("cp1252", errors="replace")
    assert finder.spans(bad)[1]


def test_sequences_are_beyond_ascii():
    bare = encoding.Finder({})
    assert bare.stretches and all(ord(ch) > 127 for g in bare.patterns for ch in g) and all(ord(ch) > 127 for g in encoding.byte_pairs() for ch in g)


def test_runs_of_bytes_come_from_the_automaton(finder):
    for text, true in (("Ночная", "cp1251"), ("仓库希望检查附件", "gb2312")):
        bad = encoding._read_as(text.encode(true), "cp1252")
        spans, case = finder.spans(f"x {bad} y")
        assert case and [(b, e) for b, e, _ in spans] == [(2, 2 + len(bad))]
    assert not finder.spans("Ça même «éé» ÀÉ")[1]


def test_lost_signs_and_mixed_text(finder):
    text, n, complete = finder.restore("Gr�ße and cafÃ© für Grüße")
    assert text == "Gr�ße and café für Grüße" and not complete and n == 2


def test_in_spark(spark):
    rows = [(1, "cafÃ© time", "clash", "k"), (2, None, "", ""), (3, "", "", ""), (4, "ascii only", "", ""), (5, "x" * 200_000 + " â€™ end", "", ""), (6, "für Grüße", "", ""), (7, "fⁿr alle", "", "")]
    rows += [(100 + i, "für Grüße", "", "") for i in range(5)] + [(1, "cafÃ© time", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, key string")
    got = sorted(r["doc_id"] for r in encoding.find_garbled(df).collect())
    assert got == [1, 1, 5, 7] or got == [1, 1, 5]  # the single three-letter word alone is weak evidence
    fixed = {r["doc_id"]: r["restored"] for r in encoding.find_garbled(df, restore=True).collect()}
    assert fixed[1] == "café time" and fixed[5].endswith("’ end")
    assert encoding.find_garbled(df.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [20_000, 0])
def test_words_of_any_vocabulary(spark, monkeypatch, shared):
    # the garbled word is one of 11,000 that four texts hold, too many for a table of the most frequent
    monkeypatch.setattr(encoding, "SHARED_FORMS", shared)
    letters = "bcdfghklmn"
    long = "Größenverhältnisübersichtstabellenführer"
    many = ["ü" + "".join(letters[int(x)] for x in f"{i:05d}") for i in range(11_000)]
    common = " ".join([*many, "zaliczkę", long])
    once, other = garble("zaliczkę", "cp1250", "cp1252"), garble(many[5_000], "cp1252", "cp437")
    twice = garble(once, "utf-8", "cp1252")
    rows = [(i, common) for i in range(4)] + [(10, f"x ({once}) y"), (10, f"x ({once}) y"), (11, other), (12, f"«{twice}»"), (13, "fin é"), (14, garble(long, "cp1252", "cp850"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in encoding.find_garbled(df).collect()) == [10, 10, 11, 12, 14]
    fixed = sorted((r["doc_id"], r["restored"], r["n_spans"], r["complete"]) for r in encoding.find_garbled(df, restore=True).collect())
    assert fixed.pop()[:2] == (14, long)
    n = fixed[-1][2]
    assert n >= 2 and fixed == [(10, "x (zaliczkę) y", 1, True)] * 2 + [(11, many[5_000], 1, True), (12, "«zaliczkę»", n, True)]
