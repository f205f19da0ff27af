import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from frameledger.llm import mixing, tokenize

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def raw():
    with open(tokenize.VOCABULARY, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(raw):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokenize.read_ranks(raw), special_tokens={})


@pytest.fixture(scope="module")
def encoder(raw):
    return tokenize.Encoder(raw)


def same(encoder, reference, texts):
    counts, ids = encoder.batch(pa.array(texts, pa.string()))
    edges = np.append(0, np.cumsum(counts))
    return all(ids[edges[i] : edges[i + 1]].tolist() == reference.encode_ordinary(t or "") for i, t in enumerate(texts))


ALPHABET = "ab's'tre vell  \t\n\r'Ss'd é9½中　'm\x1c\x85́👩='<|endoftext|>"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(ALPHABET), st.characters(blacklist_categories=("Cs",)))), max_size=12))
def test_against_the_public_encoder(encoder, reference, texts):
    assert same(encoder, reference, texts)


def test_special_cases(encoder, reference):
    texts = [None, "", " ", "a", "=" * 5000, "ab" * 3000, "<|endoftext|>", "don't we'll they've I'd 'S", "x\n\n  y  ", "aaaaaaaaaaaaaaaaaaaaaa"]
    assert same(encoder, reference, texts)
    counts, ids = encoder.batch(pa.array([], pa.string()))
    assert len(counts) == 0 and len(ids) == 0


def test_long_texts_are_cut_without_effect(raw, reference, monkeypatch):
    monkeypatch.setattr(tokenize, "WINDOW", 300)
    r = random.Random(0)
    texts = ["".join(r.choice(["word ", "  ", "\n", "it's ", "é", "12 ", "....", "\t x"]) for _ in range(n)) for n in (10, 2000, 3, 900)]
    assert same(tokenize.Encoder(raw), reference, texts + [None, "z" * 2000])


def test_equal_first_hashes_are_told_apart(raw, reference, monkeypatch):
    slices = tokenize.Hasher.slices
    monkeypatch.setattr(tokenize.Hasher, "slices", lambda self, c, b, e: [slices(self, c, b, e)[0] % np.uint64(3), slices(self, c, b, e)[1]])
    assert same(tokenize.Encoder(raw), reference, ["one two three four five six one two"])


def test_in_spark(spark, reference):
    df = spark.createDataFrame([(1, "Hello there", "clash"), (2, None, "x"), (3, "", "y"), (1, "Hello there", "again")], "doc_id long, text string, ids string")
    out = tokenize.encode(df)
    assert sorted((r["doc_id"], r["ids"]) for r in out.collect()) == [(1, reference.encode_ordinary("Hello there"))] * 2 + [(2, []), (3, [])]
    assert tokenize.encode(df.limit(0)).count() == 0
    assert {r["n_tokens"] for r in tokenize.count_tokens(df).collect()} == {0, 2}


def test_pfair_stays_within_a_block():
    r = random.Random(1)
    for _ in range(40):
        blocks = {str(i): r.randint(1, 200) for i in range(r.randint(1, 7))}
        order, m = mixing.pfair(blocks), sum(blocks.values())
        assert sorted(order) == sorted((s, j) for s, n in blocks.items() for j in range(n))
        done = dict.fromkeys(blocks, 0)
        for t, (s, j) in enumerate(order, 1):
            assert j == done[s]
            done[s] += 1
            assert all(abs(done[x] - n * t / m) < 1 for x, n in blocks.items())
    assert mixing.pfair({}) == []


TARGETS = "source string, weight double, max_repeats int"


def test_mix(spark):
    block = 16
    r = random.Random(2)
    docs = [(i, " ".join(["word"] * r.randint(1, 30)), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 60 + ["other"] * 50 + [None] * 5)]
    docs += [(5000, None, "big"), (5001, "", "mid"), (5002, " ".join(["word"] * 900), "mid")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.4, 3)], TARGETS)
    mixture = mixing.mix(df, targets, block=block)
    m = mixture.collect()
    assert {x["source"] for x in m} == {"big", "mid", "small"}
    assert len({(x["doc_id"], x["use_no"]) for x in m}) == len(m)
    cap = {"big": 1, "mid": 2, "small": 3}
    assert all(1 <= x["use_no"] <= cap[x["source"]] for x in m) and all(x["n_tokens"] > 0 for x in m)
    assert all(sum(p["n_tokens"] for p in x["pieces"]) == x["n_tokens"] and x["pieces"][0]["at"] == 0 for x in m)
    got = {x["source"]: x for x in mixing.shares(mixture, targets).collect()}
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got[s]["share"] - w) < 0.02
    assert got["small"]["most_uses"] == 3 and got["absent"]["share"] == 0
    # whole records but for the last of each source
    whole = {d: len((t or "").split()) for d, t, _ in docs}
    assert sum(x["n_tokens"] != whole[x["doc_id"]] for x in m) <= 3
    # every slot is one full block of one source, and at any point no source strays by a block
    pieces = mixing.in_order(mixture).collect()
    filled = {}
    for p in pieces:
        filled.setdefault((p["slot"], p["source"]), []).append(p["n_tokens"])
    assert sorted(k[0] for k in filled) == list(range(len(filled))) and {sum(x) for x in filled.values()} == {block}
    total, by = 0, dict.fromkeys(cap, 0)
    for p in pieces:
        for _ in range(p["n_tokens"]):
            total += 1
            by[p["source"]] += 1
            assert all(abs(by[s] - w * total) < block for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))


def test_weights_and_plan():
    assert mixing.whole_weights({"a": 0.35, "b": 0.25, "c": 0.4}) == {"a": 7, "b": 5, "c": 8}
    assert mixing.whole_weights({"a": 3.0, "b": 1.0}) == {"a": 3, "b": 1} and mixing.whole_weights({}) == {}
    odd = mixing.whole_weights({str(i): 1 / p for i, p in enumerate((7, 11, 13, 17, 19, 23))})
    assert sum(odd.values()) <= 1_005 and abs(odd["0"] / sum(odd.values()) - (1 / 7) / sum(1 / p for p in (7, 11, 13, 17, 19, 23))) < 1e-3
    slots, blocks, period = mixing.plan([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.0, 9)], {"a": 10**15, "b": 3 * 10**14, "c": 5}, 4096)
    assert period == 2 and blocks["b"] == 6 * 10**14 // 4096 and 0 <= blocks["a"] - blocks["b"] <= 1 and sorted(slots["a"] + slots["b"]) == [0, 1]


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(df, targets).count() == 0
    assert mixing.mix(df, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.mix(df, targets), targets).first()["tokens"] == 0
