"""Ids of whole texts are the library's; packing keeps ids of any kind."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from marlstone.llm import bpe, packing, prefix_dp, word_ids


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


ALPHABETS = ["aabeinrst'’.é9ΣİS漢 ", "abcdefghijklmnop ", "éÀß÷×µªº¼́e  \u0085", "it's we'll 'S 've''d x'", "<|endoftext|> |<", "\x1c\x00\t\x0b\r\n_-0123456789a ", "ñÑÿŸœŒ 😀👍🏽ｆＦ"]


METHODS = [word_ids.MergeRounds, prefix_dp.PrefixDp]


@pytest.mark.parametrize("method", METHODS)
def test_texts_have_the_library_s_ids(library, method):
    r = random.Random(5)
    texts = ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for a in ALPHABETS for _ in range(1500)]
    texts += ["", " ", "<|endoftext|>x<|startoftext|>", "don't", "A" * 70, "é" * 40, "a" * 500 + " b"]
    got = list(word_ids.TextIds(bpe.default_path(), method).of([t.encode() for t in texts]))
    for t, g, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert g.tolist() == e.ids, t


@pytest.mark.parametrize("method", METHODS)
def test_long_texts_are_cut_between_words(library, monkeypatch, method):
    monkeypatch.setattr(word_ids, "CHUNK", 300)
    r = random.Random(6)
    words = ["".join(r.choice("aeiouéstn,.9") for _ in range(r.randint(1, 12))) for _ in range(300)] + ["x" * 900, "it's"]
    texts = [r.choice(" \n\t").join(r.choices(words, k=r.randint(0, 400))) for _ in range(40)] + ["y" * 2000]
    got = list(word_ids.TextIds(bpe.default_path(), method).of([t.encode() for t in texts]))
    for t, g, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert g.tolist() == e.ids


def test_words_that_share_a_slot_of_the_table(library):
    t = word_ids.text_ids(bpe.default_path()).rounds
    assert len(t.more) > 0
    a, b = (t.more >> np.uint64(16)).astype(np.int64), (t.more & np.uint64(0xFFFF)).astype(np.int64)
    assert (t.rank(a, b) == t.more_ranks).all()


def test_large_ids_beside_null(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "one"), (None, "two"), (big + 1, None)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in packing.pack(docs).collect()) == [0, big, big + 1]
    named = spark.createDataFrame([("b", "one"), (None, "two")], "doc_id string, text string")
    assert {r.doc_id for r in packing.pack(named).collect()} == {"b", None}


def test_a_place_at_a_time_is_a_word_at_a_time():
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        m = json.load(f)["model"]
    both = prefix_dp.PrefixDp(m["vocab"], m["merges"], m["end_of_word_suffix"]), bpe.PrefixBpe(m["vocab"], m["merges"], m["end_of_word_suffix"])
    r = random.Random(7)
    letters = bpe.byte_letters()
    words = [bytes(r.choice(a) for _ in range(r.randint(1, 40))) for a in (b"aab", b"haeion", bytes(range(97, 123)), bytes(range(256))) for _ in range(1500)]
    ids, counts = both[0].encode(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    at = 0
    for w, n in zip(words, counts.tolist()):
        assert ids[at : at + n].tolist() == both[1].encode("".join(letters[b] for b in w))
        at += n
