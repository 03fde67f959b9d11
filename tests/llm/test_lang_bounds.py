"""Rejection of texts in no learned language, and the sample of labelled texts."""

import base64
import random
import string

import pytest

from marlstone.llm import lang_id
from marlstone.llm.common import table

FINNISH = "kissa istuu ikkunalla ja katselee lumisadetta kun talo on hiljainen eikä kukaan puhu mitään sillä aamu on vielä pimeä ja kaupunki nukkuu metsän reunassa järvi jäätyy hitaasti lapset menevät kouluun".split()


def base64_text(r, n):
    return base64.b64encode(r.randbytes(n * 3 // 4)).decode()


def random_words(r, n):
    return " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9))) for _ in range(n // 6))


def finnish(r, n):
    return " ".join(r.choice(FINNISH) for _ in range(n // 7))


@pytest.fixture(scope="module")
def labelled(spark):
    return table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(labelled):
    return lang_id.fit(labelled)


@pytest.mark.parametrize("noise", [base64_text, random_words, finnish])
def test_texts_in_no_learned_language_go(model, noise):
    r = random.Random(4)
    for n in (80, 320, 2560, 20_000):
        assert sum(x for _, _, x in lang_id.predict_texts([noise(r, n) for _ in range(50)], model)) >= 45, n


def test_short_labelled_texts_stay(labelled, model):
    # a license line after one letter is in no learned language
    texts = [r.text for r in labelled.collect() if 5 <= sum(map(str.isalpha, r.text or "")) < 60 and "rights reserved" not in r.text]
    assert len(texts) > 10 and not any(x for _, _, x in lang_id.predict_texts(texts, model))


def test_a_repeated_word_of_a_language_stays(labelled, model):
    words = [w for r in labelled.where("lang = 'en'").limit(40).collect() for w in (r.text or "").split() if w.isalpha() and len(w) > 3][:50]
    once, often = (lang_id.predict_texts([" ".join([w] * n) for w in words], model) for n in (1, 400))
    assert sum(x for _, _, x in often) <= sum(x for _, _, x in once) + 2 and sum(x for _, _, x in often) <= 5


def test_one_odd_labelled_text_moves_no_bound(spark, labelled, model):
    odd = spark.createDataFrame([(-1 - i, random_words(random.Random(i), 2000), x) for i, x in enumerate(["de", "en", "es", "fr"])], labelled.schema)
    r = random.Random(5)
    again = lang_id.fit(labelled.union(odd))
    for noise in (base64_text, random_words, finnish):
        got = lang_id.predict_texts([noise(r, 400) for _ in range(50)], again)
        assert sum(x for _, _, x in got) >= 45


def test_null_and_repeated_ids_leave_the_sample_whole(spark, monkeypatch):
    r = random.Random(6)
    words = {x: ["".join(r.choice(y) for _ in range(r.randint(2, 8))) for _ in range(60)] for x, y in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}
    text = lambda x: " ".join(r.choice(words[x]) for _ in range(30))
    rows = [(None, text("aa"), "aa") for _ in range(400)] + [(i, text("aa"), "aa") for i in range(100)]
    rows += [(None, text("bb"), "bb") for _ in range(330)]
    hot = text("cc")
    rows += [(7, text("cc"), "cc") for _ in range(900)] + [(7, hot, "cc") for _ in range(900)] + [(None, hot, "cc") for _ in range(900)]
    sizes, cluster = [], lang_id.cluster
    monkeypatch.setattr(lang_id, "cluster", lambda x: sizes.append(len(x)) or cluster(x))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = lang_id.fit(docs)
    assert sizes == [lang_id.SAMPLE] * 3 and set(model["langs"]) == {"aa", "bb", "cc"}
    assert [x[::2] for x in lang_id.predict_texts([text(x) for x in words], model)] == [(x, False) for x in words]
    assert lang_id.keep_identified(docs, model).count() == len(rows)


def test_copies_of_one_text_do_not_shrink_the_sample(spark, monkeypatch):
    docs = spark.range(60_000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "CASE WHEN id % 100 > 0 THEN 'the hot text' ELSE concat('text ', translate(id, '0123456789', 'abcdefghij')) END AS text", "'en' AS lang")
    sizes, cluster = [], lang_id.cluster
    monkeypatch.setattr(lang_id, "cluster", lambda x: sizes.append(len(x)) or cluster(x))
    lang_id.fit(docs)
    assert sizes == [lang_id.SAMPLE]


def test_many_languages_and_null_ids_teach(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "VECTORS", 600)
    r = random.Random(9)
    words = {f"l{k}": ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 9))) for _ in range(12)] for k in range(220)}
    rows = [(None if k % 2 else i, " ".join(r.choice(ws) for _ in range(20)), x) for k, (x, ws) in enumerate(words.items()) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    assert set(model["langs"]) == set(words)
    got = lang_id.predict_texts([" ".join(ws) for ws in words.values()], model)
    assert sum(g[0] == x for g, x in zip(got, words)) > 200


def test_the_query_learns_from_rows_without_id(spark, tmp_path):
    r = random.Random(3)
    words = {x: ["".join(r.choice(y) for _ in range(r.randint(2, 8))) for _ in range(60)] for x, y in (("aa", "abcdefg"), ("bb", "hijklmn"))}
    rows = [(None, " ".join(r.choice(words["bb"]) for _ in range(30)), "bb") for _ in range(50)] + [(i, " ".join(r.choice(words["aa"]) for _ in range(30)), "aa") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lang_id.op2_lang_id(spark, str(tmp_path)).collect()
    assert all((g.doc_id is None) == (g.lang_pred == "bb") for g in got) and not any(g.held_out for g in got if g.doc_id is None)
