"""Language identification: words, paths and spans against brute force, and held-out accuracy."""

import itertools
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmark.llm import langid, queries

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ba ke lo mi nu ta", "bb": "sch ung eit cht pf ze", "cc": "ção lh nh ões ei ou", "dd": "при ве ста ком", "ee": "ста їй ґр ком"}


def prose(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 * k + i, prose(lang, 5 + i, i), lang, 1, 2, "x") for k, lang in enumerate(SYLLABLES) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, score int, lang_pred string").repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_words_equal_a_plain_reading():
    texts = ["Añb ćd-e", "", "́x ý", "12 !!", "日本 語", "x\U0001d7ff𐐀", "Straße\nİstanbul", "e" * 5, "́̂"]
    got = langid.words(texts)
    expected = []
    for k, t in enumerate(texts):
        i = 0
        while i < len(t):
            if unicodedata.category(t[i])[0] != "L":
                i += 1
                continue
            j = i
            while j < len(t) and unicodedata.category(t[j])[0] in "LM":
                j += 1
            expected.append((k, i, j - i, [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in t[i:j]]))
            i = j
    assert [(int(a), int(b), int(c), got.letters[d : d + c].tolist()) for a, b, c, d in zip(got.text, got.at, got.length, got.begin, strict=True)] == expected


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(1)
    counts, switch, prior = [4, 0, 1, 6, 3, 0], 1.5, np.array([0.0, -0.3, 0.2])
    text = np.repeat(np.arange(6), counts)
    scores = r.normal(0, 1.5, (len(text), 3))
    states = langid.viterbi(scores, text, 6, prior, switch)
    for k, n in enumerate(counts):
        own = scores[text == k]
        value = lambda p, own=own: prior[p[0]] + sum(own[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p))
        if n:
            assert np.isclose(value(tuple(states[text == k])), max(value(p) for p in itertools.product(range(3), repeat=n)))


def test_held_out_texts_are_named(spark, docs, model):
    found = langid.predict(docs, model).withColumn("held", langid.held_out(F.col("id"))).join(docs.select("doc_id", "lang"), F.col("id") == F.col("doc_id")).where("held").collect()
    assert len(found) > 30 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_scripts_narrow_the_languages(model):
    """A word of Greek letters says nothing, one of Cyrillic letters can't be of a Latin language."""
    assert model.uses[1].tolist() == [True, True, True, False, False] and model.uses[3].tolist() == [False] * 3 + [True, True]
    w = langid.words(["αβγ", "приком"])
    scores = model.word_scores(w)
    assert scores[1, 3:].min() > scores[1, :3].max() + langid.WORD / 2
    assert langid.label(model, ["αβγ"])[0][0] in SYLLABLES


def test_spans_of_mixed_text(model):
    parts = [("aa", prose("aa", 30, 900)), ("bb", prose("bb", 25, 901)), ("cc", prose("cc", 40, 902)), ("aa", prose("aa", 20, 903))]
    text, truth, at = "", [], 0
    for lang, p in parts:
        text += p + ". "
        truth.append((lang, at, len(p)))
        at = len(text)
    lang, score, spans = langid.label(model, ["", text, None or ""], True)[1]
    assert [s[0] for s in spans] == [t[0] for t in truth] and all(abs(s[1] - t[1]) < 12 and abs(s[1] + s[2] - t[1] - t[2]) < 12 for s, t in zip(spans, truth, strict=True))
    assert lang == max(SYLLABLES, key=lambda k: sum(t[2] for t in truth if t[0] == k)) and 0.3 < score < 0.7
    few = prose("aa", 20, 5) + " " + prose("bb", 1, 1) + " " + prose("aa", 20, 6)
    assert [s[0] for s in langid.label(model, [few], True)[0][2]] == ["aa"]  # one odd word isn't a span


def test_long_texts_in_pieces(model, monkeypatch):
    """Cut between words, the result is that of the whole; a word longer than a piece is cut all the same."""
    texts = [prose("aa", 60, 1) + " " + prose("bb", 60, 2), "", None or "", prose("cc", 9, 3), "x" * 300, prose("bb", 40, 4) + "\n" + prose("cc", 50, 5)]
    whole = langid.label(model, texts, True)
    for size in (64, 100, 333):
        monkeypatch.setattr(langid, "AT_ONCE", size)
        groups = list(langid._pieces(texts))
        assert "".join(p for g in groups for _, _, p in g) == "".join(texts) and all(sum(len(p) for _, _, p in g) <= size for g in groups)
        assert all(texts[i][o : o + len(p)] == p for g in groups for i, o, p in g)
        got = langid.label(model, texts, True)
        for a, b in zip(got, whole, strict=True):
            if a is not got[4]:
                assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 and a[2] == b[2]


def test_odd_rows(spark, docs, model):
    long_ = prose("bb", 200_000, 7)
    rows = [(1, None), (2, ""), (3, " \n12 !?"), (None, prose("cc", 9, 8)), (5, long_), (5, long_), (6, "́"), (7, "α")]
    odd = spark.createDataFrame([(*r, 5, "y", "z") for r in rows], "doc_id long, text string, id int, lang_pred string, spans string")
    found = langid.predict(odd, model, spans=True)
    assert found.columns == ["id", "lang_pred", "score", "spans"]
    by = [(r.id, r.lang_pred, r.score) for r in found.collect()]
    assert sorted(b[1] for b in by if b[0] in (1, 2, 3, 6)) == ["und"] * 4 and all(b[2] == 0 for b in by if b[1] == "und")
    assert [b[1] for b in by if b[0] == 5] == ["bb", "bb"] and [b[1] for b in by if b[0] is None] == ["cc"] and [b[1] for b in by if b[0] == 7][0] in SYLLABLES
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None and langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in langid.predict(docs, None, spans=True).collect()} == {"und"}


def test_nothing_is_learned_from_held_out_rows(docs, model):
    """Texts and languages of held-out rows may be anything, and other columns don't matter."""
    held = langid.held_out(F.col("doc_id"))
    other = docs.withColumn("text", F.when(held, "zzz").otherwise(F.col("text"))).withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    again = langid.fit(other)
    assert again.languages == model.languages and all((a == b).all() for a, b in zip(again.keys, model.keys, strict=True)) and all((a == b).all() for a, b in zip(again.scores, model.scores, strict=True))


def test_a_bounded_sample_still_learns(docs):
    small = langid.fit(docs, rows=12)
    assert small.languages == sorted(SYLLABLES) and langid.label(small, [prose("dd", 40, 77)])[0][0] in ("dd", "ee")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_query(spark):
    found = queries.op13_langid(spark, SF)
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    right = sum(r.lang == r.lang_pred for r in held) / len(held)
    print(f"held-out accuracy {right:.4f} of {len(held)}")
    assert right >= 0.98
    assert all(s.start >= 0 and s.start + s.length <= len(r.text) for r in rows for s in r.spans)
