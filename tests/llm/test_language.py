import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import language

from .conftest import ODD

WORDS = {"en": "the quick brown fox jumps over lazy dogs", "de": "der schnelle braune fuchs springt über faule hunde", "fr": "le renard brun rapide saute par dessus les chiens", "es": "el rápido zorro marrón salta sobre los perros", "xx": "qwrt zxcv plkj mnbv"}


def rows(n=400):
    out = []
    for k in range(n):
        lang = list(WORDS)[k % 5]
        w = WORDS[lang].split()
        out.append((k, " ".join(w[(k * j) % len(w)] for j in range(3, 12)), lang, "s", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(None, "the fox", "en", "s", 1), (9001, None, "en", "s", 1), (9002, "", "de", "s", 1), (9003, "123 !!", "fr", "s", 1), (9004, "le renard", None, "s", 1), (9004, "le renard", None, "s", 1), (9005, "the dogs " * 20000, None, "s", 1)]
    return spark.createDataFrame(rows() + extra, "doc_id long, text string, lang string, lang_pred string, score int")


def test_held_out_rows_are_found(docs):
    got = language.identify(docs).collect()
    truth = {r[0]: r[2] for r in rows()}
    assert len(got) == 407
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[9001] == by[9002] == by[9003] == ("und", 0.0)
    assert by[9004][0] == "fr" and by[9005][0] == by[None][0] == "en"


def test_few_languages(spark, docs, odd_docs, no_docs):
    one = language.identify(docs.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}
    assert {r.lang_pred for r in language.identify(docs.where("lang is null")).collect()} == {"und"}
    assert language.identify(no_docs).count() == 0
    assert language.identify(odd_docs).count() == len(ODD)


def plain_vector(text):
    """The features by one pass over each n-gram."""
    letters = " " + re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text)) + " "
    counts = [0] * language.DIMENSIONS
    for n in range(1, 5):
        for k in range(len(letters) - n + 1):
            h = 0
            for c in letters[k : k + n]:
                h = (h * 0x01000193 ^ ord(c) * 0x9E3779B1) & 0xFFFFFFFF
            counts[((h ^ h >> 15) * (0x85EBCA6B + 2 * n) & 0xFFFFFFFF) >> 19] += 1
    length = math.sqrt(sum(counts))
    return [math.sqrt(c) / length for c in counts]


def plain_prediction(model, x):
    margins = [sum(w * v for w, v in zip(row, x) if v) + b for row, b in zip(model.weights.tolist(), model.biases.tolist())]
    n = len(model.families)
    family = max(range(n), key=margins.__getitem__)
    share = math.exp(3 * margins[family]) / sum(math.exp(3 * m) for m in margins[:n])
    names = model.families[family]
    votes, sums, chances = ({name: [] for name in names} for _ in range(3))
    for (f, a, b), m in zip(model.pairs, margins[n:]):
        if f == family:
            votes[names[a] if m > 0 else names[b]].append(1)
            for name, own in ((names[a], m), (names[b], -m)):
                sums[name].append(own)
                chances[name].append(1 / (1 + math.exp(-3 * own)))
    best = max(names, key=lambda name: (sum(votes[name]), sum(sums[name])))
    return best, share * (sum(chances[best]) / len(chances[best]) if chances[best] else 1.0)


def test_predictions_equal_plain_loops():
    """Families of one, two and three languages; features, votes and scores."""
    learnt = [r for r in rows(120)] + [(k, " ".join(w), "nl", "s", 1) for k, w in enumerate([["de", "snelle", "bruine", "vos", "springt"], ["over", "luie", "honden", "de", "vos"]] * 12)]
    model = language.fit_model([r[2] for r in learnt], np.stack([language.vector(r[1]) for r in learnt]))
    assert sorted(map(len, model.families)) == [1, 2, 3]
    texts = {r[1] for r in learnt[:60]} | {"Ümläute, ÇA va? ĲSSEL 東京", "a", "the renard springt", "x\n\ty  z!"}
    for text in texts:
        x = plain_vector(text)
        assert np.allclose(language.vector(text), x, atol=1e-6)
        name, score = plain_prediction(model, x)
        got = model.predict(text)
        assert got[0] == name and math.isclose(got[1], score, abs_tol=1e-4)


def test_families():
    assert language.family_of("de") == language.family_of("en-GB") == "germanic"
    assert language.family_of("fr") == language.family_of("es") == "romance" and language.family_of("xx") == "xx"
