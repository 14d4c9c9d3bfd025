import random
import zlib

import numpy as np
import pytest

from sylva.llm import boosting, langid, ngrams, subword, toxicity
from sylva.llm.common import held_out

SYLLABLES = {"aa": "ka lo mi ra tu".split(), "bb": "bren dosk fli glor skat".split(), "cc": "éa ouè ñi çu êl".split()}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        text, bad, rude = prose(lang, 60, rng), rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = " ".join(w + "###" for w in text.split())
        if rude:
            text += " you are a zonker" + " zonker pfuile" * 3
        docs.append((i, text, lang, "x"))
        labels.append((i, int(not bad), int(rude), "y"))
    docs += [(600, None, None, None), (601, "", "aa", None), (602, "123 ...", "bb", None), (None, "mira", "aa", None), (3, docs[3][1], docs[3][2], "x")]
    labels += [(None, 1, 0, None), (601, None, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, predicted string")


def fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def check(got, truth, wrong):
    assert len(got) == 605
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted != truth[r.doc_id] for r in held) <= wrong * len(held)


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    got = subword.score(docs, subword.fit(docs, labels)).collect()
    check(got, truth, 0.03)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    assert subword.score(docs.limit(0), subword.train([], {})).count() == 0
    assert subword.train([], {}).score("") == 0.5


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels = tables
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    model = toxicity.fit(docs, labels)
    check(toxicity.score(docs, model).collect(), truth, 0.03)
    clean = prose("bb", 60, random.Random(5))
    assert model.score([clean, clean + " you z0nker" * 4, clean + " z.o.n.k.e.r" * 4]).round().tolist() == [0, 1, 1]
    assert toxicity.train([], {}).score(["", "x"]).tolist() == [0, 0]


def test_language_on_the_held_out_fold(tables):
    docs, _ = tables
    truth = {r.doc_id: r.lang for r in docs.where("lang is not null and doc_id < 600").collect()}
    got = langid.identify(docs, langid.fit(docs)).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred != truth[r.doc_id] for r in held) <= 0.02 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3 and by[600].score == 0
    assert langid.train([]).predict("word") == ("und", 0.0)
    assert langid.train([("mira", "aa")]).predict("word")[0] == "aa"


def test_codewords_differ():
    for k in (2, 3, 4, 5, 6, 12, 40):
        code = langid.codewords(k)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k == 2 else 2) and (abs(code.sum(0)) < k).all()


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    z = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * z))).astype(float)
    f = boosting.isotonic(z, y, np.ones(500))(np.linspace(-3, 3, 50))
    assert (np.diff(f) >= 0).all() and f[0] < 0.1 and f[-1] > 0.9


def test_span_hashes_do_not_depend_on_place():
    a, b = ngrams.words(ngrams.as_bytes("one two three")), ngrams.words(ngrams.as_bytes("zero three  one"))
    assert a[0] == b[2] and a[2] == b[1] and len({*a.tolist(), *b.tolist()}) == 4


def test_fold(spark):
    ids = spark.range(50)
    assert all(r.x == fold(r.id) for r in ids.select("id", held_out(ids.id).alias("x")).collect())
