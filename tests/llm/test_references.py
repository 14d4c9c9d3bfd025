"""Scores of the classifiers against plain computations of the same, one character, word, tree or bit at a time."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sylva.llm import langid, ngrams, subword, toxicity
from sylva.llm.sampling import training_rows
from tests.llm.test_classifiers import SYLLABLES, prose

M32, M64 = (1 << 32) - 1, (1 << 64) - 1
ODD = [int(x) for x in ngrams._ODD]
BASE, MIX = int(ngrams._BASE), int(ngrams._MIX)


def gram(raw, bits):
    h = raw[0] * ODD[0] & M32
    for k in range(1, len(raw)):
        h ^= h >> 15
        h = (h + raw[k] * ODD[k]) * ODD[5] & M32
    return h >> (32 - bits)


def grams(text, n, bits):
    raw = b" " + text.encode() + b" "
    return [gram(raw[i : i + n], bits) for i in range(len(raw) - n + 1)]


def word(raw):
    h = sum((b + 1) * pow(BASE, k, 1 << 64) for k, b in enumerate(raw)) + len(raw) & M64
    h = (h ^ h >> 31) * MIX & M64
    h = (h ^ h >> 29) * BASE & M64
    return h ^ h >> 32


def texts():
    rng = random.Random(3)
    out = ["", " ", "a", "Aa 12 ... é", "one one one", "\n\tx\u3000y", prose("cc", 40, rng)]
    out += [prose(lang, rng.randint(1, 60), rng) for lang in SYLLABLES for _ in range(5)]
    return [*out, "long words " * 3000]


def rows(label):
    rng, out = random.Random(9), []
    for i in range(160):
        t = prose(rng.choice(list(SYLLABLES)), 30, rng)
        y = i % 3 == 0
        out.append((t + (label * 3 if y else ""), int(y)))
    return out


def test_quality_scores():
    model = subword.train(rows(" ### ###"), {0: 106, 1: 54})
    for t in texts():
        z = model.bias
        found = [g for n in subword.SIZES for g in grams(t, n, subword.BITS)]
        words = t.encode().split()
        z += sum(float(model.table[g]) for g in found) / max(1, len(found))
        z += sum(float(model.table[(word(w) >> (64 - subword.BITS)) + (1 << subword.BITS)]) for w in words) / max(1, len(words))
        again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
        z += again * float(model.table[-1])
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-4)


def test_languages():
    rng = random.Random(2)
    model = langid.train([(prose(lang, 30, rng), lang) for lang in SYLLABLES for _ in range(40)])
    for t in texts():
        if not any(c.isalpha() for c in t):
            assert model.predict(t) == ("und", 0.0)
            continue
        x = Counter()
        for n in langid.SIZES:
            found = grams(t.lower(), n, langid.BITS)
            for g in found:
                x[g] += 1 / len(found)
        margin = [sum(v * float(model.weights[g, b]) for g, v in x.items()) + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(r * math.log1p(math.exp(-c * m)) if c * m > -30 else r * -c * m for r, c, m in zip(model.reliability, code, margin, strict=True)) for code in model.code]
        best = min(range(len(loss)), key=lambda k: loss[k])
        p = 1 / sum(math.exp(min(loss) - v) for v in loss)
        assert model.predict(t) == (model.languages[best], pytest.approx(p, abs=1e-3))


def test_toxicity_scores():
    model = toxicity.train(rows(" you zonker pfuile zonkers!"), {0: 106, 1: 54})
    assert len(model.lexicon.keys)
    odds = dict(zip(model.lexicon.keys.tolist(), model.lexicon.odds.tolist(), strict=True))
    samples = [*texts(), "you are a zonker", "a z0nker and Z.O.N.K.E.R you", "pfuile " * 9, "ZONKER you!!! ###"]
    scores = model.score(samples)
    for t, s in zip(samples, scores, strict=True):
        x = toxicity.features(t, model.lexicon)
        if not toxicity._masked.search(t.encode()) and not toxicity._spaced.search(t.encode()):
            words = bytes(toxicity._letters[b] for b in t.encode()).split()
            plain = [odds.get(word(w), 0.0) for w in words]
            n = max(1, len(words))
            assert x[:3].tolist() == pytest.approx([sum(o != 0 for o in plain) / n, sum(plain) / n, max(plain, default=0)])
            you = [k for k, w in enumerate(words) if w.decode("latin1") in toxicity.SECOND_PERSON]
            near = sum(1 for k, o in enumerate(plain) if o and any(abs(k - j) <= toxicity.NEAR for j in you))
            assert x[14] == pytest.approx(near / n)
        z = model.trees.base
        for tree in model.trees.trees:
            at = 0
            while at < len(tree.feature):
                at = 2 * at + 1 + int(x[tree.feature[at]] > tree.cut[at])
            z += tree.value[at - len(tree.feature)]
        step = model.calibration.y[sum(e <= z for e in model.calibration.edges)]
        order = model.calibration.order
        assert s == pytest.approx(min(1, max(0, (1 - order) * step + order / (1 + math.exp(-z)))), abs=1e-9)


def test_choice_among_settings():
    ranked = toxicity.choose(rows(" you zonker pfuile"), [{"trees": 1, "rate": 0.01}, {"trees": 30}])
    assert [s for _, s in ranked][0] == {"trees": 30} and ranked[0][0] < ranked[1][0]


def fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_training_rows(spark, monkeypatch):
    from sylva.llm import sampling

    docs = spark.createDataFrame([(i, f"text {i} " + "x" * (i % 50), "l%d" % (i % 3)) for i in range(400)] + [(7, "a repeat", "l1"), (None, "n", "l0"), (500, None, "l0")], "doc_id long, text string, lang string")
    got, counts = training_rows(docs, docs.select("doc_id", "lang"), "lang", 20, "s")
    assert counts == dict(Counter("l%d" % (i % 3) for i in range(400) if not fold(i)) + (Counter() if fold(500) else Counter(["l0"])))
    assert Counter(y for _, y in got)["l1"] == Counter(y for _, y in got)["l2"] == 20 and 19 <= Counter(y for _, y in got)["l0"] <= 20
    assert not any(fold(int(t.split()[1])) for t, _ in got if t.startswith("text"))
    assert got == training_rows(docs.repartition(5), docs.select("doc_id", "lang"), "lang", 20, "s")[0]
    every = training_rows(docs, docs.select("doc_id", "lang"), "lang", 10**6, "s")[0]
    assert len(every) == sum(not fold(i) for i in range(400))
    monkeypatch.setattr(sampling, "ROWS", 9)
    assert len(training_rows(docs, docs.select("doc_id", "lang"), "lang", 20, "s")[0]) == 9
    monkeypatch.setattr(sampling, "BYTES", 3 * 40)
    assert sum(len(t) for t, _ in training_rows(docs, docs.select("doc_id", "lang"), "lang", 20, "s")[0]) <= 120
    monkeypatch.setattr(sampling, "CLASSES", 2)
    assert len(training_rows(docs, docs.select("doc_id", "lang"), "lang", 20, "s")[1]) == 2
    assert training_rows(docs.limit(0), docs.limit(0).select("doc_id", "lang"), "lang", 20, "s") == ([], {})


def test_odd_rows(spark):
    long = "ka lo mi " * 40_000
    table = [(1, "ka lo", "x"), (1, "ka lo", "x"), (2, None, None), (None, "", "y"), (3, long, "z"), (4, "123 ...", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, score string")
    quality = subword.train(rows(" ### ###"), {0: 106, 1: 54})
    toxic = toxicity.train(rows(" you zonker pfuile"), {0: 106, 1: 54})
    rng = random.Random(2)
    language = langid.train([(prose(lang, 30, rng), lang) for lang in SYLLABLES for _ in range(20)])
    for got in (subword.score(docs, quality), toxicity.score(docs, toxic), langid.identify(docs, language)):
        by = sorted(((r.doc_id or 0, r.score, r.held_out) for r in got.collect()))
        assert [i for i, *_ in by] == [0, 1, 1, 2, 3, 4] and by[1] == by[2] and all(0 <= s <= 1 for _, s, _ in by) and not by[0][2]
        assert got.limit(0).count() == 0
    for empty in (subword.score(docs.limit(0), quality), toxicity.score(docs.limit(0), toxic), langid.identify(docs.limit(0), language)):
        assert empty.count() == 0
    clashing = docs.withColumnRenamed("score", "held_out").selectExpr("*", "1 as predicted", "2 as lang_pred")
    assert subword.filter_good(clashing, quality, 0.0).columns == clashing.columns and subword.filter_good(clashing, quality, 0.0).count() == 6
    assert {r.doc_id for r in langid.filter_known(clashing, language).collect()} <= {1, 3}
    assert np.isfinite(quality.score(long))
