import random

import numpy as np
import pytest

from sylva.functions import text
from sylva.operators import bpe
from sylva.sources import formats

FOX = b"the quick brown fox jumps over the lazy dog"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


def test_slices():
    assert text.slices_of(FOX, 16) == [b"the quick brown", b" fox jumps over", b" the lazy do"]
    assert text.slices_of(FOX[8:], 16) == [b"k brown fox", b" jumps over the", b" lazy do"]
    assert text.slices_of(b"abcd efgh", 9) == [b"abcd efg"] and text.slices_of(b"abcd efgh", 10) == [b"abcd efgh"]
    assert text.slices_of(b"abcdefghij klm", 4) == [b"abcd", b"efgh", b"ij", b" kl"]
    assert text.slices_of(b"abcdefghij klm", 4, drop_last_byte=False)[-1] == b" klm"
    with pytest.raises(ValueError):
        text.slices_of(b"x", 0)


def test_slice_table(spark):
    got = text.slices(docs(spark, FOX.decode(), None), 16).orderBy("row_id", "pos").collect()
    assert [r.slice for r in got] == ["the quick brown", " fox jumps over", " the lazy do", ""]
    both = text.slices(docs(spark, FOX.decode()), 16, overlap=True).orderBy("pos").collect()
    assert [r.slice for r in both] == ["the quick brown", " fox jumps over", " the lazy do", "k brown fox", " jumps over the", " lazy do"]
    short = text.slices(docs(spark, "abc", "abcdefgh", "abcdefghi", None), 16, overlap=True).orderBy("row_id", "pos").collect()
    assert [(r.row_id, r.start, r.slice) for r in short] == [(0, 0, "abc"), (1, 0, "abcdefgh"), (1, 8, ""), (2, 0, "abcdefghi"), (2, 8, "i"), (3, 0, "")]


def test_words(spark):
    df = docs(spark, "a  b\nc a ", None, "")
    assert {(r.word, r.n) for r in text.word_counts(df).collect()} == {("a", 2), ("b\nc", 1)}
    row = text.positions(df).where("row_id = 0").first()
    assert row.words == ["a", "b\nc"] and row.positions == [0, 1, 0]
    assert {(r.word, r["first"], r.n) for r in text.word_list(df).collect()} == {("a", 0, 2), ("b\nc", 1, 1)}


SMALL = "low low low lower newest newest wide"


def test_bpe_golden(spark):
    t = bpe.train(docs(spark, SMALL), 16)
    assert t.tokens == [*[bytes([b]) for b in b"deilnorstw"], b"</w>", b"<unk>", b"lo", b"low", b"low</w>", b"ne"]
    assert t.rules == [(3, 5, 12), (12, 9, 13), (13, 10, 14), (4, 1, 15)]
    assert t.encode(SMALL)[0] == [14] and t.encode_word("lower") == [13, 1, 6, 10] and t.encode_word("newest") == [15, 9, 1, 7, 8, 10] and t.encode_word("wide") == [9, 2, 0, 1, 10]
    got = {r.row_id: r.bits for r in bpe.binary_embedding(docs(spark, "low newer", "lower zoo", None), t).collect()}
    assert got == {0: [1, 6, 9, 10, 14, 15], 1: [1, 5, 6, 10, 11, 13], 2: []}
    real = {(r.token, r.n) for r in bpe.real_embedding(docs(spark, "low low wide"), t).collect()}
    assert real == {(14, 2), (9, 1), (2, 1), (0, 1), (1, 1), (10, 1)}
    assert formats.decode_tokenizer(formats.encode_tokenizer(t)) == t


def one_at_a_time(words, size):
    alphabet = sorted({b for w in words for b in w.encode()})
    now = [[alphabet.index(b) for b in w.encode()] + [len(alphabet)] for w in words]
    rules, n = [], len(alphabet) + 2
    while n < size:
        count = {}
        for ids in now:
            for p in zip(ids, ids[1:], strict=False):
                count[p] = count.get(p, 0) + 1
        if not count:
            break
        a, b = min(count, key=lambda p: (-count[p], p[1], p[0]))
        rules.append((a, b, n))
        now = [bpe.merge(ids, a, b, n) for ids in now]
        n += 1
    return rules


def test_bpe_matches_merging_one_pair_at_a_time(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    corpus = docs(spark, " ".join(words), "aaaa aaaaa a")
    want = one_at_a_time([*words, "aaaa", "aaaaa", "a"], 40)
    assert bpe.train(corpus, 40).rules == want == bpe.train(corpus, 40, task_tokens=-1).rules
    assert bpe.train(corpus, merges=9).rules == want[:9] and bpe.train(corpus, 40, 3).rules == want[:3]
    with pytest.raises(ValueError):
        bpe.train(corpus)
    assert bpe.train(docs(spark, "aa"), 2).rules == []
    assert bpe.train(docs(spark, ""), 9).rules == []
    assert len(bpe.train(docs(spark, "ab"), 99).rules) == 2


def test_learning_with_many_ids(monkeypatch):
    monkeypatch.setattr(bpe, "DENSE", 0)
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    flat = [[b"ab".index(c) for c in w.encode()] + [2] for w in words]
    got = bpe.learn(np.array([x for w in flat for x in w]), np.cumsum([0, *map(len, flat)]), np.ones(60, np.int64), 4, 30)
    assert got == one_at_a_time(words, 34)


def test_merges_of_a_batch():
    rng = random.Random(5)
    for _ in range(300):
        words = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(6)]
        a, b = rng.randrange(3), rng.randrange(3)
        values, offsets = bpe.merge_all(np.array([x for w in words for x in w], np.int32), np.cumsum([0, *map(len, words)]), a, b, 7)
        assert [values[i:j].tolist() for i, j in zip(offsets, offsets[1:], strict=False)] == [bpe.merge(w, a, b, 7) for w in words]


def test_stats_and_ids(spark):
    row = text.corpus_stats(docs(spark, "a b", "c d e f")).first()
    assert (row.texts, row.mean_words, row.sd_words) == (2, 3.0, 1.0)
    values = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, "a")], "row_id long, label string")
    assert [(r.label, r.id) for r in text.dense_ids(values, "label").orderBy("id").collect()] == [("x", 0), ("y", 1), ("a", 2)]


def test_a_search_without_judgements_writes_none(spark):
    from sylva.plans import registry

    queries, rows, judged, t = registry._beir_tables(spark, "/root/testdata/sf0.001", judgements=False)
    assert judged.count() == 0 and rows.count() == 200 and queries.count() == 10 and len(t.rules) == registry.MERGES
