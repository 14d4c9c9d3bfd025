import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sylva.llm import token_counts
from sylva.llm.bpe import codec

BITS = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "1", "é", "…", "😀", "\t", "<|endoftext|>", "the", " the", "!", "\u3000", "\u200b", "'ll", "_", "\x1c", "\x85", "\r\n", "dog.", "<|end", " <|endoftext|>"]


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_prefix_matches_the_library():
    rng, lib = random.Random(3), library()
    for trial in range(600):
        text = "".join(rng.choice(BITS if trial % 2 else BITS[:12]) for _ in range(rng.randint(0, 14)))
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert token_counts.counts_of(codec().prefix_steps(text)).tolist() == want, repr(text)
        assert codec().count(text) == (want[-1] if want else 0)
        assert memoryview(codec().ids(text)).cast("I").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_long_pieces():
    lib = library()
    for text in ("a" * 9000, " " * 3000 + "x", " " * 3000 + "x" * 3000, "\n \t" * 1000 + "'re", "ab" * 2000, "!" * 2000, "a" * 5000 + "<|endoftext|>" * 300, "' 's" * 900):
        counts = token_counts.counts_of(codec().prefix_steps(text))
        assert counts[-1] == codec().count(text) == len(lib.encode(text).ids)
        for k in (1, 2, 1500, len(text) // 2, len(text) - 1):
            assert counts[k - 1] == len(lib.encode(text[:k]).ids), (text[:9], k)


@pytest.mark.parametrize("text", [" " * 500_000 + "a" * 500_000, (" " * 999 + "b") * 1000, "x" * 1_000_000 + "<|endoftext|>"])
def test_time_grows_with_length(text):
    codec()
    began = time.time()
    assert codec().count(text) == len(library().encode(text).ids)
    assert time.time() - began < 40


def test_rows(spark):
    rows = [(1, "the end", "x"), (1, "the end", "x"), (2, None, None), (None, "", "y"), (3, "word " * 2000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = token_counts.count_tokens(docs)
    got = sorted(counted.collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    lib = library()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(None, 0, 0, False), (1, 7, 2, False), (1, 7, 2, False), (2, 0, 0, False), (3, 10000, len(lib.encode("word " * 2000).ids), True)]
    assert [r.fits for r in got[:4]] == [0, 7, 7, 0]
    long = "word " * 2000
    assert len(lib.encode(long[: got[4].fits]).ids) <= 1024 and all(len(lib.encode(long[:k]).ids) > 1024 for k in range(got[4].fits + 1, len(long), 97))
    assert [len(r.steps) for r in got] == [0, 7, 7, 0, 10000]
    assert {(r.doc_id, r.fits) for r in token_counts.within(counted, 1).collect()} == {(None, 0), (1, 3), (2, 0), (3, 4)}
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_budget():
    text = "one two three four"
    steps = codec().prefix_steps(text)
    k = token_counts.longest_prefix(steps, 2)
    assert codec().count(text[:k]) <= 2 < codec().count(text[: k + 1])
    assert token_counts.longest_prefix(b"", 5) == 0
