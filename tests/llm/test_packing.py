import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sylva.llm import packing


def test_hilbert_steps_are_unit_steps():
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    key = packing.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pieces_cover_every_id_once(spark):
    rng = random.Random(2)
    words = "the tree of light and a winding river stone ouè".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 900]))), 1) for i in range(80)]
    rows += [(100, None, 2), (101, "", 2), (None, "alone", 3), (7, rows[7][1], 1), *[(200 + i, "a copy that recurs", 4) for i in range(60)], (300, "word " * 9000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = packing.pack(docs, partitions=3).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, pieces = defaultdict(int), defaultdict(list)
    for i, t, _ in rows:
        want[i] += len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    for r in got:
        pieces[r.doc_id].append(r)
    texts = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows}
    for i, own in pieces.items():
        assert sum(r.length for r in own) == want[i]
        for r in own:
            ids = texts[i][r.start : r.start + r.length]
            assert r.doc_tokens == len(texts[i]) and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    assert set(pieces) == set(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0), partitions=2).count() == 0


def test_neighbours_are_alike():
    a, b = "le chat dans la rue est noir " * 20, "der hund ist in dem haus " * 20
    texts = [x[: 200 + 10 * k] for k in range(10) for x in (a, b)]
    order = np.argsort(packing.keys(texts, np.zeros(20, np.int64)), kind="stable")
    assert sum(int(x) % 2 != int(y) % 2 for x, y in zip(order, order[1:], strict=False)) == 1
