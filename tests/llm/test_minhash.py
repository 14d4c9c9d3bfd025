import itertools
import random

import numpy as np

from sylva.llm import minhash
from sylva.operators import graph

WORDS = ["w%d" % i for i in range(400)]


def corpus():
    rng, rows = random.Random(4), []
    for i in range(60):
        rows.append((i, [rng.choice(WORDS) for _ in range(rng.randint(30, 200))]))
    for k in range(40):  # near copies, with one to six edits
        words = list(rows[k % 7][1])
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(999)
        rows.append((100 + k, words))
    passage = [rng.choice(WORDS) for _ in range(60)]
    rows += [(200 + k, passage + [rng.choice(WORDS) for _ in range(60)]) for k in range(90)]  # half of each is one passage
    rows += [(300 + k, list(rows[3][1])) for k in range(30)]
    return [(i, " ".join(w)) for i, w in rows]


def brute(rows):
    hashes = {i: minhash.word_hashes(t) for i, t in rows}
    table, n = np.zeros(1 << minhash.FREQUENCY_BITS, np.int64), 0
    for h in hashes.values():
        if len(h):
            table[np.unique((h >> np.uint64(64 - minhash.FREQUENCY_BITS)).astype(np.int64))] += 1
            n += 1
    idf = minhash.inverse_frequencies(table, n)
    sets = {i: minhash.shingles(h, idf) for i, h in hashes.items()}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if minhash.similarity(sets[a], sets[b]) >= 0.8:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    return group


def test_groups_match_brute_force(spark):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string"))
    assert {r.doc_id: r.cluster_id for r in got.collect()} == brute(rows)
    assert all(r.kept == (r.doc_id == r.cluster_id) for r in got.collect())


def test_odd_rows(spark):
    rows = [(1, "one two"), (2, "One  two"), (3, None), (4, None), (5, ""), (6, " \n"), (None, "one two"), (7, "x"), (7, "x"), (9, "word " * 30000), (10, "word " * 30000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.cluster_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True), (7, 7, True), (9, 9, True), (10, 9, False)]
    assert [(r.cluster_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(6)
    a, b, c = ([rng.choice(WORDS) for _ in range(80)] for _ in range(3))
    near_b = [*b[:-1], "other"]
    rows = [(1, a, "p"), (1, b, "q"), (2, near_b, "r"), (3, a, "s"), (4, c, "t"), (4, c, "u"), (None, a, "v"), (5, [], "w"), (5, [], "x")]
    rows = [(i, " ".join(w), x, 0, 0) for i, w, x in rows]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row string, h int, id int")
    got = sorted((r.doc_id or 0, r.cluster_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True)]
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["row"] for r in left.collect()) in ([*"pqtvw"], [*"pqtvx"])
    both = [(1, " ".join(b), "y"), (1, " ".join(near_b), "z")]
    kept = [r.kept for r in minhash.near_duplicates(spark.createDataFrame(both, "doc_id long, text string, x string")).collect()]
    assert sorted(kept) == [False, True]


def test_samples_agree_as_often_as_sets_do():
    idf, rng = np.full(1 << minhash.FREQUENCY_BITS, 1.5, np.float32), random.Random(1)
    gaps = []
    for _ in range(60):
        words = [rng.choice(WORDS) for _ in range(200)]
        a = minhash.shingles(minhash.word_hashes(" ".join(words)), idf)
        b = minhash.shingles(minhash.word_hashes(" ".join(w if rng.random() > 0.03 else "zz" for w in words)), idf)
        gaps.append((minhash.samples(*a) == minhash.samples(*b)).mean() - minhash.similarity(a, b))
    assert abs(np.mean(gaps)) < 0.02


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(500, 560)] + [(5, 5)]
    want = {}
    for a, b in links:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    got = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_whose_samples_seldom_agree(spark):
    rng = random.Random(15832)
    words = ["w%d" % rng.randrange(10**6) for _ in range(101)]
    edited = words[:30] + ["x"] + words[31:70] + ["y"] + words[71:]
    rows = [(1, " ".join(words)), (2, " ".join(edited))]
    assert brute(rows) == {1: 1, 2: 1}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.cluster_id for r in got} == {1: 1, 2: 1}


def test_folded_bound_never_below_similarity():
    idf, rng = np.full(1 << minhash.FREQUENCY_BITS, 1.5, np.float32), random.Random(2)
    for n in (5, 30, 300, 3000):
        words = [rng.choice(WORDS) for _ in range(n)]
        for rate in (0, 0.01, 0.03, 0.04, 0.5):
            sets = [minhash.shingles(minhash.word_hashes(" ".join(w if rng.random() >= p else "zz" for w in words)), idf) for p in (0, rate)]
            weight = np.array([w.sum(dtype=float) for _, w in sets])
            may = minhash.may_reach(np.stack([minhash.folded(*s) for s in sets]), weight, 0, np.array([1]))[0]
            assert may or minhash.similarity(*sets) < 0.8
