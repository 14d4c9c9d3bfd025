import random
import re
from collections import defaultdict

import pytest

from sylva.llm import mixing


def targets(sizes):
    """Share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 20, 300]))) + rng.choice(["", "\n", " x"]), rng.choice(["a", "b", "b", "b", "b", "B", "é", "tiny" if i % 40 == 0 else "c", None])) for i in range(900)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "u v w", "a"), (2000, None, "b"), (2001, "only", "zz")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, shard_rows=60).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    block = max(1, min(512, sum(sizes.values()) // 10_000))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.002 * sum(sizes.values()), 4 * block)
    again = mixing.mix(docs.repartition(7), shard_rows=60).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id = 2000")).collect()] == [0]


def test_rows_keep_apart(spark):
    rows = [(1, "a b c d", "", 5), (1, "a b c d", None, 6), (None, "e f", "s", 7), (None, "e f", "s", 7), (2, "", "s", 8), (3, None, "s", 9)] + [(10 + i, "x " * 40, "t", 0) for i in range(9)]
    rows = [(*r, "x", "y", i) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, at string, row string, _row int")
    got = mixing.apply_mix(docs).collect()
    taken = {(r.doc_id, r.source, r.size): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.source, r.size] += r.taken
    seen = dict.fromkeys(taken, 0)
    for r in got:
        whole = rows[r["_row"]]
        assert (r.doc_id, r.source, r["at"], r["row"]) == (whole[0], whole[2], "x", "y") and whole[1].startswith(r.text) and (r.text == whole[1] or r.n_chars == len(r.text))
        seen[r.doc_id, r.source, len(whole[1].split())] += len(r.text.split())
    assert seen == taken and sum(seen.values()) > 0
    assert {r.source for r in got if r.doc_id == 1} == {"", None}
    long = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "w", "b")], "doc_id long, text string, source string")
    assert sorted((r.size, r.taken <= 3 * r.size) for r in mixing.mix(long).collect()) == [(1, True), (200_000, True)]
    assert sum(len(r.text.split()) for r in mixing.apply_mix(long).collect()) == sum(r.taken for r in mixing.mix(long).collect())


def test_apportionment_is_that_of_highest_quotients(spark):
    rng, rows, want = random.Random(5), [], {}
    for g in range(30):
        n, seats = rng.randint(1, 25), rng.choice([0, 1, 7, 100, 5000])
        shares = [rng.choice([0, 1, 1, 2, 5, 1000]) * rng.randint(1, 9) for _ in range(n)]
        won = [0] * n
        for _ in range(seats if any(shares) else 0):
            k = max(range(n), key=lambda i: (shares[i] / (2 * won[i] + 1), -i))
            won[k] += 1
        for i, s in enumerate(shares):
            rows.append((g, i, float(s), seats))
            want[g, i] = won[i]
    df = spark.createDataFrame(rows, "g int, i int, share double, seats long")
    got = mixing.apportion(df, ["g"], "share", "seats", "i", "won").collect()
    assert {(r.g, r.i): r.won for r in got} == want
