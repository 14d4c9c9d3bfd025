import hashlib
import random

from sylva.llm import merkle


def brute_edit(rows):
    """Ids descending, nulls last; rows of one id are equal here."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        yield i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    words = "sun moon éa star 😀 rock. tree! river\n hill\n\n".split(" ")
    rows = [(3 * i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 300])))) for i in range(900)]
    rows += [(10**12, None), (-5, "tail end"), (None, "no id"), (30, rows[10][1]), (5000, "x" * 50000)]
    got = merkle.fingerprints(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_chars int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(brute_edit(rows), key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    texts = dict(rows)
    prints = {}
    for i, t in texts.items():
        assert prints.setdefault(by[i].fingerprint, t or "") == (t or "")
    long = [r for r in got if r.n_chars > 1000]
    assert sum(r.near_edited > 0.3 for r in long) > 0.9 * len(long)


def pieces(text, ends):
    """Cut after each position that `ends` tells; no piece is empty."""
    out, at = [], 0
    for k in range(1, len(text) + 1):
        if k == len(text) or ends(text, k):
            out.append(text[at:k])
            at = k
    return [x for x in out if x]


def brute_tree(text):
    """Sections, paragraphs and leaf digests, by scanning characters."""
    white = " \t\n\x0b\f\r"

    def section(t, k):
        if t[k - 1] != "\n" or t[k : k + 1] == "\n":
            return False
        j = k - 2
        while j >= 0 and k - 2 - j <= 8:
            if t[j] == "\n":
                return True
            if t[j] not in white:
                return False
            j -= 1
        return False

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for s in pieces(text, section):
        paragraphs = []
        for p in pieces(s, lambda t, k: t[k - 1] == "\n"):
            sentences = pieces(p, lambda t, k: k > 1 and t[k - 2] in ".!?" and t[k - 1] in white)
            paragraphs.append([sha(x[i : i + 80]) for x in sentences for i in range(0, len(x), 80)])
        out.append(paragraphs)
    return out, sha


def brute_print(text):
    tree, sha = brute_tree(text)
    digests = [[sha("".join(p)) for p in s] for s in tree]
    sections = [sha("".join(d)) for d in digests]
    named = ";".join(f"{h[:12]}=" + ",".join(f"{d[:12]}:{len(p)}" for d, p in zip(ds, s, strict=True)) for h, ds, s in zip(sections, digests, tree, strict=True))
    return f"{sha(''.join(sections))}|{named}|" + ",".join(x[:10] for s in tree for p in s for x in p)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ({h for h in f.split("|")[2].split(",") if h} for f in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 20)
    rng = random.Random(4)
    words = ["sun", "moon", "éa", "rock.", "tree!", "why?", "river\n", "hill\n\n", "\n \n\n", "tab\t", "x" * 90, "😀😀", "\u3000", "end. \n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 200])))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "y" * 1000), (503, "é" * 239 + "."), (504, rows[7][1]), (505, "\n\n\n"), (506, "a.\n" * 300)]
    got = {r.doc_id: r for r in merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [repr(t) for i, t in rows if got[i].fingerprint != brute_print(t or "")] == []
    ordered = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        own, other, edited = brute_print(text), brute_print(after), brute_print(text[: len(text) - half] + after[:half])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, edited), repr(text[:200])
        assert (got[i].near_edited, got[i].near_next) == (brute_likeness(own, edited), brute_likeness(own, other))


def test_small_tables(spark):
    got = merkle.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert got.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and got.near_next == 1
    assert merkle.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_roots_tell_texts_apart_and_locate_edits(spark):
    a = "one. two.\nthree\n\nfour. five\n\nsix"
    rows = [(0, a), (1, a), (2, a.replace("five", "FIVE")), (3, a + "\n"), (4, a.replace("\n\n", "\n \n")), (5, a.replace(". ", " ."))]
    df = merkle.with_fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "text", "fp")
    f = {r.doc_id: r.fp for r in df.collect()}
    assert f[0] == f[1] and len(set(f.values())) == 5
    x, y = df.where("doc_id = 0").alias("x"), df.where("doc_id = 2").alias("y")
    from pyspark.sql import functions as F

    row = x.crossJoin(y).select(merkle.differing_sections(F.col("x.fp"), F.col("y.fp")).alias("at"), merkle.likeness(F.col("x.fp"), F.col("y.fp")).alias("near")).first()
    assert row["at"] == [1] and 0 < row.near < 1
