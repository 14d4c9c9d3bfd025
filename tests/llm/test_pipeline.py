import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
from sylva.llm import langid, minhash, mixing, subword
from sylva.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng, rows, labels = random.Random(8), [], []
    sounds = {"aa": "ka lo mi ra tu".split(), "bb": "bren dosk fli glor skat".split()}
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(40, 90))]
        bad = i % 5 == 0
        text = " ".join(w + "###" if bad else w for w in words)
        rows.append((i, text, lang, rng.choice(["s", "s", "t", None]), len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(300 + k, rows[11][1], "aa", "s", len(rows[11][1])) for k in range(20)]
    rows += [(400, None, None, None, None), (401, "", "aa", "t", 0), (402, "12 34", "bb", "t", 5), (None, rows[3][1], "aa", "s", 9), rows[7]]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now
        assert now.columns == docs.columns or name == "packing"
    known = {r.doc_id for r in seen["language_id"].collect()}
    assert not {400, 401, 402} & known and len(known) >= 255
    good = {r.doc_id for r in seen["quality"].collect()}
    assert sum(i % 5 == 0 for i in good if i and i < 240) <= 3 and sum(i % 5 != 0 for i in good if i and i < 240) >= 185
    once = Counter(r.doc_id for r in seen["minhash_dedup"].collect())
    assert 11 in once and not any(i in once for i in range(300, 320)) and max(once.values()) == 1
    mixed = seen["mixing"].collect()
    whole = {r.doc_id: r.text for r in seen["minhash_dedup"].collect()}
    taken = Counter()
    for r in mixed:
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) or r.doc_id is None
        taken[r.doc_id] += len(r.text.split())
    want = {r.doc_id: r.taken for r in mixing.mix(seen["minhash_dedup"]).collect() if r.taken}
    assert dict(taken) == want
    assert {r.doc_id for r in now.collect()} == set(want)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    left = [p for p in Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-*/*")]
    assert [p.name for p in left] == ["packing"]


def test_columns_of_any_name(spark, tmp_path):
    extra = ["row", "at", "id", "h", "same", "words", "key", "score", "_row", "part", "full"]
    rows = [(i, "ka lo mi ra tu " * 8 + f"end{i % 4}", "aa", "s", 40, *extra) for i in range(12)] + [(3, "ka lo", "aa", None, 5, *extra), (None, None, None, None, None, *extra)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` string" for c in extra))
    for stage in (lambda d: langid.filter_known(d, langid.train([("ka lo", "aa")])), lambda d: subword.filter_good(d, subword.train([], {}), 0.5), minhash.drop_near_duplicates, mixing.apply_mix):
        docs = stage(docs)
        assert [c for c in docs.columns] == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *extra]
        got = docs.collect()
        assert got and all(tuple(r[5:]) == tuple(extra) for r in got)


def test_stages_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.filter_known(empty, langid.train([])).count() == 0
    assert subword.filter_good(empty, subword.train([], {})).count() == 0
    assert minhash.drop_near_duplicates(empty).count() == 0
    assert mixing.apply_mix(empty).count() == 0
