import ctypes
import json
import math
import re
import struct
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.operators import clients, evaluate, rag, tree
from sylva.sources import formats, text
from sylva.streaming import ingest

LAYERS = [(0, r, r // 5) for r in range(15)] + [(1, r, 0) for r in range(10)] + [(1, r, 1) for r in range(11, 15)] + [(2, r, 0) for r in range(15)]


def members(spark):
    return spark.createDataFrame(LAYERS, "layer int, row_id long, cluster int")


def test_links_between_layers(spark):
    got = {(r.layer, r.cluster, r.child_layer, r.child) for r in tree.edges(members(spark)).collect()}
    assert got == {(1, 0, 0, 0), (1, 0, 0, 1), (2, 0, 1, 0), (2, 0, 1, 1)}  # 4 of 5 is not more than 0.8
    nodes = tree.nodes(members(spark))
    assert {tuple(r) for r in tree.tree_stats(nodes).collect()} == {(6, 4, 2)}
    branch = {r.node: r.branch for r in tree.top_branch(nodes).collect()}
    at = lambda layer, c: (layer << 32) | c
    assert branch[at(0, 0)] == branch[at(0, 1)] == branch[at(1, 0)] == at(1, 0) and branch[at(2, 0)] == at(2, 0) and branch[at(0, 2)] == at(0, 2)
    assert tree.newick(tree.nested(nodes)) == "(L0C2N5,((L0C0N5,L0C1N5)L1C0N10,L1C1N4)L2C0N15);"
    assert json.loads(tree.tree_json(tree.nested(nodes)))["children"][0] == {"name": "L0C2N5", "children": None}
    assert tree.parse_newick("(a:1,(b,c)d)e;") == {"name": "e", "children": [{"name": "a", "children": None}, {"name": "d", "children": [{"name": "b", "children": None}, {"name": "c", "children": None}]}]}


def test_cluster_sets(spark):
    m, rows = members(spark), spark.range(16).select(F.col("id").alias("row_id"))
    assert {r.layer: (r.covered, r.noise) for r in tree.coverage(m, rows).collect()} == {0: (15, 1), 1: (14, 2), 2: (15, 1)}
    assert [r.row_id for r in tree.noise(m, rows, 1).orderBy("row_id").collect()] == [10, 15]
    assert {(r.layer, r.clusters) for r in tree.cluster_counts(m).collect()} == {(0, 3), (1, 2), (2, 1)}
    labels = spark.createDataFrame([(0, 1, " trees \n"), (0, 2, "")], "layer int, cluster int, label string")
    got = {r.key: (r.doc_count, r.article_ids, r.label) for r in tree.mapping(m.where("layer = 0"), labels).collect()}
    assert got["L0C1N5"] == (5, ["5", "6", "7", "8", "9"], "trees \n".strip(" ")) or got["L0C1N5"][2] == "trees"
    assert got["L0C2N5"][2] is None and got["L0C0N5"][2] is None
    chunks = tree.annotation_chunks(m, 6).groupBy("layer", "cluster", "chunk").count()
    assert {(r.layer, r.cluster): r.n for r in chunks.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()}[1, 0] == tree.chunks_of(10, 6) == 5


def test_chunks_of_large_clusters(spark):
    from sylva.operators import tree

    sized = {1: 6, 2: 7, 3: 11, 4: 12, 5: 13, 6: 40_000}
    m = spark.createDataFrame([(0, c, r) for c, n in sized.items() for r in range(n)], "layer long, cluster long, row_id long")
    found = tree.annotation_chunks(m, 6)  # a row for each chunk would be 800 million
    each = found.groupBy("cluster", "chunk").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("rows"))
    got = {r.cluster: tuple(r)[1:] for r in each.groupBy("cluster").agg(F.count(F.lit(1)), F.max("chunk"), F.min("n"), F.max("n"), F.min("rows")).collect()}
    assert got == {c: (tree.chunks_of(n, 6), tree.chunks_of(n, 6) - 1, 6, 6, 6) for c, n in sized.items()}


def test_files_of_clusters_are_whole_however_the_joins_before_them_run(spark, tmp_path):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k"}
    held = {k: spark.conf.get(k, None) for k in conf}
    m = spark.range(0, 3000, 1, 4).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"), (F.col("id") % 2).alias("cluster"), F.col("id").alias("row_id"))
    rows = spark.range(0, 3000, 1, 4).select(F.col("id").alias("row_id"), F.repeat(F.lit("x"), F.lit(9000)).alias("text"), F.array(F.col("id").cast("double")).alias("vector"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        formats.write_cluster_vectors(m, rows, f"{tmp_path}/")
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {f.name: f.stat().st_size for f in tmp_path.glob("*.vdb")} == {f"L{a:04d}-C-{b:06d}.vdb": 21 + 1500 * (8 + 8 + 9000) for a in (0, 1) for b in (0, 1)}


def test_names(spark):
    df = spark.createDataFrame([("L14C683N7",), ("algae__ ",), ("__",), ("red_algae",)], "name string")
    assert [r[0] for r in df.select(tree.node_label(F.col("name"))).collect()] == [None, "algae", "  ", "red_algae"]
    one = spark.createDataFrame([("x/L0014-C-000683",)], "f string").select(tree.file_key(F.col("f")).alias("k"), tree.shortened(F.col("f"), 5).alias("s")).first()
    assert (one.k, one.s) == ("L14C683", "x/L00...")
    assert [r.id for r in tree.every_nth(spark.range(10), "id", 4).collect()] == [0, 4, 8]
    lines = spark.createDataFrame([(0, '{"title":"a","content":"b"}'), (1, " "), (2, "{}")], "row_id long, value string")
    assert {tuple(r) for r in tree.articles(lines).collect()} == {("0", "a", "b"), ("2", "", "")}


def test_scores(spark):
    table = spark.createDataFrame([(0, 0, "a", 5), (0, 1, "b", 5), (1, 0, "a", 3), (1, 0, "b", 2), (1, 1, "b", 3), (1, 1, "a", 2), (2, 0, "a", 4)], "layer int, cluster int, label string, n long")
    got = {r.layer: r for r in evaluate.cluster_scores(table).collect()}
    assert got[0].ari == pytest.approx(1) and got[0].nmi == pytest.approx(1) and math.isnan(got[2].ari) and math.isnan(got[2].nmi)
    pairs = 3 + 1 + 3 + 1
    expected = 20 * 20 / 45
    assert got[1].ari == pytest.approx((pairs - expected) / (20 - expected)) and 0 < got[1].nmi < 0.1


def test_retrieval(spark):
    rows = spark.createDataFrame([(0, "q", [1.0, 0.0]), (1, "near", [1.0, 0.1]), (2, "far", [0.0, 1.0])], "row_id long, name string, vector array<double>")
    qrels = spark.createDataFrame([("q", "near", 2), ("q", "far", 3), ("none", "q", 9)], "query_id string, corpus_id string, score int")
    got = evaluate.retrieval_accuracy(rows.where("row_id = 0"), rows, qrels, "cosine").first()
    assert (got.reached, got.possible, got.accuracy) == (2, 3, pytest.approx(2 / 3))
    none = evaluate.retrieval_accuracy(rows.where("row_id = 1"), rows, qrels, "cosine").first()
    assert math.isnan(none.accuracy)


def test_prompts(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes?"), (1, 3, "user", "go"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.prompt for r in rag.chat_prompts(turns, "S\n").collect()}
    assert got[1, 1] == rag.SYSTEM + "S\n" + rag.USER + "hi" + rag.ANSWER
    assert got[1, 3] == got[1, 1] + "yes?" + rag.USER + "go" + rag.ANSWER and got[2, 0].endswith(rag.USER + rag.ANSWER)
    found = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id long, rank int, text string")
    history = rag.conversation(turns).where("conv_id = 1 and turn = 3").select(F.col("conv_id").alias("query_id"), "history")
    prompt = rag.rag_prompts(found, history, "S\n").first().prompt
    assert prompt == rag.SYSTEM + "S\nContext 1:\na \n Context 2:\nb \n " + rag.USER + "hi" + rag.ASSISTANT + "yes?" + rag.USER + "go" + rag.ASSISTANT


def test_conversations_find_passages_by_their_last_turn(spark):
    turns = spark.createDataFrame([(1, 0, "user", "cats purr"), (1, 1, "assistant", "yes"), (1, 2, "user", "dogs bark"), (2, 0, "assistant", "x"), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(0, "cats purr"), (1, "dogs bark"), (2, "a b")], "row_id long, text string")
    embed = lambda df: clients.embed(df, clients.hash_embedder(16)).select("row_id", "vector")
    rows = embed(docs).join(docs, "row_id")
    got = {r.query_id: r.prompt for r in rag.conversation_prompts(turns, rows, embed, 1, system="S\n").collect()}
    assert set(got) == {1, 3}
    assert got[1] == rag.SYSTEM + "S\nContext 1:\ndogs bark \n " + rag.USER + "cats purr" + rag.ASSISTANT + "yes" + rag.USER + "dogs bark" + rag.ASSISTANT


def test_names_of_chunks_become_one(spark):
    named = spark.createDataFrame([(0, 0, 0, " a "), (0, 1, 0, "b"), (0, 1, 1, "c"), (0, 1, 2, "b"), (0, 2, 0, None), (1, 0, 0, ""), (1, 0, 1, "d")], "layer int, cluster int, chunk int, label string")
    prompts = {(r.layer, r.cluster): r for r in rag.unification_prompts(named, "S\n").collect()}
    assert set(prompts) == {(0, 0), (0, 1), (1, 0)} and prompts[0, 0].label == "a" and prompts[0, 0].prompt is None and prompts[1, 0].label == "d"
    assert prompts[0, 1].label is None and prompts[0, 1].prompt.endswith("b\nc") and prompts[0, 1].chunks == 3
    assert {tuple(r) for r in rag.unify(named, lambda p: " both ").collect()} == {(0, 0, "a"), (0, 1, "both"), (1, 0, "d")}
    one = spark.createDataFrame([('{"content":"x"}', "no json")], "a string, b string")
    assert tuple(one.select(rag.whole_content(F.col("a")), rag.whole_content(F.col("b"))).first()) == ("x", None)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from sylva.session import shared_dir

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://x:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context))


def test_requests_and_answers(spark):
    one = spark.createDataFrame([('say "x"', ["data:{\"content\":\"a\"}", "", "data: {\"content\":\"b\"}"], '[{"index":0,"embedding":[[1.5,2]]}]', '{"error":{"message":"the input is too large to process"}}')], "p string, s array<string>, ok string, bad string")
    r = one.select(rag.completion_request(F.col("p"), 7).alias("q"), rag.stream_content(F.col("s")).alias("a"), rag.decode_embedding(F.col("ok")).alias("v"), rag.decode_embedding(F.col("bad")).alias("n"), rag.too_large(F.col("bad")).alias("t"), rag.embedding_request(F.col("p")).alias("e")).first()
    assert json.loads(r.q) == {"prompt": 'say "x"', "n_predict": 7, "stream": True} and (r.a, r.v, r.n, r.t) == ("ab", [1.5, 2.0], None, True) and json.loads(r.e) == {"content": 'say "x"'}
    checked = rag.annotation_check(spark.createDataFrame([("good name",), ("two\nlines",), ("x" * 30000,), (None,)], "text string")).collect()
    assert [c.bad for c in checked] == [False, True, True, True] and len(checked[2].correction_input) == 20000


def test_embedding_retries(spark):
    docs = spark.createDataFrame([(0, "short"), (1, "word " * 40), (2, "x" * 1000), (3, None)], "row_id long, text string")
    got = {r.row_id: r for r in clients.embed(docs, clients.hash_embedder(8, longest=130)).collect()}
    assert got[0].retries == 0 and got[1].retries == 3 and len(got[1].vector) == 8 and got[1].text == "word " * 40
    assert got[2].retries == 7 and got[2].vector is not None and got[3].vector is not None
    none = clients.embed(docs.where("row_id = 2"), clients.hash_embedder(8, longest=50)).first()
    assert none.vector is None and none.retries == 7
    assert clients.complete(spark.createDataFrame([(1, "p")], "query_id long, prompt string"), str.upper).first().answer == "P"


def test_binary_formats(spark, tmp_path):
    formats.register(spark)
    data = [(f"text é {i}", [float(i), -1.5, 0.0]) for i in range(25)]
    raw = formats.encode_vectors(data)
    assert raw[:4] == b"VEC\0" and struct.unpack("<BQQ", raw[4:21]) == (1, 25, 3)
    formats.write_bytes(str(tmp_path / "a.vdb"), raw)
    got = spark.read.format("vdb").option("rowsPerPartition", 7).load(str(tmp_path / "a.vdb")).orderBy("row_id").collect()
    assert [(r.text, r.vector) for r in got] == data and [r.row_id for r in got] == list(range(25))
    spark.createDataFrame(got).repartition(1).write.format("vdb").mode("append").save(str(tmp_path / "out"))
    assert (tmp_path / "out" / "part-00000.vdb").read_bytes() == raw
    bits = formats.encode_vectors([("a", [0, 9]), ("b", [])], binary=True, length=16)
    assert bits[21:27] == bytes([1, 2, 0, 0, 0, 0])
    formats.write_bytes(str(tmp_path / "b.vdb"), bits)
    assert [(r.text, r.bits) for r in spark.read.format("vdb").option("type", "binary").load(str(tmp_path / "b.vdb")).orderBy("row_id").collect()] == [("a", [0, 9]), ("b", [])]
    formats.write_layers(members(spark), str(tmp_path / "tree"))
    assert formats.decode_layer((tmp_path / "tree0001").read_bytes()) == [(0, list(range(10))), (1, [11, 12, 13, 14])]
    back = spark.read.format("splitset").load(str(tmp_path / "tree0001")).select("layer", "row_id", "cluster")
    assert sorted(map(tuple, back.collect())) == sorted(x for x in LAYERS if x[0] == 1)
    with pytest.raises(ValueError):
        formats.decode_layer(b"other")
    gap = spark.createDataFrame([(0, 9, 2), (0, 4, 0), (0, 5, 2)], "layer int, row_id long, cluster int")
    formats.write_layers(gap, str(tmp_path / "gap"))
    assert formats.decode_layer((tmp_path / "gap0000").read_bytes()) == [(0, [4]), (1, []), (2, [5, 9])]
    with (tmp_path / "a.vdb").open("rb") as f:
        f.read_at = lambda n, at: (f.seek(at), f.read(n))[1]
        assert formats.text_offsets(f, 1, 20) == formats.text_offsets(f, 1) and len(formats.text_offsets(f, 7, 8)) == 4
    rows = spark.createDataFrame([(i, None if i == 3 else f"é{i}", [float(i), 2.0]) for i in range(15)], "row_id long, text string, vector array<double>")
    (tmp_path / "clusters").mkdir()
    formats.write_cluster_vectors(members(spark), rows, f"{tmp_path}/clusters/")
    back = spark.read.format("vdb").load(str(tmp_path / "clusters/L0001-C-000001.vdb")).orderBy("row_id").collect()
    assert [(r.text, r.vector) for r in back] == [(f"é{i}", [float(i), 2.0]) for i in range(11, 15)]
    with pytest.raises(ValueError, match="different lengths"):
        formats.vector_bytes(pa.array([[1.0], [1.0, 2.0]]), False, 1)


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"resumes": f"t{i}", "n": i} if i != 3 else {"x": 1}) + "\n" for i in range(200)))
    got = text.jsonl(spark, str(tmp_path / "c.jsonl"), "resumes").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(200)) and got[5].text == "t5" and got[3].text is None
    assert text.jsonl(spark, str(tmp_path / "c.jsonl"), "n").where("row_id = 7").first().text == "7"
    with pytest.raises(Exception, match="no resumes"):
        text.labels(spark, str(tmp_path / "c.jsonl"), "resumes").collect()
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\na\tb\t1\na\tc\t2\n")
    judged = text.qrels(spark, str(tmp_path / "q.tsv"))
    assert text.qrels_by_query(judged).first().answers == [("b", 1), ("c", 2)]
    (tmp_path / "b.jsonl").write_text('{"_id":"1","title":"t","text":"x"}\n')
    assert tuple(text.beir(spark, str(tmp_path / "b.jsonl")).first()) == ("1", "x")
    (tmp_path / "v.tsv").write_text("n1\t1.5\t2\n")
    assert tuple(text.tsv_vectors(spark, str(tmp_path / "v.tsv")).first()) == ("n1", [1.5, 2.0])
    assert text.whole_files(spark, str(tmp_path / "v.tsv")).first().text == "n1\t1.5\t2\n"
    for name, ids in (("L0004-C-000031", "1\n2\n"), ("L0004-C-000002", "3\n")):
        (tmp_path / "cl").mkdir(exist_ok=True)
        (tmp_path / "cl" / name).write_text(ids)
    assert {tuple(r) for r in text.cluster_folder(spark, str(tmp_path / "cl")).collect()} == {(4, 31, 1), (4, 31, 2), (4, 2, 3)}
    (tmp_path / "cl" / "L0004-C-000003").write_text("3\n")
    with pytest.raises(Exception, match="stands twice"):
        text.cluster_folder(spark, str(tmp_path / "cl")).collect()
    (tmp_path / "out").mkdir()
    formats.write_cluster_files(members(spark), str(tmp_path / "out/x-"))
    assert (tmp_path / "out/x-L0000-C-000001").read_text() == "5\n6\n7\n8\n9\n" and len(list((tmp_path / "out").iterdir())) == 6
    assert sorted(map(tuple, text.cluster_folder(spark, str(tmp_path / "out")).select("layer", "row_id", "cluster").collect())) == sorted(LAYERS)
    rows = spark.createDataFrame([(0, "t", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "row_id long, text string, vector array<double>")
    assert text.entry_lines(rows).first().value.split("\n")[-1] == "t" and len(text.entry_lines(rows).first().value.split("\n")) == 3
    assert tuple(text.details(rows).first()) == ("double", 6, 1)
    assert text.projection_lines(rows.select("row_id", F.col("vector").alias("pc"))).first().value.startswith("1.000000\t2.000000")


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"t":"one"}\n{"t":"two"}\n{"x":1}\n')
    for _ in range(2):
        ingest.append_vectors(ingest.read_lines(spark, str(tmp_path / "in"), "t"), clients.hash_embedder(4), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        (tmp_path / "in" / "2.jsonl").write_text('{"t":"three"}\n')
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.text for r in got) == ["one", "three", "two"] and all(len(r.vector) == 4 for r in got)


def test_entry_points():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 50


def test_windowed_counts(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:30", "view" if m % 2 else "click") for m in range(8)]
    events = spark.createDataFrame(rows, "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    counted = ingest.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert sorted((r.start.minute, r.kind, r.n) for r in spark.table("counted").collect()) == [(0, "click", 3), (0, "view", 2), (5, "click", 1), (5, "view", 2)]


def test_what_a_step_frees_goes_back_to_the_machine(spark):
    from sylva.llm.common import prepare
    from sylva.session import give_back

    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1])
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    blocks = [libc.malloc(50_000) for _ in range(4_000)]  # small enough to come from the heap, which only shrinks at its end
    for b in blocks:
        ctypes.memset(b, 1, 50_000)
    full = held()
    for b in blocks[:-1]:
        libc.free(b)
    prepare(spark)
    assert held() < full - 150_000
    libc.free(blocks[-1])
    assert give_back(spark).startswith("Trim native heap")
