import hashlib
import random

import zstandard

from sylva.llm import warc


def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", "<p>" + "".join(rng.choice("abé😀 \r\n") for _ in range(rng.choice([0, 20, 500]))), "q") for i in range(60)]
    copy = "<html>" + "same " * 50
    rows += [(100 + i, f"http://y/{i}", copy, "q") for i in range(40)]
    rows += [(200, None, None, None), (201, "a\r\nb", "", None), (None, "u", copy, None), (300, "s", "tiny", None), (301, "s", "tiny", None), (100, "again", copy, None), (400, "long", "x" * 3_000_000, None)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    bundles = warc.write_bundles(df, f"file://{tmp_path}/w", bundle_bytes=3000, frame_bytes=2000)
    got = warc.read_bundles(bundles).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h, _ in rows), key=str)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    html = {i: h for i, _, h, _ in rows}
    for r in got:
        copy = r.page_id is not None and len((html[r.page_id] or "").encode()) >= 100 and first[html[r.page_id]] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", first[html[r.page_id]]) if copy else ("response", None))
        assert copy or bytes(r.payload) == ((html[r.page_id] if r.page_id is not None else rows[40 + 60 + 2][2]) or "").encode()
    assert bundles.count() > 2 and bundles.agg({"records": "sum"}).first()[0] == len(rows)
    assert warc.decode_record(warc.find_record(bundles, 7))["payload"] == html[7].encode()
    assert warc.find_record(bundles, 12345) is None
    assert not list(tmp_path.rglob("*.part"))


def test_two_attempts_of_a_task_do_not_mix(spark, tmp_path):
    _, df = pages(spark)
    first, second = (warc.write_bundles(df.repartition(3), str(tmp_path / "w"), bundle_bytes=3000, frame_bytes=2000) for _ in range(2))
    paths = [{r.path for r in b.collect()} for b in (first, second)]
    assert not paths[0] & paths[1] and len(list((tmp_path / "w").iterdir())) == len(paths[0] | paths[1])
    assert warc.read_bundles(first).count() == warc.read_bundles(second).count() == df.count()


def test_the_query_leaves_no_bundles(spark, tmp_path):
    from pathlib import Path

    from sylva.session import shared_dir

    rows, df = pages(spark)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.query(spark, str(tmp_path)).count() == len(rows)
    assert not list(Path(shared_dir(spark).removeprefix("file:")).glob("warc-*"))


def test_any_decoder_reads_a_bundle(tmp_path):
    out = warc.BundleWriter(str(tmp_path / "b"), frame_bytes=50)
    records = {warc.record_id(i): warc.encode_record(i, "u", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), None) for i in range(9)}
    for name, raw in records.items():
        out.add(name, raw)
    out.close()
    with open(tmp_path / "b", "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records.values())
    bundle = warc.BundleReader(str(tmp_path / "b"))
    assert len(bundle.frames) == 9 and list(bundle) == list(records.values()) and bundle.record("<urn:page:4>") == records["<urn:page:4>"]


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(empty, str(tmp_path / "e"))).count() == 0
