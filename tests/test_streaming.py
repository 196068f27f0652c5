import json
import os

from soundpairs import schemas, streaming
from soundpairs.operators.detections import first_wins, has_id
from soundpairs.operators.playlists import direct_plan
from soundpairs.plans import playlist_pairs, playlist_windows
from soundpairs.streaming import jobs
from tests.helpers import detection, detections, ms, segments, streams

T = ms("2019-05-10T17:52:43")


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    file = path / f"{name}.json"
    file.write_text("\n".join(json.dumps(r) for r in rows))
    at = 1_600_000_000 + int(name[1:])      # files are taken by age
    os.utime(file, (at, at))


def files(tmp_path):
    src = tmp_path / "in"
    rows = [detection(i, id=f"d{i % 5}", pt=[100, None, 7][i % 3], description=f"n{i}") for i in range(12)]
    rows[4]["id"] = None
    for n in range(3):
        land(src, f"f{n}", rows[n * 4:n * 4 + 4])
    return src, rows


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, rows = files(tmp_path)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def go():
        q = (streaming.stream_detections(spark, str(src), 1).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(r["pos"] for r in spark.read.parquet(out).collect())

    assert go() == list(range(12))
    land(src, "f9", [detection(99)])
    assert go() == list(range(12)) + [99]


def test_dedupe_equals_batch(spark, tmp_path):
    src, rows = files(tmp_path)
    target = str(tmp_path / "t")
    # the last row of a file comes first in order: position decides, not place in the file
    land(src, "f0", list(reversed(rows[:4])) + [detection(50, id="d0")])
    streaming.stream_dedupe(
        streaming.stream_detections(spark, str(src), 1), target, str(tmp_path / "ck")).awaitTermination()
    got = {r["id"]: r["pos"] for r in spark.read.parquet(target).collect()}
    batch = first_wins(has_id(detections(spark, *rows)))
    assert got == {r["id"]: r["pos"] for r in batch.collect()}
    assert spark.read.parquet(target).count() == len(got)


def test_a_lost_checkpoint_repeats_and_loses_nothing(spark, tmp_path):
    """The same files come again, cut into batches differently."""
    src, rows = files(tmp_path)
    target = str(tmp_path / "t")
    for ck, size in (("a", 1), ("b", 10), ("c", 2)):
        streaming.stream_dedupe(
            streaming.stream_detections(spark, str(src), size), target, str(tmp_path / ck)).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [f"d{i}" for i in range(5)]


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    sink = jobs._Sink(str(tmp_path / "t"), "ck", "r0")
    batch = detections(spark, detection(0, id="a"), detection(1, id="a"), detection(2, id="b"))
    for _ in range(2):
        sink.write(sink.only_new(batch, 3, "id"), 3)
        assert sorted(r["pos"] for r in spark.read.parquet(sink.target).collect()) == [0, 2]


def test_append_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    for n in range(2):
        land(src, f"f{n}", [{"pos": n * 3 + i, "clip_key": f"k{(n + i) % 3}"} for i in range(3)])
    sdf = spark.readStream.schema("pos long, clip_key string").option("maxFilesPerTrigger", 1).json(str(src))
    for ck in ("a", "b"):
        streaming.stream_append(sdf, str(tmp_path / "t"), str(tmp_path / ck)).awaitTermination()
    got = [r["clip_key"] for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert sorted(got) == ["k0", "k1", "k2"]


def test_resolve_equals_batch(spark, tmp_path):
    src, rows = files(tmp_path)
    cat, segs = streams(spark, ("100", T - 30_000, None)), segments(spark, ("100", T, T + 10_000))
    target = str(tmp_path / "t")
    streaming.stream_resolve(streaming.stream_detections(spark, str(src), 1), cat, segs, target,
                             str(tmp_path / "ck"), url_root="https://x/").awaitTermination()
    got = spark.read.parquet(target).drop("run", "batch_id")
    want = playlist_pairs(detections(spark, *rows), cat, segs, url_root="https://x/")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stage1_join_holds_no_state(spark, tmp_path):
    src, rows = files(tmp_path)
    cat = streams(spark, ("100", T - 30_000, None))
    out = streaming.stream_stage1(streaming.stream_detections(spark, str(src)), cat).select("pos", "plan")
    q = out.writeStream.format("memory").queryName("stage1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"] == []
    got = {r["pos"]: r["plan"] for r in spark.table("stage1").collect()}
    want = direct_plan(playlist_windows(detections(spark, *rows)), cat)
    assert got == {r["pos"]: r["plan"] for r in want.collect()}


def test_pages_stream(spark, tmp_path):
    src = tmp_path / "pages"
    src.mkdir()
    for offset in (0, 2):
        rows = [{k: v for k, v in detection(offset + i).items() if k != "pos"} for i in range(2)]
        (src / f"page-{offset}.json").write_text(json.dumps({"data": {"detections": {"results": rows}}}, indent=1))
    q = (streaming.stream_pages(spark, str(src)).writeStream.format("memory").queryName("pages")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted((r["pos"], r["id"]) for r in spark.table("pages").collect()) == [
        (i, f"det_{i}") for i in range(4)]


def test_watermark_form(spark, tmp_path):
    src, rows = files(tmp_path)
    q = (streaming.watermark_dedupe(streaming.stream_detections(spark, str(src)))
         .writeStream.format("memory").queryName("marked").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("marked").collect()) == [f"d{i}" for i in range(5)]


def test_resolve_again_adds_nothing(spark, tmp_path):
    """Under the same checkpoint, and under new ones."""
    src, rows = files(tmp_path)
    cat, segs = streams(spark, ("100", T - 30_000, None)), segments(spark, ("100", T, T + 10_000))
    target, want = str(tmp_path / "t"), None
    for ck in ("a", "a", "b"):
        streaming.stream_resolve(streaming.stream_detections(spark, str(src), 2), cat, segs, target,
                                 str(tmp_path / ck), url_root="https://x/").awaitTermination()
        got = sorted(map(str, spark.read.parquet(target).drop("run", "batch_id").collect()))
        assert want is None or got == want
        want = got


def test_no_batch_reads_what_earlier_ones_wrote(spark, tmp_path):
    """Fifty batches, and a restart: every batch's input is its own file, and after a restart what was written since."""
    src, target, ck = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "ck")
    for n in range(50):
        land(src, f"f{n}", [detection(3 * n + i, id=f"d{max(0, 2 * n + i - 1)}") for i in range(3)])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = streaming.stream_dedupe(streaming.stream_detections(spark, str(src), 1), target, ck)
        q.awaitTermination()
        read = [sum(s["numInputRows"] for s in p["sources"]) for p in q.recentProgress if p["numInputRows"]]
        assert len(read) == 50 and max(read) <= 3
        land(src, "f90", [detection(1000, id="d3"), detection(1001, id="new")])
        q = streaming.stream_dedupe(streaming.stream_detections(spark, str(src), 1), target, ck)
        q.awaitTermination()
        held = {r["id"]: r["pos"] for r in spark.read.parquet(target).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    want = {}
    for n in range(50):
        for i in range(3):
            want.setdefault(f"d{max(0, 2 * n + i - 1)}", 3 * n + i)
    assert held == {**want, "new": 1001}


def test_keys_pass_no_python_function_one_by_one(spark, tmp_path):
    """Many different keys cost no Python call each, and few state stores; the caller's settings stay."""
    src, target = tmp_path / "in", str(tmp_path / "t")
    land(src, "f0", [{"pos": i, "clip_key": f"k{i % 3000}"} for i in range(6000)])
    sdf = spark.readStream.schema("pos long, clip_key string").json(str(src))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        q = streaming.stream_append(sdf, target, str(tmp_path / "ck"))
        q.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    (state,) = q.lastProgress["stateOperators"]
    assert state["operatorName"] == "dedupe" and state["numShufflePartitions"] <= 2 * spark.sparkContext.defaultParallelism
    assert state["numRowsTotal"] == 3000
    assert sorted(r["pos"] for r in spark.read.parquet(target).collect()) == list(range(3000))


def test_rows_pass_the_state_unchanged(spark, tmp_path):
    """Large numbers, nulls and odd texts; copies within a file fold to the first position, null before all."""
    src, target = tmp_path / "in", str(tmp_path / "t")
    odd = detection(2**62 + 1, id="a", pt=10**16 + 1, description='line\n"quoted" \\   é', feed_id=None)
    plain = detection(5, id="b", candidate=None, feed=None)
    land(src, "f0", [detection(2**62 + 2, id="a")] * 3 + [odd, plain, detection(None, id="c"), detection(-7, id="c")])
    streaming.stream_dedupe(streaming.stream_detections(spark, str(src)), target, str(tmp_path / "ck")).awaitTermination()
    got = {r["id"]: r.asDict(True) for r in spark.read.schema(schemas.LANDED).parquet(target).drop("run", "batch_id").collect()}
    assert got["a"] == odd and got["b"] == plain and got["c"]["pos"] is None and len(got) == 3


def test_open_rows_are_resolved_when_the_catalog_grows(spark, tmp_path):
    src, rows = files(tmp_path)
    cat, segs = streams(spark, ("100", T - 30_000, None)), segments(spark, ("100", T, T + 10_000))
    target, det = str(tmp_path / "t"), detections(spark, *rows)
    streaming.stream_resolve(streaming.stream_detections(spark, str(src), 2), cat.where("false"), segs.where("false"),
                             target, str(tmp_path / "ck"), url_root="https://x/").awaitTermination()
    first = spark.read.parquet(target)
    assert {r["status"] for r in first.collect()} <= {"no_segments", "error_no_segments", "invalid_input", "error"}
    assert streaming.resolve_again(det, cat.where("false"), segs.where("false"), target, url_root="https://x/") == 0
    assert streaming.resolve_again(det, cat, segs.where("false"), target, url_root="https://x/") == 1
    streaming.resolve_again(det, cat, segs, target, url_root="https://x/")
    want = sorted(map(str, playlist_pairs(det, cat, segs, url_root="https://x/").collect()))
    assert sorted(map(str, streaming.latest_pairs(spark, target).collect())) == want
    # a retry that wrote its files twice over, or a fold cut short, changes nothing
    streaming.resolve_again(det, cat, segs, target, url_root="https://x/")
    folded = streaming.compact_again(spark, target)
    assert sorted(map(str, streaming.latest_pairs(spark, target).collect())) == want
    assert len([d for d in os.listdir(target) if "again" in d]) <= 1 and streaming.compact_again(spark, target) == 0
    assert folded in (0, 3)
    # the stream goes on, and takes nothing twice
    land(src, "f9", [detection(99, pt=100), detection(3, pt=100)])
    streaming.stream_resolve(streaming.stream_detections(spark, str(src), 2), cat, segs, target, str(tmp_path / "ck"),
                             url_root="https://x/").awaitTermination()
    got = streaming.latest_pairs(spark, target)
    assert got.count() == len(rows) + 1 and got.where("pos = 99").first()["status"] == "uploaded"
