import random

from pyspark.sql import functions as F

from soundpairs.operators import archive
from soundpairs.operators.clips import assemble_clips
from soundpairs.plans import archive_pairs
from soundpairs.sources import readers, writers
from tests.helpers import detection, detections, manifest, ms

SITE = "rpi_port_townsend"


def rows(df):
    return {r["pos"]: r for r in df.collect()}


def test_listed_window(spark):
    got = rows(archive_pairs(detections(spark, detection(0)), manifest(spark, SITE), list_only=True))[0]
    assert (got["windowStart"], got["windowEnd"]) == ("2019-05-10T17:52:13.000Z", "2019-05-10T17:53:13.000Z")
    assert [c[11:19] for c in got["chunkFiles"]] == ["17-52-08", "17-52-38", "17-53-08"]
    assert got["outPath"] == ""


def test_blank_rows_stay(spark):
    det = detections(spark, detection(0, timestamp=None), detection(1, timestamp="bad"), detection(2, node=None))
    for listing in (True, False):
        got = rows(archive_pairs(det, manifest(spark, SITE), list_only=listing))
        assert [got[i]["windowStart"] for i in (0, 1)] == ["", ""]
        assert [got[i]["chunkFiles"] for i in (0, 1, 2)] == [[], [], []]
    none = rows(archive_pairs(detections(spark, detection(0)), manifest(spark, SITE), list_only=True, buffer_s=0))
    assert none[0]["windowStart"] == "" and none[0]["chunkFiles"] == []


def test_one_site_for_all_rows(spark):
    got = rows(archive_pairs(detections(spark, detection(0, node=None)), manifest(spark, SITE),
                             site="rpi_sunset_bay", list_only=True))[0]
    assert got["chunkFiles"][0].endswith("_17-52-02_rpi_sunset_bay-48000-1.flac")


def test_preferred_seconds_win(spark):
    base = ms("2019-05-10T17:52:00")
    at = detections(spark, detection(0)).select(
        "pos", F.lit(SITE).alias("site"), F.lit(ms("2019-05-10T17:52:43")).alias("center_ms"))
    for seconds, want in (([0, 51], 51), ([5, 0], 0), ([22, 21, 52], 21), ([38, 8], 8), ([], None)):
        found = archive.phase_probe(at, manifest(spark, SITE, *[base + s * 1000 for s in seconds])).first()
        assert found["probe_second"] == want
        assert found["probe_phase"] == (None if want is None else want % 30)


def slow_phase(det, chunks, hints, default):
    """One row at a time, with a cache per site and day."""
    order = archive.PROBE_FIRST + [s for s in range(60) if s not in archive.PROBE_FIRST]
    cache, out = {}, {}
    for pos, site, at in sorted(det):
        key, minute = (site, at // 86_400_000), at // 60_000 * 60_000
        if key not in cache:
            hit = next((s for s in order if (site, minute + s * 1000) in chunks), None)
            if hit is not None:
                cache[key] = hit % 30
        out[pos] = cache.get(key, hints.get(site, default))
    return out


def test_day_phase_equals_the_row_by_row_cache(spark):
    rng = random.Random(3)
    det = [(p, rng.choice(["a", "b"]), rng.randrange(0, 3 * 86_400_000, 1000)) for p in range(400)]
    chunks = {(rng.choice(["a", "b"]), rng.randrange(0, 3 * 86_400_000, 1000)) for _ in range(2000)}
    df = spark.createDataFrame(det, "pos long, site string, center_ms long").repartition(5)
    man = spark.createDataFrame(list(chunks), "site string, start_ms long")
    got = {r["pos"]: r["phase"] for r in archive.day_phase(df, man, {"a": 7}, 2).collect()}
    assert got == slow_phase(det, chunks, {"a": 7}, 2)
    assert len(set(got.values())) > 3


def test_presence_and_first_builder(spark):
    have = [ms("2019-05-10T17:52:08"), ms("2019-05-10T17:53:08")]
    det = detections(spark, detection(0), detection(1), detection(2, timestamp="2019-05-10T19:00:00Z"),
                     detection(3, timestamp="2019-05-10T17:52:43Z"))
    got = rows(archive_pairs(det, manifest(spark, SITE, *have), out_dir="o/"))
    short = [c[11:19] for c in got[0]["chunkFiles"]]
    assert short == ["17-52-08", "17-53-08"]
    # the clip is there for later rows, which list what should cover the window
    assert [c[11:19] for c in got[1]["chunkFiles"]] == ["17-52-08", "17-52-38", "17-53-08"]
    assert got[3]["outPath"] == got[0]["outPath"] == (
        f"o/{SITE}_2019-05-10T17-52-13.000Z_2019-05-10T17-53-13.000Z.wav")
    assert (got[2]["outPath"], got[2]["chunkFiles"]) == ("", [])


def test_stored_clip_keeps_the_full_list(spark):
    key = f"{SITE}_2019-05-10T17-52-13.000Z_2019-05-10T17-53-13.000Z.flac"
    stored = spark.createDataFrame([(key,)], "clip_key string")
    got = rows(archive_pairs(detections(spark, detection(0)), manifest(spark, SITE), stored, fmt="flac"))[0]
    assert got["outPath"] == key and len(got["chunkFiles"]) == 3


def test_manifest_names(spark):
    paths = ["a/flac/2019-05-10_17-52-08_rpi_x-48000-1.flac", "b/2019-05-10_17-52-08_y_z-48000-1.flac",
             "2019-13-10_17-52-08_x-48000-1.flac", "2019-05-10_17-52-08_-48000-1.flac", "notes.txt"]
    df = spark.createDataFrame([(p, 5) for p in paths], "path string, length long")
    got = {r["site"]: r["start_ms"] for r in readers.manifest(df).collect()}
    assert got == {"rpi_x": ms("2019-05-10T17:52:08"), "y_z": ms("2019-05-10T17:52:08")}


def test_listing_of_files_reads_no_content(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "2019-05-10_17-52-08_s-48000-1.flac").write_bytes(b"abc")
    df = readers.read_manifest(spark, str(tmp_path), "binaryFile")
    assert [(r["site"], r["bytes"]) for r in df.collect()] == [("s", 3)]
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().lower().split("relation")[0]


def test_present(spark):
    rows_ = [("ok", 200, 5, "audio/flac"), ("part", 206, 1, None), ("gone", 404, 5, "audio/flac"),
             ("empty", 200, 0, "audio/flac"), ("page", 200, 9, "text/html; charset=utf-8")]
    df = spark.createDataFrame(rows_, "path string, status long, length long, contentType string")
    assert sorted(r["path"] for r in readers.present(df).collect()) == ["ok", "part"]


def test_payload_files_and_clips(spark, tmp_path):
    src = tmp_path / "chunks"
    src.mkdir()
    body = {f"c{i}": bytes([i, 0, 255]) * 50 for i in range(4)}
    for name, data in body.items():
        (src / name).write_bytes(data)
    (src / "c9").write_bytes(b"<!DOCTYPE html><html></html>")
    (src / "c8").write_bytes(b"")
    got = readers.read_payloads(spark, str(src))
    assert {r["name"]: bytes(r["content"]) for r in got.collect()} == body

    pairs = spark.createDataFrame([
        (0, "n_2020-01-01T00-00-00.000Z_2020-01-01T00-01-00.000Z.wav", ["c2", "c0", "c2"]),
        (1, "n_2020-01-01T00-00-00.000Z_2020-01-01T00-01-00.000Z.wav", ["c1"]),
        (2, "n_2020-01-02T00-00-00.000Z_2020-01-02T00-01-00.000Z.wav", ["c1", "c9"]),
        (3, "n_2020-01-03T00-00-00.000Z_2020-01-03T00-01-00.000Z.wav", ["c8"]),
        (4, None, []),
    ], "pos long, clip_key string, chunkFiles array<string>")
    clips = {r["clip_key"][2:12]: r for r in assemble_clips(pairs, got).collect()}
    shuffled = assemble_clips(pairs, got, max_broadcast_rows=0)
    assert "ShuffledHashJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, clips.values()))
    assert bytes(clips["2020-01-01"]["content"]) == body["c2"] + body["c0"] + body["c2"]
    assert clips["2020-01-02"]["status"] == clips["2020-01-03"]["status"] == "error_download"
    partial = {r["clip_key"][2:12]: r for r in assemble_clips(pairs, got, allow_partial=True).collect()}
    assert bytes(partial["2020-01-02"]["content"]) == body["c1"] and partial["2020-01-03"]["content"] is None

    out = str(tmp_path / "clips")
    done = writers.write_clips(assemble_clips(pairs, got), out, "https://store/")
    assert [(r["url"][:16], r["bytes"]) for r in done.collect()] == [("https://store/n_", 450)]
    assert (tmp_path / "clips" / "day=2020-01-01").is_dir()


def test_a_clip_is_folded_over_batches(monkeypatch):
    """Chunks of a clip lie in several batches, clips are emitted in bounded batches, and no rows give none."""
    import pyarrow as pa

    from soundpairs.operators import clips

    monkeypatch.setattr(clips, "BATCH_BYTES", 10)
    rows = [("a", b"12"), ("a", b""), ("a", b"345"), ("b", b"x" * 11), ("c", b"6"), ("c", b"7"), ("d", b"")]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pylist([{"k": k, "c": c} for k, c in rows[i:i + size]]) for i in range(0, len(rows), size)]
        out = [tuple(r.values()) for b in clips._fold(iter(batches)) for r in b.to_pylist()]
        assert out == [("a", 3, b"12345"), ("b", 1, b"x" * 11), ("c", 2, b"67"), ("d", 1, b"")]
    assert sum(len(b) for b in clips._fold(iter([]))) == 0


def test_windows_are_worked_out_once(spark, tmp_path):
    """Phases, jobs and rows read kept windows, not the reports again."""
    path = str(tmp_path / "reports")
    detections(spark, detection(0), detection(1, timestamp=None), detection(1)).write.parquet(path)
    for listing in (True, False):
        out = archive_pairs(
            spark.read.parquet(path), manifest(spark, SITE, ms("2019-05-10T17:52:32")), list_only=listing)
        assert not [f for f in out.inputFiles() if "/reports/" in f]
        assert sorted((r["pos"], len(r["chunkFiles"])) for r in out.collect()) == [
            (0, 3 if listing else 1), (1, 0), (1, 3)]
