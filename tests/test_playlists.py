import random

import pytest
from pyspark.sql import functions as F

from soundpairs.operators import pairs, playlists
from soundpairs.plans import playlist_pairs
from soundpairs.sources import readers, writers
from tests.helpers import detection, detections, ms, segments, streams

T = ms("2019-05-10T17:52:43")
ROOT = "https://b.s3.amazonaws.com/"
KEY = "p/rpi_port_townsend_2019-05-10T17-52-13.000Z_2019-05-10T17-53-13.000Z.flac"


def run(spark, det, str_=(), seg=(), **options):
    options.setdefault("url_root", ROOT)
    options.setdefault("prefix", "p")
    out = playlist_pairs(detections(spark, *det), streams(spark, *str_), segments(spark, *seg), **options)
    return {r["pos"]: r for r in out.collect()}


def index(row):
    return [(u.split("/")[-2], int(u.rsplit("live", 1)[1][:-3])) for u in row["chunkFiles"]]


def test_own_playlist(spark):
    got = run(spark, [detection(0, pt=100)], [("100", T - 30_000, None)])[0]
    assert index(got) == [("100", i) for i in range(1, 7)]
    assert (got["playlistTimestamps"], got["status"], got["flacPath"]) == (["100"], "uploaded", ROOT + KEY)
    assert (got["windowStart"], got["errorStage"], got["errorMessage"]) == ("2019-05-10T17:52:13.000Z", "", "")


def test_own_playlist_alone_past_its_end(spark):
    """The window runs on into the next playlist, which is not added."""
    got = run(spark, [detection(0, pt=100)],
              [("100", T - 60_000, T - 20_000), ("200", T - 20_000, None)],
              [("100", T - 60_000, T - 20_000), ("200", T - 20_000, T)])[0]
    assert index(got) == [("100", 4)]


def test_without_preference_overlap_comes_first(spark):
    args = ([detection(0, pt=100)], [("100", T - 60_000, T - 20_000), ("200", T - 20_000, None)],
            [("200", T - 20_000, T), ("100", T - 60_000, T - 20_000)])
    got = run(spark, *args, prefer_playlist=False)[0]
    assert index(got) == [("100", 4)] + [("200", i) for i in range(1, 6)]
    assert got["playlistTimestamps"] == ["100", "200"]
    last = run(spark, args[0], args[1], prefer_playlist=False)[0]     # no segments: own playlist at last
    assert index(last) == [("100", 4)]


def test_touching_playlist_is_clipped_away(spark):
    end = T - 30_000
    got = run(spark, [detection(0)], [("100", end - 60_000, end)], [("100", end - 10_000, end)])[0]
    assert (got["chunkFiles"], got["status"]) == ([], "no_segments")


def test_touching_segment_names_a_longer_stream(spark):
    end = T - 30_000
    got = run(spark, [detection(0)], [("100", end - 60_000, None)], [("100", end - 10_000, end)])[0]
    assert index(got) == [("100", i) for i in range(7, 13)]


def test_unknown_or_startless_playlists_are_passed_over(spark):
    got = run(spark, [detection(0, pt=5)], [("100", None, None)], [("100", T, T + 10_000), ("7", T, T + 10_000)])[0]
    assert got["status"] == "no_segments"


def test_zero_buffer(spark):
    assert run(spark, [detection(0, pt=100)], [("100", T - 30_000, None)], buffer_s=0)[0]["status"] == "no_segments"


def test_incomplete_and_undatable_rows(spark):
    got = run(spark, [
        detection(0, timestamp=None, pt=100), detection(1, node=None, pt=100), detection(2, feed=None, pt=100),
        detection(3, timestamp="2019-05-10Txx", pt=100), detection(4, feed_id=None, pt=100), detection(5, pt=100)],
        [("100", T - 30_000, None)])
    assert [got[i]["status"] for i in range(6)] == ["invalid_input"] * 3 + ["error", "invalid_input", "uploaded"]
    assert got[0]["errorMessage"] == "Missing timestamp, feedId, or feed.nodeName"
    assert (got[3]["errorStage"], got[3]["errorMessage"]) == ("unexpected", "Invalid date: 2019-05-10Txx")
    assert all(got[i]["chunkFiles"] == [] and got[i]["windowStart"] == "" for i in range(5))


def test_resume_comes_before_everything_found(spark):
    stored = spark.createDataFrame([(KEY,)], "clip_key string")
    prior = spark.createDataFrame([(ROOT + KEY,), ("det_9",)], "prior_key string")
    det = [detection(0, pt=100), detection(1)]
    got = run(spark, det, [("100", T - 30_000, None)], stored=stored, prior=prior)
    assert [got[i]["status"] for i in (0, 1)] == ["resume_skip_in_csv"] * 2
    assert got[0]["flacPath"] == "" and len(got[0]["chunkFiles"]) == 6
    assert run(spark, det, [("100", T - 30_000, None)], prior=prior, skip_rows=True) == {}


def test_existing_clips(spark):
    keys = spark.createDataFrame([(KEY,)], "clip_key string")
    det, cat = [detection(0, pt=100), detection(1)], [("100", T - 30_000, None)]
    listed = run(spark, det, cat, stored=keys)
    assert [listed[i]["status"] for i in (0, 1)] == ["skipped_exists_prelist", "no_segments"]
    assert listed[0]["flacPath"] == ROOT + KEY
    assert run(spark, det, cat, fresh=keys)[0]["status"] == "skipped_exists_head"


def test_failures_of_the_building_steps(spark):
    det, cat = [detection(0, pt=100)], [("100", T - 30_000, None)]
    whole = run(spark, det, cat)[0]["chunkFiles"]
    objects = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")
    assert run(spark, det, cat, objects=objects(whole))[0]["status"] == "uploaded"
    gone = run(spark, det, cat, objects=objects(whole[:2] + whole[4:]))[0]
    assert (gone["status"], gone["errorStage"]) == ("error_download", "download")
    assert gone["errorMessage"] == f"HTTP 404 for {whole[2]}" and gone["flacPath"] == ""
    for stage, e, u in (("encode", "boom", None), ("upload", None, "denied")):
        out = spark.createDataFrame([(KEY, e, u)], "clip_key string, encode_error string, upload_error string")
        row = run(spark, det, cat, outcomes=out)[0]
        assert (row["status"], row["errorStage"], row["errorMessage"]) == (f"error_{stage}", stage, e or u)
    local = run(spark, det, cat, upload=False)[0]
    assert (local["status"], local["flacPath"]) == ("saved_local", "clips/" + KEY[2:])


def test_unreadable_catalog_time_is_a_segment_error(spark):
    raw = spark.createDataFrame(
        [("feed_a", "100", "oops", None), ("feed_a", "200", "2019-05-10T17:00:00Z", None),
         ("feed_a", "200", "2019-05-10T16:00:00Z", None), ("feed_a", "300", None, "oops")],
        "feedId string, playlistTimestamp string, startTime string, endTime string")
    cat = readers.stream_catalog(raw)
    assert {r["playlist"]: (r["start_ms"], r["error"]) for r in cat.collect()} == {
        "100": (None, "Invalid date: oops"), "200": (ms("2019-05-10T16:00:00"), None), "300": (None, None)}
    det = detections(spark, detection(0, pt=100), detection(1))
    segs = segments(spark, ("100", T, T + 10_000), ("200", T, T + 10_000))
    got = {r["pos"]: r for r in playlist_pairs(det, cat, segs, url_root=ROOT).collect()}
    for row in got.values():
        assert (row["status"], row["errorStage"]) == ("error_no_segments", "segments")
        assert row["errorMessage"] == "Invalid date: oops" and row["chunkFiles"] == []


def brute_overlap(wins, segs):
    return sorted((p, s0, s1) for p, f, w0, w1 in wins for g, s0, s1 in segs
                  if f == g and s0 <= w1 and s1 >= w0)


@pytest.mark.parametrize("bucket", [1, 7, 3600])
def test_bucketed_overlap_is_whole(spark, bucket):
    """One feed holds most rows; some segments are long, some have swapped ends."""
    rng = random.Random(11)
    feed = lambda: rng.choice("aaaab")
    wins, segs = [], []
    for p in range(120):
        w0 = rng.randrange(-20_000, 60_000)
        wins.append((p, feed(), w0, w0 + rng.choice([0, 500, 6_000])))
    for _ in range(120):
        s0 = rng.randrange(-20_000, 60_000)
        segs.append((feed(), s0, s0 + rng.choice([0, 10, 1000, 40_000, -300])))
    w = spark.createDataFrame(wins, "pos long, feed_key string, w0 long, w1 long")
    s = spark.createDataFrame([(f, "x", a, b) for f, a, b in segs],
                              "feed_key string, playlist string, start_ms long, end_ms long")
    for prune in (False, True):
        found = playlists.overlap(w, s, bucket, prune)
        assert sorted((r["pos"], r["s0"], r["s1"]) for r in found.collect()) == brute_overlap(wins, segs)


def test_pruning_reaches_the_catalog_scan(spark, tmp_path):
    path = str(tmp_path / "segs")
    segments(spark, *[("x", i * 1000, i * 1000 + 999) for i in range(50)]).write.parquet(path)
    w = spark.createDataFrame([(0, "feed_a", 5000, 6000)], "pos long, feed_key string, w0 long, w1 long")
    df = playlists.overlap(w, spark.read.parquet(path), prune=True)
    assert [r["s0"] for r in df.orderBy("s0").collect()] == [5000, 6000]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "scalar-subquery" in plan or "Subquery" in plan


def test_overlap_never_loops_over_all_pairs(spark):
    w = spark.createDataFrame([(0, "a", 0, 1)], "pos long, feed_key string, w0 long, w1 long")
    s = segments(spark, ("x", 0, 1))
    plan = playlists.overlap(w, s, 60)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hot_window_is_overlapped_once(spark):
    """Many reports of one moment, none with a playlist of its own."""
    det = [detection(i) for i in range(300)]
    got = run(spark, det, [("100", T - 30_000, None)], [("100", T - 40_000, T)])
    assert len(got) == 300 and {len(r["chunkFiles"]) for r in got.values()} == {6}


def test_every_row_comes_out_once(spark):
    det = [detection(i, pt=rng) for i, rng in enumerate([100, None, 7, 100, None])] + [
        detection(5, timestamp=None), detection(6, timestamp="x")]
    for prefer in (True, False):
        got = run(spark, det, [("100", T - 30_000, None)], [("100", T, T + 1)], prefer_playlist=prefer)
        assert sorted(got) == list(range(7))


def test_builders_and_key_sets(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, "")], "pos long, clip_key string")
    got = {r["pos"]: r["builds"] for r in pairs.first_builder(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    stored = spark.createDataFrame([("b",), ("z",), ("b",)], "clip_key string")
    assert [r[0] for r in pairs.remaining(df, stored).collect()] == ["a"]
    assert [r[0] for r in pairs.already_done(df, stored).collect()] == ["b"]


def test_csv_round_trip(spark, tmp_path):
    tricky = ["a,b", 'x"y', None, "", " lead ", '["u","v"]', "new\nline", "cr\rlf", "back\\slash", "#hash"]
    det = [detection(i, pt=100, description=t) for i, t in enumerate(tricky)]
    out = playlist_pairs(detections(spark, *det), streams(spark, ("100", T - 30_000, None)),
                         segments(spark), url_root=ROOT)
    path = str(tmp_path / "csv")
    for n in (1, 2):
        writers.write_pairs_csv(out, path, mode="append")
        back = readers.read_pairs_csv(spark, path)
        assert back.columns == writers.csv_rows(out, "hls").columns
        got = sorted(r["description"] for r in back.collect())
        assert got == sorted([t or "" for t in tricky] * n)
    assert back.first()["chunkFiles"].startswith('["https://') and back.first()["category"] == ""
    assert {r["prior_key"] for r in readers.read_prior_pairs(spark, path).collect()} == {ROOT + KEY[2:]}


def test_training_pairs_and_tally(spark):
    got = playlist_pairs(
        detections(spark, detection(0, pt=100, category="whale"), detection(1, pt=100, description=""), detection(2)),
        streams(spark, ("100", T - 30_000, None)), segments(spark), url_root=ROOT)
    assert [tuple(r) for r in pairs.training_pairs(got).collect()] == [("det_0", ROOT + KEY[2:], "water", "whale")]
    tally = {r["status"]: (r["rows"], r["p50"]) for r in pairs.status_tally(
        got.withColumn("took", F.col("pos")), "took").collect()}
    assert tally == {"uploaded": (2, 0), "no_segments": (1, 2)}


def test_an_open_end_stays_a_few_rows(spark):
    """A catalog row up to the year 9999 lies in few buckets, and still meets every window it covers."""
    w = spark.createDataFrame([(1, "feed_a", 10_000, 70_000), (2, "feed_a", 10**12, 10**12 + 60_000), (3, "feed_a", -60_000, -1)],
                              "pos long, feed_key string, w0 long, w1 long")
    far = ms("9999-12-31T00:00:00")
    found = playlists.overlap(w, segments(spark, ("open", 0, far), ("swapped", far, 50_000), ("day", 0, 86_400_000)))
    assert sorted((r["pos"], r["seg_playlist"]) for r in found.collect()) == [
        (1, "day"), (1, "open"), (2, "open")]


def test_equal_starts_have_one_winner(spark):
    rows = [("p", 0, 99_999), ("p", 0, 10), ("p", 0, None)]
    for order in (rows, rows[::-1]):
        assert [r["end_ms"] for r in playlists.first_streams(streams(spark, *order)).collect()] == [10]


def test_landed_catalog_is_read_by_its_days(spark, tmp_path):
    """Rows of all lengths, swapped and missing ends; the scan leaves out folders of other days."""
    day = 86_400_000
    rows = [("p", d * day + 1000 * i, d * day + 1000 * i + 10_000) for d in range(-3, 40) for i in range(3)]
    rows += [("long", 2 * day, 50 * day), ("endless", -day, 2_932_896 * day), ("swapped", 11 * day, 9 * day),
             ("blank", None, 5 * day), ("open", 5 * day, None), ("half", 9 * day + 1, 10 * day)]
    path = str(tmp_path / "catalog")
    writers.write_segments(segments(spark, *rows), path)
    landed = readers.read_landed_segments(spark, path)
    assert sorted(map(str, landed.drop("reach", "day").collect())) == sorted(map(str, segments(spark, *rows).collect()))
    windows = spark.createDataFrame([("feed_a", 10 * day - 5000, 10 * day + 2000), ("feed_a", 10 * day + 50_000, 10 * day + 60_000)],
                                    "feed_key string, w0 long, w1 long")
    want = sorted(map(str, playlists.overlap(windows, segments(spark, *rows)).collect()))
    found = playlists.overlap(windows, landed, prune=True)
    assert sorted(map(str, found.collect())) == want and any("endless" in w for w in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day#" in plan.split("PartitionFilters")[1][:400]
    near = playlists.pruned(landed, windows).select(F.input_file_name().alias("f")).distinct().count()
    assert near < 8 < landed.select(F.input_file_name().alias("f")).distinct().count()


def test_timings_merge_over_runs(spark):
    """Quantiles of merged sketches have nearly the rank they should have; a status that was never timed has none."""
    r = random.Random(2)
    rows = [("uploaded", "", r.expovariate(1), i % 3) for i in range(6000)] + [("no_segments", "", None, 0)]
    df = spark.createDataFrame(rows, "status string, errorStage string, took double, run int")
    runs = [pairs.timing_sketches(df.where(F.col("run") == k), "took", str(k)) for k in range(3)]
    got = {r["status"]: r for r in pairs.merged_timings(runs[0].unionByName(runs[1]).unionByName(runs[2])).collect()}
    spent = sorted(t for _, _, t, _ in rows if t is not None)
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        rank = sum(t <= got["uploaded"][name] for t in spent) / len(spent)
        assert abs(rank - share) < 0.02
    assert got["uploaded"]["rows"] == 6000 and (got["no_segments"]["rows"], got["no_segments"]["p50"]) == (1, None)


def test_windows_are_worked_out_once(spark, tmp_path):
    """What follows reads kept windows, not the reports again; rows whose own playlist serves are not looked up further."""
    path = str(tmp_path / "reports")
    rows = [detection(0, pt=100), detection(1, pt=7), detection(2, timestamp=None), detection(3), detection(3, pt=100)]
    detections(spark, *rows).write.parquet(path)
    out = playlist_pairs(
        spark.read.parquet(path), streams(spark, ("100", T - 30_000, None)),
        segments(spark, ("100", T - 60_000, T)), url_root=ROOT)
    assert not [f for f in out.inputFiles() if "/reports/" in f]
    got = sorted((r["pos"], r["status"], len(r["chunkFiles"])) for r in out.collect())
    assert got == [(0, "uploaded", 6), (1, "uploaded", 6), (2, "invalid_input", 0), (3, "uploaded", 6), (3, "uploaded", 6)]
