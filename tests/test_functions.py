import pytest
from pyspark.sql import functions as F

from soundpairs import schemas, session
from soundpairs.functions import names, times
from tests.helpers import detection, detections, ms


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [
    ("2019-05-10T17:52:43.179999Z", ms("2019-05-10T17:52:43.179")),
    ("2019-05-10T17:52:43Z", ms("2019-05-10T17:52:43")),
    ("2019-05-10T17:52:43.5+02:00", ms("2019-05-10T15:52:43.5")),
    ("2019-05-10", ms("2019-05-10")),
    ("1969-12-31T23:59:59.999500Z", -1),
    ("T17:52", None), ("not-a-date", None), ("", None), ("2019-13-45T00:00:00Z", None),
    ("2019-05-10T22-32-30Z", None),
])
def test_parse(spark, text, want):
    assert value(spark, times.parse_ms(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [
    ("2019-05-10T22-32-30Z", ms("2019-05-10T22:32:30")),
    ("2019-05-10 22:32:30.1234567Z", ms("2019-05-10T22:32:30.123")),
    ("2019-05-10 22:32:30 Z", None),
])
def test_lenient(spark, text, want):
    assert value(spark, times.to_utc_ms(F.lit(text))) == want


def test_event_ms_falls_back(spark):
    df = spark.createDataFrame(
        [("2019-05-10T17:52:43Z", 5), ("bad", 5), ("", 5), (None, 5), (None, None)], "t string, p long")
    got = [r[0] for r in df.select(times.event_ms("t", "p")).collect()]
    assert got == [ms("2019-05-10T17:52:43"), 5000, 5000, 5000, None]


def test_phase_grid(spark):
    at = ms("2019-05-10T17:52:13")
    assert value(spark, times.floor_phase(F.lit(at), 30, 8)) == ms("2019-05-10T17:52:08")
    assert value(spark, times.ceil_phase(F.lit(ms("2019-05-10T17:53:13")), 30, 8)) == ms("2019-05-10T17:53:38")
    assert value(spark, times.floor_phase(F.lit(-1), 30, 8)) == -22_000
    assert value(spark, times.ceil_phase(F.lit(8_000), 30, 8)) == 8_000


def test_bad_buffer(spark):
    for buffer in (-1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            times.window_bounds(spark.range(1), buffer, "id")


@pytest.mark.parametrize("center, want", [
    ("2019-05-10T17:52:43", ["17-52-08", "17-52-38", "17-53-08"]),
    ("2019-05-10T17:52:38", ["17-52-08", "17-52-38"]),
])
def test_chunks_cover_window(spark, center, want):
    at = F.lit(ms(center))
    starts = names.chunk_starts(at - 30_000, at + 30_000, 8)
    got = value(spark, names.chunk_names(F.lit("rpi_port_townsend"), starts))
    assert got == [f"2019-05-10_{w}_rpi_port_townsend-48000-1.flac" for w in want]


@pytest.mark.parametrize("a, b, want", [
    (0, 60_000, (1, 6)), (3_000, 63_000, (1, 7)), (10_000, 10_001, (2, 2)), (5_000, 5_000, None),
    (-60_000, -1, None), (-30_000, 30_000, (1, 3)), (21_470_000, 21_480_000, (2148, 2148)),
])
def test_segment_range(spark, a, b, want):
    got = value(spark, names.segment_range(F.lit(0).cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long")))
    assert (got and tuple(got)) == want


def test_segment_url_pads_to_three_or_more(spark):
    urls = [value(spark, names.segment_url(F.lit("n"), F.lit("1"), F.lit(i))) for i in (1, 99, 999, 1000, 1234)]
    assert [u.rsplit("/", 1)[1] for u in urls] == [
        "live001.ts", "live099.ts", "live999.ts", "live1000.ts", "live1234.ts"]


def test_no_segments_counting_down(spark):
    long = lambda n: F.lit(n).cast("long")
    assert value(spark, names.enumerate_segments(F.lit("n"), F.lit("p"), long(3), long(2))) == []


def test_missing_window_has_no_interval(spark):
    none = F.lit(None).cast("long")
    cut = names.clip_interval(none, none, F.lit(5).cast("long"), F.lit(9).cast("long"))
    assert value(spark, cut["a"]) is None
    live = names.clip_interval(F.lit(1).cast("long"), F.lit(7).cast("long"), F.lit(5).cast("long"), none)
    assert tuple(value(spark, live)) == (5, 7)


@pytest.mark.parametrize("region, host", [
    (None, "b.s3.amazonaws.com"), ("", "b.s3.amazonaws.com"), ("us-east-1", "b.s3.amazonaws.com"),
    ("EU", "b.s3.eu-west-1.amazonaws.com"), ("us-west-2", "b.s3.us-west-2.amazonaws.com"),
])
def test_object_url(spark, region, host):
    got = value(spark, names.object_url(F.lit("b"), F.lit(region).cast("string"), F.lit("k/x.flac")))
    assert got == f"https://{host}/k/x.flac"


def test_norm_prefix(spark):
    assert [value(spark, names.norm_prefix(p)) for p in ("", "a", "a/")] == ["", "a/", "a/"]


def test_uri_component(spark):
    got = value(spark, names.chunk_url(F.lit("a b~(c)!'*"), F.lit(0).cast("long"), "https://x"))
    assert got.endswith("_a%20b~(c)!'*-48000-1.flac")


@pytest.mark.parametrize("text, want", [
    ("a,b", '"a,b"'), ('x"y', '"x""y"'), (None, ""), ("", ""), (" lead ", " lead "), ("a\nb", '"a\nb"'),
    ("cr\rhere", "cr\rhere"), ('["u","v"]', '"[""u"",""v""]"'),
])
def test_csv_escape(spark, text, want):
    assert value(spark, names.csv_escape(F.lit(text).cast("string"))) == want


def test_headers():
    base = ["candidate.feedId", "candidate.id", "category", "description", "feed.id", "feed.name",
            "feed.nodeName", "feedId", "id", "listenerCount", "playerOffset", "playlistTimestamp", "timestamp"]
    assert schemas.base_columns("hls") == base
    assert schemas.base_columns("archive") == [c for c in base if c != "feed.nodeName"]
    assert schemas.pair_columns("archive")[-4:] == ["windowStart", "windowEnd", "outPath", "chunkFiles"]


def test_flatten_nulls(spark):
    df = detections(
        spark, detection(0, feed={"id": None, "name": "N", "nodeName": None, "slug": "s"}),
        detection(1, feed=None, candidate=None))
    first, second = names.flatten(df, "hls").orderBy("pos").collect()
    assert (first["feed.id"], first["feed.name"], first["feed.nodeName"]) == ("", "N", "")
    assert (second["feed.id"], second["candidate.id"]) == (None, None)
    assert "feed" not in first.asDict() and "candidate" not in first.asDict()


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == configured
    kept = session.settled(spark.range(5))
    assert kept.count() == 5 and all(configured in f for f in kept.inputFiles())


def test_numbers_that_are_no_times(spark):
    from soundpairs.functions import times

    df = spark.createDataFrame([(None, 9_999_999_999_999_999), (None, 10**12), ("not-a-date", 1_500_000_000), (None, None)],
                               "t string, p long")
    got = [r[0] for r in df.select(times.event_ms("t", "p")).collect()]
    assert got == [None, None, 1_500_000_000_000, None]
    far = spark.createDataFrame([(10**15,), (0,), (-10**17,)], "ms long")
    assert [tuple(r) for r in far.select(times.day_key("ms"), times.iso_ms("ms")).collect()] == [
        (None, None), ("1970-01-01", "1970-01-01T00:00:00.000Z"), (None, None)]
