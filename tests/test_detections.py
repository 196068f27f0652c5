import json
import random
from pathlib import Path

import pytest

from soundpairs import schemas
from soundpairs.operators import detections as ops
from soundpairs.plans import select_detections
from soundpairs.sources import readers, writers
from tests.helpers import detection, detections, ms


def ids(df):
    return [r["id"] for r in df.collect()]


def test_rejected_copy_does_not_block_a_later_one(spark):
    df = detections(
        spark, detection(0, id="a", node="other"), detection(1, id="a", node="Rpi_X"),
        detection(2, id="a", node="rpi_x", description="second"), detection(3, id=None), detection(4, id=""))
    got = select_detections(df, node="RPI_X").collect()
    assert [(r["id"], r["pos"]) for r in got] == [("a", 1)]


def test_since_is_inclusive_and_drops_undatable_only_then(spark):
    df = detections(
        spark, detection(0, timestamp="2020-01-01T00:00:00Z"), detection(1, timestamp="2019-12-31T23:59:59.999Z"),
        detection(2, timestamp=None), detection(3, timestamp="bad", pt=1577836800))
    assert ids(select_detections(df, since="2020-01-01T00:00:00Z")) == ["det_0", "det_3"]
    assert len(ids(select_detections(df, since="2020-01-01T00:00:00Z", all=True))) == 4
    assert len(ids(select_detections(df))) == 4
    with pytest.raises(ValueError):
        select_detections(df, since="yesterday")


def test_cutoff_zone():
    assert ops.cutoff_ms("2020-01-01T01:00:00+01:00") == ops.cutoff_ms("2020-01-01") == ms("2020-01-01")


def test_time_order_is_stable(spark):
    df = detections(
        spark, detection(0, timestamp="2020-01-02T00:00:00Z"), detection(1, timestamp=None),
        detection(2, timestamp="2020-01-01T00:00:00Z"), detection(3, timestamp="2020-01-01T00:00:00Z"),
        detection(4, timestamp="1969-01-01T00:00:00Z"))
    assert [r["pos"] for r in ops.time_sort(df).collect()] == [4, 1, 2, 3, 0]


def test_selection_is_idempotent(spark):
    df = detections(spark, *[detection(i, id=f"d{i % 3}") for i in range(9)])
    once = select_detections(df)
    assert select_detections(once).collect() == once.collect()


def test_first_wins_limits_groups_before_the_shuffle(spark):
    plan = ops.first_wins(detections(spark, detection(0)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def pages(path: Path, sizes):
    n = 0
    for i, size in enumerate(sizes):
        rows = [{k: v for k, v in detection(n + j).items() if k != "pos"} for j in range(size)]
        n += size
        doc = {"data": {"detections": {"results": rows}}}
        (path / f"page-{i * 3:06d}.json").write_text(json.dumps(doc, indent=2))


@pytest.mark.parametrize("sizes, want", [([3, 3, 2], 8), ([3, 2, 3], 5), ([3, 0, 3], 3), ([3, 3], 6)])
def test_pages_end_at_the_first_short_one(spark, tmp_path, sizes, want):
    pages(tmp_path, sizes)
    got = readers.read_pages(spark, str(tmp_path), limit=3).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(want))
    assert got[0]["feed"]["nodeName"] == "rpi_port_townsend"


def test_all_pages_are_read_whatever_their_size(spark, tmp_path):
    pages(tmp_path, [3, 2, 3])
    assert sorted(r["pos"] for r in readers.read_pages(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_envelope(spark, tmp_path):
    path = tmp_path / "one.json"
    rows = [{k: v for k, v in detection(i).items() if k != "pos"} for i in range(3)]
    path.write_text(json.dumps({"since": None, "count": 99, "detections": rows}, indent=1))
    df = readers.read_envelope(spark, str(path))
    assert [r["pos"] for r in df.orderBy("pos").collect()] == [0, 1, 2]
    path.write_text(json.dumps({"since": None, "count": 99}))
    assert readers.read_envelope(spark, str(path)).count() == 0


def parts(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_written_envelope_is_one_document(spark, tmp_path):
    rows = [detection(i, timestamp=f"2020-01-01T00:00:{59 - i:02d}Z", description='q"\n') for i in range(40)]
    df = detections(spark, *rows).repartition(7)
    out = str(tmp_path / "env")
    writers.write_envelope(df, out, since="2020-01-01", node="x", generated_at="now")
    doc = json.loads(parts(out))
    assert (doc["since"], doc["nodeName"], doc["count"], doc["generatedAt"]) == ("2020-01-01", "x", 40, "now")
    assert [d["id"] for d in doc["detections"]] == [f"det_{i}" for i in range(39, -1, -1)]
    assert list(doc["detections"][0]) == schemas.DETECTION.fieldNames()
    assert doc["detections"][0]["listenerCount"] is None

    back = readers.read_envelope(spark, out).orderBy("pos").collect()
    assert [r["id"] for r in back] == [f"det_{i}" for i in range(39, -1, -1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        writers.write_envelope(df, str(tmp_path / "many"), all=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "many").glob("part-*"))) > 1
    back = readers.read_envelope(spark, str(tmp_path / "many")).orderBy("pos").collect()
    assert [r["id"] for r in back] == [f"det_{i}" for i in range(39, -1, -1)]

    writers.write_envelope(df, out, since="2020-01-01", all=True, positions=True)
    assert json.loads(parts(out))["since"] is None
    back = readers.read_envelope(spark, out)
    assert sorted(back.collect()) == sorted(df.collect())


def test_empty_envelope(spark, tmp_path):
    out = str(tmp_path / "env")
    writers.write_envelope(detections(spark, detection(0)).where("false"), out)
    assert json.loads(parts(out))["detections"] == []


def test_landed_filters_reach_the_scan(spark, tmp_path):
    out = str(tmp_path / "landed")
    writers.land_detections(detections(spark, *[detection(i, node=f"N{i % 2}") for i in range(6)]), out)
    df = ops.since(ops.by_node(spark.read.parquet(out), "n1"), "2019-01-01")
    assert sorted(r["pos"] for r in df.collect()) == [1, 3, 5]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(node_key,n1)" in plan and "GreaterThanOrEqual(event_ms" in plan


def test_deep_pages(spark):
    """Any page equals the plain one: gaps, many rows at one position, rows without one, ends and beyond."""
    r = random.Random(3)
    rows = [(p,) for p in [*r.sample(range(10**9), 400), *[77] * 50, *range(-20, 0), None, None, 2**62]]
    df = spark.createDataFrame(rows, "pos long")
    for limit, offset in ((10, 0), (5, 1), (7, 60), (30, 200), (10, 465), (50, 470), (10, 473), (10, 9999), (600, 0), (1, 472)):
        want = [x["pos"] for x in ops.page(df, limit, offset).collect()]
        assert [x["pos"] for x in ops.deep_page(df, limit, offset, ranges=4).collect()] == want
        assert [x["pos"] for x in ops.deep_page(df, limit, offset).collect()] == want
    assert ops.deep_page(df.where("false"), 5, 5).collect() == []
