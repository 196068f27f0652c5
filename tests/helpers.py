"""Hand-made rows."""

from datetime import datetime, timezone

from soundpairs import schemas


def ms(text: str) -> int:
    when = datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    return int(when.timestamp() * 1000)


def detection(pos, timestamp="2019-05-10T17:52:43.000000Z", id="auto", node="rpi_port_townsend",
              feed_id="feed_a", pt=None, description="water", category=None, **extra):
    feed = {"id": feed_id, "name": "Port", "nodeName": node, "slug": "port"}
    row = {
        "pos": pos, "id": f"det_{pos}" if id == "auto" else id, "feedId": feed_id, "listenerCount": None,
        "category": category, "description": description, "playerOffset": "1.5", "playlistTimestamp": pt,
        "timestamp": timestamp, "candidate": {"id": "cand", "feedId": feed_id}, "feed": feed,
    }
    row.update(extra)
    return row


def detections(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.LANDED)


def streams(spark, *rows):
    """(playlist, start, end) of feed_a, times in ms."""
    return spark.createDataFrame(
        [("feed_a", p, s, e, None) for p, s, e in rows],
        "feed_key string, playlist string, start_ms long, end_ms long, error string")


def segments(spark, *rows):
    return spark.createDataFrame(
        [("feed_a", p, s, e) for p, s, e in rows],
        "feed_key string, playlist string, start_ms long, end_ms long")


def manifest(spark, site, *starts):
    return spark.createDataFrame(
        [(site, s) for s in starts] or [("nowhere", 0)], "site string, start_ms long")
