"""Pairs over the live-stream segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundpairs.functions.names import BASE_URL, clip_name, flatten
from soundpairs.functions.times import iso_ms, to_utc_ms, window_bounds
from soundpairs.operators.common import lookup
from soundpairs.operators.pairs import (
    flag_known, flag_valid, known_keys, missing_objects, with_status,
)
from soundpairs.operators.playlists import BUCKET_S, chunk_array, plan_playlists, resolve_segments
from soundpairs.schemas import pair_columns


def playlist_windows(det: DataFrame, buffer_s: float = 30) -> DataFrame:
    """Validity, feed key, playlist key and window of each detection; w0 null where unusable."""
    flagged = flag_valid(det).withColumns({
        "center_ms": F.when(F.col("valid"), to_utc_ms("timestamp")),
        "playlist": F.col("playlistTimestamp").cast("string"),
    })
    return window_bounds(flagged, buffer_s)


def playlist_pairs(
    det: DataFrame, streams: DataFrame, segments: DataFrame,
    stored: DataFrame | None = None, fresh: DataFrame | None = None,
    prior: DataFrame | None = None, objects: DataFrame | None = None,
    outcomes: DataFrame | None = None, url_root: str = "", prefix: str = "",
    buffer_s: float = 30, prefer_playlist: bool = True, upload: bool = True,
    skip_rows: bool = False, bucket_s: int = BUCKET_S, prune: bool = False,
    base: str = BASE_URL,
) -> DataFrame:
    """One row out per row in: segments of the window, clip path and status.

    ``stored``/``fresh`` (clip_key) are the listings used for skipping, ``prior``
    (prior_key) the earlier run; ``objects`` (url) the segments that exist; ``outcomes``
    (clip_key, encode_error, upload_error) one row per clip of the building step.
    ``skip_rows`` leaves resumed rows out. ``bucket_s`` and ``prune`` steer the overlap.
    """
    if prefix and not prefix.endswith("/"):
        prefix += "/"
    if url_root and not url_root.endswith("/"):
        url_root += "/"
    rows = resolve_segments(
        playlist_windows(det, buffer_s), streams, segments, prefer_playlist,
        bucket_s, prune)
    # plans are a few numbers a row, so they cross the shuffle of the keys; URLs are written out behind it
    rows = rows.withColumn("clip_name", clip_name("node", "w0", "w1", "flac")).withColumn(
        "clip_key", F.concat(F.lit(prefix), F.col("clip_name")))
    rows = flag_known(rows, known_keys(stored, fresh, prior, url_root))
    rows = rows.withColumns({
        "chunkFiles": F.coalesce(chunk_array("node", base=base), F.array().cast("array<string>")),
        "playlistTimestamps": plan_playlists(),
    })
    if skip_rows:
        rows = rows.where(~F.col("in_prior"))
    no_note = F.lit(None).cast("string")
    if objects is not None:
        rows = missing_objects(rows, objects)
    else:
        rows = rows.withColumn("download_error", no_note)
    if outcomes is not None:
        rows = lookup(rows, outcomes.select("clip_key", "encode_error", "upload_error"), "clip_key")
    else:
        rows = rows.withColumns({"encode_error": no_note, "upload_error": no_note})
    rows = with_status(rows, upload, url_root).withColumns({
        "windowStart": F.coalesce(iso_ms("w0"), F.lit("")),
        "windowEnd": F.coalesce(iso_ms("w1"), F.lit("")),
    })
    return flatten(rows, "hls").select("pos", *[F.col(f"`{c}`") for c in pair_columns("hls")])
