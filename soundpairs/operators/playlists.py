"""Live-stream playlists: lookup, interval overlap and the three-stage resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundpairs.functions.names import BASE_URL, clip_interval, enumerate_segments, segment_range
from soundpairs.functions.times import DAY_MS, col, day_start, whole
from soundpairs.operators.common import first_row, spread_null_text
from soundpairs.session import settled

BUCKET_S = 600
# a landed catalog keeps rows of up to one day, of up to 64 days, and all others in folders of their own
REACH_DAYS = (1, 64)
# bucket sizes of ever longer catalog rows, in buckets; the longest is some five years of ten-minute buckets
LEVELS = (1, 64, 4096, 262_144)

# a plan lists (playlist, first, last); URLs are written out only at the very end
PLAN_TYPE = "array<struct<playlist:string,first:bigint,last:bigint>>"
WINDOW = ["feed_key", "w0", "w1"]


def first_streams(streams: DataFrame) -> DataFrame:
    """One stream per (feed_key, playlist): the earliest, of those the one that ends first."""
    order = [F.asc_nulls_last(c) for c in ("start_ms", "end_ms", "error") if c in streams.columns]
    return first_row(streams, ["feed_key", "playlist"], order)


def lookup_streams(det: DataFrame, streams: DataFrame) -> DataFrame:
    """Left lookup of (feed_key, playlist); adds stream_start, stream_end, stream_error.

    ``streams`` holds one row per key (see ``first_streams``). Rows without a playlist keep
    out of each other's way in the shuffle.
    """
    found = streams.select(
        F.col("feed_key").alias("_feed"), F.col("playlist").alias("_list"),
        F.col("start_ms").alias("stream_start"), F.col("end_ms").alias("stream_end"),
        (F.col("error") if "error" in streams.columns else F.lit(None).cast("string"))
        .alias("stream_error"),
    )
    salt = F.col("pos") if "pos" in det.columns else F.col("w0")
    keyed = det.withColumns({
        "_feed": F.coalesce("feed_key", F.lit("")),
        "_list": spread_null_text(F.col("playlist"), salt),
    })
    return keyed.join(found, ["_feed", "_list"], "left").drop("_feed", "_list")


def stream_range() -> Column:
    """Segment range of the looked-up stream under the window, from the stream's own bounds."""
    cut = clip_interval("w0", "w1", "stream_start", "stream_end")
    return segment_range("stream_start", cut["a"], cut["b"])


def stream_meets() -> Column:
    """Whether ``stream_range`` has any segment, as plain comparisons.

    Filters copy the expressions they test; this keeps them small.
    """
    w0, w1, start = F.col("w0"), F.col("w1"), F.col("stream_start")
    end = F.coalesce(F.col("stream_end"), w1)
    return F.coalesce((w1 > w0) & (w1 > start) & (end > w0) & (end > start), F.lit(False))


def _own_plan() -> Column:
    spot = stream_range()
    step = F.struct(F.col("playlist"), spot["first"].alias("first"), spot["last"].alias("last"))
    usable = stream_meets() & F.col("stream_error").isNull()
    return F.when(usable, F.array(step)).otherwise(F.array()).cast(PLAN_TYPE)


def direct_plan(det: DataFrame, streams: DataFrame) -> DataFrame:
    """Stage 1: the row's own playlist alone. Adds ``plan`` (maybe empty) and ``plan_error``."""
    return (
        lookup_streams(det, streams).withColumn("plan", _own_plan())
        .withColumnRenamed("stream_error", "plan_error").drop("stream_start", "stream_end")
    )


def day_number(ms: Column) -> Column:
    """Days since the epoch, rounded down."""
    return whole(day_start(ms), F.lit(DAY_MS).cast("long"))


def reach_and_day(start: str = "start_ms", end: str = "end_ms") -> dict[str, Column]:
    """Where a catalog row is landed: how long it is, and the day that it begins on."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    reach = F.lit(len(REACH_DAYS))
    for k in reversed(range(len(REACH_DAYS))):
        reach = F.when(hi - lo <= F.lit(REACH_DAYS[k] * DAY_MS).cast("long"), F.lit(k)).otherwise(reach)
    bounded = F.col(start).isNotNull() & F.col(end).isNotNull()
    return {"reach": F.when(bounded, reach).otherwise(F.lit(len(REACH_DAYS))), "day": day_number(lo)}


def _slot(ms: Column, level: int, bucket_s: int) -> Column:
    size = F.lit(bucket_s * 1000 * LEVELS[level]).cast("long")
    return whole(ms - F.pmod(ms, size), size)


def _level(lo: Column, hi: Column, bucket_s: int) -> Column:
    """The level whose buckets cut a catalog row into two at most; the last level for all longer rows."""
    out = F.lit(len(LEVELS) - 1)
    for k in reversed(range(len(LEVELS) - 1)):
        out = F.when(_slot(hi, k, bucket_s) - _slot(lo, k, bucket_s) <= 1, F.lit(k)).otherwise(out)
    return out


def _places(lo: Column, hi: Column, level: int, bucket_s: int) -> Column:
    first = _slot(lo, level, bucket_s)
    return F.transform(F.sequence(first, _slot(hi, level, bucket_s), F.lit(1).cast("long")), lambda b: F.struct(
        F.lit(level).alias("level"), b.alias("bucket"), first.alias("first")))


def used_levels(segments: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """One row: a bit for every level that some catalog row lies in."""
    lo, hi = F.least("start_ms", "end_ms"), F.greatest("start_ms", "end_ms")
    whole_rows = segments.where("start_ms is not null and end_ms is not null")
    return whole_rows.select(F.shiftleft(F.lit(1), 0).alias("_one"), _level(lo, hi, bucket_s).alias("_k")).agg(
        F.expr("bit_or(shiftleft(_one, _k))").alias("levels"))


def pruned(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Catalog rows that the time span of all windows reaches.

    A landed catalog (see ``write_segments``) is filtered by its folders, any other by its times.
    """
    spans = windows.agg(F.min("w0").alias("lo"), F.max("w1").alias("hi"))
    lo, hi = spans.select("lo").scalar(), spans.select("hi").scalar()
    if {"reach", "day"} <= set(segments.columns):
        days = spans.select(*[day_number(F.col(c)).alias(c) for c in ("lo", "hi")])
        first, last = days.select("lo").scalar(), days.select("hi").scalar()
        near = F.lit(False)
        for k, longest in enumerate(REACH_DAYS):
            near = near | ((F.col("reach") == k) & (F.col("day") >= first - longest))
        segments = segments.where((F.col("day") <= last) & (near | (F.col("reach") == len(REACH_DAYS))))
    return segments.where((F.col("start_ms") <= hi) & (F.col("end_ms") >= lo))


def overlap(
    windows: DataFrame, segments: DataFrame, bucket_s: int = BUCKET_S, prune: bool = False,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Windows and segments of one feed that meet, both ends inclusive; null ends never match.

    Buckets turn a busy feed into many small equi-joins; a pair is kept only in the first
    bucket both sides share, so none doubles. A catalog row lies in buckets of the size that
    cuts it into two at most (up to the largest size), so a row without a real end is no more
    rows than others; windows lie in the few buckets they touch of every size that the catalog
    uses (``levels``, taken from the segments unless given).
    ``prune`` first finds the time span of the windows and filters the catalog scan by it:
    worth a second look at the windows where they are few and recent.
    """
    if prune:
        segments = pruned(segments, windows)
    if levels is None:
        levels = used_levels(segments, bucket_s)
    used = levels.scalar()
    segs = segments.select(
        "feed_key", F.col("playlist").alias("seg_playlist"),
        F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"),
    ).where("s0 is not null and s1 is not null")
    meet = (F.col("s0") <= F.col("w1")) & (F.col("s1") >= F.col("w0"))
    none = F.array().cast("array<struct<level:int,bucket:bigint,first:bigint>>")
    left = windows.where("w0 is not null and w1 is not null and w0 <= w1").withColumn("_w", F.explode(F.concat(*[
        F.when(used.bitwiseAND(F.lit(1 << k)) > 0, _places(F.col("w0"), F.col("w1"), k, bucket_s)).otherwise(none)
        for k in range(len(LEVELS))])))
    # a catalog row with swapped ends still meets windows that hold both of them
    lo, hi, last = F.least("s0", "s1"), F.greatest("s0", "s1"), len(LEVELS) - 1
    level = _level(lo, hi, bucket_s)
    fit = F.when(level == 0, _places(lo, hi, 0, bucket_s))
    for k in range(1, last):
        fit = fit.when(level == k, _places(lo, hi, k, bucket_s))
    right = segs.withColumn("_s", F.explode(fit.otherwise(_places(lo, hi, last, bucket_s))))
    keyed = [F.col(c).alias(f"_{n}") for c, n in (("_w.level", "level"), ("_w.bucket", "bucket"), ("_w.first", "wf"))]
    left = left.select(*windows.columns, *keyed)
    right = right.select("feed_key", "seg_playlist", "s0", "s1", F.col("_s.level").alias("_level"),
                         F.col("_s.bucket").alias("_bucket"), F.col("_s.first").alias("_sf"))
    return (
        left.join(right, ["feed_key", "_level", "_bucket"])
        .where(meet & (F.col("_bucket") == F.greatest("_wf", "_sf")))
        .drop("_level", "_bucket", "_wf", "_sf")
    )


def by_playlist(overlaps: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """Playlists of each window with the start of their first overlapping segment."""
    return overlaps.groupBy(*keys, F.col("seg_playlist").alias("playlist")).agg(
        F.min("s0").alias("first_start")
    )


def ordered_plan(ranges: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """Collect (first_start, playlist, first, last) rows into one ordered plan per key.

    A group holds the playlists under one window, a handful.
    """
    steps = F.array_sort(F.collect_list(F.struct("first_start", "playlist", "first", "last")))
    plan = F.transform(steps, lambda s: F.struct(s["playlist"], s["first"], s["last"]))
    return ranges.groupBy(*keys).agg(plan.cast(PLAN_TYPE).alias("plan"))


def overlap_plan(
    windows: DataFrame, streams: DataFrame, segments: DataFrame, bucket_s: int = BUCKET_S,
    prune: bool = False,
) -> DataFrame:
    """Stage 2 for distinct windows (feed_key, w0, w1): ``found``, ``found_error``.

    Segments only name the playlists; the index range comes from each playlist's stream.
    Copies of a segment name nothing new and fold together before they are shuffled.
    """
    if prune:
        segments = pruned(segments, windows)
    once = segments.select("feed_key", "playlist", "start_ms", "end_ms").distinct()
    named = by_playlist(overlap(windows, once, bucket_s, levels=used_levels(segments, bucket_s)))
    spot = stream_range()
    looked = lookup_streams(named, streams)
    ranges = looked.where(stream_meets() | F.col("stream_error").isNotNull()).select(
        *WINDOW, "first_start", "playlist", "stream_error",
        spot["first"].alias("first"), spot["last"].alias("last"),
    )
    steps = F.array_sort(F.collect_list(
        F.struct("first_start", "playlist", "first", "last", "stream_error")))
    return (
        ranges.groupBy(*WINDOW).agg(steps.alias("_steps"))
        .withColumn("_bad", F.filter("_steps", lambda s: s["stream_error"].isNotNull()))
        .withColumn("found_error", F.try_element_at("_bad", F.lit(1))["stream_error"])
        .withColumn("found", F.when(
            F.col("found_error").isNull(),
            F.transform("_steps", lambda s: F.struct(s["playlist"], s["first"], s["last"])),
        ).otherwise(F.array()).cast(PLAN_TYPE))
        .drop("_steps", "_bad")
    )


def resolve_segments(
    det: DataFrame, streams: DataFrame, segments: DataFrame,
    prefer_playlist: bool = True, bucket_s: int = BUCKET_S, prune: bool = False,
) -> DataFrame:
    """The cascade: own playlist, then overlapping playlists, then own playlist regardless.

    ``det`` has pos, feed_key, playlist, w0, w1 (null w0: nothing to resolve). Adds ``plan``
    and ``plan_error``. Only windows the first stage left open are overlapped, each distinct
    window once, however many detections share it; the other rows are not shuffled for them.
    Windows and their own streams are worked out once and kept in the shared folder.
    """
    own = settled(lookup_streams(det, streams))
    open_ = F.col("w0").isNotNull() & F.col("feed_key").isNotNull()
    if prefer_playlist:
        open_ = open_ & ~stream_meets() & F.col("stream_error").isNull()
    marked = own.withColumn("_open", open_)
    todo = marked.where("_open")
    found = overlap_plan(todo.select(*WINDOW).distinct(), streams, segments, bucket_s, prune)
    hit = (F.size("found") > 0) | F.col("found_error").isNotNull()
    looked = todo.join(found, WINDOW, "left").withColumns({
        "plan": F.when(hit, F.col("found")).otherwise(_own_plan()),
        "plan_error": F.when(hit, F.col("found_error")).otherwise(F.col("stream_error")),
    }).drop("found", "found_error")
    rest = marked.where("not _open").withColumns({"plan": _own_plan(), "plan_error": F.col("stream_error")})
    return rest.unionByName(looked).drop("_open", "stream_start", "stream_end", "stream_error")


def chunk_array(node, plan="plan", base: str = BASE_URL) -> Column:
    """All segment URLs of a plan: playlist order, then index."""
    node, plan = col(node), col(plan)
    urls = F.transform(plan, lambda p: enumerate_segments(
        node, p["playlist"], p["first"], p["last"], base))
    return F.flatten(urls)


def plan_playlists(plan="plan") -> Column:
    return F.transform(col(plan), lambda p: p["playlist"])
