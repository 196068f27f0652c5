"""Selecting detections: filters, first-wins distinct, time order, paging."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundpairs.functions.times import event_ms
from soundpairs.operators.common import first_row

def report_ms() -> Column:
    return event_ms("timestamp", "playlistTimestamp")


def _report_ms(df: DataFrame) -> Column:
    # a landed table already stores the time, and a filter on it reaches the scan
    return F.col("event_ms") if "event_ms" in df.columns else report_ms()


def has_id(df: DataFrame) -> DataFrame:
    return df.where(F.col("id").isNotNull() & (F.col("id") != ""))


def by_node(df: DataFrame, want: str | None) -> DataFrame:
    """Case-insensitive node match; an empty ``want`` keeps all rows."""
    if not want:
        return df
    stored = "node_key" in df.columns
    have = F.col("node_key") if stored else F.lower("feed.nodeName")
    return df.where(have == want.lower())


def cutoff_ms(cutoff: str) -> int:
    """Cutoff text to epoch ms; a time without zone is UTC."""
    try:
        when = datetime.fromisoformat(cutoff)
    except ValueError as e:
        raise ValueError(f"not an ISO date: {cutoff}") from e
    if when.tzinfo is None:
        when = when.replace(tzinfo=timezone.utc)
    gap = when - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (gap.days * 86_400 + gap.seconds) * 1000 + gap.microseconds // 1000


def since(df: DataFrame, cutoff: str | None, all: bool = False) -> DataFrame:
    """Rows at or after the cutoff; undatable rows go only when there is a cutoff."""
    if all or not cutoff:
        return df
    return df.where(_report_ms(df) >= F.lit(cutoff_ms(cutoff)).cast("long"))


def first_wins(df: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """First row per key in input order. Filter before, never after."""
    return first_row(df, [key], [pos])


def count_detections(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def sort_ms(df: DataFrame) -> Column:
    """Sort time: undatable rows count as 0."""
    return F.coalesce(_report_ms(df), F.lit(0).cast("long"))


def time_sort(df: DataFrame) -> DataFrame:
    """Ascending by time, input order within a time (range-partitioned, so no hot value)."""
    return df.orderBy(sort_ms(df), "pos")


def page(df: DataFrame, limit: int = 250, offset: int = 0) -> DataFrame:
    return df.orderBy("pos").offset(offset).limit(limit)


def deep_page(df: DataFrame, limit: int, offset: int, ranges: int = 1024) -> DataFrame:
    """The rows that ``page`` gives, however far down, without sorting what lies before them.

    Rows are counted by equal ranges of ``pos`` (``ranges`` counts reach the driver), and the range that holds the
    page is cut again until it is about as large as the page or a single position; only its rows are sorted. Rows
    without a position come first, as in any sort.
    """
    lo, hi = df.agg(F.min("pos"), F.max("pos")).first()
    if lo is None:
        return page(df, limit, offset)
    key, before = F.coalesce(F.col("pos"), F.lit(lo - 1).cast("long")), 0
    lo -= 1
    while True:
        width = (hi - lo) // ranges + 1
        slot = F.call_function("div", key - F.lit(lo).cast("long"), F.lit(width).cast("long"))
        rows = df.where(key.between(lo, hi)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()
        first = last = None
        seen = before
        for r in sorted(rows):
            if first is None and seen + r.n > offset:
                first, skipped = r.slot, seen
            if seen < offset + limit:
                last = r.slot
            seen += r.n
        if first is None:
            return df.where("false")
        held = sum(r.n for r in rows if first <= r.slot <= last)
        near, far = lo + first * width, min(hi, lo + (last + 1) * width - 1)
        done = width == 1 or held <= 4 * limit or far - near >= hi - lo
        lo, hi, before = near, far, skipped
        if done:
            return df.where(key.between(lo, hi)).orderBy("pos").offset(offset - before).limit(limit)
