"""Selecting the detections to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from soundpairs.operators.detections import by_node, first_wins, has_id, since as at_or_after, time_sort


def select_detections(
    df: DataFrame, since: str | None = None, all: bool = False, node: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Filter, then keep the first row of each id, then sort by time.

    ``ordered=False`` leaves the sort (a range shuffle) to whoever writes the rows.
    """
    kept = first_wins(at_or_after(by_node(has_id(df), node), since, all))
    return time_sort(kept) if ordered else kept
