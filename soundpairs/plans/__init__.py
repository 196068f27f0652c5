"""Composed jobs: selection, archive pairs, playlist pairs."""

from soundpairs.plans.archive_pairs import archive_pairs
from soundpairs.plans.playlist_pairs import playlist_pairs, playlist_windows
from soundpairs.plans.select_detections import select_detections

__all__ = ["archive_pairs", "playlist_pairs", "playlist_windows", "select_detections"]
