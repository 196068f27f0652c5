"""Pairs over the chunk archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundpairs.functions.names import chunk_names, chunk_starts, clip_name, flatten
from soundpairs.functions.times import iso_ms, to_utc_ms, window_bounds
from soundpairs.operators.archive import (
    DEFAULT_PHASE, SITE_PHASE_HINT, chunk_presence, day_phase, present_chunks,
)
from soundpairs.operators.common import spread_null_ms, spread_null_text
from soundpairs.operators.pairs import distinct_keys
from soundpairs.schemas import pair_columns
from soundpairs.session import settled

JOB = ["site", "w0", "phase"]


def archive_pairs(
    det: DataFrame, manifest: DataFrame, stored: DataFrame | None = None, site: str | None = None,
    fmt: str = "wav", list_only: bool = False, buffer_s: float = 30, out_dir: str = "",
    hints: dict[str, int] = SITE_PHASE_HINT, default_phase: int = DEFAULT_PHASE,
) -> DataFrame:
    """One row per detection: window, clip path and chunk names.

    ``list_only`` names every chunk the window covers. Otherwise chunkFiles are the chunks
    present; a clip already there (``stored``, or built by an earlier row of this run) keeps
    the full list. A row without timestamp, with an unreadable one, or with an empty window
    stays, blank.
    """
    rows = det.withColumns({
        "site": F.lit(site) if site else F.col("feed.nodeName"),
        "center_ms": F.when(F.lit(buffer_s > 0), to_utc_ms("timestamp")),
    })
    # read for the phases, the jobs and the rows themselves
    rows = day_phase(settled(window_bounds(rows, buffer_s)), manifest, hints, default_phase)
    starts = F.when(F.col("site").isNotNull(), chunk_starts("w0", "w1", F.col("phase")))
    names = F.coalesce(chunk_names("site", starts), F.array().cast("array<string>"))
    if list_only:
        rows = rows.withColumns({"outPath": F.lit(""), "chunkFiles": names})
    else:
        rows = _with_clip(rows, starts, names, manifest, stored, fmt, out_dir)
    rows = rows.withColumns({
        "windowStart": F.coalesce(iso_ms("w0"), F.lit("")),
        "windowEnd": F.coalesce(iso_ms("w1"), F.lit("")),
    })
    return flatten(rows, "archive").select("pos", *[F.col(f"`{c}`") for c in pair_columns("archive")])


def _with_clip(rows, starts, names, manifest, stored, fmt, out_dir) -> DataFrame:
    """Add outPath and chunkFiles.

    Rows sharing site, window and phase share the answer, so presence is worked out once per
    such job, on three narrow columns, and joined back.
    """
    jobs = (
        rows.where("site is not null and w0 is not null")
        .groupBy(*JOB, "w1").agg(F.min("pos").alias("job_pos"))
    )
    chunks = chunk_presence(jobs.withColumn("start_ms", F.explode(starts)), manifest)
    # one clip has at most one job per phase, so this window never holds more than a few rows
    clip = Window.partitionBy("site", "w0")
    has_audio = F.size("present_ms") > 0
    jobs = present_chunks(chunks, [*JOB, "w1", "job_pos"]).withColumns({
        "clip_key": clip_name("site", "w0", "w1", fmt),
        "_built": F.min(F.when(has_audio, F.col("job_pos"))).over(clip),
    }).drop("w1", "job_pos")
    if stored is not None:
        known = distinct_keys(stored).withColumn("_stored", F.lit(True))
        jobs = jobs.join(known, "clip_key", "left")
    else:
        jobs = jobs.withColumn("_stored", F.lit(False))

    keyed = rows.withColumns({
        "_site": spread_null_text(F.col("site"), F.col("pos")),
        "_w0": spread_null_ms(F.col("w0"), F.col("pos")),
        "_phase": F.coalesce("phase", F.lit(-1).cast("long")),
    })
    jobs = jobs.withColumnsRenamed({"site": "_site", "w0": "_w0", "phase": "_phase"})
    there = F.coalesce("_stored", F.lit(False)) | F.coalesce(F.col("pos") > F.col("_built"), F.lit(False))
    some = F.size(F.coalesce("present_ms", F.array().cast("array<bigint>"))) > 0
    path = F.concat(F.lit(out_dir), F.col("clip_key"))
    return (
        keyed.join(jobs, ["_site", "_w0", "_phase"], "left")
        .withColumn("_there", there)
        .withColumn("outPath", F.when(F.col("_there") | some, path).otherwise(F.lit("")))
        .withColumn("chunkFiles", F.when(F.col("_there"), names).otherwise(
            F.coalesce(chunk_names("site", "present_ms"), F.array().cast("array<string>"))))
    )
