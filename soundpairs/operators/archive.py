"""Archive chunks: phase detection, enumeration, presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundpairs.functions.names import CHUNK_SECONDS, chunk_name, chunk_starts
from soundpairs.functions.times import day_start, minute_start, whole
from soundpairs.operators.common import spread_null_ms, spread_null_text
from soundpairs.session import settled

# fixed values: seconds of the minute tried first, then 0..59; phase when a day has none
PROBE_FIRST = [2, 8, 21, 22, 32, 38, 51, 52]
SITE_PHASE_HINT = {"rpi_sunset_bay": 2, "rpi_port_townsend": 8}
DEFAULT_PHASE = 2


def _second(ms: Column) -> Column:
    return whole(ms - minute_start(ms), F.lit(1000).cast("long"))


def probe_rank(second: Column) -> Column:
    """Place of a second in the probing order."""
    listed = F.array_position(F.array(*[F.lit(s) for s in PROBE_FIRST]), second.cast("int"))
    return F.when(listed > 0, listed).otherwise(F.lit(len(PROBE_FIRST) + 1) + second)


def _probe_code(start: Column) -> Column:
    """Rank and second in one long, so that its minimum is the chunk a probe finds first."""
    return probe_rank(_second(start)) * 100 + _second(start)


def minute_probes(manifest: DataFrame) -> DataFrame:
    """(site, minute_ms, probe_second): the chunk a probe of that minute finds first."""
    start = F.col("start_ms")
    return (
        manifest.groupBy("site", minute_start(start).alias("minute_ms"))
        .agg(F.min(_probe_code(start)).alias("_code"))
        .select("site", "minute_ms", F.pmod("_code", F.lit(100)).alias("probe_second"))
    )


def phase_probe(det: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the probed second of each row's minute and its phase (null: nothing found).

    ``det`` has pos, site, center_ms.
    """
    keyed = det.withColumns({
        "_site": spread_null_text(F.col("site"), F.col("pos")),
        "_minute": spread_null_ms(minute_start("center_ms"), F.col("pos")),
    })
    probes = minute_probes(manifest).withColumnsRenamed({"site": "_site", "minute_ms": "_minute"})
    return (
        keyed.join(probes, ["_site", "_minute"], "left")
        .drop("_site", "_minute")
        .withColumn("probe_phase", F.pmod("probe_second", F.lit(CHUNK_SECONDS)))
    )


def first_hits(det: DataFrame, manifest: DataFrame) -> DataFrame:
    """(site, day_ms, hit_pos, hit_phase): each day's first successful probe in input order.

    Rows of one minute share one probe, so the detections shrink to their minutes before
    anything is shuffled; the manifest meets those minutes only, unaggregated.
    """
    minutes = (
        det.where("site is not null and center_ms is not null")
        .groupBy("site", minute_start("center_ms").alias("minute_ms"))
        .agg(F.min("pos").alias("pos"))
    )
    start = F.col("start_ms")
    found = manifest.select("site", minute_start(start).alias("minute_ms"), _probe_code(start).alias("code"))
    return (
        found.join(minutes, ["site", "minute_ms"])
        .groupBy("site", day_start("minute_ms").alias("day_ms"))
        .agg(F.min(F.struct("pos", "code")).alias("hit"))
        .select("site", "day_ms", F.col("hit.pos").alias("hit_pos"),
                (F.col("hit.code") % 100 % CHUNK_SECONDS).alias("hit_phase"))
    )


def site_hint(site: Column, hints: dict[str, int], default: int) -> Column:
    choice = F.lit(default).cast("long")
    for name, phase in hints.items():
        choice = F.when(site == name, F.lit(phase).cast("long")).otherwise(choice)
    return choice


def day_phase(
    det: DataFrame, manifest: DataFrame,
    hints: dict[str, int] = SITE_PHASE_HINT, default: int = DEFAULT_PHASE,
) -> DataFrame:
    """Add ``phase``: the day's first hit from that row on, before it the site's hint.

    Equal to carrying the first non-null probe over (site, day) in input order, but a busy
    day is never gathered in one window partition. The hits are worked out once and kept in
    the shared folder; they are joined by broadcast only if that table is small.
    """
    hits = first_hits(det, manifest).withColumnsRenamed({"site": "_site", "day_ms": "_day"})
    keyed = det.withColumns({
        "_site": spread_null_text(F.col("site"), F.col("pos")),
        "_day": spread_null_ms(day_start("center_ms"), F.col("pos")),
    })
    phase = F.when(F.col("pos") >= F.col("hit_pos"), F.col("hit_phase")).otherwise(
        site_hint(F.col("site"), hints, default)
    )
    return (
        keyed.join(settled(hits), ["_site", "_day"], "left")
        .withColumn("phase", F.when(F.col("center_ms").isNotNull(), phase))
        .drop("_site", "_day", "hit_pos", "hit_phase")
    )


def enumerate_chunks(df: DataFrame, step_s: int = CHUNK_SECONDS) -> DataFrame:
    """One row per chunk covering the window (site, w0, w1, phase): ``start_ms``, ``chunk``."""
    starts = chunk_starts("w0", "w1", F.col("phase"), step_s)
    return df.withColumn("start_ms", F.explode(starts)).withColumn(
        "chunk", chunk_name("site", "start_ms")
    )


def chunk_presence(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Flag enumerated chunks (site, start_ms) the manifest has."""
    known = manifest.select("site", "start_ms").distinct().withColumn("_known", F.lit(True))
    return (
        chunks.join(known, ["site", "start_ms"], "left")
        .withColumn("present", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def present_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Present chunk starts of every key in time order (a window bounds their number)."""
    starts = F.collect_set(F.when(F.col("present"), F.col("start_ms")))
    return chunks.groupBy(*keys).agg(F.array_sort(starts).alias("present_ms"))
