"""Streams over landed files.

Every ``foreachBatch`` sink writes batch N of a checkpoint to a folder of its own in overwrite
mode: a batch run again after a lost driver or executor replaces its own output, so appends
are exactly-once. Where keys must stay unique they are remembered in keyed state (see ``state``), so
no batch reads what earlier ones wrote; a run started over with a new checkpoint takes the keys of
the target first.

Rows that lacked something when they came are resolved again by ``resolve_again``, which leaves what
was written and adds a newer version; ``latest_pairs`` reads the newest of each row.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from soundpairs import schemas
from soundpairs.functions.times import event_ms
from soundpairs.operators.common import first_row
from soundpairs.operators.detections import has_id
from soundpairs.operators.playlists import direct_plan
from soundpairs.plans.playlist_pairs import playlist_pairs, playlist_windows
from soundpairs.session import settled
from soundpairs.streaming.state import first_arrivals, state_parts, use_keyed_store


def stream_detections(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New detection files (JSON lines with ``pos``) as they land."""
    return spark.readStream.schema(schemas.LANDED).option("maxFilesPerTrigger", max_files).json(path)


def stream_pages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New page files as they land; position is file offset plus place in the page."""
    offset = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("long")
    return (
        spark.readStream.schema(schemas.PAGE).option("multiLine", True)
        .option("maxFilesPerTrigger", max_files).json(path)
        .select(offset.alias("_o"), F.posexplode("data.detections.results").alias("_i", "_d"))
        .select((F.col("_o") + F.col("_i")).alias("pos"), "_d.*")
    )


class _Sink:
    """Folders ``run=R/batch_id=N`` under the target; R is the stream's own id.

    Spark keeps that id in the checkpoint: a restart goes on under it, and a checkpoint begun anew
    in the same place has another, so its batches never replace those of the old one.
    """

    def __init__(self, target: str, checkpoint: str, run: str | None = None):
        self.target, self.checkpoint, self.run = target, checkpoint, run

    def named(self, spark: SparkSession) -> None:
        if self.run is None:
            self.run = "r" + json.loads(spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.target}/run={self.run}/batch_id={batch_id}")

    def others(self, batch: DataFrame, batch_id: int, key: str) -> DataFrame | None:
        """The ``key`` column of everything but this batch, or None before the first."""
        stored = T.StructType([
            batch.schema[key], T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
        try:
            done = batch.sparkSession.read.schema(stored).parquet(self.target)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return done.where((F.col("run") != self.run) | (F.col("batch_id") != batch_id)).select(key)

    def only_new(self, batch: DataFrame, batch_id: int, key: str) -> DataFrame:
        """Rows of a batch that stands by itself, without a stream's state, whose key is nowhere else."""
        first = first_row(batch, [key], ["pos"])
        seen = self.others(batch, batch_id, key)
        return first if seen is None else first.join(seen, key, "left_anti")

    def start(self, sdf: DataFrame, key: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
        """Write what ``make`` gives for the rows of each batch whose key is new."""
        spark = sdf.sparkSession
        use_keyed_store(spark)

        def each(batch: DataFrame, n: int) -> None:
            # the state is run once; the session of a stateful stream plans without AQE, the caller's may have it
            rows = settled(batch, spark)
            self.named(spark)
            self.write(make(rows), n)

        with state_parts(spark):
            return (
                first_arrivals(sdf, key, self.target).writeStream.foreachBatch(each)
                .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            )


def stream_dedupe(sdf: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Exact first-wins by id: inside the batch by position, across batches by arrival."""
    return _Sink(target, checkpoint).start(has_id(sdf), "id")


def watermark_dedupe(sdf: DataFrame, delay: str = "30 days") -> DataFrame:
    """Bounded-state de-duplication; rows later than ``delay`` may be dropped or repeated.

    A row without a readable time is dated by arrival, else it would never be compared.
    """
    dated = F.coalesce(F.timestamp_millis(event_ms("timestamp", "playlistTimestamp")), F.current_timestamp())
    return has_id(sdf).withColumn("event_time", dated).withWatermark(
        "event_time", delay).dropDuplicatesWithinWatermark(["id"])


def stream_stage1(sdf: DataFrame, streams: DataFrame, buffer_s: float = 30) -> DataFrame:
    """Stream-static lookup of each detection's own playlist (no state)."""
    return direct_plan(playlist_windows(sdf, buffer_s), streams)


def stream_resolve(
    sdf: DataFrame, streams: DataFrame, segments: DataFrame, target: str, checkpoint: str, **options
) -> StreamingQuery:
    """The full cascade per micro-batch; one pair row per detection, told apart by ``pos``.

    A micro-batch spans little time, so the segment scan is filtered by its span. Detections that
    the target holds already are not resolved again, also under a new checkpoint; see
    ``resolve_again`` for those that were left without a clip.
    """
    options.setdefault("prune", True)
    return _Sink(target, checkpoint).start(
        sdf, "pos", lambda rows: playlist_pairs(rows, streams, segments, **options))


def stream_append(sdf: DataFrame, target: str, checkpoint: str, key: str = "clip_key") -> StreamingQuery:
    """Append rows whose clip key the target does not hold yet."""
    return _Sink(target, checkpoint).start(sdf, key)


_AGAIN = "again-"


def is_open() -> Column:
    """Rows that may come out otherwise when more of the catalog, or more objects, have landed.

    A row whose clip an earlier run made is open only as long as it has no segments.
    """
    bare = (F.col("status") == "resume_skip_in_csv") & (F.size("chunkFiles") == 0)
    return (F.col("status") == "no_segments") | F.col("status").startswith("error_") | bare


def _versions(spark: SparkSession, target: str) -> DataFrame:
    """All rows under ``target`` with their version: 0 from a stream, then one more for each retry."""
    rows = spark.read.parquet(target)
    number = F.regexp_extract(F.col("run").cast("string"), f"^{_AGAIN}([0-9]+)$", 1)
    return rows.withColumn("_version", F.when(number != "", number.try_cast("long")).otherwise(F.lit(0))).drop("run", "batch_id")


def latest_pairs(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of every row that a stream or a retry wrote.

    Retries hold few rows, so the streams' rows are only held against their positions.
    """
    rows = _versions(spark, target)
    again = first_row(rows.where("_version > 0"), ["pos"], [F.col("_version").desc()])
    return rows.where("_version = 0").join(again.select("pos"), "pos", "left_anti").unionByName(again).drop("_version")


def resolve_again(
    det: DataFrame, streams: DataFrame, segments: DataFrame, target: str, **options
) -> int:
    """Resolve the open rows of ``target`` with the catalog as it is now; the version written, or 0 for none.

    ``det`` is the landed detections. Only rows that come out differently are written, as one version
    more; a run that fails leaves no version, so it can simply be run again. Not for two runs at a time.
    """
    spark = det.sparkSession
    rows = settled(latest_pairs(spark, target).where(is_open()))
    if rows.isEmpty():
        return 0
    new = playlist_pairs(det.join(rows.select("pos"), "pos", "left_semi"), streams, segments, **options)
    both = rows.select("pos", F.xxhash64(*sorted(f"`{c}`" for c in rows.columns)).alias("_was"))
    now = F.xxhash64(*sorted(f"`{c}`" for c in new.columns))
    changed = settled(new.join(both, "pos").where(now != F.col("_was")).drop("_was"))
    if changed.isEmpty():
        return 0
    version = _versions(spark, target).agg(F.max("_version")).first()[0] + 1
    changed.write.mode("overwrite").parquet(f"{target}/run={_AGAIN}{version}/batch_id=0")
    return version


def compact_again(spark: SparkSession, target: str) -> int:
    """Fold all retries into one, latest wins; the version it has, or 0 where there is nothing to fold.

    The folded rows are written as a version more before the older ones go, so readers see every row at any time.
    """
    rows = _versions(spark, target).where("_version > 0")
    known = [r._version for r in rows.select("_version").distinct().collect()]        # one a retry
    if len(known) < 2:
        return 0
    version = max(known) + 1
    first_row(rows, ["pos"], [F.col("_version").desc()]).drop("_version").write.mode("overwrite").parquet(
        f"{target}/run={_AGAIN}{version}/batch_id=0")
    for old in known:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/run={_AGAIN}{old}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return version
