"""Pair-building inputs derived from the given tables.

Every view covers its whole table. Reports are the ``events``: eight feeds, with gaps and
noise in the fields a lander would leave patchy.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundpairs.functions.names import CHUNK_SUFFIX, clip_name
from soundpairs.functions.times import DAY_MS, day_start, name_stamp, window_bounds
from soundpairs.session import scratch_path, use_utc

SLOT_S = 21_600          # a playlist runs six hours
LATER = 10**12           # positions of late copies
ROGUE = 10**16            # a playlist key that is no time
PREFIX = "clips/"
URL_ROOT = "https://pairs.example.org/"


def _long(value: int):
    return F.lit(value).cast("long")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = use_utc(spark), sf_dir.rstrip("/")
        self._landed: set[str] = set()

    def landed(self, *names: str) -> Views:
        """Write the named views to the shared folder once and read them from there on."""
        for name in [n for n in names if n not in self._landed]:
            path = scratch_path(self.spark, name)
            rows = getattr(self, name)
            if name == "det":       # the events come as one small file; give every core some
                rows = rows.repartition(self.spark.sparkContext.defaultParallelism)
            rows.write.parquet(path)
            self.__dict__[name] = self.spark.read.parquet(path)
            self._landed.add(name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
        slot = F.expr(f"unix_micros(cast(ts as timestamp)) div {SLOT_S * 1_000_000}") * SLOT_S
        return self.table("events").select(
            "event_id", F.pmod("user_id", F.lit(8)).alias("feed"), "event_type", "value", "props",
            us.alias("us"), ms.alias("ms"), slot.alias("pt"))

    @cached_property
    def det(self) -> DataFrame:
        """Detections with noise, then late copies of the error reports."""
        e, b = F.col("event_id"), self.base
        at = F.timestamp_micros("us")
        iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        feed_id = F.concat(F.lit("feed_"), F.col("feed").cast("string"))
        node = F.concat(F.lit("rpi_node_"), F.col("feed").cast("string"))
        text = (
            F.when(e % 17 == 0, None).when(e % 29 == 0, "not-a-date")
            .when(e % 41 == 0, F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'"))
            .when(e % 43 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS'Z'")).otherwise(iso)
        )
        playlist = F.when(e % 51 == 0, None).when(e % 1009 == 0, _long(ROGUE)).when(e % 13 == 0, F.col("pt") - SLOT_S).otherwise(F.col("pt"))
        det_id = F.concat(F.lit("det_"), e.cast("string"))

        def rows(frame, pos, det_id, category, stamp, pt, feed_id_in, node_in, has_feed):
            feed = F.struct(
                feed_id_in.alias("id"), F.concat(F.lit("Node "), F.col("feed").cast("string")).alias("name"),
                node_in.alias("nodeName"), F.concat(F.lit("node-"), F.col("feed").cast("string")).alias("slug"))
            candidate = F.struct(F.concat(F.lit("cand_"), e.cast("string")).alias("id"), feed_id.alias("feedId"))
            return frame.select(
                pos.alias("pos"), det_id.alias("id"), feed_id.alias("feedId"),
                F.when(e % 4 == 0, F.col("feed")).alias("listenerCount"),
                category.alias("category"), F.col("props").alias("description"),
                F.col("value").cast("decimal(12,2)").cast("string").alias("playerOffset"),
                pt.alias("playlistTimestamp"), stamp.alias("timestamp"),
                F.when(e % 3 != 0, candidate).alias("candidate"),
                F.when(has_feed, feed).alias("feed"),
            )

        first = rows(
            b, e, F.when(e % 97 == 0, None).when(e % 101 == 0, "").otherwise(det_id), F.col("event_type"),
            text, playlist, F.when(e % 31 != 0, feed_id), F.when(e % 23 != 0, node), e % 37 != 0)
        later = rows(
            b.where("event_type = 'error'"), e + LATER, det_id, F.lit("dup"), iso, F.col("pt"),
            feed_id, node, F.lit(True))
        return first.unionByName(later)

    @cached_property
    def _slots(self) -> DataFrame:
        return self.base.select("feed", "pt").distinct()

    @cached_property
    def raw_streams(self) -> DataFrame:
        """Playlists: six-hour slots less ten minutes (the newest live, Sundays' without a start),
        and a backup playlist inside each slot."""
        newest = self.base.agg(F.max("pt")).scalar()
        start = F.col("pt") * 1000
        sunday = F.dayofweek(F.timestamp_millis(start)) == 1
        main = self._slots.select(
            "feed", F.col("pt").alias("key"), start.alias("st"),
            F.when(F.col("pt") != newest, start + _long(21_000_000)).alias("et"), sunday.alias("blank"))
        backup = self._slots.select(
            "feed", (F.col("pt") + 7).alias("key"), (start + _long(3_620_000)).alias("st"),
            (start + _long(7_220_000)).alias("et"), F.lit(False).alias("blank"))
        return main.unionByName(backup).select(
            F.concat(F.lit("feed_"), F.col("feed").cast("string")).alias("feed_key"),
            F.col("key").cast("string").alias("playlist"),
            F.when(~F.col("blank"), F.col("st")).alias("start_ms"), F.col("et").alias("end_ms"),
            F.col("st").alias("first_ms"))

    @cached_property
    def streams(self) -> DataFrame:
        return self.raw_streams.drop("first_ms")

    @cached_property
    def segments(self) -> DataFrame:
        """Catalog segments of 60 s along every playlist."""
        minute = _long(60_000)
        last = F.coalesce("end_ms", F.col("first_ms") + _long(21_600_000)) - minute
        return self.raw_streams.select(
            "feed_key", "playlist", F.explode(F.sequence("first_ms", last, minute)).alias("start_ms"),
        ).withColumn("end_ms", F.col("start_ms") + minute)

    @cached_property
    def manifest(self) -> DataFrame:
        """Archive chunks: every 30 s at a phase per day; none on a feed's day of rest nor
        between two and four o'clock."""
        day = day_start("ms")
        days = self.base.select("feed", day.alias("d")).distinct()
        work = days.where(F.dayofweek(F.timestamp_millis("d")) - 1 != F.pmod("feed", F.lit(7)))
        n = F.expr(f"d div {DAY_MS}")
        phase = F.pmod(n * 7 + F.col("feed") * 3, F.lit(30)) * 1000
        hour = F.col("start_ms") - F.col("d")
        return work.select(
            "feed", "d", F.explode(F.sequence(
                F.col("d") + phase, F.col("d") + _long(DAY_MS - 1), _long(30_000))).alias("start_ms"),
        ).where((hour < 7_200_000) | (hour >= 14_400_000)).select(
            F.concat(F.lit("rpi_node_"), F.col("feed").cast("string")).alias("site"), "start_ms",
            F.concat(name_stamp("start_ms"), F.lit("_rpi_node_"), F.col("feed").cast("string"),
                     F.lit(CHUNK_SUFFIX)).alias("name"))

    def clips(self, ext: str, truth: str) -> DataFrame:
        """Clip names of all reports meeting a condition on events."""
        node = F.concat(F.lit("rpi_node_"), F.col("feed").cast("string"))
        return window_bounds(self.base.where(truth), 30, "ms").select(
            clip_name(node, "w0", "w1", ext).alias("clip"))

    @cached_property
    def stored(self) -> DataFrame:
        return self.clips("flac", "event_type = 'click'").select(
            F.concat(F.lit(PREFIX), "clip").alias("clip_key"))

    @cached_property
    def fresh(self) -> DataFrame:
        return self.clips("flac", "event_type = 'signup'").select(
            F.concat(F.lit(PREFIX), "clip").alias("clip_key"))

    @cached_property
    def prior(self) -> DataFrame:
        return self.clips("flac", "value > 20").select(
            F.concat(F.lit(URL_ROOT + PREFIX), "clip").alias("prior_key"))

    @cached_property
    def audio(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("audio_id"), "embedding", "label")

    @cached_property
    def prompts(self) -> DataFrame:
        """One prompt per label: its first clip stands for it."""
        return self.audio.groupBy("label").agg(
            F.min_by("embedding", "audio_id").alias("embedding"), F.min("audio_id").alias("prompt_id")
        ).select("prompt_id", "embedding", "label")

    @cached_property
    def captioned(self) -> DataFrame:
        """Clips whose document was judged good; the document is the caption."""
        good = self.table("labels").where("quality = 1").select("doc_id")
        docs = self.table("documents").join(good, "doc_id")
        return self.audio.join(docs, F.col("audio_id") == F.col("doc_id")).select(
            "audio_id", "embedding", F.col("text").alias("caption"))
