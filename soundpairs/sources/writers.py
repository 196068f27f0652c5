"""Writers: envelope, pair CSV, landed detections, clips."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundpairs import schemas
from soundpairs.functions.names import json_array
from soundpairs.functions.times import day_key
from soundpairs.operators.detections import report_ms, sort_ms
from soundpairs.operators.playlists import reach_and_day


def write_envelope(
    df: DataFrame, path: str, since: str | None = None, node: str | None = None,
    all: bool = False, generated_at: str | None = None, positions: bool = False,
) -> None:
    """One JSON document, detections in time order, written by many tasks.

    The part files, read in name order, are the document: a head line, one line per
    detection, a closing line. Only the row count and the first row's key pass the driver.
    ``positions`` adds each row's ``pos``, so that the lines can be read back in parallel.
    """
    now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    fields = (schemas.LANDED if positions else schemas.DETECTION).fieldNames()
    rows = df.select(sort_ms(df).alias("_ms"), "pos", F.struct(*fields).alias("detection"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_ms", "pos")).alias("first")).first()

    head = json.dumps({
        "since": None if all else since, "nodeName": node or None, "count": facts["n"],
        "generatedAt": generated_at or now,
    }, separators=(",", ":"))[:-1] + ',"detections":['
    text = F.to_json("detection", {"ignoreNullFields": "false"})
    if facts["first"] is not None:
        ms, pos = facts["first"]
        lead = F.when((F.col("_ms") == ms) & (F.col("pos") == pos), F.lit("")).otherwise(F.lit(","))
        text = F.concat(lead, text)
    body = rows.select(F.lit(1).alias("_part"), "_ms", "pos", text.alias("value"))
    ends = df.sparkSession.createDataFrame(
        [(0, 0, 0, head), (2, 0, 0, "]}")], "_part int, _ms long, pos long, value string")
    body.unionByName(ends).orderBy("_part", "_ms", "pos").select("value").write.mode(
        "overwrite").text(path)


def write_detection_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, unsorted: the form for large sets."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def land_detections(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by UTC day with event_ms and node_key stored, so that ``since`` and
    ``by_node`` become scan filters. Rebalancing splits a busy day over several files."""
    keyed = df.withColumns({
        "event_ms": report_ms(), "node_key": F.lower("feed.nodeName"),
    }).withColumn("event_day", F.coalesce(day_key("event_ms"), F.lit("undated")))
    keyed.hint("rebalance", "event_day").write.mode(mode).partitionBy("event_day").parquet(path)


def write_segments(segments: DataFrame, path: str, mode: str = "append") -> None:
    """Typed segment catalog in folders by length class, day and feed, in time order within a file.

    A scan with the time span of some windows then reads the folders of their days alone.
    """
    keyed = segments.select("feed_key", "playlist", "start_ms", "end_ms").withColumns(reach_and_day())
    keyed.withColumn("feed", F.col("feed_key")).hint("rebalance", "reach", "day", "feed").sortWithinPartitions(
        "reach", "day", "feed", "start_ms").write.mode(mode).partitionBy("reach", "day", "feed").parquet(path)


def csv_rows(pairs: DataFrame, form: str) -> DataFrame:
    """Header-ordered text columns; arrays as JSON text, null as empty text."""
    def text(name: str):
        c = F.col(f"`{name}`")
        if isinstance(pairs.schema[name].dataType, T.ArrayType):
            return json_array(c)
        return F.coalesce(c.cast("string"), F.lit(""))
    return pairs.select(*[text(c).alias(c) for c in schemas.pair_columns(form)])


def write_pairs_csv(pairs: DataFrame, path: str, form: str = "hls", mode: str = "overwrite") -> None:
    """Pair table as CSV; ``append`` adds part files, each with its own header."""
    csv_rows(pairs, form).write.mode(mode).csv(
        path, header=True, escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_clips(clips: DataFrame, path: str, root: str = "", mode: str = "append") -> DataFrame:
    """Clip bytes to Parquet by UTC day; returns clip_key, url and bytes of the clips given.

    The day is read off the clip name. Clips without content are not written, nor (in append mode) those
    the target holds already, so a retry adds nothing. Clips of other runs are not returned.
    """
    day = F.regexp_extract("clip_key", r"_(\d{4}-\d{2}-\d{2})T[^_]*_[^_]*$", 1)
    made = clips.where(F.col("content").isNotNull()).select(
        "clip_key", "content", F.length("content").cast("long").alias("bytes"), day.alias("day"))
    spark = clips.sparkSession
    if mode == "append":
        try:
            there = spark.read.schema("clip_key string").parquet(path)
            made = made.join(there, "clip_key", "left_anti").select(made.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    made.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)
    mine = clips.where(F.col("content").isNotNull()).select("clip_key").distinct()
    written = spark.read.schema("clip_key string, bytes long").parquet(path).join(mine, "clip_key", "left_semi")
    return written.select("clip_key", F.concat(F.lit(root), F.col("clip_key")).alias("url"), "bytes")
