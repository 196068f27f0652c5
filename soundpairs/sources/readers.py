"""Readers: landed files to tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundpairs import schemas
from soundpairs.functions.names import CHUNK_SUFFIX
from soundpairs.functions.times import STAMP_FORMAT, parse_ms, to_utc_ms
from soundpairs.operators.playlists import first_streams

def page_rows(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows (pos, detection fields) of pages (offset, results).

    All pages are read. With ``limit`` (the page size asked for) the run ends at the first shorter
    page, as a fetch loop would; later pages are then no part of it.
    """
    sized = files.select("offset", F.coalesce("results", F.array().cast(files.schema["results"].dataType))
                         .alias("results"))
    if limit is not None:
        short = sized.where(F.size("results") < limit).agg(F.min("offset").alias("last"))
        last = short.select(F.coalesce("last", F.lit(2**63 - 1))).scalar()
        sized = sized.where(F.col("offset") <= last)
    return (
        sized.select("offset", F.posexplode("results").alias("_i", "_d"))
        .select((F.col("offset") + F.col("_i")).alias("pos"), "_d.*")
    )


def read_pages(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Landed page files; a page's own ``offset``, or else the digits ending its file's name, is its offset.

    ``lines``: files hold one page a line (such pages need an offset of their own). A malformed page fails.
    """
    named = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1)
    page = schemas.T.StructType([schemas.T.StructField("offset", schemas.T.LongType())] + schemas.PAGE.fields)
    files = spark.read.schema(page).json(path, multiLine=not lines, mode="FAILFAST").select(
        F.coalesce("offset", F.nullif(named, F.lit("")).cast("long")).alias("offset"),
        F.col("data.detections.results").alias("results"))
    return page_rows(files, limit)


def envelope_rows(docs: DataFrame) -> DataFrame:
    """Rows of envelope documents; those that carry positions keep them."""
    rows = docs.select(F.posexplode("detections").alias("_i", "_d"))
    place = F.col("_i").cast("long")
    if "pos" in docs.schema["detections"].dataType.elementType.fieldNames():
        return rows.select(F.coalesce("_d.pos", place).alias("pos"), *[
            F.col(f"_d.{f}") for f in schemas.DETECTION.fieldNames()])
    return rows.select(place.alias("pos"), "_d.*")


_HEAD = ',"detections":['


def read_envelope(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Envelopes as written by ``write_envelope``, or documents each in one file (``lines``: in one line).

    The written form is known by its head line, whatever the number of its part files; it is read line by
    line in parallel, in the order of parts and lines. A document in one file is one task's work by its
    format. Documents without detections have no rows; malformed ones fail.
    """
    text = spark.read.text(path)
    if not lines and not text.where(F.col("value").startswith("{") & F.col("value").endswith(_HEAD)).isEmpty():
        return read_envelope_lines(spark, path)
    shape = schemas.T.StructType([schemas.T.StructField("detections", schemas.T.ArrayType(schemas.LANDED))])
    return envelope_rows(spark.read.schema(shape).json(path, multiLine=not lines, mode="FAILFAST"))


def read_envelope_lines(spark: SparkSession, path: str) -> DataFrame:
    """An envelope written by ``write_envelope``, line by line; without positions of their own, detections are
    numbered (with gaps) by part file and line."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    within = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    order = F.shiftleft(F.coalesce(F.nullif(part, F.lit("")).cast("long"), F.lit(0).cast("long")), 40) + within
    value = F.col("value")
    rows = spark.read.text(path).select("value", order.alias("_at")).where(
        (value != "") & (value != "]}") & ~(value.startswith("{") & value.endswith(_HEAD)))
    parsed = F.from_json(F.regexp_replace("value", "^,", ""), schemas.LANDED, {"mode": "FAILFAST"})
    return rows.select("_at", parsed.alias("_d")).select(
        F.coalesce("_d.pos", "_at").alias("pos"), *[F.col(f"_d.{f}") for f in schemas.DETECTION.fieldNames()])


def read_detection_lines(spark: SparkSession, path: str) -> DataFrame:
    """Detections as JSON lines with their position: the form for large sets."""
    return spark.read.schema(schemas.LANDED).json(path)


def stream_catalog(raw: DataFrame) -> DataFrame:
    """Catalog records to (feed_key, playlist, start_ms, end_ms, error), first per key.

    A time that is there but unreadable makes every lookup of that playlist an error.
    """
    def bad(name: str) -> Column:
        text = F.col(name)
        return F.when((text != "") & parse_ms(text).isNull(), F.concat(F.lit("Invalid date: "), text))

    noted = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    return first_streams(raw.select(
        F.col("feedId").alias("feed_key"), F.col("playlistTimestamp").alias("playlist"),
        to_utc_ms("startTime").alias("start_ms"),
        to_utc_ms("endTime").alias("end_ms"),
        F.coalesce(noted, bad("startTime"), F.when(F.col("startTime") != "", bad("endTime")))
        .alias("error"),
    ))


def read_streams(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return stream_catalog(spark.read.schema(schemas.STREAM).format(fmt).load(path))


def segment_catalog(raw: DataFrame) -> DataFrame:
    """Catalog records to (feed_key, playlist, start_ms, end_ms)."""
    return raw.select(
        F.col("feedId").alias("feed_key"), F.col("playlistTimestamp").alias("playlist"),
        parse_ms("startTime").alias("start_ms"), parse_ms("endTime").alias("end_ms"),
    )


def read_segments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return segment_catalog(spark.read.schema(schemas.SEGMENT).format(fmt).load(path))


def read_landed_segments(spark: SparkSession, path: str) -> DataFrame:
    """A catalog as ``write_segments`` left it; ``reach`` and ``day`` let an overlap prune its folders."""
    schema = "feed_key string, playlist string, start_ms long, end_ms long, reach int, day long, feed string"
    return spark.read.schema(schema).parquet(path).drop("feed")


def is_present(objects: DataFrame) -> Column:
    """An object counts if it was answered with success, has a body, and is not a web page."""
    return (
        F.col("status").between(200, 299)
        & (F.col("length") > 0)
        & ~F.coalesce(F.col("contentType"), F.lit("")).contains("text/html")
    )


def present(objects: DataFrame) -> DataFrame:
    return objects.where(is_present(objects))


def manifest(listing: DataFrame) -> DataFrame:
    """Chunk paths to (site, start_ms, name, bytes); other names are left out.

    A name is a 19-character stamp, ``_``, the site, the suffix: plain cuts, no patterns.
    """
    name = F.col("name")
    stamp = F.try_to_timestamp(F.substring(name, 1, 19), F.lit(STAMP_FORMAT))
    site = F.substring(name, F.lit(21), F.length(name) - F.lit(20 + len(CHUNK_SUFFIX)))
    return (
        listing.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"))
        .where(name.endswith(CHUNK_SUFFIX) & (F.substring(name, 20, 1) == "_")
               & (F.length(name) > 20 + len(CHUNK_SUFFIX)))
        .select(site.alias("site"), F.unix_millis(stamp).alias("start_ms"), "name", "bytes")
        .where("start_ms is not null")
    )


def read_listing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored listing, or (``binaryFile``) the files themselves without their content."""
    if fmt == "binaryFile":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.select("path", "length")
    if fmt == "text":
        return spark.read.text(path).select(F.col("value").alias("path"), F.lit(None).cast("long").alias("length"))
    return spark.read.schema(schemas.LISTING).format(fmt).load(path)


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    listing = read_listing(spark, path, fmt)
    if "status" in listing.columns:
        listing = listing.where(F.col("status").isNull() | is_present(listing))
    return manifest(listing)


def stored_keys(listing: DataFrame, prefix: str = "") -> DataFrame:
    """Set of object keys under a prefix."""
    return listing.select(F.col("path").alias("clip_key")).where(
        F.col("clip_key").startswith(prefix) & (F.col("clip_key") != "")).distinct()


def read_stored_keys(spark: SparkSession, path: str, prefix: str = "", fmt: str = "parquet") -> DataFrame:
    return stored_keys(read_listing(spark, path, fmt), prefix)


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """A pair table written by ``write_pairs_csv``: all text, quoted arrays and newlines whole."""
    return spark.read.csv(
        path, header=True, escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).na.fill("")


def read_prior_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a prior run: the clip path where there is one, else the id."""
    rows = read_pairs_csv(spark, path)
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("flacPath", "id") if c in rows.columns])
    return rows.select(key.alias("prior_key")).where("prior_key is not null").distinct()


def payloads(files: DataFrame, root: str = "") -> DataFrame:
    """(name, content) of landed objects; empty bodies and web pages are absent."""
    head = F.lower(F.ltrim(F.decode(F.substring("content", 1, 64), "ISO-8859-1")))
    page = head.startswith("<!doctype html") | head.startswith("<html")
    below = F.substring_index("path", "/", -1) if not root else F.replace(
        F.col("path"), F.lit(root.rstrip("/") + "/"), F.lit(""))
    return files.where((F.length("content") > 0) & ~page).select(below.alias("name"), "content")


def read_payloads(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Landed chunk files by name; names carry site and time, so they are unique."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return payloads(reader.load(path))
