"""Sources, sinks and streams: the derived tables are landed as files, then read or streamed.

Each query lands its whole input in the shared scratch folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from soundpairs import schemas, streaming
from soundpairs.functions.times import iso_ms
from soundpairs.operators import clips, pairs, playlists
from soundpairs.operators.common import numbered
from soundpairs.plans import archive_pairs, select_detections
from soundpairs.session import scratch_path
from soundpairs.sources import readers, writers
from soundpairs.workload.composed import (
    CLIP_SQL, PAIR_COLUMNS, PAIR_SQL, STAGE1_SQL, archive_jobs, chunk_payloads, playlist_rows, resolved,
)
from soundpairs.workload.registry import PHASES, iso, query
from soundpairs.workload.scalars import q
from soundpairs.workload.sets import OVERLAP_SQL, clip_pairs, usable
from soundpairs.workload.views import PREFIX, URL_ROOT

_FLAT = """pos, id, "feedId", "listenerCount", category, description, "playerOffset", "playlistTimestamp",
  "timestamp", node, feed_key"""


def _flat(df):
    return df.select(
        "pos", "id", "feedId", "listenerCount", "category", "description", "playerOffset",
        "playlistTimestamp", "timestamp", F.col("feed.nodeName").alias("node"),
        F.coalesce("feed.id", "feedId").alias("feed_key"))


def landed_pages(v, limit=250):
    """Every report as page files: the event id gives page and place."""
    path = scratch_path(v.spark, "pages")
    fields = [c for c in schemas.DETECTION.fieldNames()]
    place = F.struct((F.col("pos") % limit).alias("i"), F.struct(*fields).alias("d"))
    first = v.det.where(F.col("category") != "dup")
    rows = first.groupBy((F.col("pos") - F.col("pos") % limit).alias("offset")).agg(
        F.array_sort(F.collect_list(place)).alias("rows"))
    results = F.transform("rows", lambda r: r["d"])
    rows.select("offset", F.struct(F.struct(results.alias("results")).alias("detections")).alias("data")
                ).write.json(path, ignoreNullFields=False)
    return path


@query("s_pages", q(f"select {_FLAT} from det where category <> 'dup'"))
def s_pages(v):
    return _flat(readers.read_pages(v.spark, landed_pages(v), lines=True))


def landed_lines(v):
    path = scratch_path(v.spark, "detections")
    writers.write_detection_lines(v.det, path)
    return path


_CHOSEN = """ chosen as (select * from (
  select *, row_number() over (partition by id order by pos) as r from det where id <> '') t where r = 1)
"""


@query("s_envelope", _CHOSEN + f"select {_FLAT} from chosen")
def s_envelope(v):
    """One document per feed and day, as daily runs would leave them."""
    path = scratch_path(v.spark, "envelopes")
    rows = select_detections(v.det, ordered=False)
    body = F.struct(*[F.col(c) for c in schemas.LANDED.fieldNames()])
    docs = rows.groupBy("feedId", F.substring("timestamp", 1, 10)).agg(F.collect_list(body).alias("detections"))
    docs.select(F.lit(None).cast("string").alias("since"), F.size("detections").alias("count"),
                "detections").write.json(path, ignoreNullFields=False)
    return _flat(readers.read_envelope(v.spark, path, lines=True))


@query("k_envelope", _CHOSEN + f"select {_FLAT} from chosen")
def k_envelope(v):
    path = scratch_path(v.spark, "envelope")
    writers.write_envelope(select_detections(v.det, ordered=False), path, all=True, positions=True)
    return _flat(readers.read_envelope(v.spark, path))


_PLAIN = _FLAT.removeprefix("pos, ")


@query("k_envelope_order", _CHOSEN + f"""select {_PLAIN},
  row_number() over (order by coalesce(event_ms, 0), pos) as place from chosen""")
def k_envelope_order(v):
    """The plain form, whose part files alone tell the order."""
    path = scratch_path(v.spark, "envelope")
    writers.write_envelope(select_detections(v.det, ordered=False), path, all=True)
    return numbered(_flat(readers.read_envelope(v.spark, path)).orderBy("pos").drop("pos"))


@query("s_streams", q("select feed_key, playlist, st as start_ms, et as end_ms from str"))
def s_streams(v):
    path = scratch_path(v.spark, "streams")
    v.raw_streams.select(
        F.col("feed_key").alias("feedId"), F.col("playlist").alias("playlistTimestamp"),
        iso_ms("start_ms").alias("startTime"), iso_ms("end_ms").alias("endTime"),
    ).write.json(path)
    return readers.read_streams(v.spark, path).drop("error")


@query("s_segments", q("select feed_key, playlist, s0 as start_ms, s1 as end_ms from seg"))
def s_segments(v):
    path = scratch_path(v.spark, "segments")
    v.segments.select(
        F.col("feed_key").alias("feedId"), F.col("playlist").alias("playlistTimestamp"),
        iso_ms("start_ms").alias("startTime"), iso_ms("end_ms").alias("endTime"),
    ).write.parquet(path)
    return readers.read_segments(v.spark, path, "parquet")


def _listing(v):
    n = F.pmod(F.xxhash64("name"), F.lit(5))
    return v.manifest.select(
        F.concat("site", F.lit("/flac/"), "name").alias("path"),
        F.when(F.col("start_ms") % 120_000 < 30_000, 0).otherwise(F.length("name")).cast("long").alias("length"),
        F.when(F.col("start_ms") % 90_000 < 30_000, 404).otherwise(200).cast("long").alias("status"),
        F.when(F.col("start_ms") % 300_000 < 30_000, "text/html; charset=utf-8").otherwise("audio/flac")
        .alias("contentType"))


_THERE = "start_ms % 120000 >= 30000 and start_ms % 90000 >= 30000 and start_ms % 300000 >= 30000"


@query("s_manifest", q("select site, start_ms, name, length(name) as bytes from man"))
def s_manifest(v):
    path = scratch_path(v.spark, "manifest")
    v.manifest.select(
        F.concat("site", F.lit("/flac/"), "name").alias("path"), F.length("name").cast("long").alias("length"),
        F.lit(200).cast("long").alias("status"), F.lit("audio/flac").alias("contentType"),
    ).write.parquet(path)
    return readers.read_manifest(v.spark, path)


@query("f_present", q(f"select site || '/flac/' || name as path from man where {_THERE}"))
def f_present(v):
    return readers.present(_listing(v)).select("path")


@query("s_stored", q("select clip_key from stored"))
def s_stored(v):
    path = scratch_path(v.spark, "stored")
    v.stored.unionByName(v.fresh.select(F.concat(F.lit("other/"), "clip_key").alias("clip_key"))).select(
        F.col("clip_key").alias("path"), F.lit(1).cast("long").alias("length")).write.parquet(path)
    return readers.read_stored_keys(v.spark, path, PREFIX)


@query("s_payloads", q("select name, md5(name) as digest from man"))
def s_payloads(v):
    path = scratch_path(v.spark, "payloads")
    v.manifest.select(F.col("name").alias("path"), F.encode("name", "UTF-8").alias("content")).write.parquet(path)
    got = readers.payloads(v.spark.read.parquet(path))
    return got.select("name", F.md5("content").alias("digest"))


def _csv_text(df):
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


_TEXT_COLUMNS = ", ".join(
    f'coalesce(cast("{c}" as varchar), \'\') as "{c}"' for c in schemas.pair_columns("hls")[:13])
_JSON = """case when {0} is null then '[]' else '["' || replace({0}, ',', '","') || '"]' end"""
_CSV_SQL = PAIR_SQL + f"""select {_TEXT_COLUMNS}, coalesce({iso('w0')}, '') as "windowStart",
  coalesce({iso('w1')}, '') as "windowEnd", {_JSON.format('playlists')} as "playlistTimestamps",
  {_JSON.format('urls')} as "chunkFiles", "flacPath", status, "errorStage", "errorMessage" from rows"""


@query("k_csv", _CSV_SQL)
def k_csv(v):
    path = scratch_path(v.spark, "pairs")
    writers.write_pairs_csv(playlist_rows(v), path)
    return readers.read_pairs_csv(v.spark, path)


@query("k_append", PAIR_SQL + """
select id, status, count(*) * 2 as rows from (select coalesce(id, '') as id, status from rows) t group by all""")
def k_append(v):
    path = scratch_path(v.spark, "pairs")
    for _ in range(2):
        writers.write_pairs_csv(playlist_rows(v), path, mode="append")
    return readers.read_pairs_csv(v.spark, path).groupBy("id", "status").agg(F.count(F.lit(1)).alias("rows"))


@query("s_prior", PAIR_SQL + """
select distinct case when "flacPath" <> '' then "flacPath" else id end as prior_key from rows
where "flacPath" <> '' or id <> ''""")
def s_prior(v):
    path = scratch_path(v.spark, "pairs")
    writers.write_pairs_csv(playlist_rows(v), path)
    return readers.read_prior_pairs(v.spark, path)


@query("k_clips", CLIP_SQL + """
select clip_key, 'store/' || clip_key as url,
  cast(sum(length(name) + 100) as bigint) as bytes from built group by clip_key""")
def k_clips(v):
    built, path = clips.assemble_clips(archive_jobs(v), chunk_payloads(v)), scratch_path(v.spark, "clips")
    writers.write_clips(built, path, "store/")
    return writers.write_clips(built, path, "store/")       # as after a retry


@query("k_landed", q("""select pos, id from det where lower(node) = 'rpi_node_3'
  and event_ms >= epoch_us(timestamp '2024-01-12 06:00:00') // 1000"""))
def k_landed(v):
    from soundpairs.operators import detections
    from soundpairs.workload.scalars import CUTOFF

    path = scratch_path(v.spark, "landed")
    writers.land_detections(v.det, path)
    landed = v.spark.read.parquet(path)
    return detections.since(detections.by_node(landed, "rpi_node_3"), CUTOFF).select("pos", "id")


@query("a_progress", q("select cast(count(*) as bigint) as rows, count(*) filter (id <> '') as keys from det"))
def a_progress(v):
    watched, seen = pairs.observe_progress(v.det, key="id")
    watched.write.format("noop").mode("overwrite").save()
    return v.spark.createDataFrame([(seen.get["rows"], seen.get["keys"])], "rows long, keys long")


def _landed_stream(v):
    return streaming.stream_detections(v.spark, landed_lines(v), max_files=2)


@query("st_ingest", q(f"select {_FLAT} from det"))
def st_ingest(v):
    target = scratch_path(v.spark, "ingested")
    job = (_landed_stream(v).writeStream.format("parquet").option("path", target)
           .option("checkpointLocation", scratch_path(v.spark, "ck")).trigger(availableNow=True).start())
    job.awaitTermination()
    return _flat(v.spark.read.schema(schemas.LANDED).parquet(target))


@query("st_dedupe", q("select id, min(pos) as pos, 1 as rows from det where id <> '' group by id"))
def st_dedupe(v):
    """Late copies land after the stream has stopped once; then all comes again, as after a lost checkpoint."""
    source, target, ck = (scratch_path(v.spark, n) for n in ("detections", "deduped", "ck"))
    late = F.col("category") == "dup"
    for rows, mark in ((v.det.where(~F.coalesce(late, F.lit(False))), ck), (v.det.where(late), ck), (None, ck + "-new")):
        if rows is not None:
            writers.write_detection_lines(rows, source, mode="append")
        streaming.stream_dedupe(
            streaming.stream_detections(v.spark, source, max_files=2), target, mark).awaitTermination()
    return v.spark.read.parquet(target).groupBy("id").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("rows"))


@query("st_watermark", q("select id, 1 as rows from det where id <> '' group by id"))
def st_watermark(v):
    """All files in one micro-batch, so that none is late."""
    target = scratch_path(v.spark, "marked")
    rows = streaming.watermark_dedupe(streaming.stream_detections(v.spark, landed_lines(v)))
    (rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", scratch_path(v.spark, "ck"))
     .trigger(availableNow=True).start().awaitTermination())
    return v.spark.read.schema("id string").parquet(target).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("rows"))


@query("st_stage1", STAGE1_SQL)
def st_stage1(v):
    target = scratch_path(v.spark, "staged")
    rows = streaming.stream_stage1(_landed_stream(v), v.streams).where("w0 is not null").select("pos", "node", "plan")
    (rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", scratch_path(v.spark, "ck"))
     .trigger(availableNow=True).start().awaitTermination())
    return resolved(v.spark.read.schema(rows.schema).parquet(target))


@query("st_resolve", PAIR_SQL + f"select pos, {PAIR_COLUMNS} from rows")
def st_resolve(v):
    v.landed("streams", "segments", "stored", "fresh", "prior")      # every micro-batch reads them
    target = scratch_path(v.spark, "resolved")
    source = landed_lines(v)
    for _ in range(2):      # a second run over the same files, as after a lost checkpoint, adds nothing
        streaming.stream_resolve(
            streaming.stream_detections(v.spark, source, max_files=2), v.streams, v.segments, target,
            scratch_path(v.spark, "ck"), stored=v.stored, fresh=v.fresh, prior=v.prior, url_root=URL_ROOT, prefix=PREFIX,
        ).awaitTermination()
    done = v.spark.read.parquet(target).drop("run", "batch_id")
    return done.withColumns({a: F.array_join(a, ",") for a in ("playlistTimestamps", "chunkFiles")})


@query("st_resolve_again", PAIR_SQL + f"select pos, {PAIR_COLUMNS} from rows")
def st_resolve_again(v):
    """The catalog lands feed by feed: a stream meets the first three, retries the next two and then all."""
    v.landed("streams", "segments", "stored", "fresh", "prior")      # every micro-batch and retry reads them
    target, options = scratch_path(v.spark, "resolved"), {
        "stored": v.stored, "fresh": v.fresh, "prior": v.prior, "url_root": URL_ROOT, "prefix": PREFIX}

    def landed(feeds):
        known = F.substring_index("feed_key", "_", -1).cast("int") < feeds
        return v.streams.where(known), v.segments.where(known)

    streaming.stream_resolve(
        _landed_stream(v), *landed(3), target, scratch_path(v.spark, "ck"), **options).awaitTermination()
    for feeds in (5, 8):
        streaming.resolve_again(v.det, *landed(feeds), target, **options)
    streaming.compact_again(v.spark, target)
    done = streaming.latest_pairs(v.spark, target)
    return done.withColumns({a: F.array_join(a, ",") for a in ("playlistTimestamps", "chunkFiles")})


@query("j_overlap_landed", OVERLAP_SQL)
def j_overlap_landed(v):
    """The catalog in folders by length, day and feed, pruned by the windows' time span."""
    path = scratch_path(v.spark, "catalog")
    writers.write_segments(v.segments, path)
    return playlists.overlap(usable(v).drop("playlist"), readers.read_landed_segments(v.spark, path), prune=True).select(
        "pos", F.col("seg_playlist").alias("playlist"), "s0", "s1")


@query("st_append", q("select clip_key, count(*) as rows from (select distinct clip_key from win) t group by all"))
def st_append(v):
    source, target = scratch_path(v.spark, "clip_pairs"), scratch_path(v.spark, "appended")
    rows = clip_pairs(v)
    rows.write.json(source)
    sdf = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).json(source)
    for _ in range(2):      # a second run over the same files, as after a lost checkpoint, adds nothing
        streaming.stream_append(sdf, target, scratch_path(v.spark, "ck")).awaitTermination()
    return v.spark.read.parquet(target).groupBy("clip_key").agg(F.count(F.lit(1)).alias("rows"))
