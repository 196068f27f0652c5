"""Joins, aggregates, windows, sorts, set operations and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundpairs.functions import names, times
from soundpairs.operators import archive, detections, pairs, playlists
from soundpairs.operators.common import first_row, numbered
from soundpairs.plans import playlist_windows
from soundpairs.workload.registry import PHASES, chunk, clip, query, segment
from soundpairs.workload.scalars import q
from soundpairs.workload.views import PREFIX, URL_ROOT


def usable(v):
    """Narrow windows of the rows that can be resolved."""
    return playlist_windows(v.det).where("w0 is not null").select(
        "pos", "feed_key", "node", "playlist", "w0", "w1")


def sited(v):
    return v.det.select("pos", F.col("feed.nodeName").alias("site"),
                        times.to_utc_ms("timestamp").alias("center_ms"))


def clip_pairs(v):
    name = names.clip_name("node", "w0", "w1", "flac")
    return usable(v).select("pos", F.concat(F.lit(PREFIX), name).alias("clip_key"))


@query("j_lookup", q("""select w.pos, w.playlist, s.st as stream_start, s.et as stream_end
from win w left join str s on s.feed_key = w.feed_key and s.playlist = w.playlist"""))
def j_lookup(v):
    return playlists.lookup_streams(usable(v), v.streams).select(
        "pos", "playlist", "stream_start", "stream_end")


OVERLAP_SQL = q("""select w.pos, s.playlist, s.s0, s.s1
from win w join seg s on w.feed_key = s.feed_key and s.s0 <= w.w1 and s.s1 >= w.w0""")


@query("j_overlap", OVERLAP_SQL)
def j_overlap(v):
    return playlists.overlap(usable(v).drop("playlist"), v.segments).select(
        "pos", F.col("seg_playlist").alias("playlist"), "s0", "s1")


@query("j_overlap_bucketed", OVERLAP_SQL)
def j_overlap_bucketed(v):
    """Narrow buckets and a pruned catalog: the same pairs."""
    return playlists.overlap(usable(v).drop("playlist"), v.segments, 600, prune=True).select(
        "pos", F.col("seg_playlist").alias("playlist"), "s0", "s1")


def enumerated(v):
    rows = times.window_bounds(archive.day_phase(sited(v), v.manifest))
    return archive.enumerate_chunks(rows.where("site is not null"))


@query("g_chunks", PHASES + f"select pos, t as start_ms, {chunk('node', 't')} as chunk from chunks")
def g_chunks(v):
    return enumerated(v).select("pos", "start_ms", "chunk")


@query("j_chunk_presence", PHASES + """select pos, t as start_ms, m.site is not null as present
from chunks c left join man m on m.site = c.node and m.start_ms = c.t""")
def j_chunk_presence(v):
    return archive.chunk_presence(enumerated(v), v.manifest).select("pos", "start_ms", "present")


@query("a_present_chunks", PHASES + """select pos, coalesce(string_agg(m.name, ',' order by t), '') as chunks
from chunks c left join man m on m.site = c.node and m.start_ms = c.t group by pos""")
def a_present_chunks(v):
    got = archive.present_chunks(
        archive.chunk_presence(enumerated(v).select("pos", "site", "start_ms"), v.manifest), ["pos", "site"])
    return got.select("pos", F.array_join(names.chunk_names("site", "present_ms"), ",").alias("chunks"))


@query("j_phase_probe", PHASES + "select pos, sec as probe_second, sec % 30 as probe_phase from centred")
def j_phase_probe(v):
    return archive.phase_probe(sited(v), v.manifest).select("pos", "probe_second", "probe_phase")


@query("w_day_phase", PHASES + "select pos, phase from phased")
def w_day_phase(v):
    return archive.day_phase(sited(v), v.manifest).select("pos", "phase")


@query("j_skip_existing", q("""select pos, w.clip_key, case when s.clip_key is not null then 'skipped_exists_prelist'
  when f.clip_key is not null then 'skipped_exists_head' end as skip_status
from win w left join stored s on s.clip_key = w.clip_key left join fresh f on f.clip_key = w.clip_key"""))
def j_skip_existing(v):
    return pairs.skip_existing(clip_pairs(v), v.stored, v.fresh)


_RESUMED = f"'{URL_ROOT}' || clip_key in (select prior_key from prior)"


@query("j_resume_flag", q(f"select pos, clip_key, {_RESUMED} as resumed from win"))
def j_resume_flag(v):
    return pairs.resume(clip_pairs(v), v.prior, URL_ROOT)


@query("j_resume_anti", q(f"select pos, clip_key from win where not ({_RESUMED})"))
def j_resume_anti(v):
    return pairs.resume(clip_pairs(v), v.prior, URL_ROOT).where("not resumed").drop("resumed")


@query("j_annotate", q("""select pos, id, quality, toxic from det
left join labels l on 'det_' || l.doc_id = id"""))
def j_annotate(v):
    notes = v.table("labels").select(
        F.concat(F.lit("det_"), F.col("doc_id").cast("string")).alias("id"),
        F.col("quality"), F.col("toxic"))
    return pairs.annotate(v.det, notes).select("pos", "id", "quality", "toxic")


@query("a_first_wins", q("""select pos, id from (
  select pos, id, row_number() over (partition by id order by pos) as r
  from det where id <> '' and lower(node) like 'rpi_node_%') t where r = 1"""))
def a_first_wins(v):
    kept = detections.has_id(v.det).where(F.lower("feed.nodeName").like("rpi_node_%"))
    return detections.first_wins(kept).select("pos", "id")


@query("a_count", q("""select count(distinct id) as count from det where id <> ''"""))
def a_count(v):
    return detections.count_detections(detections.first_wins(detections.has_id(v.det)))


@query("a_by_playlist", q("select pos, playlist, first_start from lapped"))
def a_by_playlist(v):
    found = playlists.overlap(usable(v).drop("playlist"), v.segments)
    return playlists.by_playlist(found, ["pos"])


@query("a_chunk_array", q("""select pos, string_agg(playlist || ':' || i, ',' order by first_start, playlist, i)
  as chunks from (select pos, playlist, first_start, unnest(generate_series(f, l)) as i from multi) t group by pos"""))
def a_chunk_array(v):
    named = playlists.by_playlist(
        playlists.overlap(usable(v).drop("playlist"), v.segments), ["pos", "feed_key", "w0", "w1"])
    spot = playlists.stream_range()
    ranges = playlists.lookup_streams(named, v.streams).select(
        "pos", "first_start", "playlist", spot["first"].alias("first"), spot["last"].alias("last"))
    plan = playlists.ordered_plan(ranges.where("first is not null"), ["pos"])
    steps = F.flatten(F.transform("plan", lambda p: F.transform(
        F.sequence(p["first"], p["last"]),
        lambda i: F.concat(p["playlist"], F.lit(":"), i.cast("string")))))
    return plan.select("pos", F.array_join(steps, ",").alias("chunks"))


@query("a_distinct_keys", q("select distinct clip_key from win"))
def a_distinct_keys(v):
    return pairs.distinct_keys(clip_pairs(v))


@query("w_first_builder", q("""select pos, clip_key,
  row_number() over (partition by clip_key order by pos) = 1 as builds from win"""))
def w_first_builder(v):
    return pairs.first_builder(clip_pairs(v))


@query("o_time_sort", q("""select pos, coalesce(event_ms, 0) as sort_ms,
  row_number() over (order by coalesce(event_ms, 0), pos) as place from det"""))
def o_time_sort(v):
    df = detections.time_sort(v.det)
    return numbered(df.select("pos", detections.sort_ms(df).alias("sort_ms")))


@query("o_page", q("select pos, id from det order by pos limit 250 offset 250"))
def o_page(v):
    return detections.page(v.det, 250, 250).select("pos", "id")


@query("o_page_deep", q("select pos, id from det order by pos limit 250 offset (select count(*) // 2 from det)"))
def o_page_deep(v):
    """A page in the middle of all reports."""
    return detections.deep_page(v.det, 250, v.det.count() // 2).select("pos", "id")


@query("a_key_totals", q("""select count(*) as rows, count(distinct clip_key) as keys,
  (select count(distinct clip_key) from win where clip_key in (select clip_key from stored)) as stored from win"""))
def a_key_totals(v):
    return pairs.key_totals(clip_pairs(v), v.stored)


@query("u_remaining", q("select distinct clip_key from win where clip_key not in (select clip_key from stored)"))
def u_remaining(v):
    return pairs.remaining(clip_pairs(v), v.stored)


@query("u_done", q("select distinct clip_key from win where clip_key in (select clip_key from stored)"))
def u_done(v):
    return pairs.already_done(clip_pairs(v), v.stored)


@query("g_segments", q(f"""select pos, string_agg({segment('node', 'playlist', 'i')}, ',' order by i) as urls
from (select o.pos, w.node, o.playlist, unnest(generate_series(f, l)) as i
      from own o join win w on w.pos = o.pos) t group by pos"""))
def g_segments(v):
    spot = playlists.stream_range()
    rows = playlists.lookup_streams(usable(v), v.streams).withColumn("spot", spot).where("spot is not null")
    urls = names.enumerate_segments("node", "playlist", "spot.first", "spot.last")
    return rows.select("pos", F.array_join(urls, ",").alias("urls"))


@query("w_first_row", q("select site, min(name) as name from man group by site"))
def w_first_row(v):
    return first_row(v.manifest, ["site"], ["name"]).select("site", "name")
