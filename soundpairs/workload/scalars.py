"""Scalar functions and filters over all reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundpairs.functions import names, times
from soundpairs.functions.names import BASE_URL
from soundpairs.operators import detections, pairs
from soundpairs.workload.registry import chunk, clip, iso, mod, query, safe_iso, segment, stamp

_SELECT = " select_ as (select 1) "


def _site():
    return F.concat(F.lit("rpi_node_"), F.col("feed").cast("string"))


def q(body: str) -> str:
    """The shared inputs end in a comma; a query without CTEs of its own adds this one."""
    return _SELECT + body


@query("p_event_ms", q("""
select pos, coalesce(
  epoch_us(try_strptime(replace("timestamp", ' ', 'T'), '%Y-%m-%dT%H:%M:%S.%fZ')) // 1000,
  "playlistTimestamp" * 1000) as event_ms from det"""))
def p_event_ms(v):
    return v.det.select("pos", times.event_ms("timestamp", "playlistTimestamp").alias("event_ms"))


_LENIENT = """coalesce(
  epoch_us(try_strptime(replace("timestamp", ' ', 'T'), '%Y-%m-%dT%H:%M:%S.%fZ')) // 1000,
  epoch_us(try_strptime("timestamp", '%Y-%m-%dT%H-%M-%SZ')) // 1000)"""


@query("p_utc_lenient", q(f'select pos, {_LENIENT} as utc_ms from det'))
def p_utc_lenient(v):
    return v.det.select("pos", times.to_utc_ms("timestamp").alias("utc_ms"))


@query("p_utc_hls", q(f'select pos, {_LENIENT} as utc_ms from det'))
def p_utc_hls(v):
    return v.det.select("pos", times.to_utc_ms("timestamp").alias("utc_ms"))


def _flat_sql(cols):
    return "select pos, " + ", ".join(f'"{c}"' for c in cols) + " from det"


_ARCHIVE = ["candidate.feedId", "candidate.id", "category", "description", "feed.id", "feed.name",
            "feedId", "id", "listenerCount", "playerOffset", "playlistTimestamp", "timestamp"]
_HLS = _ARCHIVE + ["feed.nodeName"]


@query("p_flatten_archive", q(_flat_sql(_ARCHIVE)))
def p_flatten_archive(v):
    return names.flatten(v.det, "archive")


@query("p_flatten_hls", q(_flat_sql(_HLS)))
def p_flatten_hls(v):
    return names.flatten(v.det, "hls")


@query("p_csv_escape", """ texts as (
  select doc_id as pos, text as t from documents
  union all select event_id, props from events
  union all select pos, "timestamp" from raw_det)
select pos, md5(case when t is null then ''
  when regexp_matches(t, '[",\\n]') then '"' || replace(t, '"', '""') || '"' else t end) as field from texts""")
def p_csv_escape(v):
    texts = (
        v.table("documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("t"))
        .unionByName(v.table("events").select(F.col("event_id").alias("pos"), F.col("props").alias("t")))
        .unionByName(v.det.select("pos", F.col("timestamp").alias("t"))))
    return texts.select("pos", F.md5(names.csv_escape("t").cast("binary")).alias("field"))


@query("p_bounds", q("select pos, utc_ms - 30000 as w0, utc_ms + 30000 as w1 from det"))
def p_bounds(v):
    df = v.det.select("pos", times.to_utc_ms("timestamp").alias("center_ms"))
    return times.window_bounds(df).select("pos", "w0", "w1")


@query("p_iso", q(f"select event_id, {iso('ms')} as iso from base"))
def p_iso(v):
    return v.base.select("event_id", times.iso_ms("ms").alias("iso"))


@query("p_safe_iso", q(f"select event_id, {safe_iso('ms')} as iso from base"))
def p_safe_iso(v):
    return v.base.select("event_id", times.safe_iso("ms").alias("iso"))


@query("p_stamp", q(f"select event_id, {stamp('ms')} as stamp from base"))
def p_stamp(v):
    return v.base.select("event_id", times.name_stamp("ms").alias("stamp"))


# shifted half a century back, so that times before 1970 are covered too
_EARLY = "(ms - 1704067200000 - 500000)"


@query("p_floor_phase", q(f"""select event_id, {_EARLY} - {mod(_EARLY + ' - feed * 1000', 30000)} as t
from base"""))
def p_floor_phase(v):
    ms = F.col("ms") - 1704067200000 - 500000
    return v.base.select("event_id", times.floor_phase(ms, 30, F.col("feed")).alias("t"))


@query("p_ceil_phase", q(f"""select event_id, {_EARLY} + {mod('feed * 1000 - ' + _EARLY, 30000)} as t
from base"""))
def p_ceil_phase(v):
    ms = F.col("ms") - 1704067200000 - 500000
    return v.base.select("event_id", times.ceil_phase(ms, 30, F.col("feed")).alias("t"))


@query("p_trunc", q("""select event_id, epoch_us(date_trunc('minute', ts)) // 1000 as minute_ms,
  strftime(ts, '%Y-%m-%d') as day from base"""))
def p_trunc(v):
    return v.base.select("event_id", times.minute_start("ms").alias("minute_ms"),
                         times.day_key("ms").alias("day"))


@query("p_chunk_name", q(f"""select event_id, {chunk("'rpi_node_' || feed", 'ms')} as name,
  '{BASE_URL}/rpi_node_' || feed || '/flac/' || url_encode({chunk("'rpi_node_' || feed", 'ms')}) as url
from base"""))
def p_chunk_name(v):
    return v.base.select("event_id", names.chunk_name(_site(), "ms").alias("name"),
                         names.chunk_url(_site(), "ms").alias("url"))


_INDEX = "((ms - pt * 1000) // 10000 + 1)"


@query("p_segment_url", q(f"""select event_id, {segment("'rpi_node_' || feed", 'cast(pt as varchar)', _INDEX)}
  as url from base"""))
def p_segment_url(v):
    i = F.expr("(ms - pt * 1000) div 10000 + 1")
    return v.base.select("event_id", names.segment_url(_site(), F.col("pt").cast("string"), i).alias("url"))


@query("p_segment_range", q("""select event_id,
  case when b > a then (greatest(a - st, 0)) // 10000 + 1 end as first,
  case when b > a then (b - st + 9999) // 10000 end as last
from (select event_id, pt * 1000 as st, greatest(ms - 30000, pt * 1000) as a,
        least(ms + 30000, pt * 1000 + 21000000) as b from base) t"""))
def p_segment_range(v):
    st = F.col("pt") * 1000
    cut = names.clip_interval(F.col("ms") - 30000, F.col("ms") + 30000, st, st + 21000000)
    spot = names.segment_range(st, cut["a"], cut["b"])
    return v.base.select("event_id", spot["first"].alias("first"), spot["last"].alias("last"))


@query("p_clip", q("""select event_id, greatest(ms - 30000, pt * 1000) as a,
  least(ms + 30000, coalesce(case when feed <> 0 then pt * 1000 + 21000000 end, ms + 30000)) as b from base"""))
def p_clip(v):
    end = F.when(F.col("feed") != 0, F.col("pt") * 1000 + 21000000)
    cut = names.clip_interval(F.col("ms") - 30000, F.col("ms") + 30000, F.col("pt") * 1000, end)
    return v.base.select("event_id", cut["a"].alias("a"), cut["b"].alias("b"))


@query("p_clip_name", q(f"""select event_id,
  {clip("'rpi_node_' || feed", '(ms - 30000)', '(ms + 30000)', 'wav')} as wav,
  {clip("'rpi_node_' || feed", '(ms - 30000)', '(ms + 30000)', 'flac')} as flac from base"""))
def p_clip_name(v):
    df = times.window_bounds(v.base, 30, "ms")
    return df.select("event_id", *[names.clip_name(_site(), "w0", "w1", x).alias(x) for x in ("wav", "flac")])


@query("p_object_url", q("""select event_id, 'https://pairs' ||
  case when region is null or region = '' or region = 'us-east-1' then '.s3.amazonaws.com'
       when region = 'EU' then '.s3.eu-west-1.amazonaws.com'
       else '.s3.' || region || '.amazonaws.com' end || '/' ||
  case when prefix = '' then '' when right(prefix, 1) = '/' then prefix else prefix || '/' end ||
  'det_' || event_id || '.flac' as url
from (select event_id, case feed when 0 then null when 1 then 'EU' when 2 then 'us-east-1' when 3 then ''
        else 'us-west-2' end as region,
        case event_type when 'click' then '' when 'view' then 'clips/' else 'a/b' end as prefix from base) t"""))
def p_object_url(v):
    feed, kind = F.col("feed"), F.col("event_type")
    region = F.when(feed == 0, None).when(feed == 1, "EU").when(feed == 2, "us-east-1").when(
        feed == 3, "").otherwise("us-west-2")
    prefix = F.when(kind == "click", "").when(kind == "view", "clips/").otherwise("a/b")
    key = F.concat(names.norm_prefix(prefix), F.lit("det_"), F.col("event_id").cast("string"), F.lit(".flac"))
    return v.base.select("event_id", names.object_url(F.lit("pairs"), region, key).alias("url"))


@query("p_json_array", q("""select event_id,
  case when feed = 0 then '[]' when feed = 1 then '[]'
       else '["' || event_type || '",' || to_json(props) || ']' end as arr from base"""))
def p_json_array(v):
    feed = F.col("feed")
    arr = F.when(feed == 0, None).when(feed == 1, F.array().cast("array<string>")).otherwise(
        F.array("event_type", "props"))
    return v.base.select("event_id", names.json_array(arr).alias("arr"))


@query("p_feed_key", q("select pos, feed_key from det"))
def p_feed_key(v):
    return v.det.select("pos", names.feed_key().alias("feed_key"))


@query("f_node", q("select pos, id from det where lower(node) = 'rpi_node_3'"))
def f_node(v):
    return detections.by_node(v.det, "RPI_Node_3").select("pos", "id")


CUTOFF = "2024-01-12T06:00:00Z"


@query("f_since", q("""select pos, id from det
where event_ms >= epoch_us(timestamp '2024-01-12 06:00:00') // 1000"""))
def f_since(v):
    return detections.since(v.det, CUTOFF).select("pos", "id")


@query("f_has_id", q("select pos, id from det where id is not null and id <> ''"))
def f_has_id(v):
    return detections.has_id(v.det).select("pos", "id")


@query("f_valid", q("""select pos, coalesce("timestamp", '') <> '' and coalesce(feed_key, '') <> ''
  and coalesce(node, '') <> '' as valid from det"""))
def f_valid(v):
    return pairs.flag_valid(v.det).select("pos", "valid")
