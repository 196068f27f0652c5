"""Registered queries, and SQL for the derived inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from soundpairs.functions.names import BASE_URL
from soundpairs.operators.archive import PROBE_FIRST
from soundpairs.workload.views import LATER, PREFIX, ROGUE, SLOT_S, URL_ROOT, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views)`` under ``name``, with the SELECT it must equal."""
    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = INPUTS + sql
        return fn
    return add


def iso(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


def safe_iso(ms: str) -> str:
    return f"replace({iso(ms)}, ':', '-')"


def stamp(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d_%H-%M-%S')"


def mod(a: str, n: int) -> str:
    return f"((({a}) % {n} + {n}) % {n})"


def chunk(site: str, ms: str) -> str:
    return f"{stamp(ms)} || '_' || {site} || '-48000-1.flac'"


def segment(node: str, playlist: str, i: str) -> str:
    return (f"'{BASE_URL}/' || {node} || '/hls/' || {playlist} || '/live' || "
            f"case when {i} < 1000 then lpad(cast({i} as varchar), 3, '0') else cast({i} as varchar) end || '.ts'")


def clip(node: str, w0: str, w1: str, ext: str) -> str:
    return f"{node} || '_' || {safe_iso(w0)} || '_' || {safe_iso(w1)} || '.{ext}'"


INPUTS = f"""
with base as (
  select event_id, {mod('user_id', 8)} as feed, event_type, value, props, ts,
    epoch_us(ts) // 1000 as ms, (epoch_us(ts) // {SLOT_S * 1_000_000}) * {SLOT_S} as pt
  from events),
raw_det as (
  select event_id as pos,
    case when event_id % 97 = 0 then null when event_id % 101 = 0 then ''
         else 'det_' || event_id end as id,
    'feed_' || feed as "feedId", event_type as category, event_id, feed, props as description, value, ms,
    case when event_id % 17 = 0 then null when event_id % 29 = 0 then 'not-a-date'
         when event_id % 41 = 0 then strftime(ts, '%Y-%m-%dT%H-%M-%SZ')
         when event_id % 43 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S.%fZ')
         else strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') end as "timestamp",
    case when event_id % 51 = 0 then null when event_id % 1009 = 0 then {ROGUE} when event_id % 13 = 0 then pt - {SLOT_S} else pt end
      as "playlistTimestamp",
    event_id % 37 <> 0 as has_feed,
    case when event_id % 31 <> 0 then 'feed_' || feed end as fid,
    case when event_id % 23 <> 0 then 'rpi_node_' || feed end as fnode,
    case when event_id % 17 = 0 or event_id % 29 = 0 then null
         when event_id % 41 = 0 then ms // 1000 * 1000 else ms end as utc_ms,
    case when event_id % 17 = 0 or event_id % 29 = 0 or event_id % 41 = 0 then null else ms end as iso_ms
  from base
  union all
  select event_id + {LATER}, 'det_' || event_id, 'feed_' || feed, 'dup', event_id, feed, props, value, ms,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), pt, true, 'feed_' || feed, 'rpi_node_' || feed, ms, ms
  from base where event_type = 'error'),
det as (
  select pos, id, "feedId", case when event_id % 4 = 0 then feed end as "listenerCount", category,
    description, cast(cast(value as decimal(12,2)) as varchar) as "playerOffset",
    "playlistTimestamp", "timestamp",
    case when event_id % 3 <> 0 then 'cand_' || event_id end as "candidate.id",
    case when event_id % 3 <> 0 then 'feed_' || feed end as "candidate.feedId",
    case when has_feed then coalesce(fid, '') end as "feed.id",
    case when has_feed then 'Node ' || feed end as "feed.name",
    case when has_feed then coalesce(fnode, '') end as "feed.nodeName",
    case when has_feed then fnode end as node,
    coalesce(case when has_feed then fid end, "feedId") as feed_key,
    cast("playlistTimestamp" as varchar) as playlist, utc_ms,
    coalesce(iso_ms, case when "playlistTimestamp" < {ROGUE} then "playlistTimestamp" * 1000 end) as event_ms
  from raw_det),
slots as (select distinct feed, pt from base),
lists as (
  select feed, pt as key, pt * 1000 as st,
    case when pt <> (select max(pt) from base) then pt * 1000 + 21000000 end as et,
    dayofweek(make_timestamp(pt * 1000000)) = 0 as blank from slots
  union all
  select feed, pt + 7, pt * 1000 + 3620000, pt * 1000 + 7220000, false from slots),
str as (
  select 'feed_' || feed as feed_key, cast(key as varchar) as playlist,
    case when not blank then st end as st, et, st as first_ms from lists),
seg as (
  select feed_key, playlist, s0, s0 + 60000 as s1 from (
    select feed_key, playlist,
      unnest(generate_series(first_ms, coalesce(et, first_ms + 21600000) - 60000, 60000)) as s0
    from str) q),
days as (select distinct feed, ms // 86400000 as n from base),
man as (
  select 'rpi_node_' || feed as site, m as start_ms, {chunk("'rpi_node_' || feed", 'm')} as name from (
    select feed, n, unnest(generate_series(
      n * 86400000 + ((n * 7 + feed * 3) % 30) * 1000, n * 86400000 + 86399999, 30000)) as m
    from days where dayofweek(make_timestamp(n * 86400000000)) <> feed % 7) q
  where m - n * 86400000 < 7200000 or m - n * 86400000 >= 14400000),
clips as (
  select event_type, value, {clip("'rpi_node_' || feed", '(ms - 30000)', '(ms + 30000)', 'flac')} as flac,
    {clip("'rpi_node_' || feed", '(ms - 30000)', '(ms + 30000)', 'wav')} as wav from base),
stored as (select distinct '{PREFIX}' || flac as clip_key from clips where event_type = 'click'),
fresh as (select distinct '{PREFIX}' || flac as clip_key from clips where event_type = 'signup'),
prior as (select distinct '{URL_ROOT}{PREFIX}' || flac as prior_key from clips where value > 20),
win as (
  select *, utc_ms - 30000 as w0, utc_ms + 30000 as w1,
    '{PREFIX}' || {clip('node', '(utc_ms - 30000)', '(utc_ms + 30000)', 'flac')} as clip_key
  from det where "timestamp" is not null and node is not null and utc_ms is not null),
own as (
  select pos, feed_key, w0, w1, playlist, (greatest(w0, st) - st) // 10000 + 1 as f,
    (least(w1, coalesce(et, w1)) - st + 9999) // 10000 as l
  from win join str using (feed_key, playlist)
  where st is not null and least(w1, coalesce(et, w1)) > greatest(w0, st)),
lapped as (
  select w.pos, s.playlist, min(s.s0) as first_start
  from win w join seg s on w.feed_key = s.feed_key and s.s0 <= w.w1 and s.s1 >= w.w0 group by all),
multi as (
  select w.pos, x.playlist, x.first_start, (greatest(w0, st) - st) // 10000 + 1 as f,
    (least(w1, coalesce(et, w1)) - st + 9999) // 10000 as l
  from lapped x join win w using (pos) join str s on s.feed_key = w.feed_key and s.playlist = x.playlist
  where st is not null and least(w1, coalesce(et, w1)) > greatest(w0, st)),
plan as (
  select pos, playlist, 0 as first_start, f, l from own
  union all
  select pos, playlist, first_start, f, l from multi where pos not in (select pos from own)),
"""

# URL list and playlist list of every planned row, from (pos, playlist, first_start, f, l)
def listing(plan: str) -> str:
    return f"""
urls_{plan} as (
  select pos, string_agg({segment('node', 'playlist', 'i')}, ',' order by first_start, playlist, i) as urls
  from (select p.pos, w.node, p.playlist, p.first_start, unnest(generate_series(p.f, p.l)) as i
        from {plan} p join win w on w.pos = p.pos) q group by pos),
lists_{plan} as (
  select pos, string_agg(playlist, ',' order by first_start, playlist) as playlists from {plan} group by pos)
"""


PHASES = f"""
minutes as (
  select site, start_ms // 60000 * 60000 as mn, arg_min(sec, place) as sec from (
    select site, start_ms, start_ms // 1000 % 60 as sec,
      coalesce(list_position({PROBE_FIRST}, start_ms // 1000 % 60), 100 + start_ms // 1000 % 60)
        as place from man) q group by all),
centred as (
  select d.*, utc_ms // 60000 * 60000 as mn, utc_ms // 86400000 as dy, m.sec,
    utc_ms - 30000 as w0, utc_ms + 30000 as w1
  from det d left join minutes m on m.site = d.node and m.mn = utc_ms // 60000 * 60000),
phased as (
  select *, case when utc_ms is not null then coalesce(
    first_value(sec % 30 ignore nulls) over (partition by node, dy order by pos
      rows between unbounded preceding and current row), 2) end as phase
  from centred),
spans as (
  select *, w0 - {mod('w0 - phase * 1000', 30000)} as c0, w1 + {mod('phase * 1000 - w1', 30000)} as c1
  from phased),
chunks as (
  select pos, node, w0, w1, phase, t from (
    select pos, node, w0, w1, phase, unnest(generate_series(c0, c1 - 30000, 30000)) as t
    from spans where node is not null and utc_ms is not null) q)
"""
