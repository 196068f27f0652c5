"""Whole jobs: selection, archive pairs, playlist pairs, clips, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundpairs import plans
from soundpairs.operators import clips, detections, pairs, playlists, similarity
from soundpairs.functions.times import to_utc_ms
from soundpairs.schemas import pair_columns
from soundpairs.session import scratch_path, settled
from soundpairs.workload.registry import PHASES, chunk, clip, iso, listing, query
from soundpairs.workload.scalars import CUTOFF, q
from soundpairs.workload.sets import usable
from soundpairs.workload.views import PREFIX, URL_ROOT


@query("c_select", q("""select pos, id, event_ms, "description" from (
  select *, row_number() over (partition by id order by pos) as r from det
  where id <> '' and lower(node) = 'rpi_node_2'
    and event_ms >= epoch_us(timestamp '2024-01-12 06:00:00') // 1000) t where r = 1"""))
def c_select(v):
    df = plans.select_detections(v.det, since=CUTOFF, node="RPI_node_2")
    return df.select("pos", "id", detections.report_ms().alias("event_ms"), "description")


def _quoted(cols):
    return ", ".join(f'"{c}"' for c in cols)


def _as_text(df, *arrays):
    return df.withColumns({a: F.array_join(a, ",") for a in arrays})


_ARCHIVE = pair_columns("archive")[:-4]


@query("c_archive_list", PHASES + f""",
named as (select pos, string_agg({chunk('node', 't')}, ',' order by t) as names from chunks group by pos)
select p.pos, {_quoted(_ARCHIVE)}, coalesce({iso('w0')}, '') as "windowStart",
  coalesce({iso('w1')}, '') as "windowEnd", '' as "outPath", coalesce(names, '') as "chunkFiles"
from phased p left join named n on n.pos = p.pos""")
def c_archive_list(v):
    return _as_text(plans.archive_pairs(v.det, v.manifest, list_only=True), "chunkFiles")


@query("c_archive_build", PHASES + f""",
named as (
  select c.pos, string_agg({chunk('node', 't')}, ',' order by t) as names,
    string_agg(m.name, ',' order by t) as have
  from chunks c left join man m on m.site = c.node and m.start_ms = c.t group by c.pos),
made as (
  select p.pos, {clip('p.node', 'w0', 'w1', 'wav')} as wav, names, have
  from phased p left join named n on n.pos = p.pos),
there as (
  select a.*, coalesce(a.wav in (select wav from clips where event_type = 'click'), false)
    or coalesce(a.pos > b.built, false) as kept
  from made a left join (select wav, min(pos) as built from made where have is not null group by wav) b
    on a.wav = b.wav)
select p.pos, {_quoted(_ARCHIVE)}, coalesce({iso('w0')}, '') as "windowStart",
  coalesce({iso('w1')}, '') as "windowEnd",
  case when kept or have is not null then 'out/' || wav else '' end as "outPath",
  coalesce(case when kept then names else have end, '') as "chunkFiles"
from phased p join there t on t.pos = p.pos""")
def c_archive_build(v):
    stored = v.clips("wav", "event_type = 'click'").withColumnRenamed("clip", "clip_key")
    return _as_text(plans.archive_pairs(v.det, v.manifest, stored, out_dir="out/"), "chunkFiles")


def resolved(df):
    """pos, playlists and segment URLs as text, for rows that got any."""
    return df.where(F.size("plan") > 0).select(
        "pos", F.array_join(playlists.plan_playlists(), ",").alias("playlists"),
        F.array_join(playlists.chunk_array("node"), ",").alias("urls"))


def _plan_sql(plan, extra=""):
    return extra + listing(plan) + f"select pos, playlists, urls from urls_{plan} join lists_{plan} using (pos)"


_OWN = "mine as (select pos, playlist, 0 as first_start, f, l from own),"


STAGE1_SQL = _plan_sql("mine", _OWN)


@query("c_stage1", STAGE1_SQL)
def c_stage1(v):
    return resolved(playlists.direct_plan(usable(v), v.streams))


@query("c_stage2", _plan_sql("multi"))
def c_stage2(v):
    rows = usable(v)
    found = playlists.overlap_plan(rows.select(*playlists.WINDOW).distinct(), v.streams, v.segments)
    joined = rows.join(found, playlists.WINDOW).withColumnRenamed("found", "plan")
    return resolved(joined)


@query("c_stage3", _plan_sql("last", """
last as (select * from multi union all
  select pos, playlist, 0, f, l from own where pos not in (select pos from multi)),"""))
def c_stage3(v):
    return resolved(playlists.resolve_segments(usable(v), v.streams, v.segments, prefer_playlist=False))


@query("c_cascade", _plan_sql("plan"))
def c_cascade(v):
    return resolved(playlists.resolve_segments(usable(v), v.streams, v.segments))


_STATUS = f"""
outcome as (
  select d.pos, d.*, w.w0, w.w1, w.clip_key, u.urls, x.playlists,
    case when d."timestamp" is null or d.node is null then 'invalid_input'
      when d.utc_ms is null then 'error'
      when '{URL_ROOT}' || w.clip_key in (select prior_key from prior) then 'resume_skip_in_csv'
      when u.urls is null then 'no_segments'
      when w.clip_key in (select clip_key from stored) then 'skipped_exists_prelist'
      when w.clip_key in (select clip_key from fresh) then 'skipped_exists_head'
      else 'uploaded' end as status
  from det d left join win w on w.pos = d.pos left join urls_plan u on u.pos = d.pos
    left join lists_plan x on x.pos = d.pos),
rows as (
  select *, case status when 'invalid_input' then 'validate' when 'error' then 'unexpected' else '' end
      as "errorStage",
    case status when 'invalid_input' then '{pairs.INVALID_MESSAGE}'
      when 'error' then 'Invalid date: ' || "timestamp" else '' end as "errorMessage",
    case when status = 'uploaded' or status like 'skipped_exists%' then '{URL_ROOT}' || clip_key else '' end
      as "flacPath"
  from outcome)
"""


def playlist_rows(v, **options):
    v.landed("streams", "segments", "stored", "fresh", "prior")      # the cascade reads them several times
    return plans.playlist_pairs(
        v.det, v.streams, v.segments, v.stored, v.fresh, v.prior,
        url_root=URL_ROOT, prefix=PREFIX, **options)


PAIR_COLUMNS = f"""{_quoted(pair_columns("hls")[:13])}, coalesce({iso('w0')}, '') as "windowStart",
  coalesce({iso('w1')}, '') as "windowEnd", coalesce(playlists, '') as "playlistTimestamps",
  coalesce(urls, '') as "chunkFiles", "flacPath", status, "errorStage", "errorMessage" """

PAIR_SQL = listing("plan") + "," + _STATUS


@query("c_playlist", PAIR_SQL + f"select pos, {PAIR_COLUMNS} from rows")
def c_playlist(v):
    return _as_text(playlist_rows(v), "playlistTimestamps", "chunkFiles")


@query("c_status", PAIR_SQL + 'select pos, status, "errorStage", "errorMessage", "flacPath" from rows')
def c_status(v):
    return playlist_rows(v).select("pos", "status", "errorStage", "errorMessage", "flacPath")


_BROKEN = "playlist like '%4%' and feed_key = 'feed_5'"
_GONE = "%17.ts"

#: Status of every row where pieces of the catalog, objects and building steps fail
_OUTCOMES = f"""
bad_lists as (select feed_key, playlist from str where {_BROKEN}),
bad_own as (select w.pos from win w join bad_lists b on b.feed_key = w.feed_key and b.playlist = w.playlist),
bad_found as (select distinct l.pos from lapped l join win w using (pos)
  join bad_lists b on b.feed_key = w.feed_key and b.playlist = l.playlist),
built as (select '{PREFIX}' || flac as clip_key, bool_or(value > 12) as enc, bool_or(value > 8) as up from clips group by all),
judged as (
  select r.pos, r.clip_key, r.status as before, r."errorMessage" as said, r."flacPath",
    r.pos in (select pos from bad_own) or (
      r.pos in (select pos from bad_found) and r.pos not in (select pos from own)) as broken,
    list_filter(string_split(coalesce(r.urls, ''), ','), lambda u: u like '{_GONE}')[1] as gone, b.enc, b.up
  from rows r left join built b on b.clip_key = r.clip_key),
told as (
  select pos, clip_key, said, case
      when before in ('invalid_input', 'error', 'resume_skip_in_csv') then before
      when broken then 'error_no_segments' when before <> 'uploaded' then before
      when gone is not null then 'error_download' when enc then 'error_encode' when up then 'error_upload'
      else 'uploaded' end as status, gone
  from judged),
final as (
  select pos, status, case status when 'invalid_input' then 'validate' when 'error' then 'unexpected'
      when 'error_no_segments' then 'segments' when 'error_download' then 'download'
      when 'error_encode' then 'encode' when 'error_upload' then 'upload' else '' end as "errorStage",
    case status when 'error_no_segments' then 'lookup failed' when 'error_download' then 'HTTP 404 for ' || gone
      when 'error_encode' then 'encoder failed' when 'error_upload' then 'upload failed' else said end as "errorMessage",
    case when status = 'uploaded' or status like 'skipped_exists%' then '{URL_ROOT}' || clip_key else '' end as "flacPath"
  from told)
"""


def _failing(v):
    """Streams with failed lookups, the objects that exist, and how building each clip went."""
    error = F.when(F.expr(_BROKEN), F.lit("lookup failed")).cast("string")
    urls = playlist_rows(v).select(F.explode("chunkFiles").alias("url")).where(~F.col("url").like(_GONE))
    went = v.clips("flac", "true").select(F.concat(F.lit(PREFIX), "clip").alias("clip_key"))
    value = v.clips("flac", "value > 12").select(F.concat(F.lit(PREFIX), "clip").alias("clip_key"), F.lit("encoder failed").alias("e"))
    up = v.clips("flac", "value > 8").select(F.concat(F.lit(PREFIX), "clip").alias("clip_key"), F.lit("upload failed").alias("u"))
    outcomes = went.distinct().join(value.distinct(), "clip_key", "left").join(up.distinct(), "clip_key", "left").select(
        "clip_key", F.col("e").alias("encode_error"), F.col("u").alias("upload_error"))
    return v.streams.withColumn("error", error), urls, outcomes


def failing_rows(v, **options):
    found, objects, outcomes = _failing(v)
    return plans.playlist_pairs(
        v.det, found, v.segments, v.stored, v.fresh, v.prior, objects=objects, outcomes=outcomes,
        url_root=URL_ROOT, prefix=PREFIX, **options)


@query("c_status_failures", PAIR_SQL + "," + _OUTCOMES + 'select * from final')
def c_status_failures(v):
    """Lookups, downloads, encoding and uploads fail for some rows."""
    return failing_rows(v).select("pos", "status", "errorStage", "errorMessage", "flacPath")


@query("c_status_local", PAIR_SQL + f"""
select pos, case status when 'uploaded' then 'saved_local' else status end as status,
  case status when 'uploaded' then 'clips/' || substr(clip_key, {len(PREFIX) + 1}) else "flacPath" end as "flacPath" from rows""")
def c_status_local(v):
    """Clips are kept in a folder instead of being uploaded."""
    return playlist_rows(v, upload=False).select("pos", "status", "flacPath")


@query("a_status_tally", PAIR_SQL + """
select status, "errorStage", count(*) as rows from rows group by all""")
def a_status_tally(v):
    return pairs.status_tally(playlist_rows(v))


@query("a_timings", PAIR_SQL + """
select status, "errorStage", count(*) as rows, true as p50_ok, true as p95_ok from rows group by all""")
def a_timings(v):
    """Two runs store sketches of a duration; merged quantiles are held against the rank they have among all rows."""
    rows = settled(playlist_rows(v).select("pos", "status", "errorStage", F.col("playerOffset").cast("double").alias("spent")))
    path = scratch_path(v.spark, "timings")
    for run in range(2):
        pairs.timing_sketches(rows.where(F.col("pos") % 2 == run), "spent", f"run{run}").write.mode("append").parquet(path)
    merged = pairs.merged_timings(v.spark.read.parquet(path))
    told = rows.join(merged.drop("rows"), ["status", "errorStage"])

    def near(column: str, share: float):
        timed = F.count("spent")
        below = F.count_if(F.col("spent") < F.col(column)) / timed
        upto = F.count_if(F.col("spent") <= F.col(column)) / timed
        return F.when(timed > 0, (below <= share + 0.02) & (upto >= share - 0.02)).otherwise(F.lit(True))

    return told.groupBy("status", "errorStage").agg(
        F.count(F.lit(1)).alias("rows"), near("p50", 0.5).alias("p50_ok"), near("p95", 0.95).alias("p95_ok"))


@query("c_training", PAIR_SQL + """
select id, "flacPath" as audio, description as text, category as label from rows
where "flacPath" <> '' and description <> ''""")
def c_training(v):
    return pairs.training_pairs(playlist_rows(v))


_PAYLOAD = "name || repeat(right(name, 5), 20)"


def chunk_payloads(v):
    """Stand-in bytes of every archive chunk: its name, then filler."""
    text = F.concat("name", F.repeat(F.right("name", F.lit(5)), F.lit(20)))
    return v.manifest.select("name", F.encode(text, "UTF-8").alias("content"))


def archive_jobs(v):
    out = plans.archive_pairs(v.det, v.manifest)
    return out.where("outPath <> ''").select("pos", F.col("outPath").alias("clip_key"), "chunkFiles")


CLIP_SQL = PHASES + f""",
have as (
  select c.pos, {clip('c.node', 'c.w0', 'c.w1', 'wav')} as clip_key, m.name, t
  from chunks c join man m on m.site = c.node and m.start_ms = c.t),
built as (
  select clip_key, name, t from have h
  join (select clip_key as k, min(pos) as first from have group by k) b on b.k = h.clip_key and b.first = h.pos)
"""


@query("c_assemble", CLIP_SQL + f"""
select clip_key, count(*) as chunks, md5(string_agg({_PAYLOAD}, '' order by t)) as digest
from built group by clip_key""")
def c_assemble(v):
    built = clips.assemble_clips(archive_jobs(v), chunk_payloads(v))
    return built.where("status = 'built'").select("clip_key", "chunks", F.md5("content").alias("digest"))


_VECTORS = """ emb as (select vec_id, embedding::double[] as v, label from embeddings),
prompts as (select label, min(vec_id) as prompt_id, arg_min(v, vec_id) as v from emb group by label),
captioned as (
  select e.vec_id, e.v, d.text as caption from emb e join documents d on d.doc_id = e.vec_id
  join labels l on l.doc_id = e.vec_id where l.quality = 1)
"""


def _near_sql(corpus, columns):
    return f"""select {columns} from (
  select q.vec_id as query_id, c.vec_id as neighbor_id, c.*,
    round(list_cosine_similarity(q.v, c.v), 9) as sim,
    row_number() over (partition by q.vec_id
      order by round(list_cosine_similarity(q.v, c.v), 9) desc, c.vec_id) as rank
  from emb q join {corpus} c on c.vec_id <> q.vec_id) t where rank <= 5"""


@query("n_nearest", _VECTORS + _near_sql("emb", "query_id, neighbor_id, sim, rank, label, 'v1' as version"))
def n_nearest(v):
    near = similarity.nearest(v.audio, v.audio, 5)
    return similarity.attach(near, v.audio, meta=["label"], version="v1")


@query("n_nearest_grid", _VECTORS + _near_sql("emb", "'v' || query_id as query_id, 'v' || neighbor_id as neighbor_id, sim"))
def n_nearest_grid(v):
    """Text ids, laid out in blocks. The ids are padded so that ties go as those of numbers do."""
    named = v.audio.withColumn("audio_id", F.concat(F.lit("v"), F.lpad(F.col("audio_id").cast("string"), 12, "0")))
    near = similarity.nearest(named, named, 5, max_broadcast=0)
    plain = {c: F.regexp_replace(c, "^v0*(?=.)", "v") for c in ("query_id", "neighbor_id")}
    return near.select("query_id", "neighbor_id", "sim").withColumns(plain)


@query("n_caption", _VECTORS + _near_sql("captioned", """query_id as audio_id, neighbor_id, sim, rank,
  md5(caption) as evidence, case when rank = 1 then md5(caption) end as caption"""))
def n_caption(v):
    got = similarity.caption_evidence(v.audio, v.captioned, 5)
    return got.withColumns({
        "evidence": F.md5(F.col("evidence").cast("binary")),
        "caption": F.md5(F.col("caption").cast("binary"))})


@query("j_score", _VECTORS + """
select vec_id as audio_id, prompt_id, round(list_cosine_similarity(e.v, p.v), 9) as sim from emb e, prompts p""")
def j_score(v):
    return similarity.score(v.audio, v.prompts)


@query("j_score_grid", _VECTORS + """
select vec_id as audio_id, prompt_id, round(list_cosine_similarity(e.v, p.v), 9) as sim from emb e, prompts p""")
def j_score_grid(v):
    return similarity.score(v.audio, v.prompts, max_broadcast=0)


@query("n_nearest_approx")
def n_nearest_approx(v):
    return similarity.nearest_approx(v.audio, v.audio, 5, complete=True)


_PROBED = f"""{_VECTORS},
wide as (select greatest(4, case when count(*) < {similarity.BUCKET_ROWS} then 0
  else cast(floor(log2(count(*) // {similarity.BUCKET_ROWS})) as integer) + 1 end) as bits, max(len(v)) as d from emb),
series as (select i, bits, d from wide, unnest(generate_series(0, 8 * bits - 1)) as g(i)),
seeds as (select i, bits, list_transform(generate_series(1, d), lambda j:
  (i * d + j) * 2654435761 % 4294967296 * 48271 % 2147483647) as h from series),
planes as (select i, bits, list_transform(h, lambda x: cast(x * x % 2147483647 % 2001 - 1000 as double)) as p from seeds),
whole as (select vec_id, list_transform(v, lambda x: floor(x * {similarity.PROBE_SCALE})) as z from emb),
margins as (select vec_id, i // bits as t, i % bits as b, list_dot_product(z, p) as m from whole, planes),
codes as (select vec_id, t, cast(sum(case when m >= 0 then cast(1 as bigint) << b else 0 end) as bigint) as code
  from margins group by all),
doubtful as (select vec_id, t, b, row_number() over (partition by vec_id, t order by abs(m), b) as r from margins),
masks as (select vec_id, t, s, cast(sum(case when (s >> (r - 1)) & 1 = 1 then cast(1 as bigint) << b else 0 end) as bigint) as mask
  from doubtful, unnest(generate_series(0, 7)) as g(s) where r <= 3 group by all),
probes as (select vec_id, t, xor(code, mask) as code from masks join codes using (vec_id, t)),
met as (select distinct p.vec_id as query_id, c.vec_id as neighbor_id from probes p join codes c using (t, code)
  where p.vec_id <> c.vec_id),
ranked as (select query_id, neighbor_id, round(list_cosine_similarity(q.v, c.v), 9) as sim,
  row_number() over (partition by query_id order by round(list_cosine_similarity(q.v, c.v), 9) desc, neighbor_id) as rank
  from met join emb q on q.vec_id = query_id join emb c on c.vec_id = neighbor_id)
select query_id, neighbor_id, sim, rank from ranked where rank <= 5"""


@query("n_nearest_probed", _PROBED)
def n_nearest_probed(v):
    return similarity.nearest_probed(v.audio, v.audio, 5)


def text_stats():
    """A tiny stand-in model: length, blanks and lines of a text."""
    return lambda texts: [[len(t), t.count(" "), t.count("\n")] for t in texts]


@query("n_embed", q("""select doc_id, [length(text)::float, (length(text) - length(replace(text, ' ', '')))::float,
  (length(text) - length(replace(text, chr(10), '')))::float]::varchar as vector from documents"""))
def n_embed(v):
    docs = similarity.embed(v.table("documents").select("doc_id", "text"), "text", text_stats)
    parts = F.transform("embedding", lambda x: x.cast("string"))
    return docs.select("doc_id", F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")).alias("vector"))
