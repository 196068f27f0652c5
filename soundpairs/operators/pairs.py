"""Pair rows: validity, resume, skipping, status, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from soundpairs.functions.names import feed_key
from soundpairs.functions.times import clean_time_text
from soundpairs.operators.common import lookup

# fixed values: the message of an incomplete row
INVALID_MESSAGE = "Missing timestamp, feedId, or feed.nodeName"


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def flag_valid(df: DataFrame) -> DataFrame:
    """Add feed_key, node and ``valid``; incomplete rows stay."""
    return df.withColumns({"feed_key": feed_key(), "node": F.col("feed.nodeName")}).withColumn(
        "valid", _filled(F.col("timestamp")) & _filled(F.col("feed_key")) & _filled(F.col("node"))
    )


def distinct_keys(df: DataFrame, key: str = "clip_key") -> DataFrame:
    """Set of keys; empty and null are none."""
    return df.select(key).where(_filled(F.col(key))).distinct()


def known_keys(
    stored: DataFrame | None = None, fresh: DataFrame | None = None,
    prior: DataFrame | None = None, url_root: str = "",
) -> DataFrame | None:
    """One row per clip key with flags in_stored, in_fresh, in_prior.

    Prior rows are URLs; those under ``url_root`` become keys, so all three sets meet the
    pairs in one join.
    """
    parts = []
    for frame, flag in ((stored, "in_stored"), (fresh, "in_fresh")):
        if frame is not None:
            parts.append(frame.select("clip_key", F.lit(flag).alias("_flag")))
    if prior is not None:
        mine = prior.where(F.col("prior_key").startswith(url_root))
        key = F.substring(F.col("prior_key"), F.lit(len(url_root) + 1), F.length("prior_key"))
        parts.append(mine.select(key.alias("clip_key"), F.lit("in_prior").alias("_flag")))
    if not parts:
        return None
    known = parts[0]
    for part in parts[1:]:
        known = known.unionByName(part)
    return known.groupBy("clip_key").agg(*[
        F.max(F.col("_flag") == flag).alias(flag) for flag in ("in_stored", "in_fresh", "in_prior")
    ])


def flag_known(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
    """Attach the flags of ``known_keys``; false where a key is unknown."""
    flags = ["in_stored", "in_fresh", "in_prior"]
    if known is None:
        return pairs.withColumns({f: F.lit(False) for f in flags})
    return lookup(pairs, known, "clip_key").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def skip_existing(pairs: DataFrame, stored: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Add ``skip_status`` for clips already stored (or found by a fresher listing)."""
    flagged = flag_known(pairs, known_keys(stored=stored, fresh=fresh))
    return flagged.withColumn("skip_status", skip_status()).drop("in_stored", "in_fresh", "in_prior")


def skip_status() -> Column:
    return F.when(F.col("in_stored"), F.lit("skipped_exists_prelist")).when(
        F.col("in_fresh"), F.lit("skipped_exists_head")
    )


def resume(pairs: DataFrame, prior: DataFrame, url_root: str) -> DataFrame:
    """Add ``resumed``: the clip's URL already stands in a prior run's rows."""
    flagged = flag_known(pairs, known_keys(prior=prior, url_root=url_root))
    return flagged.withColumnRenamed("in_prior", "resumed").drop("in_stored", "in_fresh")


def remaining(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct clip keys not stored yet."""
    return distinct_keys(pairs).join(distinct_keys(stored), "clip_key", "left_anti")


def already_done(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct clip keys that are stored."""
    return distinct_keys(pairs).join(distinct_keys(stored), "clip_key", "left_semi")


def first_builder(pairs: DataFrame, clip: str = "clip_key", pos: str = "pos") -> DataFrame:
    """Add ``builds``: the first row of a clip builds it, later ones find it there.

    The first position is aggregated map-side, so a clip shared by very many rows costs
    one small row per task.
    """
    first = pairs.where(F.col(clip).isNotNull()).groupBy(clip).agg(F.min(pos).alias("_first"))
    return (
        lookup(pairs, first, clip, pos)
        .withColumn("builds", F.coalesce(F.col(pos) == F.col("_first"), F.lit(False))).drop("_first")
    )


def missing_objects(pairs: DataFrame, objects: DataFrame) -> DataFrame:
    """Add ``download_error`` naming the first segment URL that is not among ``objects``.

    Only rows still to be built are looked at, and each different list of a clip once, however many rows ask for it.
    """
    listed = pairs.withColumn("_list", F.xxhash64("chunkFiles"))
    todo = listed.where(~(F.col("in_prior") | F.col("in_stored") | F.col("in_fresh")) & (F.size("chunkFiles") > 0))
    once = todo.groupBy("clip_key", "_list").agg(F.any_value("chunkFiles").alias("chunkFiles"))
    need = once.select("clip_key", "_list", F.posexplode("chunkFiles").alias("_i", "url"))
    gone = (
        need.join(objects.select("url").distinct(), "url", "left_anti")
        .groupBy("clip_key", "_list").agg(F.min(F.struct("_i", "url")).alias("_gone"))
        .select("clip_key", "_list", F.concat(F.lit("HTTP 404 for "), F.col("_gone.url")).alias("_error"))
    )
    ask = ~(F.col("in_prior") | F.col("in_stored") | F.col("in_fresh"))
    return listed.join(gone, ["clip_key", "_list"], "left").withColumn(
        "download_error", F.when(ask, F.col("_error"))).drop("_list", "_error")


def with_status(
    df: DataFrame, upload: bool = True, url_root: str = "", local_dir: str = "clips"
) -> DataFrame:
    """Status, stage, message and clip path; the first matching rule wins.

    Reads valid, center_ms, plan, plan_error, in_prior, in_stored, in_fresh,
    download_error, encode_error, upload_error.
    """
    none = F.lit(None).cast("string")
    rules: list[tuple[Column, str | None, str, Column]] = [
        (~F.col("valid"), "invalid_input", "validate", F.lit(INVALID_MESSAGE)),
        (F.col("center_ms").isNull(), "error", "unexpected",
         F.concat(F.lit("Invalid date: "), clean_time_text("timestamp"))),
        (F.col("in_prior"), "resume_skip_in_csv", "", none),
        ((F.size("plan") <= 0) & F.col("plan_error").isNotNull(),
         "error_no_segments", "segments", F.col("plan_error")),
        (F.size("plan") <= 0, "no_segments", "", none),
        (F.col("in_stored"), "skipped_exists_prelist", "", none),
        (F.col("in_fresh"), "skipped_exists_head", "", none),
        (F.col("download_error").isNotNull(), "error_download", "download", F.col("download_error")),
        (F.col("encode_error").isNotNull(), "error_encode", "encode", F.col("encode_error")),
    ]
    if upload:
        rules.append(
            (F.col("upload_error").isNotNull(), "error_upload", "upload", F.col("upload_error")))
    built = "uploaded" if upload else "saved_local"

    status = stage = message = None
    for test, name, where, text in rules:
        chain = (lambda c, v: F.when(test, v) if c is None else c.when(test, v))
        status, stage, message = (
            chain(status, F.lit(name)), chain(stage, F.lit(where)), chain(message, text))
    url = F.concat(F.lit(url_root), F.col("clip_key"))
    path = F.when(F.col("status").startswith("skipped_exists"), url).when(
        F.col("status") == built,
        url if upload else F.concat(F.lit(local_dir + "/"), F.col("clip_name")))
    return df.withColumns({
        "status": status.otherwise(F.lit(built)),
        "errorStage": stage.otherwise(F.lit("")),
        "errorMessage": F.coalesce(message.otherwise(none), F.lit("")),
    }).withColumn("flacPath", F.coalesce(path, F.lit("")))


def status_tally(pairs: DataFrame, duration: str | None = None) -> DataFrame:
    """Rows per status and stage, with stage timings where a duration column is given."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if duration:
        aggs += [F.percentile_approx(duration, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)]
    return pairs.groupBy("status", "errorStage").agg(*aggs)


def timing_sketches(pairs: DataFrame, duration: str, run: str) -> DataFrame:
    """Per status and stage of one run: rows, and a quantile sketch of their durations that can be merged.

    A sketch is a few KB whatever the number of rows; a run stores its own next to those of other runs.
    """
    return pairs.groupBy("status", "errorStage").agg(
        F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double(F.col(duration).cast("double")).alias("sketch"),
    ).withColumn("run", F.lit(run))


def merged_timings(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Rows and quantiles (p50, p95, ...) over all runs, within 1.7 % of the rank; null where nothing was timed."""
    merged = sketches.groupBy("status", "errorStage").agg(
        F.sum("rows").alias("rows"), F.kll_merge_agg_double("sketch").alias("_all"))
    timed = F.kll_sketch_get_n_double("_all") > 0
    return merged.withColumns({
        f"p{round(q * 100)}": F.when(timed, F.kll_sketch_get_quantile_double("_all", F.lit(q))) for q in quantiles
    }).drop("_all")


def key_totals(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: clip keys in all rows, different ones, and those of them that are stored."""
    keys = distinct_keys(pairs)
    there = keys.join(distinct_keys(stored), "clip_key", "left_semi").agg(F.count(F.lit(1))).scalar()
    return pairs.agg(F.count("clip_key").alias("rows"), F.count_distinct("clip_key").alias("keys")).withColumn("stored", there)


def observe_progress(df: DataFrame, name: str = "progress", key: str | None = None) -> tuple[DataFrame, Observation]:
    """Count rows, and those with a ``key``, as they stream by; read ``Observation.get`` after."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    if key is not None:
        counts.append(F.count_if(_filled(F.col(key))).alias("keys"))
    return df.observe(seen, *counts), seen


def annotate(det: DataFrame, annotations: DataFrame, on: str = "id") -> DataFrame:
    """Attach moderator annotations to reports; reports without one stay."""
    return lookup(det, annotations.withColumn(on, F.col(on).cast("string")), on)


def training_pairs(pairs: DataFrame, audio: str = "flacPath") -> DataFrame:
    """Rows with both a clip and a text; the category is the label."""
    return pairs.where(_filled(F.col(audio)) & _filled(F.col("description"))).select(
        "id", F.col(audio).alias("audio"), F.col("description").alias("text"),
        F.col("category").alias("label"),
    )
