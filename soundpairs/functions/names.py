"""Object names, URLs, segment ranges and text encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundpairs.functions.times import ceil_phase, col, floor_phase, name_stamp, safe_iso, whole
from soundpairs.schemas import FLATTENED, base_columns

# fixed values of the archive and the live stream
CHUNK_SUFFIX = "-48000-1.flac"
CHUNK_SECONDS = 30
SEGMENT_SECONDS = 10
DEFAULT_REGION = "us-east-1"     # its host name has no region part
LEGACY_REGIONS = {"EU": "eu-west-1"}

# stand-in address; callers pass their own archive root
BASE_URL = "https://audio-archive.example.org"

# characters the JVM's form encoding escapes but URI components leave alone, and its blank
_URI_FIXES = [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]


def chunk_name(site: Column | str, ms: Column | str) -> Column:
    return F.concat(name_stamp(ms), F.lit("_"), col(site), F.lit(CHUNK_SUFFIX))


def chunk_url(site: Column | str, ms: Column | str, base: str = BASE_URL) -> Column:
    name = F.url_encode(chunk_name(site, ms))
    for found, wanted in _URI_FIXES:
        name = F.replace(name, F.lit(found), F.lit(wanted))
    return F.concat(F.lit(base + "/"), col(site), F.lit("/flac/"), name)


def chunk_starts(w0: Column | str, w1: Column | str, phase_s: Column | int,
                 step_s: int = CHUNK_SECONDS) -> Column:
    """Start times of the chunks that cover a window; null for an empty window."""
    w0, w1 = col(w0), col(w1)
    step = F.lit(step_s * 1000).cast("long")
    first = floor_phase(w0, step_s, phase_s)
    last = ceil_phase(w1, step_s, phase_s) - step
    return F.when((w1 > w0) & (last >= first), F.sequence(first, last, step))


def chunk_names(site: Column | str, starts: Column | str) -> Column:
    site = col(site)
    return F.transform(col(starts), lambda ms: chunk_name(site, ms))


def segment_url(node: Column | str, playlist: Column | str, i: Column | str,
                base: str = BASE_URL) -> Column:
    return F.concat(
        F.lit(base + "/"), col(node), F.lit("/hls/"), col(playlist), F.lit("/live"),
        _padded(col(i)), F.lit(".ts"),
    )


def _padded(i: Column) -> Column:
    """At least three digits; ``lpad`` alone would cut longer ones."""
    text = i.cast("string")
    return F.when(i < 1000, F.lpad(text, 3, "0")).otherwise(text)


def clip_interval(w0, w1, s0, s1) -> Column:
    """Window cut to a playlist as struct(a, b); a null end is a live playlist.

    Written as comparisons because ``greatest`` and ``least`` pass over nulls, while a missing
    window or start has no interval.
    """
    w0, w1, s0, s1 = col(w0), col(w1), col(s0), col(s1)
    return F.struct(
        F.when(w0 >= s0, w0).when(w0 < s0, s0).alias("a"),
        F.when(s1 < w1, s1).otherwise(w1).alias("b"),
    )


def segment_range(stream_ms, a_ms, b_ms) -> Column:
    """1-based segment indices struct(first, last) under a..b; null when there is none.

    An interval that ends after it begins, and after the stream begins, always has one.
    """
    stream_ms, a_ms, b_ms = col(stream_ms), col(a_ms), col(b_ms)
    step, zero = F.lit(SEGMENT_SECONDS * 1000).cast("long"), F.lit(0).cast("long")
    first = whole(F.greatest(a_ms - stream_ms, zero), step) + 1
    last = whole(b_ms - stream_ms + step - 1, step)
    found = F.struct(first.alias("first"), last.alias("last"))
    return F.when((b_ms > a_ms) & (b_ms > stream_ms), found)


def enumerate_segments(node, playlist, first, last, base: str = BASE_URL) -> Column:
    """URLs first..last; empty if the range is (a descending ``sequence`` would count down)."""
    node, playlist, first, last = col(node), col(playlist), col(first), col(last)
    urls = F.transform(
        F.sequence(first, last, F.lit(1).cast("long")),
        lambda i: segment_url(node, playlist, i, base),
    )
    return F.when(last >= first, urls).otherwise(F.array().cast("array<string>"))


def clip_name(node, w0, w1, ext: str) -> Column:
    if ext not in ("wav", "flac"):
        raise ValueError(f"clip format is wav or flac, not {ext!r}")
    return F.concat(
        col(node), F.lit("_"), safe_iso(w0), F.lit("_"), safe_iso(w1), F.lit("." + ext)
    )


def norm_prefix(prefix: Column | str) -> Column:
    """A non-empty prefix ends with ``/``."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    needs = (prefix != "") & ~prefix.endswith("/")
    return F.when(needs, F.concat(prefix, F.lit("/"))).otherwise(F.coalesce(prefix, F.lit("")))


def bucket_root(bucket: Column, region: Column) -> Column:
    """HTTPS root of a bucket, no trailing slash."""
    place = F.when(region.isNull() | (region == ""), F.lit(DEFAULT_REGION))
    for old, new in LEGACY_REGIONS.items():
        place = place.when(region == old, F.lit(new))
    place = place.otherwise(region)
    host = F.when(place == DEFAULT_REGION, F.lit(".s3.amazonaws.com")).otherwise(
        F.concat(F.lit(".s3."), place, F.lit(".amazonaws.com"))
    )
    return F.concat(F.lit("https://"), bucket, host)


def object_url(bucket: Column, region: Column, key: Column | str) -> Column:
    return F.concat(bucket_root(bucket, region), F.lit("/"), col(key))


def json_array(arr: Column | str) -> Column:
    """Compact JSON text of a text array; null and empty are ``[]``."""
    return F.coalesce(F.to_json(col(arr)), F.lit("[]"))


def csv_escape(value: Column | str) -> Column:
    """One CSV field: quoted only where a comma, quote or newline occurs."""
    text = F.coalesce(col(value).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def feed_key() -> Column:
    return F.coalesce(F.col("feed.id"), F.col("feedId"))


def flatten_columns(form: str) -> dict[str, Column]:
    """Dotted columns; a null field of a present object is empty text, an absent object null."""
    return {
        f"{parent}.{child}": F.when(
            F.col(parent).isNotNull(), F.coalesce(F.col(f"{parent}.{child}"), F.lit(""))
        )
        for parent, children in FLATTENED[form].items()
        for child in children
    }


def flatten(df: DataFrame, form: str = "archive") -> DataFrame:
    """Nested objects to dotted columns, header order; other columns follow unchanged."""
    made = flatten_columns(form)
    base = base_columns(form)
    rest = [c for c in df.columns if c not in base and c not in FLATTENED[form]]
    return df.select(
        *[made[c].alias(c) if c in made else F.col(c) for c in base if c in made or c in df.columns],
        *[F.col(f"`{c}`") for c in rest],
    )
