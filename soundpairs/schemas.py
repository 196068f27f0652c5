"""Declared schemas. Nothing is inferred: a null-only column would come back as text."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()

CANDIDATE = _struct(id=_s, feedId=_s)
FEED = _struct(id=_s, name=_s, nodeName=_s, slug=_s)

DETECTION = _struct(
    id=_s, feedId=_s, listenerCount=_l, category=_s, description=_s,
    playerOffset=_s,             # text holding a decimal
    playlistTimestamp=_l,        # epoch seconds
    timestamp=_s, candidate=CANDIDATE, feed=FEED,
)

# a landed detection also carries its place in the input order
LANDED = T.StructType([T.StructField("pos", _l, True)] + DETECTION.fields)

ENVELOPE = _struct(
    since=_s, nodeName=_s, count=_l, generatedAt=_s, detections=T.ArrayType(DETECTION)
)

# one landed page: the query answer as received
PAGE = _struct(data=_struct(detections=_struct(results=T.ArrayType(DETECTION))))

# catalog records carry the playlist key as text; "error" is the lander's note of a failed lookup
STREAM = _struct(
    startTime=_s, endTime=_s, duration=_d, playlistTimestamp=_s, feedId=_s, error=_s
)
SEGMENT = _struct(startTime=_s, endTime=_s, duration=_d, playlistTimestamp=_s, feedId=_s)

LISTING = _struct(path=_s, length=_l, status=_l, contentType=_s)

# trailing columns of each pair form, in file order (fixed values)
ARCHIVE_TRAILING = ["windowStart", "windowEnd", "outPath", "chunkFiles"]
HLS_TRAILING = [
    "windowStart", "windowEnd", "playlistTimestamps", "chunkFiles",
    "flacPath", "status", "errorStage", "errorMessage",
]

# nested fields kept by each form (fixed values); slug is in neither
FLATTENED = {
    "archive": {"feed": ["id", "name"], "candidate": ["id", "feedId"]},
    "hls": {"feed": ["id", "name", "nodeName"], "candidate": ["id", "feedId"]},
}


def base_columns(form: str, schema: T.StructType = DETECTION) -> list[str]:
    """Flattened detection columns in code-unit order."""
    nested = FLATTENED[form]
    plain = [f.name for f in schema.fields if f.name not in nested and f.name != "pos"]
    dotted = [f"{parent}.{child}" for parent, kids in nested.items() for child in kids]
    return sorted(plain + dotted, key=lambda name: name.encode("utf-16-be"))


def pair_columns(form: str, schema: T.StructType = DETECTION) -> list[str]:
    """Full header of a pair table: base columns, then the trailing ones."""
    return base_columns(form, schema) + (
        ARCHIVE_TRAILING if form == "archive" else HLS_TRAILING
    )
