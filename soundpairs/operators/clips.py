"""Joining chunk payloads into clips."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundpairs.operators.common import first_row
from soundpairs.session import settled

#: Clip bytes that leave a task in one batch, about; a longer clip is a batch of its own.
BATCH_BYTES = 32 << 20
_BUILT = {"clip_key": pa.string(), "chunks": pa.int64(), "content": pa.binary()}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per clip from rows (clip_key, content) that come clip by clip, chunks in order.

    Only the chunks of one clip are held, and joined once.
    """
    key, parts, done, size = None, [], [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _BUILT.values())], list(_BUILT))

    for batch in batches:
        for clip, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            if clip != key:
                if parts:
                    done.append((key, len(parts), b"".join(parts)))
                    size += len(done[-1][2])
                    if size > BATCH_BYTES:
                        yield batch_of(done)
                        done, size = [], 0
                key, parts = clip, []
            parts.append(content.as_py())
    if parts:
        done.append((key, len(parts), b"".join(parts)))
    yield batch_of(done)


def assemble_clips(
    pairs: DataFrame, payloads: DataFrame, allow_partial: bool = False,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Raw PCM of each clip: its chunks joined in order, not trimmed to the window.

    ``pairs`` has pos, clip_key, chunkFiles; ``payloads`` one row (name, content) per object
    name. Every clip is built once. The wanted names are written first, so Spark knows their
    size and takes them to the payload scan where they stay under its broadcast threshold
    (``max_broadcast_rows`` sets a bound in rows instead). Wanted chunks are dealt by clip and
    sorted by place, and a clip is folded as its chunks come by, so a task holds the bytes of one
    clip. A clip with a missing chunk has null content, unless partial clips are fine.
    """
    clips = first_row(
        pairs.where(F.col("clip_key").isNotNull() & (F.size("chunkFiles") > 0))
        .select("pos", "clip_key", "chunkFiles"),
        ["clip_key"], ["pos"],
    )
    wanted = settled(clips.select(
        "clip_key", F.size("chunkFiles").cast("long").alias("wanted"),
        F.posexplode("chunkFiles").alias("i", "name"),
    ))
    names = wanted.select("clip_key", "i", "name")
    if max_broadcast_rows is not None:
        names = F.broadcast(names) if wanted.count() <= max_broadcast_rows else names.hint("shuffle_hash")
    chunks = payloads.select("name", "content").where(F.col("content").isNotNull()).join(names, "name")
    found = chunks.repartition("clip_key").sortWithinPartitions("clip_key", "i").select(
        "clip_key", "content").mapInArrow(_fold, "clip_key string, chunks long, content binary")
    whole = (F.col("chunks") == F.col("wanted")) | F.lit(allow_partial)
    return (
        wanted.where("i = 0").select("clip_key", "wanted")
        .join(found, "clip_key", "left")
        .withColumns({
            "chunks": F.coalesce("chunks", F.lit(0).cast("long")),
            "content": F.when(whole, F.col("content")),
        })
        .withColumn("status", F.when(F.col("content").isNull(), "error_download").otherwise("built"))
    )
