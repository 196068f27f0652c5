"""Sum-of-squares packing of token sequences.

Every document becomes its ids and one closing id. Documents longer than a sequence are cut into
pieces of full length, of which the first may be shorter. Full pieces are sequences by themselves.
The others are dealt into groups by hash, at most about ``GROUP_ROWS`` rows each, and every group is
packed by the sum-of-squares rule: with N(g) open sequences of gap g, a piece of size s goes where
the sum of N(g)^2 becomes smallest. Pieces are taken longest first, and a sequence is opened only
where none has room (free opening, the rule's online form, took 2 % more sequences here).

What groups leave badly filled is dealt into fewer groups and packed once more, so the loss at the
edge of a group doesn't add up. Nothing but counts reaches the driver.

Null and empty texts are the closing id alone. Repeated rows are packed like any others. An empty
table gives no rows.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundpairs.llm.bpe import TreeEncoder
from soundpairs.session import settled

CAPACITY = 1024
CLOSING = 2
GROUP_ROWS = 4000
#: A sequence with a larger gap is packed anew in the second round.
GAP = 4


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_ENCODERS: dict[str, tuple[TreeEncoder, dict[str, int]]] = {}


def json_encoder(path: str, pattern: str) -> tuple[TreeEncoder, dict[str, int]]:
    """Encoder of a byte-level `tokenizers` file, values are little-endian ids; and its special tokens.

    Merges in such a file rank by id, so the vocabulary is handed to `tiktoken` as ranks, which
    gives the same ids at a quarter of the time (a test compares the two).
    """
    if path not in _ENCODERS:
        import regex
        import tiktoken

        with open(path) as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        core = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        plain = core._core_bpe.encode_ordinary if hasattr(core, "_core_bpe") else core.encode_ordinary

        def encode(piece: str) -> bytes:
            return np.array(plain(piece), "<u4").tobytes()

        _ENCODERS[path] = TreeEncoder(encode, regex.compile(pattern).findall), special
    return _ENCODERS[path]


def ids_of(text: str, encoder: TreeEncoder, special: dict[str, int]) -> bytes:
    """Little-endian ids; strings of special tokens are taken out first, as the library does."""
    for name, number in special.items():
        if name in text:
            one = np.array([number], "<u4").tobytes()
            return one.join(ids_of(t, encoder, special) for t in text.split(name))
    return b"".join(encoder.values(text))


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return list(zip(starts, np.diff([*starts, n]).tolist()))


def cut(docs: DataFrame, path: str, pattern: str, capacity: int, closing: int) -> DataFrame:
    """One row per piece. Texts are read where they lie."""
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, special = json_encoder(path, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "", encoder, special) + end
                view = memoryview(ids)
                rows += [(doc, i, start, n, zlib.crc32(view[4 * start:4 * (start + n)]))
                         for i, (start, n) in enumerate(pieces_of(len(ids) // 4, capacity))]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each size, and the gap each sequence is left with."""
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    gap_of: list[int] = []
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        # change of the sum by moving one sequence from gap g to g - s; gap 0 counts for nothing
        change = 2 * (counts[:capacity + 1 - s] - counts[s:] + 1)
        change[0] = 1 - 2 * counts[s]
        change[counts[s:] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        if counts[best + s] > 0:
            gap = best + s
            b = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, len(gap_of)
            gap_of.append(capacity)
        where[i], offset[i] = b, capacity - gap
        gap_of[b] = gap - s
        if gap > s:
            open_at[gap - s].append(b)
            counts[gap - s] += 1
    return where, offset, np.array(gap_of, np.int64)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _round(rows: DataFrame, n: int, capacity: int, number: int) -> DataFrame:
    """Packs groups of rows; ``seq`` is their sequence, ``gap`` what it is left with."""
    groups = max(1, math.ceil(n / GROUP_ROWS))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
        where, offset, gaps = sum_of_squares(group["length"].to_numpy(), capacity)
        seq = where * groups + group["_group"][0].as_py()
        for name, values in (("seq", seq), ("offset", offset), ("gap", gaps[where])):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group.drop_columns(["_group"])

    # repeats of one row differ by their place in the settled table, so they spread like other rows
    copy = F.monotonically_increasing_id()
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", copy, F.lit(number)), F.lit(groups))
    return rows.withColumn("_group", key).groupBy("_group").applyInArrow(
        pack, PIECE + ", seq long, offset long, gap long")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY,
                   closing: int = CLOSING) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    pieces = settled(cut(docs, path, pattern, capacity, closing))
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    n = rest.count()
    first = settled(_round(rest, n, capacity, 1))
    poor = first.where(F.col("gap") > GAP).drop("seq", "offset", "gap")
    second = _round(poor, poor.count(), capacity, 2)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    lone = F.monotonically_increasing_id()
    return (
        full.select(*out, (lone * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        .unionByName(first.where(F.col("gap") <= GAP).select(
            *out, (F.col("seq") * 3 + 1).alias("sequence_id"), "offset"))
        .unionByName(second.select(*out, (F.col("seq") * 3 + 2).alias("sequence_id"), "offset"))
    )
