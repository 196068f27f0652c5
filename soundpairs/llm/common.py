"""Small helpers of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that vector code works on at once. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of rows that go to a Python worker as one batch, beside its last row. By rows alone (Spark's 10,000) a batch grows with the texts.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package, wherever the session was started.

    A cluster gets the package by ``--py-files`` or has it installed.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by ``BATCH_BYTES``, unless the session says otherwise.

    Executor and worker hold a batch several times over, both outside the heap's limit.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int]:
    """Columns ``keep`` and the place of the text: among them, or else behind them."""
    if "text" in keep:
        return docs.select(*keep), keep.index("text")
    return docs.select(*keep, "text"), len(keep)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[str]:
    """Python texts of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES,
                rows: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, UTF-8 bytes) of runs of rows with about ``limit`` bytes, ``rows`` at most.

    Works on Arrow's own buffer: no text becomes a Python object. Null is the empty text.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(i + rows, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, at[i:j + 1] - at[i], raw[at[i]:at[j]]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fold_of(doc_id: Column, folds: int) -> Column:
    """Checksum of the id as text, modulo ``folds``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def about(df: DataFrame, key: Column, rows: int, n: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows of ``df``, chosen by a hash of ``key``."""
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


_POWER = np.uint64(0x9E3779B97F4A7C55)
_BACK = np.uint64(pow(int(_POWER), -1, 1 << 64))


@functools.lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = (1 << bits) + 1
    out = []
    for base in (_POWER, _BACK):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def body_hashes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each raw[lo:hi], the same wherever it lies."""
    up, back = _powers(max(8, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
