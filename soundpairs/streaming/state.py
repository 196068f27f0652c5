"""First arrivals of a key, remembered in Spark's keyed state store.

The state of a key is its mere presence, kept by ``dropDuplicates`` in RocksDB on the executors with its changes in the
checkpoint, so a micro-batch costs what its own keys cost, however many came before. A checkpoint begun anew has no state: its first micro-batch takes the keys that the target holds already from the target's own files, and
later ones take those that were written since. Such keys enter the state and give nothing.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"


def use_keyed_store(spark: SparkSession) -> None:
    """RocksDB as the state store, unless the session names one; a query keeps the store it began with."""
    if spark.conf.get(_PROVIDER, "").endswith(".HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


@contextlib.contextmanager
def state_parts(spark: SparkSession) -> Iterator[None]:
    """Two state stores a core for a query that begins here, if the session does not have fewer shuffle partitions.

    Every micro-batch opens and commits each store, also where a batch has few keys. A checkpoint keeps the number it began with.
    """
    before = spark.conf.get(_PARTS)
    spark.conf.set(_PARTS, min(int(before), max(8, 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_PARTS, before)


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder that a stream can watch before anything was written to it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)


def stored_keys(spark: SparkSession, target: str, kind: T.StructField) -> DataFrame:
    """The stream of the key column of all that is written under ``target``; all there is comes at once."""
    make_folder(spark, target)
    schema = T.StructType([kind, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
    return spark.readStream.schema(schema).parquet(target)


def _best(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row per key: that of the target, else the first by position."""
    rows = rows.take(pc.sort_indices(pa.table(rows), sort_keys=[
        ("_key", "ascending"), ("_stored", "descending"), ("_pos", "ascending"), ("_row", "ascending")]))
    if len(rows) > 1:
        key = rows.column(0)
        other = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1))
        rows = rows.filter(pa.concat_arrays([pa.array([True]), other]))
    return rows


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best row per key and Arrow batch."""
    for batch in batches:
        yield _best(batch)


def _fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best row per key of a task that has all rows of its keys; holds about twice its different keys."""
    held, waiting, n = [], [], 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n > sum(map(len, held)):
            held, waiting, n = [_best(pa.concat_batches([*held, *waiting]))], [], 0
    if held or waiting:
        rows = _best(pa.concat_batches([*held, *waiting]))
        for at in range(0, len(rows), 10_000):
            yield rows.slice(at, 10_000)


def first_arrivals(sdf: DataFrame, key: str, target: str) -> DataFrame:
    """The rows of a stream whose ``key`` comes for the first time: of one micro-batch the first by ``pos``.

    Rows without a key are left out. Copies of a key are folded in each task before they are shuffled, so a key that
    holds most rows is a few rows. A task then holds its share of one micro-batch's keys, and the state sees one row of each.
    Rows pass as JSON text, which keeps every value of the schema.
    """
    spark, kind = sdf.sparkSession, sdf.schema[key]
    rows = sdf.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(False).alias("_stored"),
        F.coalesce(F.col("pos").cast("long"), F.lit(-(2**63))).alias("_pos"), F.to_json(F.struct("*")).alias("_row"))
    known = stored_keys(spark, target, kind).where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(True).alias("_stored"), F.lit(0).cast("long").alias("_pos"), F.lit("").alias("_row"))
    both = rows.unionByName(known)
    folded = both.mapInArrow(_fold, both.schema).repartition(int(spark.conf.get(_PARTS)), "_key").mapInArrow(_fold_all, both.schema)
    first = folded.dropDuplicates(["_key"]).where("not _stored")
    return first.select(F.from_json("_row", sdf.schema).alias("_r")).select("_r.*")
