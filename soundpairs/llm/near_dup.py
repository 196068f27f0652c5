"""Near-duplicate groups by MinHash.

* *Signature.* A document's set holds 64-bit hashes of its 5-word shingles. One permutation: the hash
  range is cut into bins and each keeps the least hash in it. An empty bin borrows from a bin
  drawn by a hash of (bin, attempt), drawn again until one is full (optimal densification).
* *Classes.* Documents with equal sets are one node from here on.
* *Buckets.* Bands of ``ROWS`` bins each, ``BANDS`` at ``PERCENT`` and more below it; nodes that agree on a band
  share its bucket. A pair at the threshold shares none with a chance below one in a million.
* *Stars* and *components*: see ``stars``; no candidate is dropped.

Null and empty texts have no shingles and are linked with nothing, nor are rows with a null doc_id, whose
component is null. Rows are told apart by doc_id and text, and every row has the component of its own text; rows
with equal doc_id and different texts are linked only if their texts are. Ties go to the smaller doc_id.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundpairs.llm.common import byte_chunks, mix
from soundpairs.llm.stars import linked, shingles
from soundpairs.operators.common import first_row
from soundpairs.session import settled

WORDS = 5
#: Documents are linked with percent * union <= 100 * intersection; this is op4's.
PERCENT = 85
BANDS, ROWS = 24, 5
#: Chance that a pair at the threshold shares no bucket, at most.
MISSED = 1e-6

_TURN = np.uint64(0xD6E8FEB86659FD93)


def bands_for(percent: int) -> int:
    """How many bands miss a pair at the threshold with a chance of ``MISSED`` at most."""
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 0 and 100")
    return math.ceil(math.log(MISSED) / math.log1p(-(percent / 100) ** ROWS))


def least_set(percent: int) -> int:
    """Sets smaller than this are linked with equal sets only."""
    return math.ceil(percent / (100 - percent))


@functools.lru_cache(maxsize=4)
def _layout(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``count`` bands: where bins begin, the bin that an empty bin borrows from at each attempt, and seeds."""
    bins = count * ROWS
    floors = (np.arange(bins, dtype=object) * (1 << 64) // bins).astype(np.uint64)
    draws = (mix(np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1_000_003)
                 + np.arange(4096, dtype=np.uint64)[None, :]) % np.uint64(bins)).astype(np.int64)
    return floors, draws, mix(np.arange(1, count + 1, dtype=np.uint64))


def bands(own: np.ndarray, count: int = BANDS) -> np.ndarray:
    """Bucket of each of ``count`` bands of a sorted, not empty set."""
    floors, draws, seeds = _layout(count)
    at = np.searchsorted(own, floors)
    full = at < np.append(at[1:], len(own))
    least = own[np.minimum(at, len(own) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        source = draws[empty, 0]
        attempt = 0
        while True:
            bad = np.flatnonzero(~full[source])
            if not len(bad):
                break
            attempt += 1
            if attempt == draws.shape[1]:          # next to impossible: the first full bin
                source[bad] = np.flatnonzero(full)[0]
                break
            source[bad] = draws[empty[bad], attempt]
        least[empty] = least[source]
    cells = least.reshape(count, ROWS)
    h = seeds.copy()
    for k in range(ROWS):
        h = mix(h * _TURN + cells[:, k])
    return h


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, words, n, k1, k2, buckets): hash of each text, size and digest of its set, and its buckets."""
    count, smallest = bands_for(percent), least_set(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, found = [], [], []
            for _, at, raw in byte_chunks(batch.column(2)):
                for own in shingles(at, raw, WORDS):
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    found.append(bands(own, count).view(np.int64) if len(own) >= smallest else None)
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.array(found, pa.list_(pa.int64()))], ["doc_id", "words", "n", "k1", "k2", "buckets"])

    return keyed(docs).mapInArrow(run, "doc_id long, words long, n long, k1 long, k2 long, buckets array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, words, text); doc_id and the hash of the text tell rows apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("words"), "text")


def set_nodes(sig: DataFrame) -> DataFrame:
    """One numbered row per different set of rows with a doc_id: that with the smallest doc_id."""
    known = sig.where("doc_id is not null and n > 0")
    return settled(first_row(known, ["k1", "k2"], ["doc_id", "words"]).withColumn("node", F.monotonically_increasing_id()))


def texts_of(docs: DataFrame, nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What gives (node, text) of wanted nodes; a row that is repeated is read once."""
    def fetch(wanted: DataFrame) -> DataFrame:
        places = nodes.select("node", "doc_id", "words").join(wanted, "node", "left_semi")
        return keyed(docs).hint("merge").join(places, ["doc_id", "words"]).dropDuplicates(
            ["doc_id", "words"]).select("node", "text")

    return fetch


def classes(nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    """(k1, k2, component_id, kept_words): of each set, the least doc_id of its component and that row's text hash."""
    own = F.struct("doc_id", "words")
    if found is None:
        return nodes.select("k1", "k2", F.col("doc_id").alias("component_id"), F.col("words").alias("kept_words"))
    where = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = where.groupBy("component").agg(F.min(own).alias("_least"))
    return where.join(least, "component").select(
        "k1", "k2", F.col("_least.doc_id").alias("component_id"), F.col("_least.words").alias("kept_words"))


def near_classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and the classes of their sets."""
    sig = settled(signatures(docs, percent))
    nodes = set_nodes(sig)
    return sig, classes(nodes, linked(nodes, texts_of(docs, nodes), percent, WORDS))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sig, found = near_classes(docs, percent)
    # rows without shingles all have the digest of the empty set, which is no class
    out = sig.join(found, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the rows of each group of near copies that with the smallest doc_id, once; all rows in no group.

    Rows are told apart by doc_id and text, so unrelated texts under one doc_id all stay, as do rows without a doc_id
    or without a word.
    """
    _, found = near_classes(docs, percent)
    kept = found.select(F.col("component_id").alias("_id"), F.col("kept_words").alias("_words")).distinct()
    grouped = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(grouped).withColumns({"_id": F.col("doc_id").cast("long"), "_words": F.xxhash64("text")})
    left = own.join(kept, ["_id", "_words"], "left_semi")
    return first_row(left, ["_id", "_words"], ["_id"]).drop("_id", "_words").unionByName(docs.where(~grouped))
