"""Homomorphic multiset hash of a text's paragraphs.

Every paragraph (the text between line feeds) is hashed to a wide vector, and a text's fingerprint
is the sum of its paragraphs' vectors, lane by lane modulo a power of two. So the order of paragraphs
doesn't matter, and a paragraph is put in or taken out by adding or subtracting its vector; nothing
else is read. A vector has two parts:

* ``EXACT`` lanes modulo 2^64 from a cryptographic digest of the paragraph: equal sums mean equal
  multisets of paragraphs (but for collisions);
* ``SKETCH`` signed lanes modulo 2^32, in which every run of 8 bytes of the paragraph adds +1 or -1
  to one lane. Their inner products estimate how many runs two texts share.

Likeness is 1 for equal fingerprints, else the cosine of the sketch lanes, cut to 0..1. Texts with
nothing in common come out near 0, give or take 1/sqrt(SKETCH).

Null is the empty text, which is one empty paragraph.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundpairs.llm.common import mix, shuffle_parts

EXACT, SKETCH, RUN = 16, 128, 8
#: Text bytes of one range of documents, about.
RANGE_BYTES = 64 << 20
_SHIFTS = np.arange(RUN, dtype=np.uint64) * np.uint64(8)


def paragraph_vectors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Summed vectors of the paragraphs of ``text``."""
    raw = text.encode("utf-8", "surrogatepass")
    digest = hashlib.blake2b
    joined = b"".join([digest(p, person=b"one").digest() + digest(p, person=b"two").digest() for p in raw.split(b"\n")])
    exact = np.frombuffer(joined, np.uint64).reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    sketch = np.zeros(SKETCH, np.int64)
    if len(raw) >= RUN:
        b = np.frombuffer(raw, np.uint8)
        n = len(b) - RUN + 1
        window = np.lib.stride_tricks.as_strided(b, (n, RUN), (1, 1))
        runs = np.ascontiguousarray(window).view("<u8").ravel()
        ends = np.flatnonzero(b == 10)
        if len(ends):           # runs stay within a paragraph
            last = np.zeros(len(b) + 1, np.int64)
            last[ends + 1] = 1
            last = np.cumsum(last)
            runs = runs[last[RUN:len(b) + 1] == last[:n]]
        h = mix(runs)
        lane = (h & np.uint64(2 * SKETCH - 1)).astype(np.int64)
        count = np.bincount(lane, minlength=2 * SKETCH)
        sketch = count[:SKETCH] - count[SKETCH:]
    return exact, sketch.astype(np.uint32)


class Fingerprint:
    """A fingerprint that paragraphs can be put into and taken out of."""

    def __init__(self, text: str | None = ""):
        self.exact, self.sketch = paragraph_vectors(text or "")

    def insert(self, paragraphs: str) -> Fingerprint:
        exact, sketch = paragraph_vectors(paragraphs)
        self.exact, self.sketch = self.exact + exact, self.sketch + sketch
        return self

    def delete(self, paragraphs: str) -> Fingerprint:
        exact, sketch = paragraph_vectors(paragraphs)
        self.exact, self.sketch = self.exact - exact, self.sketch - sketch
        return self

    def text(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        if np.array_equal(self.exact, other.exact) and np.array_equal(self.sketch, other.sketch):
            return 1.0
        a, b = (x.sketch.astype(np.int32).astype(np.float64) for x in (self, other))
        norm = float(np.sqrt(a @ a) * np.sqrt(b @ b))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first characters of ``following``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def with_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """``key`` (doc_id, null first) and ``block``: a range of keys, alike for every reading of the table."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), "doc_id", "text")
    keyed = keyed.withColumn("_at", F.col("key").cast("double"))
    if blocks < 2:
        return keyed.drop("_at").withColumn("block", F.lit(0.0))
    ends = keyed.where("doc_id is not null").approxQuantile("_at", [i / blocks for i in range(1, blocks)], 0.1 / blocks)
    inner = sorted(set(ends or []))
    if not inner:
        return keyed.drop("_at").withColumn("block", F.lit(0.0))
    splits = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_at", outputCol="block")
    return splits.transform(keyed).drop("_at")


def fingerprint_documents(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, which borrows from the next document.

    Documents are dealt into ranges of doc_id of about ``RANGE_BYTES`` of text, each sorted on its own; a range also
    gets a copy of the first document of the next range, so that texts are shuffled once. Ranges are read from their
    end, so the next document is known and no row waits. Rows with equal doc_id are all followed by the first (by
    text) of the next larger doc_id; a null doc_id comes before all. The only document is followed by itself.
    """
    spark = docs.sparkSession
    if blocks is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(2 * shuffle_parts(spark), math.ceil(size / RANGE_BYTES))
    ranged = with_blocks(docs, blocks)
    first = ranged.groupBy("block").agg(F.min("key").alias("key"))          # at most one row per range
    order = Window.orderBy("block")
    heads = (
        first.withColumn("_before", F.lag("block").over(order))
        .withColumn("_last", F.max("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("key", F.coalesce("_before", "_last").alias("to"))
    )
    lent = (
        ranged.select("key", "text").join(F.broadcast(heads), "key")
        .groupBy("key", "to").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    rows = ranged.select("block", "doc_id", "key", "text", F.lit(0).alias("lent")).unionByName(
        lent.select(F.col("to").alias("block"), F.lit(None).cast("long").alias("doc_id"), "key", "text", F.lit(1).alias("lent")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key = None
        after, follows, first = "", None, None      # the next document's text and fingerprint, the first text of this key
        for batch in batches:
            ready = []
            for at, doc, own_key, text, is_lent in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                text = text or ""
                if at != block:
                    assert is_lent, "a range without its borrowed row"
                    block, key, first = at, None, text
                    continue
                if own_key != key:
                    key, after, follows = own_key, first, Fingerprint(first)
                first = text                        # the last one of a key is its first by text
                other, mark = edited(text, after), Fingerprint(text)
                changed = Fingerprint(other)
                ready.append((doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
                              mark.text(), changed.text(), mark.likeness(changed), mark.likeness(follows)))
            yield _batch(ready)

    return (
        rows.repartition(max(shuffle_parts(spark), blocks), "block")
        .sortWithinPartitions("block", F.desc("lent"), F.desc("key"), F.desc("text"))
        .select("block", "doc_id", "key", "text", "lent").mapInArrow(run, SCHEMA)
    )


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
