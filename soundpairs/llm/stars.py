"""Components of texts that share buckets, confirmed on full shingle sets. Whatever the buckets are made of.

In each bucket one hub is paired with the others, so pairs grow with the bucket's size and not with its square.
The hub is the member whose buckets are largest, which is the centre of a family of copies. Pairs are confirmed
on full sets. Buckets that still hold nodes of different components get more hubs, many times as many each round,
until every pair in them is confirmed, refused or already in one component; no candidate is dropped. A bucket is
ranked only as far as its hubs, and it meets them in as many parts as its size asks for.

A node is a different set of shingles, known by a number; ``fetch`` gives the texts of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundpairs.llm.common import body_hashes, byte_chunks, mix
from soundpairs.llm.components import components
from soundpairs.operators.common import first_row, top_k
from soundpairs.session import settled

#: Hubs of the second round, and the factor of further rounds.
MORE_HUBS = 32
#: Members that are compared with one hub in one task, about.
SALT_ROWS = 500
#: Members of a bucket that meet its hubs in one task, about.
PART_ROWS = 1000
#: Earlier buckets of a node that are looked at to make a pair once.
BACK = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_TURN = np.uint64(0xD6E8FEB86659FD93)


def shingles(at: np.ndarray, raw: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted set of hashes of the ``words``-word shingles of each text of a run of rows.

    A text of fewer words has one shingle, all of them; a text without words has none.
    """
    rows = len(at) - 1
    low = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_WHITE[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True                                             # a text's end also ends its last word
    lo = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    hi = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    word = body_hashes(low, lo, hi) if len(lo) else np.zeros(0, np.uint64)
    first = np.searchsorted(lo, at[:-1])
    last = np.append(first[1:], len(lo))
    run = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        run = run * _TURN + word[k:k + len(run)]
    run = mix(run + np.uint64(words))
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= words:
            out.append(np.unique(run[a:b - words + 1]))
        elif b > a:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * _TURN + w
                out.append(mix(np.array([h + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    assert len(out) == rows
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Those ``pairs`` (hub, member) whose full sets are similar enough, as links (u, v).

    Members and a copy of the hub's text meet by (hub, salt), with about ``SALT_ROWS`` members each.
    """
    pairs = settled(pairs)
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "hub").select(
        F.col("member").alias("node"), "hub", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"),
        F.lit(1).alias("kind"))
    hubs = salts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                        F.lit(0).alias("kind"))
    rows = texts.join(members.unionByName(hubs), "node").repartition("hub", "salt").sortWithinPartitions(
        "hub", "salt", "kind", "node").select("hub", "salt", "kind", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for batch in batches:
            sets = [s for _, a, raw in byte_chunks(batch.column(4)) for s in shingles(a, raw, words)]
            u, v = [], []
            for hub, kind, node, this in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                            batch.column(3).to_pylist(), sets):
                if not kind:
                    own, at = this, hub
                    continue
                if at != hub:
                    raise ValueError("a member without its hub")
                both = len(np.intersect1d(own, this, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(this) - both):
                    u.append(hub)
                    v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return settled(rows.mapInArrow(run, "u long, v long"))


def alike_size(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _enough(both: str, a: str, b: str, percent: int) -> str:
    """Whether sets of sizes a and b can be similar enough with ``both`` common shingles."""
    return f"{100 + percent} * {both} >= {percent} * ({a} + {b})"


def linked(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, words: int) -> DataFrame | None:
    """(node, component) of linked ``nodes`` (node, n, buckets), or None where no bucket is shared.

    ``fetch`` gives (node, text), once each, of wanted nodes (node).
    """
    rows = nodes.where("buckets is not null").select("node", "n", F.explode("buckets").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = settled(rows.hint("merge").join(sizes, "bucket"))
    if shared.isEmpty():
        return None
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")           # a large bucket is dealt in parts from here on
    members = settled(shared.join(weight, "node").select(
        "bucket", "node", "n", "weight", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")))
    texts = settled(fetch(weight.select("node")))
    order = [F.col("weight").desc(), F.col("node")]
    hubs = _dealt(first_row(members, ["bucket"], order).select(
        "bucket", "parts", F.col("node").alias("hub"), F.col("n").alias("m")))
    pairs = members.join(hubs, ["bucket", "part"]).where(
        (F.col("node") != F.col("hub")) & alike_size("n", "m", percent)).select("hub", F.col("node").alias("member")).distinct()
    links = confirmed(pairs, texts, percent, words)
    found, done, more, common = components(links), 1, MORE_HUBS, None
    while True:
        now = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = _mixed(now, done)
        if common is None:
            open_ = settled(open_)
            common = settled(shared_shingles(open_.select("node").distinct(), texts, words))
        open_ = open_.join(common, "node").withColumn("c", F.col("n") - F.col("alone"))
        least = _dealt(open_.groupBy("bucket").agg(F.min("n").alias("_least"), F.max("parts").alias("parts")))
        able = open_.join(least, ["bucket", "part"]).where(
            F.expr(_enough("c", "n", "_least", percent))).drop("_least", "alone")
        able = settled(_mixed(able, 1).withColumn("before", _before("node")))
        if able.isEmpty():
            return found
        hubs = top_k(able, ["bucket"], order, more).select(
            "bucket", "parts", F.col("node").alias("hub"), F.col("n").alias("m"), F.col("c").alias("d"),
            F.col("component").alias("other"), F.col("weight").alias("heavy"))
        hubs = settled(hubs.withColumn("led", _before("hub")))
        # of two members the one that is better everywhere leads; a pair is made where none of the last buckets is shared
        later = (F.col("weight") < F.col("heavy")) | ((F.col("weight") == F.col("heavy")) & (F.col("node") > F.col("hub")))
        apart = (F.col("component") != F.col("other")) & F.expr(_enough("least(c, d)", "n", "m", percent))
        pairs = able.join(_dealt(hubs), ["bucket", "part"]).where(
            later & apart & ~F.arrays_overlap("before", "led")).select("hub", F.col("node").alias("member")).distinct()
        new = confirmed(pairs, texts, percent, words)
        if not new.isEmpty():
            links = settled(links.unionByName(new))
            found = components(links)
        elif able.where(F.col("size") > more).isEmpty():
            return found
        # the hubs of this round are done with
        members = settled(members.join(hubs.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti"))
        more *= MORE_HUBS


def _dealt(per_bucket: DataFrame) -> DataFrame:
    """A row of each bucket for every one of its parts."""
    return per_bucket.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _before(node: str):
    """The last ``BACK`` buckets of a node before each of its own, in the order of their numbers.

    The first bucket that two nodes share has no shared one before it. So a pair that is made only where neither
    knows of one is always made, and seldom more than once however many buckets they share.
    """
    return F.collect_list("bucket").over(Window.partitionBy(node).orderBy("bucket").rowsBetween(-BACK, -1))


def _mixed(rows: DataFrame, done: int) -> DataFrame:
    """Rows of buckets with several components and more than ``done`` members, with the bucket's ``size``."""
    mixed = rows.groupBy("bucket").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"),
        F.max("parts").alias("parts")).where((F.col("a") < F.col("b")) & (F.col("size") > done)).drop("a", "b")
    return rows.drop("size").join(_dealt(mixed), ["bucket", "part"])


def shared_shingles(wanted: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, alone): how many shingles of each wanted node no other wanted one has.

    Whatever is linked with it has none of these, which bounds what two sets can have in common.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, at, raw in byte_chunks(batch.column(1)):
                sets = shingles(at, raw, words)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(first, first + len(sets)), [len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    each = texts.join(wanted, "node").select("node", "text").mapInArrow(run, "node long, shingle long")
    alone = each.groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    counts = alone.groupBy("node").agg(F.count("*").alias("alone"))
    return wanted.join(counts, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
