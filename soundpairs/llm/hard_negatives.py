"""Hard negatives by anchor-clustered shared lists.

An anchor's positives are the rows of its label with the largest inner products; the hard negatives of a positive are
the best rows of other labels whose score lies in a band below the positive's. All of them come off sorted lists:

1. *Clusters.* Anchors are clustered by direction; each cluster knows the widest angle between its centroid and a member.
2. *Lists.* For every cluster each candidate gets one bound, its length times the cosine of its angle to the centroid less that widest
   angle, in all at least its score with any member of unit length. A cluster's list is all candidates by falling bound; it is
   sorted once, into ``SHARES`` of the candidates by cut points that are taken over all of them.
3. *Walks.* Every member walks its cluster's list share by share, and a block of a share by falling bound, until no
   bound left can beat what it holds: first for its positives, then for the negatives of all its positives at once.
   Members that are certified drop out; the next share is read only for clusters with open members. The last share is the rest, so
   a walk without a certificate ends with all candidates seen, and results are exact.

A block of candidates meets a part of a cluster's members in one task; both are of bounded size, and only the best few
rows per member leave it. Products are of whole numbers and exact: in doubles below 2^53, in 64-bit integers above.

Equal rows (label and vector) are one candidate with the smallest ids that any answer can need, and are one anchor. Centroids
are fitted on about ``SAMPLE`` anchors. Rows without a label, vector or id, with a null or non-finite component, or with a
squared length of 2^62 and more (products would leave 64 bits) take no part. A shorter vector counts as filled
up with zeros. A row that is repeated counts once; rows with an anchor's id are none of its positives. Ties go to the smaller
id. An empty table, and one without anchors, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundpairs.llm.common import about
from soundpairs.operators.common import top_k
from soundpairs.session import settled

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Of a positive's score, in percent, what its negatives' scores lie between.
LOW, HIGH = 80, 100
SAMPLE = 20_000
#: Anchors of a cluster, about, up to ``CLUSTERS`` clusters.
MEMBERS, CLUSTERS = 64, 64
#: Shares of a list that are walked one after the other; the last is all that is left.
SHARES = (1 / 16, 1 / 4, 1)
#: Candidates and members that meet in one task, about, and candidates that are looked at together.
BLOCK, PART, STEP = 8192, 512, 512
ROUNDS = 10
#: Angles and products of doubles are off by less.
SLACK = 1e-6


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): whole-number vectors, and labels of which every seventh row's is one further."""
    label = F.col("label").cast("long")
    return embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
    ).where(
        F.col("label").isNotNull() & F.col("x").isNotNull()
        & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * float(SCALE)).cast("long")).alias("v"))


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part, with two hashes that tell vectors apart."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(
        square < float(1 << 62)).select("vec_id", "label", "v", F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))


def candidates(rows: DataFrame, ids: int) -> DataFrame:
    """(node, label, k1, k2, v, ids): one row per different label and vector, with its ``ids`` smallest ids."""
    each = rows.groupBy("label", "k1", "k2", "vec_id").agg(F.first("v").alias("v"))
    few = top_k(each, ["label", "k1", "k2"], [F.col("vec_id")], ids)
    return settled(few.groupBy("label", "k1", "k2").agg(
        F.min_by("v", "vec_id").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn(
        "node", F.monotonically_increasing_id()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones end with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))


def directions(v: np.ndarray) -> np.ndarray:
    """Unit vectors; zero stays zero."""
    return v / np.maximum(lengths(v), 1e-300)[:, None]


def centroids(v: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of the directions of ``v``, by Lloyd's rounds from evenly spaced rows."""
    x = directions(v)
    c = x[np.linspace(0, len(x) - 1, max(1, min(k, len(x)))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1) \
            if x.shape[1] else np.zeros((len(c), 0))
        c = np.where(lengths(total)[:, None] > 0, directions(total), c)
    return c


def angles(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions(v) @ c.T, -1.0, 1.0))


def bounds_of(v: np.ndarray, c: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """At least the product of each row with any unit vector within ``widest`` of each centroid."""
    bound = lengths(v)[:, None] * np.cos(np.maximum(0.0, angles(v, c) - widest - SLACK))
    return np.nextafter((bound + np.abs(bound) * 1e-9 + 1e-9).astype(np.float32), np.float32(np.inf))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if lengths(a).max(initial=0) * lengths(b).max(initial=0) < 1 << 52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The ``k`` best (score, id) that a member holds."""

    def __init__(self, k: int, rows: list[tuple[int, int]] | None = None) -> None:
        self.k, self.rows = k, rows or []

    def least(self) -> float:
        """What another row must reach to matter."""
        return self.rows[-1][0] if len(self.rows) == self.k else -math.inf

    def add(self, scores: np.ndarray, at: np.ndarray, ids: list[list[int]]) -> None:
        if len(at) > self.k:                # all that may be among the best, ties included
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            at, scores = at[scores >= cut], scores[scores >= cut]
        new = [(int(s), i) for s, j in zip(scores.tolist(), at.tolist()) for i in ids[j]]
        self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1]))[:self.k]


def walk_block(members: pa.Table, block: pa.Table, width: int, k: int, bands: bool) -> pa.Table:
    """What a part of a cluster's members find in a block: (node, goal, vec_id, score).

    Without ``bands`` rows of a member's label are looked for, its only goal is 0; with them rows of other labels, for each of its
    ``goals``, the scores of its positives. ``floors`` are the scores that a find must reach, one a goal.
    """
    block = block.sort_by([("bound", "descending"), ("node", "ascending")])
    x, bound, label = matrix(block["v"].combine_chunks(), width), block["bound"].to_numpy(), block["label"].to_numpy()
    ids = block["ids"].to_pylist()
    v, length, own = matrix(members["v"].combine_chunks(), width), members["length"].to_numpy(), members["label"].to_numpy()
    goals, floors = members["goals"].to_pylist(), members["floors"].to_pylist()
    held = [[Best(k) for _ in g] for g in goals]
    need = np.array([min(f) for f in floors])
    for first in range(0, len(x), STEP):
        open_ = np.flatnonzero(length * float(bound[first]) * (1 + 1e-9) >= need)
        if not len(open_):
            break
        part = slice(first, first + STEP)
        score = products(v[open_], x[part])
        same = label[part] == own[open_, None]
        for m, row, alike in zip(open_.tolist(), score, same):
            for g, (goal, floor, best) in enumerate(zip(goals[m], floors[m], held[m])):
                floor = max(floor, best.least())
                fits = row >= floor - abs(floor) * 1e-9 if math.isfinite(floor) else np.ones(len(row), bool)
                fits &= ~alike & (row >= -(-LOW * goal // 100)) & (row <= HIGH * goal // 100) if bands else alike
                at = np.flatnonzero(fits)
                if len(at):
                    best.add(row[at], at + first, ids)
            need[m] = min(max(f, b.least()) for f, b in zip(floors[m], held[m]))
    out = [(node, goal, i, s) for node, g, h in zip(members["node"].to_pylist(), goals, held)
           for goal, best in zip(g, h) for s, i in best.rows]
    columns = list(zip(*out)) if out else [()] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("node", "goal", "vec_id", "score"), columns)})


class Lists:
    """Clusters of anchors, and the list of candidates that each cluster's members share."""

    def __init__(self, nodes: DataFrame, anchors: DataFrame) -> None:
        self.total, count = nodes.count(), anchors.count()
        self.width = nodes.agg(F.max(F.size("v"))).first()[0]
        width = self.width
        sample = about(anchors, F.col("node"), SAMPLE, count).select("node", "v").toArrow().sort_by("node")
        sample = sample if len(sample) else anchors.select("node", "v").limit(1).toArrow()
        c = centroids(matrix(sample["v"].combine_chunks(), width), min(CLUSTERS, max(1, count // MEMBERS)))
        self.clusters = len(c)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = matrix(batch.column(2), width)
                angle, length = angles(v, c), lengths(v)
                cluster = angle.argmin(axis=1)
                # a zero vector has no direction, and no product but 0
                own = np.where(length > 0, angle[np.arange(len(v)), cluster], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cluster, pa.int32()), pa.array(own), pa.array(length)],
                    ["node", "label", "v", "cluster", "angle", "length"])

        self.anchors = settled(anchors.select("node", "label", "v").mapInArrow(
            assign, "node long, label long, v array<long>, cluster int, angle double, length double"))
        widest, self.sizes = np.zeros(len(c)), [0] * len(c)
        for r in self.anchors.groupBy("cluster").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():
            widest[r.cluster], self.sizes[r.cluster] = r.a, r.n

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = bounds_of(matrix(batch.column(2), width), c, widest)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(b.ravel()), len(c)).cast(pa.list_(pa.float32()))],
                    ["node", "label", "v", "ids", "bounds"])

        self.rows = settled(nodes.select("node", "label", "v", "ids").mapInArrow(
            bound, "node long, label long, v array<long>, ids array<long>, bounds array<float>"))
        at = [1 - s for s in SHARES[:-1]]
        cuts = self.rows.agg(*[F.percentile_approx(F.col("bounds")[i], at, 1000).alias(f"c{i}") for i in range(len(c))]).first()
        #: Cluster by share: the least bound of the share; the rest has any.
        self.cuts = [[float(x) for x in cuts[i]] + [-math.inf] for i in range(len(c))]

    def share(self, number: int, clusters: list[int]) -> DataFrame:
        """Candidates of one share of the lists of ``clusters``, a row for each list."""
        low = {c: self.cuts[c][number] for c in clusters}
        high = {c: self.cuts[c][number - 1] if number else math.inf for c in clusters}
        many = self.clusters

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = batch.column(4).flatten().to_numpy().reshape(len(batch), many)
                for c in clusters:
                    at = np.flatnonzero((b[:, c] >= low[c]) & (b[:, c] < high[c]))
                    if len(at):
                        own = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [*own.columns[:4], pa.array(np.full(len(at), c, np.int32)), pa.array(b[at, c].astype(np.float64))],
                            ["node", "label", "v", "ids", "cluster", "bound"])

        return self.rows.mapInArrow(pick, "node long, label long, v array<long>, ids array<long>, cluster int, bound double")

    def walked(self, members: DataFrame, k: int, bands: bool) -> DataFrame:
        """(node, goal, vec_id, score): the ``k`` best of every goal of ``members`` (node, goals, floors)."""
        anchors = self.anchors.join(members, "node").drop("angle")
        parts = F.array(*[F.lit(max(1, math.ceil(n / PART))) for n in self.sizes])[F.col("cluster")]
        open_ = settled(anchors.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")))
        held = None
        for number, share in enumerate(SHARES):
            clusters = sorted(r.cluster for r in open_.select("cluster").distinct().collect())     # CLUSTERS at most
            if not clusters:
                break
            blocks = max(1, math.ceil(share * self.total / BLOCK))
            width = self.width
            left = open_.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            right = self.share(number, clusters).withColumn(
                "block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).withColumn(
                "part", F.explode(F.sequence(F.lit(0), parts - 1)))

            def meet(members: pa.Table, block: pa.Table) -> pa.Table:
                if not len(members) or not len(block):
                    return _NOTHING
                return walk_block(members, block, width, k, bands)

            key = ["cluster", "part", "block"]
            found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
                meet, "node long, goal long, vec_id long, score long")
            if held is not None:
                found = held.unionByName(found)
            held = settled(top_k(found, ["node", "goal"], [F.col("score").desc(), F.col("vec_id")], k).drop("rank"))
            # what a goal still needs: its floor, or the last of the rows that it is full of
            full = held.groupBy("node", "goal").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(
                F.col("n") == k).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("goal", "least"))).alias("full"))
            floors = F.zip_with("goals", "floors", lambda g, f: F.greatest(f, F.coalesce(F.element_at("full", g).cast("double"), f)))
            cut = F.array(*[F.lit(c[number]) for c in self.cuts])[F.col("cluster")]
            open_ = settled(open_.join(full, "node", "left").withColumn(
                "floors", F.when(F.col("full").isNull(), F.col("floors")).otherwise(floors)).drop("full").where(
                F.col("length") * cut * (1 + 1e-9) >= F.array_min("floors")))
        return held


_NOTHING = pa.table({n: pa.array([], pa.int64()) for n in ("node", "goal", "vec_id", "score")})
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, wanted: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """The first ``negatives`` rows of other labels in the band below each of the ``positives`` of every anchor.

    ``rows`` are (vec_id, label, v), v whole numbers; anchors are those for which ``wanted`` holds.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    nodes = candidates(rows, max(positives + 1, negatives))
    asked = settled(rows.where(wanted).select(F.col("vec_id").alias("anchor_id"), "label", "k1", "k2").distinct().join(
        nodes.select("label", "k1", "k2", "node"), ["label", "k1", "k2"]).select("anchor_id", "node"))
    if asked.isEmpty():
        return spark.createDataFrame([], _RESULT)
    lists = Lists(nodes, nodes.join(asked.select("node").distinct(), "node"))
    nothing = F.array(F.lit(-math.inf))
    alike = lists.walked(lists.anchors.select("node", F.array(F.lit(0).cast("long")).alias("goals"), nothing.alias("floors")),
                         positives + 1, bands=False)
    pairs = top_k(asked.join(alike, "node").where(F.col("vec_id") != F.col("anchor_id")), ["anchor_id", "node"],
                  [F.col("score").desc(), F.col("vec_id")], positives).select(
        "anchor_id", "node", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = settled(pairs)
    # below 0 the band is empty
    goals = pairs.where("positive_score >= 0").groupBy("node").agg(F.array_sort(F.collect_set("positive_score")).alias("goals"))
    goals = goals.withColumn("floors", F.transform("goals", lambda g: g.cast("double") * (LOW / 100)))
    others = lists.walked(goals, negatives, bands=True)
    if others is None:
        return spark.createDataFrame([], _RESULT)
    found = pairs.join(others.withColumnsRenamed({"goal": "positive_score", "vec_id": "negative_id", "score": "negative_score"}),
                       ["node", "positive_score"])
    return top_k(found, ["anchor_id", "node", "positive_id"], [F.col("negative_score").desc(), F.col("negative_id")],
                 negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                   "positive_score", "negative_score")


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth row."""
    return hard_negatives(prepared(embeddings), F.col("vec_id") % 100 == 0)


def mined_sql() -> str:
    return f"""
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), scores as (
    select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as alike,
        cast(list_dot_product(a.v, b.v) as bigint) as score
    from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
    select anchor_id, other as positive_id, score as positive_score from scores where alike
    qualify row_number() over (partition by anchor_id order by score desc, other) <= {POSITIVES}
), negatives as (
    select anchor_id, positive_id, other as negative_id, positive_score, score as negative_score,
        row_number() over (partition by anchor_id, positive_id order by score desc, other) as rank
    from positives join scores using (anchor_id)
    where not alike and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
from negatives where rank <= {NEGATIVES}"""
