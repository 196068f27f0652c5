"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised with a codebook of its own; a pair of
centroids is a cell. A query walks the cells in the order of their summed distances, with a heap, until
they hold a share of all indexed rows and ``k + 1`` at least, and reranks the rows of those cells by exact cosine.

Codebooks grow with the square root of the index, so that a cell holds about ``CELL_ROWS`` rows, up to ``CENTROIDS`` a half.
The share is measured: on the sample that the codebooks are fitted on (about ``SAMPLE`` rows), it is the one that finds ``RECALL``
of the true neighbours of up to ``PROBES`` of its rows. Vectors with structure need little, random ones much; in a larger
index neighbours are nearer, so the sample's share is enough.

Equal vectors are indexed once, with their ``k + 1`` smallest ids, which is all that any answer can need;
queries with equal vectors are answered once. Cells are packed into blocks of about ``BLOCK`` rows (a
larger cell is spread over several). A query goes to the blocks it has cells in, and a block is copied only as often as
the queries that come to it fill parts of ``QUERIES_PER_BLOCK``.

Vectors that are null, zero, hold null or non-finite
components, or have another length than most, take no part, nor do rows without an id. Rows with equal
ids count once per different vector; ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundpairs.llm.common import about
from soundpairs.session import settled

CENTROIDS, CELL_ROWS = 512, 6
SAMPLE, PROBES = 20_000, 256
#: Share of true neighbours that the sample must find; the least allowed for an index is lower, as for other rows.
RECALL = 0.95
BLOCK = 2048
QUERIES_PER_BLOCK = 2048
ROUNDS = 12


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return distances(x[:, :h], self.first), distances(x[:, h:], self.second)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's k-means, from evenly spaced rows."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = distances(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def walk(a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: float) -> np.ndarray:
    """Cells in the order of a[i] + b[j] until they hold ``enough`` rows."""
    ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b, width, held = a[ia].tolist(), b[ib].tolist(), len(b), held.tolist()
    heap, out, got = [(a[0] + b[0], 0, 0)], [], 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = ia[i] * width + ib[j]
        out.append(cell)
        got += held[cell]
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return np.array(out, np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, k1, k2): rows that take part, vectors as doubles, and what tells vectors apart."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(~bad & F.exists("v", lambda x: x != 0.0))
    )
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").head(1)
    d = sizes[0].d if sizes else 0
    return rows.where(F.size("v") == d).withColumn("v", F.transform("v", lambda x: x + 0.0)).select(
        "vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(classes: DataFrame, n: int, k: int) -> tuple[Codebooks, float]:
    """Codebooks, and the share of the index that a query has to look at."""
    rows = about(classes, F.col("vec_id"), SAMPLE, n).select("vec_id", "v").toArrow().sort_by("vec_id")
    x = unit(matrix(rows["v"].combine_chunks()))
    size, h = max(1, min(CENTROIDS, n // 4, round(math.sqrt(n / CELL_ROWS)))), max(1, x.shape[1] // 2)
    books = Codebooks(codebook(x[:, :h], size), codebook(x[:, h:], size) if x.shape[1] > h else np.zeros((1, 0)))
    return books, needed_share(books, x, k)


def needed_share(books: Codebooks, x: np.ndarray, k: int) -> float:
    """Share of the rows, cells in order, that holds ``RECALL`` of the ``k`` nearest of rows of ``x``."""
    probes = np.unique(np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int))
    own_a, own_b = (d.argmin(axis=1) for d in books.halves(x))
    a, b = books.halves(x[probes])
    found = []
    for i, row in enumerate(probes):
        near = x @ x[row]
        near[row] = -np.inf
        true = np.argsort(-near, kind="stable")[:min(k, len(x) - 1)]
        walked = np.sort(distance := a[i, own_a] + b[i, own_b])
        found.append(np.searchsorted(walked, distance[true], "right") / len(x))
    found = np.concatenate(found) if found else np.zeros(0)
    return float(np.quantile(found, RECALL, method="higher")) if len(found) else 1.0


def nearest(vectors: DataFrame, wanted, k: int = 5, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each row for which ``wanted`` holds.

    ``share`` of the index is looked at; unless given, it is measured.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    ranked = rows.dropDuplicates(["vec_id", "k1", "k2"]).withColumn("_i", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(
        F.col("_i") <= k + 1)
    classes = settled(ranked.groupBy("k1", "k2").agg(
        F.min_by("v", "vec_id").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"),
        F.min("vec_id").alias("vec_id")))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made, measured = build(classes, n, k)
    books, share = spark.sparkContext.broadcast(made), measured if share is None else share

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = books.value.cell_of(unit(matrix(batch.column(1)))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["ids", "v", "cell"])

    index = settled(classes.select("ids", "v").mapInArrow(assign, "ids array<long>, v array<double>, cell long"))
    held = np.zeros(books.value.cells, np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():     # CENTROIDS^2 rows at most
        held[r.cell] = r.n
    # cells in order fill blocks; a cell of more than a block has several of its own
    first, parts, block, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, BLOCK
    for c, h in enumerate(held.tolist()):
        if h > room and room < BLOCK:
            block, room = block + 1, BLOCK
        first[c] = block
        if h > BLOCK:
            parts[c] = math.ceil(h / BLOCK)
            block += int(parts[c])
        else:
            room -= h
    plan = spark.sparkContext.broadcast((held, first, parts))
    asked = rows.where(wanted).select(F.col("vec_id").alias("query_id"), "k1", "k2").join(
        classes.select("k1", "k2", F.col("vec_id").alias("node")), ["k1", "k2"]).select("query_id", "node").distinct()
    asked = settled(asked)
    nodes = asked.select("node").distinct()
    queries = classes.join(nodes, classes["vec_id"] == nodes["node"]).select("node", "v")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, parts = plan.value
        for batch in batches:
            if not len(batch):
                continue
            a, b = books.value.halves(unit(matrix(batch.column(1))))
            for i in range(len(batch)):
                cells = walk(a[i], b[i], held, max(math.ceil(share * n), k + 1))
                cells = cells[held[cells] > 0]
                # a cell of several blocks goes to all of them
                to = np.repeat(first[cells], parts[cells])
                to += np.arange(len(to)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                cells = np.repeat(cells, parts[cells])
                order = np.lexsort((cells, to))
                to, cells = to[order], cells[order]
                cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(to)), pa.int32()), pa.array(cells, pa.int64()))
                at = pa.array(np.full(len(cut), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cut]), batch.column(0).take(at), batch.column(1).take(at), lists],
                    ["block", "node", "v", "cells"])

    sent = settled(queries.select("node", "v").mapInArrow(
        route, "block long, node long, v array<double>, cells array<long>"))
    loads = sent.groupBy("block").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("parts"))
    sent = sent.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = plan.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            spread = np.array([ids[0].as_py() for ids in batch.column(0)], np.int64) if len(batch) else cell
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first[cell] + spread % parts[cell])], ["ids", "v", "cell", "block"])

    entries = index.mapInArrow(place, "ids array<long>, v array<double>, cell long, block long").join(
        loads, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, ids, scores = [], [], []
        if len(left) and len(right):
            x = matrix(left["v"].combine_chunks())
            cell = left["cell"].to_numpy()
            own = left["ids"].to_pylist()
            smallest = np.array([i[0] for i in own])
            scale = np.abs(x).max(axis=1)
            x = x / scale[:, None]
            norm = np.sqrt((x * x).sum(axis=1))
            for q, v, cells in zip(right["node"].to_pylist(), matrix(right["v"].combine_chunks()), right["cells"].to_pylist()):
                at = np.flatnonzero(np.isin(cell, cells))
                if not len(at):
                    continue
                v = v / np.abs(v).max()
                score = (x[at] * v).sum(axis=1) / (norm[at] * np.sqrt((v * v).sum()))
                best = np.lexsort((smallest[at], -score))[:k + 1]
                near = sorted((-score[j], i) for j in best for i in own[at[j]])[:k + 1]
                nodes += [q] * len(near)
                ids += [i for _, i in near]
                scores += [-s for s, _ in near]
        return pa.table({"node": pa.array(nodes, pa.int64()), "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(scores, pa.float64())})

    found = entries.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(
        rerank, "node long, vec_id long, score double")
    order = [F.col("score").desc(), F.col("vec_id")]
    best = found.withColumn("_i", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(
        F.col("_i") <= k + 1).drop("_i")
    each = asked.join(best, "node").where(F.col("query_id") != F.col("vec_id"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(vec_id: str = "vec_id"):
    return F.col(vec_id) % 50 == 0
