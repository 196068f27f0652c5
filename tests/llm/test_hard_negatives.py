"""Shared lists against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundpairs.llm import hard_negatives as hn
from tests.llm.conftest import SF, rows

SCHEMA = "vec_id long, label long, embedding array<double>"


def brute(data, anchor=lambda i: i % 100 == 0):
    """(anchor, positive, rank, negative, positive score, negative score) over (id, label, vector)."""
    use = []
    for i, label, x in data:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in x))
        if row not in use and sum(c * c for c in row[2]) < 1 << 62:
            use.append(row)
    out = []
    for i, label, v in use:
        if not anchor(i):
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in use if j != i]
        for minus, p, _ in sorted(s for s in score if s[2] == label)[:5]:
            band = sorted((s, j) for s, j, other in score if other != label and 80 * -minus <= 100 * -s <= 100 * -minus)
            out += [(i, p, k + 1, j, -minus, -s) for k, (s, j) in enumerate(band[:5])]
    return sorted(out, key=str)


def clustered(n, d, seed, spread=0.4, labels=3):
    r = np.random.default_rng(seed)
    c = r.normal(size=(labels + 2, d))
    return [(i, int(r.integers(labels)), (c[r.integers(len(c))] + spread * r.normal(size=d)).round(3).tolist()) for i in range(n)]


def as_table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_clustered_rows_in_small_blocks(llm_spark, monkeypatch, seed):
    """Several clusters, parts, blocks and shares; many anchors."""
    for name, value in (("MEMBERS", 5), ("BLOCK", 40), ("PART", 7), ("STEP", 9), ("SAMPLE", 30)):
        monkeypatch.setattr(hn, name, value)
    data = clustered(400, 6, seed)
    got = hn.hard_negatives(hn.prepared(as_table(llm_spark, data)), F.col("vec_id") % 5 == 0)
    assert rows(got) == brute(data, lambda i: i % 5 == 0) != []


def test_the_table(llm_spark):
    table = llm_spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    assert rows(hn.mined(table)) == brute(data)


def test_odd_rows(llm_spark):
    """Nulls anywhere, no components, zeros, other lengths, ties, copies, repeated rows and ids, large components."""
    inf, nan = float("inf"), float("nan")
    r = random.Random(3)
    data = [(100 * i, r.choice([0, 1, None]), [r.choice([0.0, 1.0, -0.5]) for _ in range(4)]) for i in range(12)]
    data += [(i, r.choice([0, 1]), [1.0, 0.0, 0.5, r.choice([0.0, 0.25])]) for i in range(1, 60)]
    data += [(i, i % 2, [1.0, 0.0, 0.5, 0.25]) for i in range(61, 90)] * 2
    data += [(200, 1, [1.0, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 4), (300, None, [1.0] * 4), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0]),
             (303, 1, [nan, 0.0, 0.0, 0.0]), (304, 1, [inf, 0.0, 0.0, 0.0]), (305, 0, []), (400, 0, [1.0, 0.5]), (401, 1, [1.0] * 6),
             (402, 1, [1e300, 0.0, 0.0, 0.0]), (500, 1, [2000000.0, 1.0, 0.0, 3.0]), (501, 1, [1999999.0, 1.5, 0.0, 3.0]),
             (502, 2, [1999998.0, 1.0, 0.25, 3.0]), (503, 2, [2000000.0, 0.99, 0.0, 3.0])]
    clash = as_table(llm_spark, data).withColumns({c: F.lit("x") for c in ("v", "k1", "node", "ids", "cluster", "score", "goals")})
    assert rows(hn.mined(clash)) == brute(data) != []
    assert hn.mined(clash.where("false")).collect() == []
    assert hn.mined(clash.where("vec_id % 100 <> 0")).collect() == []


def test_one_vector_holds_most_rows(llm_spark):
    data = [(i, i % 3, [0.5, 0.25, 1.0]) for i in range(600)] + clustered(200, 3, 5)[1:]
    data = [(1000 + 10 * k, label, x) for k, (_, label, x) in enumerate(data)]
    assert rows(hn.mined(as_table(llm_spark, data))) == brute(data) != []


def test_no_bound_is_below_a_product():
    r = np.random.default_rng(0)
    for scale in (1, 1000, 2**28):
        x = np.floor(r.normal(size=(500, 8)) * scale).astype(np.int64)
        x[:5] = 0
        c = hn.centroids(x[:100], 4)
        angle = hn.angles(x[:100], c)
        own = angle.argmin(axis=1)
        widest = np.array([angle[own == k, k].max(initial=0) for k in range(len(c))])
        bound = hn.bounds_of(x, c, widest).astype(float)
        score = hn.products(x[:100], x)
        assert (score == np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x[:50]] for u in x[:100]])[:, :50]).all() \
            if score.shape[1] == 50 else True
        length = hn.lengths(x[:100])
        assert (score <= length[:, None] * bound[:, own].T * (1 + 1e-9)).all()


def test_products_are_exact():
    r = np.random.default_rng(1)
    for top in (100, 1 << 20, 1 << 29):
        a, b = r.integers(-top, top, (20, 4)), r.integers(-top, top, (30, 4))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert hn.products(a, b).tolist() == want


def test_clear_structure_ends_walks_early(llm_spark, monkeypatch):
    """Where anchors lie close together, most of the list is never read."""
    monkeypatch.setattr(hn, "BLOCK", 300)
    read = []
    share = hn.Lists.share
    monkeypatch.setattr(hn.Lists, "share", lambda self, number, clusters: read.append(number) or share(self, number, clusters))
    r = np.random.default_rng(7)
    data = []
    for i in range(3000):
        near = i % 100 == 0 or i % 10 == 3
        x = np.array([1.0, 0, 0, 0]) if near else np.array([0, 1.0, 0, 0])
        data.append((i, int(r.integers(2)), (x + 0.02 * r.normal(size=4)).round(4).tolist()))
    assert rows(hn.mined(as_table(llm_spark, data))) == brute(data) != []
    assert max(read) < len(hn.SHARES) - 1
