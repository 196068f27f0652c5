"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from soundpairs.session import settled


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v) but the least of each component.

    Every round hangs neighbours on the least one they know, until a round changes nothing (count and
    combined hash of its edges are watched as they are written). Minima are aggregated before the
    shuffle and joined back, so a node with very many neighbours is no task of its own.
    """
    edges, before = _written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        edges, after = _written(small)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    seen = Observation()
    done = settled(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")))
    return done, (seen.get["n"], seen.get["h"])
