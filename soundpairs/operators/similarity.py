"""Similarity over embedding columns: scores, nearest neighbours, caption evidence.

Vectors meet in blocks of bounded size. A block pair is one small matrix product inside a
task, and only its best ``k`` per query leave the task, so no pair list is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soundpairs.operators.common import top_k
from soundpairs.session import settled

QUERY_BLOCK = 2048         # rows of one query block; also the most that is ever broadcast
CORPUS_BLOCK = 32_768      # rows of one corpus block
STRIPE = 1024              # corpus rows per matrix product
SCORE_BLOCK = 1024         # rows a side of a score block: a block is emitted whole
BUCKET_ROWS = 32           # corpus rows of one hash bucket, about
PROBE_SCALE = 1 << 20      # hash planes see components as whole numbers of this many parts
TIE_DIGITS = 9             # sums differ in the last bits between blocks; equal to here is a tie
TIE = 2 * 10.0 ** -TIE_DIGITS   # sums further apart than this are no tie
NONE = -2.0                # below every similarity



def _hit(ids: DataFrame) -> str:
    kind = ids.schema["id"].dataType.simpleString()
    return f"query_id {kind}, neighbor_id {kind}, sim double"


def _ids(values) -> np.ndarray:
    """Ids as an array that sorts: whole numbers, or text."""
    values = np.asarray(values)
    return values.astype(str) if values.dtype == object else values


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _sims(queries: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    return np.round(np.clip(queries @ corpus.T, -1.0, 1.0), TIE_DIGITS)


class _Best:
    """Best k per query so far: similarity first, then the smaller id.

    A query's k-th best so far bounds what may still enter, so of a product all but a few cells are
    passed over by one comparison; only those that may enter are rounded and ordered.
    """

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.units, self.k, self.exclude = ids, units, k, exclude_self
        self.by_id = np.argsort(ids, kind="stable")
        self.row, self.sim = np.empty(0, dtype=np.int64), np.empty(0)
        self.nid = np.empty(0, dtype=ids.dtype)
        self.bound = np.full(len(ids), NONE)

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        for at in range(0, len(ids), STRIPE):
            part = ids[at:at + STRIPE]
            with np.errstate(invalid="ignore"):
                sim = self.units @ units[at:at + STRIPE].T
            if self.exclude:
                self._exclude(sim, part)
            bound, short = self.bound.copy(), np.nonzero(self.bound == NONE)[0]
            if len(short) and len(part) > self.k:               # with fewer than k so far, the stripe's own k-th best
                own = sim[short]
                own[np.isnan(own)] = -np.inf
                bound[short] = np.maximum(NONE, np.partition(own, -self.k, axis=1)[:, -self.k] - TIE)
            row, column = np.nonzero(sim >= bound[:, None])     # a zero vector is near nothing: NaN is never taken
            if len(row):
                self._keep(row, part[column], np.round(np.clip(sim[row, column], -1.0, 1.0), TIE_DIGITS))

    def _exclude(self, sim: np.ndarray, part: np.ndarray) -> None:
        known = self.ids[self.by_id]
        first, last = np.searchsorted(known, part, "left"), np.searchsorted(known, part, "right")
        for column in np.nonzero(last > first)[0]:
            sim[self.by_id[first[column]:last[column]], column] = -np.inf

    def _keep(self, row: np.ndarray, nid: np.ndarray, sim: np.ndarray) -> None:
        row, nid, sim = (np.concatenate(x) for x in ((self.row, row), (self.nid, nid), (self.sim, sim)))
        order = np.lexsort((nid, -sim, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[place < self.k]
        self.nid, self.sim, self.row = nid[order], sim[order], row[place < self.k]
        full = place == self.k - 1
        self.bound[row[full]] = self.sim[place[place < self.k] == self.k - 1] - TIE

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.row], "neighbor_id": self.nid, "sim": self.sim})


def _vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Ids stay text where they are text; all numbers are long."""
    kind = "string" if isinstance(df.schema[key].dataType, T.StringType) else "long"
    return df.select(F.col(key).cast(kind).alias("id"), F.col(vec).alias("vec")).where(
        "id is not null and vec is not null")


def _small(df: DataFrame, bound: int) -> pd.DataFrame | None:
    """The rows of ``df`` if there are at most ``bound``, else None."""
    rows = df.limit(bound + 1).toPandas()
    return rows if len(rows) <= bound else None


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _all(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _grid(queries: DataFrame, corpus: DataFrame, query_block: int, corpus_block: int):
    """Every query block beside every corpus block, as a cogroup on the cell (r, c)."""
    r = max(1, -(-queries.count() // query_block))
    c = max(1, -(-corpus.count() // corpus_block))
    left = queries.withColumns({"r": _block(F.col("id"), r)}).withColumn("c", _all(c))
    right = corpus.withColumns({"c": _block(F.col("id"), c)}).withColumn("r", _all(r))
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c"))


def _cell_best(k: int, exclude_self: bool) -> Callable:
    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": q["id"][:0], "neighbor_id": c["id"][:0], "sim": np.empty(0)})
        best = _Best(_ids(q["id"]), _unit(q["vec"]), k, exclude_self)
        best.add(_ids(c["id"]), _unit(c["vec"]))
        return best.rows()
    return cell


def _final(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, ["query_id"], [F.desc("sim"), F.asc("neighbor_id")], k)


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "audio_id",
    corpus_id: str = "audio_id", vec: str = "embedding", exclude_self: bool = True,
    max_broadcast: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact k nearest by cosine, ties by id: query_id, neighbor_id, sim, rank.

    Few queries (counted) travel to the corpus, which is scanned where it lies; more are laid
    out in a grid of bounded blocks. Either way a task sends k rows per query.
    """
    q, c = _vectors(queries, query_id, vec), _vectors(corpus, corpus_id, vec)
    few = _small(q, max_broadcast)
    if few is None:
        return _final(_grid(q, c, QUERY_BLOCK, CORPUS_BLOCK).applyInPandas(
            _cell_best(k, exclude_self), _hit(q)), k)
    if few.empty:
        return _final(c.sparkSession.createDataFrame([], _hit(q)), k)
    sent = c.sparkSession.sparkContext.broadcast(
        (_ids(few["id"]), _unit(few["vec"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(*sent.value, k, exclude_self)
        for batch in batches:
            if len(batch):
                best.add(_ids(batch["id"]), _unit(batch["vec"]))
        yield best.rows()

    return _final(c.mapInPandas(scan, _hit(q)), k)


def attach(hits: DataFrame, corpus: DataFrame, corpus_id: str = "audio_id",
           meta: list[str] | None = None, version: str | None = None) -> DataFrame:
    """Add the neighbour's meta columns and the model version to nearest rows."""
    kept = meta if meta is not None else [c for c in corpus.columns if c not in (corpus_id, "embedding")]
    facts = corpus.select(F.col(corpus_id).cast(hits.schema["neighbor_id"].dataType).alias("neighbor_id"), *kept)
    out = hits.join(facts, "neighbor_id", "left")
    return out.withColumn("version", F.lit(version)) if version is not None else out


def score(
    audio: DataFrame, prompts: DataFrame, audio_id: str = "audio_id", prompt_id: str = "prompt_id",
    vec: str = "embedding", max_broadcast: int = QUERY_BLOCK,
) -> DataFrame:
    """Cosine of every audio to every prompt: audio_id, prompt_id, sim.

    The full product is the answer here. Prompts of a counted size go to the audio scan;
    a larger set is laid out in blocks.
    """
    a, p = _vectors(audio, audio_id, vec), _vectors(prompts, prompt_id, vec)
    kinds = [x.schema["id"].dataType.simpleString() for x in (a, p)]
    shape = f"audio_id {kinds[0]}, prompt_id {kinds[1]}, sim double"

    def table(aid: np.ndarray, av: np.ndarray, pid: np.ndarray, pv: np.ndarray) -> pd.DataFrame:
        sims = _sims(av, pv)
        return pd.DataFrame({"audio_id": np.repeat(aid, len(pid)),
                             "prompt_id": np.tile(pid, len(aid)), "sim": sims.ravel()})

    few = _small(p, max_broadcast)
    if few is None:
        def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if x.empty or y.empty:
                return table(x["id"][:0], np.empty((0, 1)), y["id"][:0], np.empty((0, 1)))
            return table(x["id"].to_numpy(), _unit(x["vec"]), y["id"].to_numpy(), _unit(y["vec"]))
        return _grid(a, p, SCORE_BLOCK, SCORE_BLOCK).applyInPandas(cell, shape)
    if few.empty:
        return a.sparkSession.createDataFrame([], shape)
    sent = a.sparkSession.sparkContext.broadcast((few["id"].to_numpy(), _unit(few["vec"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, pv = sent.value
        for batch in batches:
            for at in range(0, len(batch), SCORE_BLOCK // 2):
                part = batch.iloc[at:at + SCORE_BLOCK // 2]
                yield table(part["id"].to_numpy(), _unit(part["vec"]), pid, pv)

    return a.mapInPandas(scan, shape)


def caption_evidence(
    audio: DataFrame, captioned: DataFrame, k: int = 5, audio_id: str = "audio_id",
    vec: str = "embedding", caption: str = "caption",
) -> DataFrame:
    """The k nearest captioned clips of each audio, and the nearest one's text as caption.

    Only k rows per audio carry text. Columns: audio_id, neighbor_id, sim, rank, evidence,
    caption.
    """
    near = nearest(audio, captioned, k, audio_id, audio_id, vec)
    with_text = attach(near, captioned, audio_id, [caption]).withColumnRenamed(caption, "evidence")
    best = F.when(F.col("rank") == 1, F.col("evidence"))
    return with_text.select(
        F.col("query_id").alias("audio_id"), "neighbor_id", "sim", "rank", "evidence",
        best.alias("caption"),
    )


def _signatures(df: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Rows (id, vec, t, bucket): sign patterns under fixed random hyperplanes."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vec"]])
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], tables * bits))
            on = (m @ planes >= 0).reshape(len(m), tables, bits)
            code = on.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
            yield pd.DataFrame({"id": batch["id"], "vec": batch["vec"], "buckets": list(code)})

    vec_type = df.schema["vec"].dataType.simpleString()
    kind = df.schema["id"].dataType.simpleString()
    made = df.mapInPandas(sign, f"id {kind}, vec {vec_type}, buckets array<long>")
    return made.select("id", "vec", F.posexplode("buckets").alias("t", "bucket"))


def nearest_approx(
    queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "audio_id",
    corpus_id: str = "audio_id", vec: str = "embedding", tables: int = 8, bits: int = 6,
    seed: int = 7, exclude_self: bool = True, complete: bool = False,
) -> DataFrame:
    """k nearest among vectors sharing a hash bucket in some table, ranked by exact cosine.

    A bucket however full is cut into blocks of bounded size on both sides. Recall depends on
    tables and bits: a query may be left with fewer than k rows. ``complete`` answers those
    exactly, against the whole corpus.
    """
    q, c = _vectors(queries, query_id, vec), _vectors(corpus, corpus_id, vec)
    qs, cs = _signatures(q, tables, bits, seed), _signatures(c, tables, bits, seed)

    # at most tables * 2^bits rows, whatever the data
    def sizes(df: DataFrame, block: int, name: str) -> DataFrame:
        return df.groupBy("t", "bucket").agg(
            F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    if tables * 2 ** bits > 1_000_000:
        raise ValueError("too many buckets: lower tables or bits")
    cut = F.broadcast(sizes(qs, QUERY_BLOCK, "r_n").join(sizes(cs, CORPUS_BLOCK, "c_n"),
                                                         ["t", "bucket"]))
    left = (qs.join(cut, ["t", "bucket"])
            .withColumn("r", F.pmod(F.xxhash64("id"), F.col("r_n")).cast("int"))
            .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("c_n") - 1))))
    right = (cs.join(cut, ["t", "bucket"])
             .withColumn("c", F.pmod(F.xxhash64("id"), F.col("c_n")).cast("int"))
             .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r_n") - 1))))
    cell = ["t", "bucket", "r", "c"]
    hits = (left.select("id", "vec", *cell).groupBy(*cell)
            .cogroup(right.select("id", "vec", *cell).groupBy(*cell))
            .applyInPandas(_cell_best(k, exclude_self), _hit(q)))
    near = _final(hits.groupBy("query_id", "neighbor_id").agg(F.max("sim").alias("sim")), k)
    if not complete:
        return near
    near = settled(near)
    served = near.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = q.join(served.where(F.col("n") >= k), "id", "left_anti")
    rest = nearest(short, c, k, "id", "id", "vec", exclude_self)
    enough = near.join(served.where(F.col("n") >= k).select(F.col("id").alias("query_id")),
                       "query_id", "left_semi")
    return enough.unionByName(rest)


def probe_bits(rows: int) -> int:
    """Bits of a bucket number, so that a bucket of a corpus of ``rows`` holds about ``BUCKET_ROWS``."""
    return max(4, (rows // BUCKET_ROWS).bit_length())


def integer_planes(count: int, d: int) -> np.ndarray:
    """``count`` fixed hyperplanes of whole numbers, from a formula that other engines can repeat."""
    x = np.arange(count, dtype=np.int64)[:, None] * d + np.arange(1, d + 1)
    x = x * 2_654_435_761 % 4_294_967_296 * 48_271 % 2_147_483_647
    return x * x % 2_147_483_647 % 2001 - 1000


def _probed(df: DataFrame, tables: int, bits: int, flips: int) -> DataFrame:
    """Rows (id, vec, t, bucket): of each table the vector's own bucket and those of its ``flips`` least certain bits."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = np.floor(np.stack([np.asarray(v, np.float64) for v in batch["vec"]]) * PROBE_SCALE)
            margin = (m @ integer_planes(tables * bits, m.shape[1]).T).reshape(len(m), tables, bits)
            code = ((margin >= 0) << np.arange(bits)).sum(axis=2)
            doubtful = np.argsort(np.abs(margin), axis=2, kind="stable")[:, :, :flips]
            mask = np.zeros((len(m), tables, 1), np.int64)
            for i in range(doubtful.shape[2]):              # every subset of them, nearest buckets first
                mask = np.concatenate([mask, mask | (1 << doubtful[:, :, i:i + 1])], axis=2)
            yield pd.DataFrame({"id": batch["id"], "vec": batch["vec"], "buckets": [
                [t.tolist() for t in row] for row in code[:, :, None] ^ mask]})

    vec_type = df.schema["vec"].dataType.simpleString()
    kind = df.schema["id"].dataType.simpleString()
    made = df.mapInPandas(place, f"id {kind}, vec {vec_type}, buckets array<array<bigint>>")
    return made.select("id", "vec", F.posexplode("buckets").alias("t", "_b")).select(
        "id", "vec", "t", F.explode("_b").alias("bucket"))


def nearest_probed(
    queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "audio_id",
    corpus_id: str = "audio_id", vec: str = "embedding", tables: int = 8, flips: int = 3,
    exclude_self: bool = True,
) -> DataFrame:
    """k nearest among vectors in the buckets that a query probes, ranked by exact cosine.

    A bucket is the side of every one of a table's hyperplanes that a vector lies on; there are more planes, and so
    more buckets, the larger the corpus is. A query looks into its own bucket of each table and into those behind the ``flips`` planes
    that it lies nearest to, in any combination. Signs are taken on whole numbers (components times ``PROBE_SCALE``, rounded
    down), so they are the same wherever they are computed. A bucket however full is cut into blocks on both sides. A
    query has fewer than ``k`` rows where its buckets hold fewer.
    """
    q, c = _vectors(queries, query_id, vec), _vectors(corpus, corpus_id, vec)
    bits = probe_bits(c.count())
    qs, cs = _probed(q, tables, bits, flips), _probed(c, tables, bits, 0)

    def sizes(df: DataFrame, block: int, name: str) -> DataFrame:
        return df.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    cut = settled(sizes(qs, QUERY_BLOCK, "r_n").join(sizes(cs, CORPUS_BLOCK, "c_n"), ["t", "bucket"]))
    cell = ["t", "bucket", "r", "c"]
    left = (qs.join(cut, ["t", "bucket"])
            .withColumn("r", F.pmod(F.xxhash64("id"), F.col("r_n")).cast("int"))
            .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("c_n") - 1))))
    right = (cs.join(cut, ["t", "bucket"])
             .withColumn("c", F.pmod(F.xxhash64("id"), F.col("c_n")).cast("int"))
             .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r_n") - 1))))
    hits = (left.select("id", "vec", *cell).groupBy(*cell)
            .cogroup(right.select("id", "vec", *cell).groupBy(*cell))
            .applyInPandas(_cell_best(k, exclude_self), _hit(q)))
    return _final(hits.groupBy("query_id", "neighbor_id").agg(F.max("sim").alias("sim")), k)


def embed(df: DataFrame, column: str, model_factory: Callable[[], Callable],
          out: str = "embedding") -> DataFrame:
    """Apply a user's model to a column; the model is loaded once per task.

    ``model_factory()`` returns a function from a list of values to a list of vectors.
    """
    shape = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for batch in batches:
            vectors = model(batch[column].tolist())
            yield batch.assign(**{out: [np.asarray(v, dtype=np.float32) for v in vectors]})

    return df.mapInPandas(apply, shape)
