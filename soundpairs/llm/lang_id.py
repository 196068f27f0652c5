"""Nearest-centroid language identification.

A text is a vector of counts of letter n-grams (3 bytes, lower-cased, everything but letters one
blank), hashed to ``DIM`` lanes, damped, weighted by inverse document frequency and normalised.
Each language has several centroids: spherical k-means over its vectors. A text gets the language
of the centroid with the largest cosine. It is rejected if that cosine is far below what texts of
its length reach in the sample the centroids were fitted on.

Document frequencies count every training document. Centroids and rejection bounds are fitted on
about ``SAMPLE`` documents per language.

Null texts and texts without a letter are ``und`` with score 0, and count as rejected. Ties go to the
language that sorts first. With nothing to learn from, every text is ``und``. Null ids are never
learned from and count as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundpairs.llm.common import byte_chunks, fold_of, with_text

DIM = 4096
CENTROIDS = 4
SAMPLE = 400
ROUNDS = 8
FOLDS = 5
#: A text is rejected below this share of the cosine that nearly all sampled texts of its length reach.
REJECT = 0.6
#: Texts with fewer n-grams say too little to be rejected.
LEAST_GRAMS = 64
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def counts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram counts, whether the text has letters) of runs of rows."""
    for first, at, raw in byte_chunks(column):
        rows = len(at) - 1
        row = np.repeat(np.arange(rows), np.diff(at))
        b = _FOLD[raw]
        lettered = np.bincount(row[_LETTER[raw]], minlength=rows) > 0
        for i in np.flatnonzero(~lettered & (np.bincount(row[raw >= 128], minlength=rows) > 0)):
            lettered[i] = any(c.isalpha() for c in raw[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
        if len(raw) >= 3:
            gram = (b[:-2] * 65536 + b[1:-1] * 256 + b[2:]) * np.uint32(0x9E3779B1)
            whole = (row[2:] == row[:-2]) & ~((b[1:-1] == 32) & ((b[:-2] == 32) | (b[2:] == 32)))
            lane = (gram >> np.uint32(20)).astype(np.int64) + row[2:] * DIM
            counts = np.bincount(lane[whole], minlength=rows * DIM).reshape(rows, DIM)
        else:
            counts = np.zeros((rows, DIM), np.int64)
        yield first, counts, lettered


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray       # (rows, DIM)
    langs: list[str]            # of each centroid, ascending
    bounds: np.ndarray          # least cosine by floor(log2(number of n-grams))

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return vectors(counts, self.idf)

    def classify(self, counts: np.ndarray, lettered: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each row of counts."""
        if not self.langs:
            n = len(counts)
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        cosine = np.clip((self.vectors(counts) @ self.centroids.T).astype(np.float64), 0.0, 1.0)
        best = np.argmax(cosine, axis=1)
        score = np.where(lettered, cosine[np.arange(len(best)), best], 0.0)
        rejected = ~lettered | (score < self.bounds[_length_class(counts)])
        return [self.langs[i] if ok else UNKNOWN for i, ok in zip(best, lettered)], score, rejected


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(31, np.log2(np.maximum(1, counts.sum(axis=1))).astype(int))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit length. Starts from rows that are far from those taken before."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[chosen[0]]
    for _ in range(k - 1):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(k)])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def document_frequency(train: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all training texts have each lane, and their number; summed in the executors."""
    def run(batches):
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, counts, _ in counts_of(batch.column(0)):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *total[at].tolist()], pa.int64())], ["lane", "n"])

    sums = train.select("text").mapInArrow(run, "lane int, n long").groupBy("lane").agg(F.sum("n").alias("n"))
    found = {r.lane: r.n for r in sums.collect()}           # DIM + 1 rows at most
    df = np.zeros(DIM)
    for lane, n in found.items():
        if lane >= 0:
            df[lane] = n
    return df, found.get(-1, 0)


def fit(docs: DataFrame, train: Column) -> Model:
    """Learns from text and lang of the rows for which ``train`` holds."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    per_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    df, n = document_frequency(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not per_lang:
        return Model(idf, np.zeros((0, DIM), np.float32), [], np.zeros(32))
    pick = F.lit(False)
    for lang, count in per_lang.items():
        cut = (1 << 30) if count <= SAMPLE else int((1 << 30) * SAMPLE / count)
        pick = pick | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < cut))

    def run(batches):
        for batch in batches:
            for first, counts, lettered in counts_of(batch.column(0)):
                keep = np.flatnonzero(lettered)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(keep + first)),
                     pa.array([np.minimum(counts[i], 65535).astype("<u2").tobytes() for i in keep], pa.binary())],
                    ["lang", "counts"])

    sample = rows.where(pick).select("text", "lang").mapInArrow(run, "lang string, counts binary").collect()
    by_lang: dict[str, list] = {}
    for r in sample:
        by_lang.setdefault(r.lang, []).append(np.frombuffer(r.counts, "<u2"))
    centroids, langs, least = [], [], np.full(32, np.inf)
    for lang in sorted(by_lang):
        counts = np.stack(sorted(by_lang[lang], key=lambda c: c.tobytes()))
        x = vectors(counts, idf)
        c = spherical_kmeans(x, CENTROIDS)
        centroids.append(c)
        langs += [lang] * len(c)
        cosine, size = (x @ c.T).max(axis=1), _length_class(counts)
        for s in np.unique(size):
            least[s] = min(least[s], np.quantile(cosine[size == s], 0.005))
    for s in range(30, -1, -1):         # shorter texts can't be asked for more than longer ones
        least[s] = min(least[s], least[s + 1])
    known = least[np.isfinite(least)]
    least = np.where(np.isfinite(least), least, known.max() if len(known) else 0.0)
    for s in range(int(np.argmax(np.isfinite(least)))):
        least[s] = 0.0
    bounds = REJECT * least
    bounds[:LEAST_GRAMS.bit_length() - 1] = 0.0
    return Model(idf, np.concatenate(centroids).astype(np.float32), langs, bounds)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with lang_pred, score and rejected. Each row's prediction reads its text only."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["lang_pred string", "score double", "rejected boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = with_text(docs, keep)

    def run(batches):
        model = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for _, counts, lettered in counts_of(batch.column(at)):
                a, b, c = model.classify(counts, lettered)
                langs += a
                scores += b.tolist()
                rejected += c.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id, FOLDS) == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    model = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
