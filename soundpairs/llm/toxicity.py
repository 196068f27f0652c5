"""Weakly supervised toxicity scores.

1. *Lexicon.* Words and word beginnings that mark toxic documents are mined from about ``LABELLED``
   labelled rows: document counts per class are summed in the executors, and the ``ENTRIES`` most
   useful ones are kept. A short list of common insults and a few patterns come on top.
2. *Voters.* Every stem of the lexicon votes "toxic" where it occurs; patterns vote too; one voter
   says "clean" where no entry occurs. All others abstain.
3. *Label model.* Expectation maximisation estimates each voter's rates given the hidden class. The label
   of a training row is one voter more, of accuracy ``GOLD``. Correlations that remain between voters
   given the class, of either sign, are estimated as well; a voter's log odds are divided by one plus their sum.
4. *Classifier.* A logistic regression on entry counts is trained on the posterior labels. Only it
   scores documents.

Null and empty texts get the score of a text without entries. Without labelled rows only insults and
patterns vote. Rows with null ids or null labels are never learned from; if a doc_id has several
labels, the largest holds.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundpairs.llm.common import about, byte_chunks, fold_of, texts, with_text
from soundpairs.llm.near_dup import WORDS
from soundpairs.llm.stars import shingles
from soundpairs.session import settled

FOLDS = 3
#: Labelled rows that the lexicon, the label model and the classifier are fitted on, about.
LABELLED = 40_000
ENTRIES = 512
#: Entries that share their first letters are one voter; beyond this many voters they share the last one.
STEM, VOTERS = 4, 64
THRESHOLD = 0.7
#: An entry must be in so many toxic documents of the sample at least, and in this share; near copies count once.
SUPPORT, SUPPORT_SHARE = 5, 0.01
#: One clean document with an entry weighs against so many toxic ones.
CLEAN_COST = 40
#: Accuracy the label model grants to the labels themselves.
GOLD = 0.97
INSULTS = ["idiot", "stupid", "moron", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "clown"]
_WORD = re.compile(r"[^\W\d_]+")
_AT_YOU = re.compile(r"\b(?:you|your|you're|youre)\b\W+(?:\w+\W+){0,3}?(?:" + "|".join(INSULTS) + r")\b", re.I)
_SHOUT = re.compile(r"[!?]{3,}")


@dataclass
class Lexicon:
    """Entries ``word`` (ends with a blank) or ``beginning``, each with its voter."""

    entries: list[str]
    voter: np.ndarray
    voters: int

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, e in enumerate(self.entries):
            found.add_word(e.rstrip(" "), (i, len(e.rstrip(" ")), e.endswith(" ")))
        found.make_automaton()
        return found


def lexicon(mined: list[str]) -> Lexicon:
    entries = list(dict.fromkeys([*mined, *(w + " " for w in INSULTS)]))
    # a word that is also a beginning in the list would hide it: the beginning says it all
    entries = [e for e in entries if not (e.endswith(" ") and e[:-1] in entries)]
    stems: dict[str, int] = {}
    for e in [*(w + " " for w in INSULTS), *entries]:
        stems.setdefault(e[:STEM], min(len(stems), VOTERS - 1))
    return Lexicon(entries, np.array([stems[e[:STEM]] for e in entries]), max(stems.values()) + 1)


#: Features after the voters': insult at "you", shouting marks, upper case, no entry at all.
PATTERNS = 4


def features(text: str, automaton, lex: Lexicon) -> np.ndarray:
    """Number of each voter's entries in the text, then the patterns."""
    k = lex.voters
    x = np.zeros(k + PATTERNS, np.float32)
    low = text.lower()
    n = len(low)
    for end, (i, size, word) in automaton.iter(low):
        start = end - size + 1
        if start and low[start - 1].isalpha() or word and end + 1 < n and low[end + 1].isalpha():
            continue
        x[lex.voter[i]] += 1
    x[k] = x[:k].any() and bool(_AT_YOU.search(text))
    x[k + 1] = "!!" in text and bool(_SHOUT.search(text))
    x[k + 2] = len(text) >= 20 and text.isupper()
    x[k + 3] = not x[:k].any()
    return x


def _tokens(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w + " " for w in words} | {w[:k] for w in words for k in (3, 4, 5, 6) if len(w) >= k}


def mine(sample: DataFrame) -> list[str]:
    """The most useful entries of labelled rows (text, toxic)."""
    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, mark in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                (toxic if mark else clean).update(_tokens(text))
        keys = list(toxic.keys() | clean.keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i:i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([toxic[k] for k in part]), pa.array([clean[k] for k in part])],
                ["entry", "toxic", "clean"])

    def copies(batches):
        for batch in batches:
            keys = [int(own[0]) if len(own) else 0
                    for _, at, raw in byte_chunks(batch.column(0)) for own in shingles(at, raw, WORDS)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.array(keys, np.uint64).view(np.int64))], ["text", "toxic", "copy"])

    rows = sample.select("text", "toxic")
    once = rows.where("toxic > 0").mapInArrow(copies, "text string, toxic int, copy long").dropDuplicates(["copy"])
    rows = once.drop("copy").unionByName(rows.where("toxic = 0"))
    use = F.col("toxic") - CLEAN_COST * F.col("clean")
    support = max(SUPPORT, int(SUPPORT_SHARE * sample.where("toxic > 0").count()))
    best = (
        rows.mapInArrow(run, "entry string, toxic long, clean long")
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= support) & (use > 0))
        .orderBy(use.desc(), F.length("entry").desc(), "entry").limit(4 * ENTRIES).collect())
    chosen: list[str] = []
    for r in best:
        e = r.entry.rstrip(" ")
        if len(chosen) < ENTRIES and not any(e.startswith(c.rstrip(" ")) or c.startswith(e) for c in chosen):
            chosen.append(r.entry)
    return chosen


def votes(x: np.ndarray, lex: Lexicon) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains; one column for each stem and pattern."""
    k = lex.voters
    return np.concatenate([x[:, :k + 3] > 0, -(x[:, k + 3:] > 0).astype(np.int8)], axis=1).astype(np.int8)


def label_model(v: np.ndarray, share: float, gold: np.ndarray | None = None, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, rates of each voter's speaking by class, correlations given the class).

    ``gold`` are labels, 1 or 0.
    """
    told = np.zeros(len(v)) if gold is None else np.log(GOLD / (1 - GOLD)) * (2.0 * gold - 1)
    spoke = (v != 0).astype(np.float64)
    tilt = v.sum(axis=1)
    prior = min(0.5, max(0.01, share))
    most = max(1.0, float(np.quantile(tilt, 1 - prior)))        # as many rows as the share says start as toxic
    post = np.where(tilt >= most, 0.9, np.where(tilt < 0, 0.05, prior))
    discount = np.ones(v.shape[1])
    rho = np.zeros((v.shape[1], v.shape[1]))
    rates = np.zeros((2, v.shape[1]))
    for turn in range(rounds):
        for c, w in ((1, post), (0, 1 - post)):
            rates[c] = (w @ spoke + 0.5) / (w.sum() + 10)
        if turn:                        # what voters still share once the class is known
            rho = np.zeros_like(rho)
            for c, w in ((1, post), (0, 1 - post)):
                d = (spoke - rates[c]) * np.sqrt(w)[:, None]
                cov = d.T @ d / max(w.sum(), 1.0)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                rho += 0.5 * np.minimum(np.abs(cov / np.outer(sd, sd)), 1)
            np.fill_diagonal(rho, 0)
            rho[rho < 0.1] = 0
            discount = 1 / (1 + rho.sum(axis=1))
        odds = told + np.log(prior / (1 - prior)) + (
            spoke * (np.log(rates[1]) - np.log(rates[0])) * discount
            + (1 - spoke) * (np.log1p(-rates[1]) - np.log1p(-rates[0])) * discount).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, rates, rho


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-5, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) by Newton steps on soft labels."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(a) + decay * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(a) + decay * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def damped(x: np.ndarray) -> np.ndarray:
    """One hit counts for most; more hits add little."""
    return np.minimum(np.log2(1 + x.astype(np.float64)), 2.0)


@dataclass
class Model:
    lex: Lexicon
    weights: np.ndarray


def trainable(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id, FOLDS) != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    marks = (
        labels.where(F.col("toxic").isNotNull() & trainable(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    n = marks.count()
    # about LABELLED ids and marks, whatever the input: less than a megabyte
    chosen = F.broadcast(about(marks, F.col("doc_id"), LABELLED, n))
    sample = settled(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"))
    lex = lexicon(mine(sample))
    k = lex.voters

    def run(batches):
        automaton = lex.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t, automaton, lex).tobytes() for t in texts(batch.column(0))], pa.binary()),
                 batch.column(1)], ["x", "toxic"])

    rows = sample.mapInArrow(run, "x binary, toxic int").collect()      # LABELLED rows, about
    if not rows:
        weights = np.concatenate([np.full(k, 4.0), [1.0, 0.5, 0.5, -1.0], [-2.0]])
        return Model(lex, weights)
    rows.sort(key=lambda r: (r.x, r.toxic))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    gold = np.array([r.toxic for r in rows], float)
    post, _, _ = label_model(votes(x, lex), float(gold.mean()), gold)
    return Model(lex, logistic(damped(x), post))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with score and predicted. Each row's score reads its text only."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "predicted int"])
    lex, weights = model.lex, model.weights
    rows, at = with_text(docs, keep)

    def run(batches):
        automaton, k = lex.automaton(), lex.voters
        for batch in batches:
            marks = [features(t, automaton, lex) for t in texts(batch.column(at))]
            x = np.stack(marks) if marks else np.zeros((0, k + PATTERNS), np.float32)
            p = 1 / (1 + np.exp(-np.clip(damped(x) @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(p, pa.float64()),
                 pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], [*keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, fit(docs, labels), ["doc_id"]).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 1, F.lit(True)).alias("held_out"), "score", "predicted")
