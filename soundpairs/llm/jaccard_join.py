"""Jaccard self-join of documents on word n-grams, by token-combination prefixes.

A document's set holds 64-bit hashes of its 3-word shingles, its tokens. Documents with equal sets are one node.
Two linked nodes have ``need(n)`` common tokens at least, so, in any one order of all tokens, the first
``n - need(n) + k`` tokens of each share ``k`` (an extended prefix).

1. *Sieve.* In the order of hashes, each set's first ``2 free + 1`` tokens are counted, where free = n - need(n). A node whose
   probe shares too few of them with any other probe has no partner. Nothing else is done with it.
2. *Order.* All tokens of the nodes that are left are counted over them; rare tokens come first.
3. *Prefixes.* If two linked sets share a token of at most ``RARE`` nodes, the first one they share is rare and lies in
   both plain prefixes (k = 1), so rare tokens of these are keys by themselves. Otherwise all that they share is
   frequent: frequent tokens are dealt into G classes by hash, prefixes are extended to k = G + 1, so some class holds
   two of the common ones, and pairs of tokens of one class are keys. G follows the size of the set, so a set has
   about as many keys as its plain prefix is long, and never all pairs of its tokens; a set near a bound of
   sizes has the keys of both sides.
4. *Verification.* Nodes that share a key meet in stars (see ``stars``) and are confirmed on their full sets, until every such pair
   is confirmed, refused, or already in one component. The filter loses no link.

Null and empty texts, and texts without words, have empty sets and are linked with nothing, nor are rows with a
null doc_id, whose component is null. Rows are told apart by doc_id and text, as in ``near_dup``; repeated rows have
equal results. Ties go to the smaller doc_id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundpairs.llm.common import byte_chunks, mix
from soundpairs.llm.near_dup import classes, keyed, set_nodes, texts_of
from soundpairs.llm.stars import linked, shingles
from soundpairs.session import settled

WORDS = 3
#: Documents are linked with percent * union <= 100 * intersection.
PERCENT = 90
#: A token of more nodes than this is frequent.
RARE = 16
#: Tokens of more than this share of all are joined by broadcast; there are at most as many as its inverse.
HOT = 1e-4
_ONE, _TWO = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)


def need(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares with any set it is linked with, at least."""
    return -(-percent * n // 100)


def free(n: int, percent: int = PERCENT) -> int:
    return n - need(n, percent)


def probe_need(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set's probe that another probe must have: the smallest partner's extension counts."""
    return free(need(n, percent), percent) + 1


def class_counts(n: int, percent: int = PERCENT) -> list[int]:
    """Numbers of classes that a set of n is indexed under: one for each power of two that a partner's size can be in."""
    powers = range(need(n, percent).bit_length() - 1, (100 * n // percent).bit_length())
    return sorted({max(1, (1 << b) * (100 - percent) // 80) for b in powers})


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, words, n, k1, k2, probe): text hash, size and digest of each set, and its probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, probes = [], [], []
            for _, at, raw in byte_chunks(batch.column(2)):
                for own in shingles(at, raw, WORDS):
                    n = len(own)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    spare = free(100 * n // percent, percent)           # none: only equal sets are linked
                    probes.append(own[:2 * free(n, percent) + 1].view(np.int64) if n and spare else None)
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.array(probes, pa.list_(pa.int64()))], ["doc_id", "words", "n", "k1", "k2", "probe"])

    return keyed(docs).mapInArrow(run, "doc_id long, words long, n long, k1 long, k2 long, probe array<long>")


def sieved(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n) of those nodes whose probe shares enough tokens with others' to have a partner."""
    tokens = nodes.where("probe is not null").select("node", F.explode("probe").alias("token"))
    alone = tokens.groupBy("token").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
    counts = alone.groupBy("node").agg(F.count("*").alias("alone"))
    return nodes.where("probe is not null").join(counts, "node", "left").where(
        F.expr(f"size(probe) - coalesce(alone, 0) >= {_probe_need_sql('n', percent)}")).select("node", "n")


def _probe_need_sql(n: str, percent: int) -> str:
    least = f"(({percent} * {n} + 99) div 100)"
    return f"({least} - ({percent} * {least} + 99) div 100 + 1)"


def tokens_of(texts: DataFrame) -> DataFrame:
    """(node, token) of all texts (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, at, raw in byte_chunks(batch.column(1)):
                sets = shingles(at, raw, WORDS)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(first, first + len(sets)), [len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(sets).view(np.int64))], ["node", "token"])

    return texts.select("node", "text").mapInArrow(run, "node long, token long")


def ordered_tokens(texts: DataFrame) -> DataFrame:
    """(node, tokens): its tokens that others have too, each as (number of nodes, token), rarest first.

    The few tokens that hold a fixed share of all rows are joined by broadcast, so none meets in one task.
    """
    each = tokens_of(texts)
    counts = settled(each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
    total = counts.agg(F.sum("k")).first()[0] or 0
    hot = F.col("k") > max(1.0, HOT * total)                                # 1 / HOT tokens at most
    marked = each.join(F.broadcast(counts.where(hot).withColumnRenamed("k", "k0")), "token", "left")
    found = marked.where("k0 is not null").select("node", F.struct(F.col("k0").alias("k"), "token").alias("t")).unionByName(
        marked.where("k0 is null").select("node", "token").join(counts.where(~hot), "token").select(
            "node", F.struct("k", "token").alias("t")))
    return found.groupBy("node").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def keys_of(n: int, k: np.ndarray, token: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> np.ndarray:
    """Keys of a set of n tokens, given those that others have too, in order, with their counts."""
    ahead = n - len(token)                                  # tokens that no other has come first
    plain = max(0, free(n, percent) + 1 - ahead)
    rare_ones = token[:plain][k[:plain] <= rare]
    out = [mix(rare_ones * _ONE + np.uint64(1))]
    for count in class_counts(n, percent):
        reach = max(0, free(n, percent) + 1 + count - ahead)
        often = token[:reach][k[:reach] > rare]
        if len(often) < 2:
            continue
        of = mix(often + _TWO) % np.uint64(count)
        order = np.lexsort((often, of))
        often, of = often[order], of[order]
        for step in range(1, len(often)):                   # each token with the step-th next of its class
            same = np.flatnonzero(of[step:] == of[:-step])
            if not len(same):
                break
            out.append(mix(mix(often[same] * _ONE + np.uint64(count)) + often[same + step] * _TWO))
    return np.unique(np.concatenate(out))


def keyed_nodes(nodes: DataFrame, ordered: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n, buckets) of nodes that have a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, found = [], [], []
            for i, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = own.values
                got = keys_of(n, own.field("k").to_numpy(), own.field("token").to_numpy().view(np.uint64), percent)
                if len(got):
                    node.append(i)
                    size.append(n)
                    found.append(got.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                                              pa.array(found, pa.list_(pa.int64()))], ["node", "n", "buckets"])

    return nodes.join(ordered, "node").select("node", "n", "tokens").mapInArrow(
        run, "node long, n long, buckets array<long>")


def jaccard_links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(node, component) of linked nodes, or None where no key is shared."""
    left = settled(sieved(nodes, percent))
    texts = settled(texts_of(docs, nodes)(left.select("node")))
    keys = settled(keyed_nodes(left, ordered_tokens(texts), percent))
    return linked(keys, lambda wanted: texts.join(wanted, "node", "left_semi"), percent, WORDS)


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sig = settled(signatures(docs, percent))
    nodes = set_nodes(sig)
    found = classes(nodes, jaccard_links(docs, nodes, percent))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sig.join(found, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
