"""Removal of byte strings that occur more than once, decided by suffix arrays.

A string of ``SPAN`` bytes that starts at two places is removed at both. Strings never cross
documents, and are judged on the input.

1. *Owners.* Of the ``GRAM``-byte runs inside a span, the one with the least hash owns it, the first
   among equals. Equal spans have equal owners, whatever surrounds them. Neighbouring spans mostly share
   their owner, so a document falls into segments: the spans of one owner, some 85 starts on average.
2. *Candidates.* Only segments whose owner's hash occurs again anywhere can hold a repeated span. Equal
   segments are counted and kept once.
3. *Suffix arrays.* Segments are dealt by their owner's hash, so equal spans meet in one shard. Spans whose own
   hash is alone there are left out. What remains is sorted by induced sorting, and the permuted common prefixes tell
   which spans are equal.
4. *Removal.* What holds for a segment goes back to all its copies; spans join per document, and the
   covered bytes go.

An owner with very many different segments (a passage that a large share of all documents borrows, with
other text around it) is first cut down to those spans whose own hash occurs again; the copies of the
passage then are equal segments again. Where borrowers have copies of their own, all that is theirs occurs
again as well: an owner that is still crowded is cut again, by the least hash of the longer runs of ``CUTS``
in each span, which equal spans share too. The last of these is the span itself, so no shard grows with the
number of borrowers.

Null and empty texts have no bytes. Repeated rows are copies like any others, and each is returned. Rows
are told apart by doc_id and text, so a repeated or null doc_id does no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundpairs.llm.common import body_hashes, byte_chunks, mix
from soundpairs.llm.suffix_array import permuted_lcp, suffix_array
from soundpairs.session import settled

SPAN = 200
GRAM = 32
#: Bytes of a shard, about.
SHARD_BYTES = 400_000
#: Different segments of one owner (some 6 MB, the largest shard) beyond which it is cut down by the hashes of
#: its spans.
CROWD = 20_000
#: Lengths of the runs that cut an owner which is still crowded, one after the other.
CUTS = (116, SPAN)
_PLACE = np.uint64((1 << 21) - 1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position."""
    n = len(raw) - GRAM + 1
    windows = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    words = np.ascontiguousarray(windows).view("<u8").ravel()
    words = words ^ (words >> np.uint64(29))
    words *= _ODD[0]
    words ^= words >> np.uint64(32)
    h = words[:n] * _ODD[0]
    for i in range(1, GRAM // 8):
        h += words[8 * i:8 * i + n] * _ODD[i]
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i."""
    m, w = x, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:len(x) - width + 1], m[width - w:]) if w < width else m


def segments(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start in the row, number of starts, owner's hash) of all segments of a run of rows."""
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none.astype(np.uint64))]
    size = np.diff(at)
    block = int(_PLACE) // 2
    # (row, from, to): spans that start there; rows in one block are handled together
    if len(raw) <= block:
        jobs = [(0, 0, len(raw))]
    else:
        jobs = [(r, lo, min(lo + block, int(n))) for r, n in enumerate(size) for lo in range(0, int(n), block)]
    for r, lo, hi in jobs:
        together = len(raw) <= block
        part = raw if together else raw[at[r] + lo:min(at[r] + hi + SPAN - 1, at[r + 1])]
        starts = len(part) - SPAN + 1
        if starts <= 0:
            continue
        h = gram_hashes(part)
        place = np.arange(len(h), dtype=np.uint64)
        own = sliding_min((h & ~_PLACE) | place, SPAN - GRAM + 1)
        if together:
            row = np.repeat(np.arange(len(size)), size)
            row_of, inside = row[:starts], row[:starts] == row[SPAN - 1:]
        else:
            row_of, inside = np.full(starts, r), np.ones(starts, bool)
        change = np.ones(starts, bool)
        change[1:] = (own[1:] != own[:-1]) | (row_of[1:] != row_of[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, starts))
        good = inside[first]
        first, count = first[good], count[good]
        owner = h[(own[first] & _PLACE).astype(np.int64)]
        base = at[row_of[first]] if together else np.full(len(first), -lo)
        found.append((row_of[first], first - base, count, owner))
    return tuple(np.concatenate(x) for x in zip(*found))


def row_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(
        "_text", F.xxhash64("text"))


def find_segments(docs: DataFrame, owners_only: bool) -> DataFrame:
    """Segments (owner, body, _doc, _text, place) of all documents; place is start * 2^16 + starts."""
    schema = "owner long" if owners_only else "owner long, body long, _doc long, _text long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, at, raw in byte_chunks(batch.column(0), rows=1 << 30):
                row, start, count, owner = segments(at, raw)
                owner = pa.array(owner.view(np.int64))
                if owners_only:
                    yield pa.RecordBatch.from_arrays([owner], ["owner"])
                    continue
                lo = at[row] + start
                body = body_hashes(raw, lo, lo + count + SPAN - 1)
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [owner, pa.array(body.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take),
                     pa.array(start * 65536 + count)], ["owner", "body", "_doc", "_text", "place"])

    if owners_only:
        return docs.select("text").mapInArrow(run, schema)
    return row_key(docs).select("text", "_doc", "_text").mapInArrow(run, schema)


def texts_by_row(docs: DataFrame) -> DataFrame:
    return row_key(docs).select("_doc", "_text", "text")


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of ``wanted`` segments (owner, body, n, _doc, _text, place), each read from one document."""
    per_row = wanted.groupBy("_doc", "_text").agg(F.collect_list(F.struct("owner", "body", "n", "place")).alias("_wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            size = 0
            for text, rows in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for w in rows.as_py():
                    start, count = w["place"] >> 16, w["place"] & 65535
                    for o, x in zip(out, (w["owner"], w["body"], w["n"], count, raw[start:start + count + SPAN - 1])):
                        o.append(x)
                    size += count + SPAN
                if size > 4_000_000:
                    yield _fetched(out)
                    out, size = ([], [], [], [], []), 0
            yield _fetched(out)

    return texts_by_row(docs).join(per_row, ["_doc", "_text"]).select("text", "_wanted").mapInArrow(
        run, "owner long, body long, n long, count int, bytes binary")


def _fetched(out) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(o, k) for o, k in zip(out, kinds)], ["owner", "body", "n", "count", "bytes"])


def runs_of(good: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of ``good`` places that lie in one segment."""
    edge = np.ones(len(good), bool)
    edge[1:] = (good[1:] != good[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(edge)
    end = np.append(first[1:], len(good))
    return first[good[first]], end[good[first]]


def repeated_starts(bodies: list[bytes], counts: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of runs of starts whose span occurs more than once, by suffix array.

    Spans whose hash nothing else has are left out before, and equal runs of what remains are sorted once.
    """
    text = np.frombuffer(b"".join(bodies), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    segment = np.repeat(np.arange(len(bodies)), counts)
    start = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts) + at[segment]
    _, same = np.unique(body_hashes(text, start, start + SPAN), return_inverse=True)
    first, end = runs_of(np.bincount(same, weights=copies[segment])[same] > 1, segment)
    lo, hi = start[first], start[end - 1] + SPAN
    of = segment[first]
    _, sample, part = np.unique(body_hashes(text, lo, hi), return_index=True, return_inverse=True)
    own, lo_of, hi_of = repeated_parts([text[a:b] for a, b in zip(lo[sample], hi[sample])],
                                       np.bincount(part, weights=copies[of], minlength=len(sample)))
    # back to every place that a part was found at
    size = np.bincount(own, minlength=len(sample))
    count = size[part]
    run = np.repeat((np.cumsum(size) - size)[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    seg, shift = np.repeat(of, count), np.repeat(lo - at[of], count)
    return seg, shift + lo_of[run], shift + hi_of[run]


def repeated_parts(parts: list[np.ndarray], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to) of the runs of starts of different ``parts`` whose span occurs again, in order of parts."""
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    text = np.concatenate(parts)
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa, 1024, starts=at[:-1])
    group = np.cumsum(lcp[sa] < SPAN)                     # suffixes of a group share their span
    of = np.empty(len(text), np.int64)
    of[sa] = group
    counts = np.diff(at) - SPAN + 1
    part = np.repeat(np.arange(len(parts)), counts)
    start = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts) + at[part]
    times = np.bincount(of[start], weights=copies[part])
    first, end = runs_of(times[of[start]] > 1, part)
    lo = start[first] - at[part[first]]
    return part[first], lo, lo + end - first


def judge(fetched: DataFrame, shards: int) -> DataFrame:
    """(owner, body, lo, hi): starts lo..hi-1 of the segment have a span that occurs again."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("owner", "ascending"), ("body", "ascending")])
        owner, body = group["owner"].to_numpy(), group["body"].to_numpy()
        once = np.ones(len(owner), bool)            # a row that is repeated fetches its segments again
        once[1:] = (owner[1:] != owner[:-1]) | (body[1:] != body[:-1])
        group, owner, body = group.filter(pa.array(once)), owner[once], body[once]
        seg, lo, hi = repeated_starts(group["bytes"].to_pylist(), group["count"].to_numpy().astype(np.int64),
                                      group["n"].to_numpy())
        return pa.table({"owner": owner[seg], "body": body[seg], "lo": lo, "hi": hi})

    return fetched.withColumn("_shard", F.pmod(F.xxhash64("owner"), F.lit(shards))).groupBy("_shard").applyInArrow(
        run, "owner long, body long, lo long, hi long")


def thinned(docs: DataFrame, cand: DataFrame, wanted: DataFrame, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of crowded owners, cut down to the spans whose own hash occurs again.

    Gives their candidates, and their distinct segments with the bytes.
    """
    bodies = settled(fetch(docs, wanted.join(crowds, "owner", "left_semi")))

    def starts(batches):
        for batch in batches:
            for owner, body, n, raw in zip(*[batch.column(i) for i in range(4)]):
                b = np.frombuffer(raw.as_py(), np.uint8)
                at = np.arange(len(b) - SPAN + 1)
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([owner.as_py()] * k), pa.array([body.as_py()] * k), pa.array([n.as_py()] * k),
                     pa.array(at), pa.array(body_hashes(b, at, at + SPAN).view(np.int64))],
                    ["owner", "body", "n", "at", "span"])

    each = bodies.select("owner", "body", "n", "bytes").mapInArrow(
        starts, "owner long, body long, n long, at long, span long")
    again = each.groupBy("owner", "span").agg(F.sum("n").alias("_n")).where("_n > 1").select("owner", "span")
    left = each.join(again, ["owner", "span"], "left_semi").groupBy("owner", "body").agg(F.collect_set("at").alias("_at"))

    def trim(batches):
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for owner, body, n, raw, at in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                at = np.sort(np.array(at, np.int64))
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                b = np.frombuffer(raw, np.uint8)
                for run in np.split(at, cuts):
                    lo, hi = int(run[0]), int(run[-1]) + SPAN
                    part = int(body_hashes(b, np.array([lo]), np.array([hi])).view(np.int64)[0])
                    for o, x in zip(out, (owner, body, n, lo, len(run), part, raw[lo:hi])):
                        o.append(x)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)],
                                             ["owner", "body", "n", "lo", "count", "part", "bytes"])

    parts = settled(bodies.join(left, ["owner", "body"]).select("owner", "body", "n", "bytes", "_at").mapInArrow(
        trim, "owner long, body long, n long, lo long, count long, part long, bytes binary").withColumn(
        "key", F.col("owner")))
    for length in CUTS:
        still = settled(parts.select("key", "part").distinct().groupBy("key").agg(F.count("*").alias("_n")).where(
            F.col("_n") > CROWD).select("key"))
        if still.isEmpty():
            break
        parts = settled(parts.join(still, "key", "left_anti").unionByName(
            cut_again(parts.join(still, "key", "left_semi"), length)))
    cut = cand.join(parts.select("owner", "body", "lo", "count", "part", "key").distinct(), ["owner", "body"]).select(
        F.col("key").alias("owner"), F.col("part").alias("body"), "_doc", "_text",
        ((F.shiftright("place", 16) + F.col("lo")) * 65536 + F.col("count")).alias("place"))
    kept = parts.groupBy(F.col("key").alias("owner"), F.col("part").alias("body")).agg(
        F.sum("n").alias("n"), F.first("count").cast("int").alias("count"), F.first("bytes").alias("bytes"))
    return cut, kept


def cut_again(parts: DataFrame, length: int) -> DataFrame:
    """``parts`` as runs of spans that share their key and the least hash of their ``length``-byte runs, the new key."""
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64()]
    names = ["owner", "body", "n", "lo", "count", "part", "bytes", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = ([], [], [], [], [], [], [], []), 0
            for owner, body, n, at, raw, key in zip(*batch.columns):
                raw = raw.as_py()
                b = np.frombuffer(raw, np.uint8)
                place = np.arange(len(b) - length + 1)
                least = sliding_min(body_hashes(b, place, place + length), SPAN - length + 1)
                first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                end = np.append(first[1:], len(least))
                sub = body_hashes(b, first, end + SPAN - 1)
                new = mix(least[first] + np.array([key.as_py()], np.int64).view(np.uint64) * _ODD[1])
                for lo, hi, part, k in zip(first.tolist(), end.tolist(), sub.view(np.int64).tolist(),
                                           new.view(np.int64).tolist()):
                    row = (owner.as_py(), body.as_py(), n.as_py(), at.as_py() + lo, hi - lo, part,
                           raw[lo:hi + SPAN - 1], k)
                    for o, x in zip(out, row):
                        o.append(x)
                    size += hi - lo + SPAN
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)
                    out, size = ([], [], [], [], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)

    return parts.select("owner", "body", "n", "lo", "bytes", "key").mapInArrow(
        run, "owner long, body long, n long, lo long, count long, part long, bytes binary, key long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_doc, _text, _spans): covered byte ranges of every row that has some, as start * 2^32 + length."""
    again = settled(
        find_segments(docs, True).groupBy("owner").agg(F.count("*").alias("_n")).where("_n > 1").select("owner"))
    cand = settled(find_segments(docs, False).join(again, "owner", "left_semi"))
    wanted = settled(
        cand.groupBy("owner", "body").agg(F.count("*").alias("n"), F.min(F.struct("_doc", "_text", "place")).alias("_at"))
        .select("owner", "body", "n", "_at._doc", "_at._text", "_at.place"))
    total = wanted.agg(F.sum(F.col("place").bitwiseAND(65535) + SPAN - 1)).first()[0] or 0
    crowds = settled(wanted.groupBy("owner").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select("owner"))
    if crowds.isEmpty():
        fetched = fetch(docs, wanted)
    else:
        cut, kept = thinned(docs, cand, wanted, crowds)
        cand = cand.join(crowds, "owner", "left_anti").unionByName(cut)
        kept = settled(kept)                              # single spans are many more bytes than their segments
        total += kept.agg(F.sum(F.col("count") + SPAN - 1)).first()[0] or 0
        fetched = fetch(docs, wanted.join(crowds, "owner", "left_anti")).unionByName(kept)
    shards = max(1, math.ceil(total / SHARD_BYTES))
    spans = cand.join(judge(fetched, shards), ["owner", "body"]).select(
        "_doc", "_text",
        ((F.shiftright("place", 16) + F.col("lo")) * F.lit(1 << 32) + (F.col("hi") - F.col("lo") + SPAN - 1)).alias("_span"))
    return spans.groupBy("_doc", "_text").agg(F.collect_list("_span").alias("_spans"))


def kept_bytes(raw: bytes, spans: list[int] | None) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    if not spans:
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int32)
    s = np.array(spans, np.int64)
    np.add.at(edge, s >> 32, 1)
    np.add.at(edge, (s >> 32) + (s & 0xFFFFFFFF), -1)
    gone = np.cumsum(edge[:-1]) > 0
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return left, len(raw) - len(left), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row's kept (the remaining bytes), n_bytes, n_removed and n_spans, with doc_id or ``keep``.

    With doc_id alone the texts are shuffled once for both of the joins that read them. With ``keep``, kept
    is a text: a character that lost a byte is left out.
    """
    as_text = keep is not None
    spans = repeated_spans(docs)
    if keep is None:
        rows = texts_by_row(docs).join(spans, ["_doc", "_text"], "left").withColumn(
            "doc_id", F.when(F.col("_doc") > -(2**63), F.col("_doc")))
        fields = ["`doc_id` bigint"]
        keep = ["doc_id"]
        rows = rows.select("doc_id", F.col("text").alias("_raw"), "_spans")
    else:
        rows = row_key(docs).select(*keep, F.col("text").alias("_raw"), "_doc", "_text").join(
            spans, ["_doc", "_text"], "left").select(*keep, "_raw", "_spans")
        fields = [f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    kind = "string" if as_text else "binary"
    schema = ", ".join(fields + [f"kept {kind}", "n_bytes long", "n_removed long", "n_spans long"])
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(k), batch.column(k + 1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                left, removed, runs = kept_bytes(raw, spans.as_py())
                out.append((left.decode("utf-8", "ignore") if as_text else left, len(raw), removed, runs))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                [*keep, "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(run, schema)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """Counts per document and the digest of what remains."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
