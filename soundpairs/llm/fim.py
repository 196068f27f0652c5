"""Fill-in-the-middle texts by block rotation in place.

A text is cut into units, its lines. Two draws, from a digest of seed and doc_id, say after how many units the
prefix and the middle end. The text lies in one byte array all the time: the three sentinels are put
before their blocks, and the blocks change places by rotation, which is three reversals. A reversal
exchanges both ends ``BLOCK`` bytes at a time, so nothing but the text itself is ever held.

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; one rotation.
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; one more.
* ``plain``: the text as it is, where it is empty, holds a sentinel, or isn't drawn for a transformation.

Restoring finds the sentinels, turns the rotations back and takes the sentinels out. A sentinel begins with ``<``,
ends with ``>`` and has neither inside, so text and sentinels can't form another one where they meet.

A null text is the empty one; a null doc_id draws like an empty id. Rows with equal doc_id draw alike, each row is
transformed by itself. Other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
#: Of 100 documents, those that are transformed; of these, those in the form ``spm``.
RATE, SPM = 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that a reversal exchanges at once.
BLOCK = 1 << 16
#: Bytes of one batch of results, about.
BATCH_BYTES = 4 << 20


def reverse(view: np.ndarray, lo: int, hi: int) -> None:
    """view[lo:hi] the other way round, in place."""
    while hi - lo > 1:
        k = min(BLOCK, (hi - lo) // 2)
        left = view[lo:lo + k].copy()
        view[lo:lo + k] = view[hi - k:hi][::-1]
        view[hi - k:hi] = left[::-1]
        lo, hi = lo + k, hi - k


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Blocks buf[lo:mid] and buf[mid:hi] change places."""
    if lo < mid < hi:
        view = np.frombuffer(buf, np.uint8)
        reverse(view, lo, mid)
        reverse(view, mid, hi)
        reverse(view, lo, hi)


def unit_ends(buf: bytearray) -> np.ndarray:
    """Where each line ends, its line feed included."""
    ends = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10) + 1
    return ends if len(buf) == 0 or buf[-1] == 10 else np.append(ends, len(buf))


def chars(buf: bytearray, lo: int, hi: int) -> int:
    """Code points of buf[lo:hi]: all bytes but those that continue one."""
    return int(((np.frombuffer(buf, np.uint8, hi - lo, lo) & 0xC0) != 0x80).sum()) if hi > lo else 0


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    return struct.unpack(">4I", hashlib.sha256(key.encode()).digest()[:16])


def transform(buf: bytearray, doc_id: int | None, seed: int = SEED, rate: int = RATE,
              spm: int = SPM) -> tuple[int, str, int | None, int | None]:
    """Units, form, and code points of prefix and middle; ``buf`` becomes the output."""
    ends = unit_ends(buf)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or any(mark in buf for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None
    a, b = (int(ends[u - 1]) if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle = chars(buf, 0, a), chars(buf, a, b)
    for at, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):        # from behind, so that places hold
        buf[at:at] = mark
    begin, cut = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    rotate(buf, begin, cut, len(buf))                               # middle and suffix
    if h4 % 100 >= spm:
        return n, "psm", prefix, middle
    rotate(buf, 0, begin, begin + len(buf) - cut)                   # prefix and suffix
    return n, "spm", prefix, middle


def restore(buf: bytearray, form: str) -> None:
    """``buf``, an output of that form, becomes the text again."""
    if form == "plain":
        return
    p, s, m = buf.find(PREFIX), buf.find(SUFFIX), buf.find(MIDDLE)
    if min(p, s, m) < 0 or (form == "spm") != (s < p):
        raise ValueError(f"no output of the form {form}")
    if form == "spm":
        rotate(buf, 0, p, m)
        s = m - p                                   # the suffix lies behind the prefix again
    rotate(buf, s, m, len(buf))
    for at, mark in ((s + len(buf) - m, SUFFIX), (s, MIDDLE), (0, PREFIX)):
        del buf[at:at + len(mark)]


def to_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (bytes) of every row."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                buf = bytearray(text.as_py() or b"")
                row = transform(buf, doc, seed, rate, spm)
                out.append((doc, *row, bytes(buf)))
                size += len(buf)
                if size > BATCH_BYTES:
                    yield _batch(out, kinds, names)
                    out, size = [], 0
            yield _batch(out, kinds, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def from_middle(outputs: DataFrame) -> DataFrame:
    """``outputs`` of ``to_middle`` with their restored texts (bytes); other columns of it stay."""
    names = [f.name for f in outputs.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema) + ", restored binary"
    form, output = names.index("form"), names.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, out = 0, 0, []
            for i, (how, raw) in enumerate(zip(batch.column(form).to_pylist(), batch.column(output))):
                buf = bytearray(raw.as_py())
                restore(buf, how)
                out.append(bytes(buf))
                size += len(buf)
                if size > BATCH_BYTES or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(first, i + 1 - first).columns, pa.array(out, pa.binary())], [*names, "restored"])
                    first, size, out = i + 1, 0, []

    return outputs.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def middle_digest(docs: DataFrame) -> DataFrame:
    """Every row's form and cuts, with the digests of its output and of the text restored from it."""
    both = from_middle(to_middle(docs))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def middle_sql() -> str:
    """The same in SQL, by lists of lines."""
    marks = " or ".join(f"contains(t, '{m.decode()}')" for m in (PREFIX, SUFFIX, MIDDLE))
    draw = [f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)" for i in range(4)]
    return f"""
with texts as (
    select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), units as (
    select doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as lines, h from texts
), cuts as (
    select doc_id, t, lines, len(lines) as n,
        least({draw[0]} % (len(lines) + 1), {draw[1]} % (len(lines) + 1)) as a,
        greatest({draw[0]} % (len(lines) + 1), {draw[1]} % (len(lines) + 1)) as b,
        case when t = '' or {marks} or {draw[2]} % 100 >= {RATE} then 'plain'
             when {draw[3]} % 100 < {SPM} then 'spm' else 'psm' end as form
    from units
), blocks as (
    select doc_id, t, n, form, coalesce(array_to_string(lines[1:a], ''), '') as p,
        coalesce(array_to_string(lines[a + 1:b], ''), '') as m, coalesce(array_to_string(lines[b + 1:n], ''), '') as s
    from cuts
)
select doc_id, n, form,
    case when form <> 'plain' then length(p) end as prefix_chars,
    case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
           else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from blocks"""
