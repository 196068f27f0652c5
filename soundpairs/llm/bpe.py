"""Byte-level BPE, encoded as a tree over halves of the text and decoded up the same tree.

A text longer than a leaf is halved; both halves are encoded on their own and joined. The pattern
that cuts a text into pieces reads from left to right and keeps no memory at a cut, so:

* in the left half, cuts at least ``LOOKAHEAD`` characters before its end cannot change with what
  follows (no branch of the pattern looks further), and
* from the first cut that both the re-encoded window and the right half share, the right half's
  pieces are those of the whole text.

The join re-encodes a window around the border, from the last settled cut on the left, and doubles
it until it meets such a shared cut. That makes the join associative, so any tree gives the ids
of one pass over the whole text.

Units between cuts are looked up in a bounded memo: pseudo-random words recur, and a piece is merged
by the library (`tiktoken`) once. A unit that follows one blank and neither starts nor ends with
white space never shares a piece with its neighbours, so a leaf of such units is a plain split.

Null and empty texts have no ids. Strings of special tokens are ordinary text here.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: No branch of the pattern decides by characters further than this behind the end of a piece.
LOOKAHEAD = 3
LEAF_CHARS = 16384
#: Units remembered by one worker.
MEMO = 250_000


class Unsafe(Exception):
    """A unit touches white space beyond its one blank, so that a plain split may cut wrongly."""


class Memo(dict):
    """unit -> value. A unit ``w`` stands for one blank and ``w``; ``(w,)`` stands for ``w`` itself."""

    def __init__(self, encode: Callable[[str], object], limit: int = MEMO):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, unit):
        if isinstance(unit, str):
            if not unit or unit[0].isspace() or unit[-1].isspace():
                raise Unsafe
            value = self.encode(" " + unit)
        else:
            value = self.encode(unit[0])
        if len(self) >= self.limit:
            self.clear()
        self[unit] = value
        return value


def _length(unit) -> int:
    return len(unit) + 1 if isinstance(unit, str) else len(unit[0])


class TreeEncoder:
    """``encode(piece)`` gives the value of a text without outside context; ``find`` cuts pieces."""

    def __init__(self, encode: Callable[[str], object], find: Callable[[str], list[str]],
                 leaf: int = LEAF_CHARS, limit: int = MEMO):
        self.memo, self.find, self.leaf = Memo(encode, limit), find, leaf

    def _leaf(self, text: str) -> tuple[list, list]:
        if not text:
            return [], []
        head, *units = text.split(" ")
        try:
            if head:
                if head[-1].isspace():
                    raise Unsafe
                units.insert(0, (head,))
            memo = self.memo
            return units, [memo[u] for u in units]
        except Unsafe:
            units = [(p,) for p in self.find(text)]
            return units, [self.memo[u] for u in units]

    def parts(self, text: str, lo: int = 0, hi: int | None = None) -> tuple[list, list]:
        """Units of ``text[lo:hi]`` as if it stood alone, and their values."""
        hi = len(text) if hi is None else hi
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, self.parts(text, lo, mid), self.parts(text, mid, hi), mid, hi)

    def _join(self, text: str, left, right, mid: int, hi: int) -> tuple[list, list]:
        units, values = left
        start, keep = mid, len(units)
        while keep and start > mid - LOOKAHEAD:
            keep -= 1
            start -= _length(units[keep])
        # `start` is a cut of the left half that what follows cannot move
        window, cuts, seen, at_right = 64, {}, 0, mid
        while True:
            end = min(hi, mid + window)
            found = self._leaf(text[start:end])
            while seen < len(right[0]) and at_right < end:
                cuts[at_right] = seen
                at_right += _length(right[0][seen])
                seen += 1
            at, settled = start, end if end == hi else end - LOOKAHEAD
            for j, u in enumerate(found[0]):
                if mid <= at <= settled and at in cuts:
                    i = cuts[at]
                    return (units[:keep] + found[0][:j] + right[0][i:],
                            values[:keep] + found[1][:j] + right[1][i:])
                at += _length(u)
            if end == hi:
                return units[:keep] + found[0], values[:keep] + found[1]
            window *= 2

    def values(self, text: str) -> list:
        return self.parts(text)[1]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_ENCODERS: dict[tuple, TreeEncoder] = {}


def rank_encoder(path: str, pattern: str) -> TreeEncoder:
    """Values are (number of ids, decimal ids, decoded bytes); kept for the life of the worker."""
    if (path, pattern) not in _ENCODERS:
        import regex
        import tiktoken

        ranks = read_ranks(path)
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        token = {i: b for b, i in ranks.items()}

        def encode(piece: str):
            ids = core.encode_ordinary(piece)
            return len(ids), ",".join(map(str, ids)), b"".join([token[i] for i in ids])

        _ENCODERS[path, pattern] = TreeEncoder(encode, regex.compile(pattern).findall)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of every document.

    ``ids=True`` adds the ids themselves. Reads only doc_id and text; rows stay where they are.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                values = encoder.values(text.as_py() or "")
                n, names, raw = zip(*values) if values else ((), (), ())
                listed = ",".join(names)
                rows.append((sum(n), hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(b"".join(raw)).hexdigest(),
                             *([[int(i) for i in listed.split(",") if i]] if ids else [])))
            columns = list(zip(*rows)) if rows else [()] * (3 + ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:4 + ids])

    from pyspark.sql import functions as F
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
