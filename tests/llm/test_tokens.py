"""Tree BPE and packing against the libraries."""

import random
import zlib
from collections import defaultdict

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from soundpairs.llm import bpe, packing
from tests.llm.conftest import rows

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
LETTERS = list("ab'slrevémd  \n\t.,!?12ñß漢字\x1c\xa0 ²ⅷ́🙂") + ["'ll", "'re", " ", " ", "  "]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def random_texts(n, size, seed):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_any_tree_gives_the_ids_of_one_pass(library):
    whole = bpe.rank_encoder(RANKS, P.PATTERN)
    r = random.Random(2)
    for text in random_texts(3000, 60, 1):
        tree = bpe.TreeEncoder(whole.memo.encode, whole.find, leaf=r.choice([1, 2, 3, 5, 8, 20]))
        values = tree.values(text)
        assert ",".join(v[1] for v in values) == ",".join(map(str, library.encode_ordinary(text)))
        assert b"".join(v[2] for v in values) == text.encode()


def test_memo_is_bounded_and_right_when_it_overflows(library):
    whole = bpe.rank_encoder(RANKS, P.PATTERN)
    tree = bpe.TreeEncoder(whole.memo.encode, whole.find, limit=10)
    text = " ".join(f"word{i}" for i in range(200))
    assert ",".join(v[1] for v in tree.values(text)) == ",".join(map(str, library.encode_ordinary(text)))
    assert len(tree.memo) <= 10


def test_documents_round_trip(docs, odd_docs, library):
    for df in (docs, odd_docs):
        want = sorted(((r.doc_id, len(ids := library.encode_ordinary(r.text or "")),
                        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256((r.text or "").encode()).hexdigest(), ids) for r in df.collect()), key=str)
        assert rows(bpe.encode_documents(df, RANKS, P.PATTERN, ids=True)) == want


def test_json_vocabulary_gives_the_ids_of_its_library():
    tokenizer = Tokenizer.from_file(JSON)
    encoder, special = packing.json_encoder(JSON, P.PATTERN)
    for text in random_texts(2000, 40, 3) + ["a<|endoftext|> b", "<|endoftext|><|endoftext|>"]:
        got = np.frombuffer(packing.ids_of(text, encoder, special), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(df, got, capacity=1024):
    tokenizer = Tokenizer.from_file(JSON)
    ids = [tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in df.collect()]
    want = sorted((len(x[s:s + n]), zlib.crc32(np.array(x[s:s + n], "<u4").tobytes()))
                  for x in ids for s, n in packing.pieces_of(len(x), capacity))
    assert sorted((r.length, r.ids_crc32) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(n for n, _ in want) // capacity)


def test_packing(docs, odd_docs):
    used, least = check_packing(docs, packing.pack_documents(docs, JSON, P.PATTERN).collect())
    assert used <= 1.02 * least + 1
    check_packing(odd_docs, packing.pack_documents(odd_docs, JSON, P.PATTERN).collect())


def test_many_groups_lose_little(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 40)
    used, least = check_packing(docs, packing.pack_documents(docs, JSON, P.PATTERN).collect())
    assert used <= 1.05 * least + 1


def test_pieces():
    assert packing.pieces_of(1024, 1024) == [(0, 1024)]
    assert packing.pieces_of(1025, 1024) == [(0, 1), (1, 1024)]
    assert packing.pieces_of(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_sum_of_squares_follows_its_rule():
    """Against a plain reading of the rule."""
    r = random.Random(5)
    for _ in range(50):
        sizes = np.array([r.randint(1, 30) for _ in range(60)])
        bins = []
        for s in sorted(sizes.tolist(), reverse=True):
            best = None
            for g in sorted({b for b in bins if b >= s}):
                counts = defaultdict(int)
                for b in bins:
                    counts[b] += 1
                counts[g] -= 1
                counts[g - s] += 1
                score = sum(n * n for gap, n in counts.items() if gap)
                if best is None or score < best[0]:
                    best = (score, g)
            if best:
                bins.remove(best[1])
                bins.append(best[1] - s)
            else:
                bins.append(30 - s)
        _, _, gaps = packing.sum_of_squares(sizes, 30)
        assert sorted(gaps.tolist()) == sorted(bins)


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, JSON, P.PATTERN).collect() == []
    assert bpe.encode_documents(no_docs, RANKS, P.PATTERN).collect() == []
    assert regex.fullmatch(P.PATTERN, " word")
