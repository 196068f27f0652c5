"""Token-combination prefixes against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from soundpairs.llm import jaccard_join as jj
from tests.llm.conftest import rows


def sets_of(data):
    out = []
    for _, text in data:
        w = (text or "").encode().lower().split()
        out.append(frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    return out


def brute(data, percent=90):
    sets, at, parent = sets_of(data), defaultdict(list), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for j, n in Counter(j for s in own for j in at[s]).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for s in own:
            at[s].append(i)
    least = {}
    for i, (doc, _) in enumerate(data):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(data)), key=str)


def families(seed, count=12, size=25):
    """Families of texts of all lengths, whose members differ in a few words; many share a passage."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line, out = [r.choice(words) for _ in range(40)], []
    for f in range(count):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 11, 12, 13, 20, 33, 60, 130, 300]))]
        if f % 3 == 0:
            base += line
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                k = r.randrange(len(w))
                w[k:k + r.randint(0, 1)] = [r.choice(words)]
            out.append((len(out), " ".join(w)))
    return out


@pytest.mark.parametrize("percent", [90, 80])
def test_no_linked_pair_lacks_a_common_key(percent):
    """Sieve and keys of every linked pair of different sets, for several bounds of rare tokens."""
    for seed in range(4):
        sets = sorted(set(sets_of(families(seed))) - {frozenset()}, key=str)
        number = {t: np.uint64(hash(t) % (1 << 64)) for s in sets for t in s}
        df = Counter(t for s in sets for t in s)
        hashed = [sorted(int(number[t]) for t in s) for s in sets]
        probes = [set(h[:2 * jj.free(len(h), percent) + 1]) for h in hashed]
        for rare in (1, 3, 16):
            keys = []
            for s in sets:
                own = sorted((df[t], int(number[t])) for t in s if df[t] > 1)
                k, token = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.uint64)
                keys.append(set(jj.keys_of(len(s), k, token, percent, rare).tolist()) if own else set())
            linked = 0
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    if 100 * len(a & b) >= percent * len(a | b):
                        linked += 1
                        assert keys[i] & keys[j]
                        both = len(probes[i] & probes[j])
                        assert both >= jj.probe_need(len(a), percent) and both >= jj.probe_need(len(b), percent)
            assert linked


def test_keys_grow_with_the_set_and_not_with_its_square():
    r = np.random.default_rng(0)
    for n in (100, 1000, 10_000):
        token = r.integers(0, 1 << 63, n).astype(np.uint64)
        assert len(jj.keys_of(n, np.full(n, 1000), token)) < n


def test_the_sieve_in_sql_is_the_one_in_python(llm_spark):
    for percent in (90, 80):
        got = llm_spark.range(1, 400).selectExpr("id", jj._probe_need_sql("id", percent) + " as k").collect()
        assert [r.k for r in got] == [jj.probe_need(r.id, percent) for r in got]


def test_documents(docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(jj.jaccard_join(docs)) == brute(data)


def test_families(llm_spark, monkeypatch):
    monkeypatch.setattr(jj, "RARE", 4)
    data = families(1) + [(1000, "a b"), (1001, "A\tb"), (1002, ""), (1003, None), (1004, " \n"), (1005, "a b c"), (1005, "x y"),
                          (1006, "A b  C"), (1007, "x y"), (1005, "x y")]
    assert rows(jj.jaccard_join(llm_spark.createDataFrame(data, "doc_id long, text string"))) == brute(data)
    data = families(2, 6, 60)
    df = llm_spark.createDataFrame(data, "doc_id long, text string")
    assert rows(jj.jaccard_join(df, 80)) == brute(data, 80) != brute(data)


def test_odd_rows_and_no_rows(odd_docs, no_docs):
    got = jj.jaccard_join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.component_id is None for r in got if r.doc_id is None)
    named = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    assert sorted((tuple(r) for r in got if r.doc_id is not None), key=str) == brute(named)
    assert jj.jaccard_join(no_docs).collect() == []
