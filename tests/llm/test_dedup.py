"""Near duplicates, repeated passages and fingerprints against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from soundpairs.llm import fingerprint, near_dup, suffix_dedup
from soundpairs.llm.components import components
from soundpairs.llm.suffix_array import permuted_lcp, suffix_array
from tests.llm.conftest import rows


def brute_near(data, percent=85):
    sets = []
    for _, text in data:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    at, parent = defaultdict(list), list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in at[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for s in own:
            at[s].append(i)
    least = {}
    for i, (doc, _) in enumerate(data):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least[find(i)], least[find(i)] == doc) for i, (doc, _) in enumerate(data)), key=str)


def family(n, edits, seed, first=1000):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    base = [r.choice(words) for _ in range(200)]
    out = [(first + n, " ".join(base))]
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(1, edits)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((first + i, " ".join(w)))
    return out


def test_near_duplicates_of_the_table(docs):
    assert rows(near_dup.near_duplicates(docs)) == brute_near([(r.doc_id, r.text) for r in docs.collect()])


def test_a_family_whose_members_are_only_near_its_centre(llm_spark):
    data = family(60, 5, 7) + [(1, "a b"), (2, "A\tb"), (3, ""), (4, None), (5, "a b c d e"), (6, "a  B c d E"),
                               (7, "a b c d e f g h i j k"), (8, "x a b c d e f g h i j k")]
    df = llm_spark.createDataFrame(data, "doc_id long, text string")
    assert rows(near_dup.near_duplicates(df)) == brute_near(data)


def test_near_duplicates_at_another_threshold(docs, llm_spark):
    """Also sets of four and five shingles, which are linked from 0.8 on."""
    assert (near_dup.bands_for(85), near_dup.least_set(85)) == (near_dup.BANDS, 6)
    assert (near_dup.bands_for(80), near_dup.least_set(80)) == (35, 4)
    data = family(40, 8, 11) + [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "k l m n o p q"), (4, "k l m n o p q r")]
    df = llm_spark.createDataFrame(data, "doc_id long, text string")
    want = brute_near(data, 80)
    assert rows(near_dup.near_duplicates(df, 80)) == want != brute_near(data)


def test_odd_rows(odd_docs):
    got = near_dup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = near_dup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "None", *"12334678", "9"])


def test_texts_under_one_id_are_told_apart(llm_spark):
    """A link through either text of an id counts, and unrelated texts under one id all stay."""
    r = random.Random(9)
    one, two = (" ".join(r.choice("abcdefgh") * 3 + str(r.randint(0, 99)) for _ in range(80)) for _ in range(2))
    data = [(1, one), (1, two), (3, two + " x"), (4, one), (4, "alpha beta"), (9, "alpha beta"), (9, "gamma delta"), (9, "gamma delta"),
            (10, two), (11, "gamma  Delta")]
    df = llm_spark.createDataFrame(data, "doc_id long, text string")
    assert rows(near_dup.near_duplicates(df)) == brute_near(data)
    kept = [(1, one), (1, two), (4, "alpha beta"), (9, "gamma delta")]
    assert rows(near_dup.keep_one(df)) == sorted(kept, key=str)


def test_components_of_a_path_and_a_star(llm_spark):
    links = [(i, i + 1) for i in range(10, 30)] + [(100, j) for j in range(101, 140)]
    got = dict(map(tuple, components(llm_spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 10 for i in range(11, 31)} | {j: 100 for j in range(101, 140)}


def test_signature_borrows_only_from_full_bins():
    own = np.unique(np.random.default_rng(0).integers(0, 2**63, 7).astype(np.uint64) * np.uint64(2))
    assert len(near_dup.bands(own)) == near_dup.BANDS
    assert (near_dup.bands(own) == near_dup.bands(own.copy())).all()


def brute_spans(data, span=200):
    seen = Counter()
    raws = [(text or "").encode() for _, text in data]
    for b in raws:
        for i in range(len(b) - span + 1):
            seen[b[i:i + span]] += 1
    out = []
    for (doc, _), b in zip(data, raws):
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(n):
    r = random.Random(0)
    p = "".join(r.choice("abcdefgh ") for _ in range(400))
    noise = lambda: "".join(r.choice("klmnop ") for _ in range(r.randint(0, 120)))
    return [(100 + i, noise() + p[r.randint(0, 100):r.randint(250, 400)] + noise()) for i in range(n)] + [
        (1, "x" * 500), (2, "é" * 150), (3, "Q" + "é" * 150 + "z"), (4, "y" * 199), (5, None), (6, "")]


def test_repeated_passages(docs, odd_docs, llm_spark):
    for df in (docs, odd_docs, llm_spark.createDataFrame(passages(60), "doc_id long, text string")):
        data = [(r.doc_id, r.text) for r in df.collect()]
        assert rows(suffix_dedup.dedup_digest(df)) == brute_spans(data)


def test_crowded_owners_are_thinned_to_the_same_result(llm_spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 5)
    data = passages(60)
    df = llm_spark.createDataFrame(data, "doc_id long, text string")
    assert rows(suffix_dedup.dedup_digest(df)) == brute_spans(data)


def test_no_owner_stays_crowded_by_borrowers_with_copies(llm_spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 5)
    largest, judge = [], suffix_dedup.judge

    def seen(fetched, shards):
        largest.append(fetched.groupBy("owner").agg(F.countDistinct("body").alias("n")).agg(F.max("n")).first()[0])
        return judge(fetched, shards)

    monkeypatch.setattr(suffix_dedup, "judge", seen)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    for size in (60, 190):          # shorter and longer than the first of CUTS
        line, data = text(size), []
        for i in range(30):
            own = text(250) + line + text(250)
            data += [(2 * i, own), (2 * i + 1, own if i % 3 else text(40) + own)]
        data.append((1000, text(250) + line + text(250)))
        df = llm_spark.createDataFrame(data, "doc_id long, text string")
        assert rows(suffix_dedup.dedup_digest(df)) == brute_spans(data)
    assert max(largest) <= 5


def test_an_owner_beyond_the_real_bound(llm_spark):
    """More borrowers of one passage than ``CROWD``, each with its own text around it, some with copies."""
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    noise = lambda n: "".join(r.choices("klmnopqrstuvwxyz ", k=n))
    data = []
    for i in range(suffix_dedup.CROWD + 500):
        text = noise(45) + passage + noise(45)
        data += [(len(data), text)] + ([(len(data) + 1, text + noise(5))] if i % 50 == 0 else [])
    seen, raws = Counter(), [t.encode() for _, t in data]
    for b in raws:
        seen.update(hash(b[i:i + 200]) for i in range(len(b) - 199))
    want = []
    for (doc, _), b in zip(data, raws):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[hash(b[i:i + 200])] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((doc, len(b), sum(gone), 1, hashlib.sha256(kept).hexdigest()))
    df = llm_spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    assert rows(suffix_dedup.dedup_digest(df)) == sorted(want, key=str)


def test_text_longer_than_a_block(llm_spark, monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice("abcdef") for _ in range(3000))
    data = [(1, text + text[500:1500] + "z"), (2, text[1000:1300])]
    want = brute_spans(data)
    monkeypatch.setattr(suffix_dedup, "_PLACE", np.uint64((1 << 10) - 1))
    raw = np.frombuffer(data[0][1].encode(), np.uint8)
    small = suffix_dedup.segments(np.array([0, len(raw)]), raw)
    assert len(raw) > 1 << 10 and (np.diff(np.sort(small[1])) > 0).all()
    assert small[2].sum() == len(raw) - suffix_dedup.SPAN + 1       # every span has one owner
    monkeypatch.undo()
    assert rows(suffix_dedup.dedup_digest(llm_spark.createDataFrame(data, "doc_id long, text string"))) == want


def test_suffix_array_and_prefixes():
    r = random.Random(0)
    for k in range(400):
        text = bytes(r.randrange(r.choice([1, 2, 3, 256])) for _ in range(r.randint(1, 60))) * r.choice([1, 1, 3])
        a = np.frombuffer(text, np.uint8)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(a).tolist() == order
        want = [0] * len(text)
        for x, y in zip(order, order[1:]):
            while x + want[y] < len(text) and y + want[y] < len(text) and text[x + want[y]] == text[y + want[y]]:
                want[y] += 1
        assert permuted_lcp(a, np.array(order), 10_000).tolist() == want


def brute_prints(data):
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    keys = sorted({(d is not None, d or 0) for d, _ in order})
    first = {}
    for d, t in order:
        first.setdefault((d is not None, d or 0), t or "")
    out = []
    for d, t in order:
        nxt = first[keys[(keys.index((d is not None, d or 0)) + 1) % len(keys)]]
        text = t or ""
        cut = len(text) // 4
        changed = text[:len(text) - cut] + nxt[:cut]
        out.append((d, len(text), hashlib.sha256(changed.encode()).hexdigest(),
                    fingerprint.Fingerprint(text).text(), fingerprint.Fingerprint(changed).text()))
    return sorted(out, key=str)


def test_fingerprints_and_edited_texts(docs, odd_docs):
    for df, blocks in ((docs, 8), (docs, 1), (odd_docs, 5)):
        got = fingerprint.fingerprint_documents(df, blocks).drop("near_edited", "near_next")
        assert rows(got) == brute_prints([(r.doc_id, r.text) for r in df.collect()])


def test_fingerprints_are_sums():
    one, two, three = "first line\nsecond one", "a third", "a fourth, longer line of text"
    whole = fingerprint.Fingerprint("\n".join([one, two, three]))
    swapped = fingerprint.Fingerprint("\n".join([three, one, two]))
    assert whole.text() == swapped.text() and whole.likeness(swapped) == 1.0
    assert fingerprint.Fingerprint(one).insert(two).insert(three).text() == whole.text()
    assert whole.delete(two).text() == fingerprint.Fingerprint("\n".join([one, three])).text()
    assert fingerprint.Fingerprint("ab").text() != fingerprint.Fingerprint("ba").text()


def test_likeness_tells_edited_from_other(docs):
    got = fingerprint.fingerprint_documents(docs).where("n_chars > 500").collect()
    assert np.mean([r.near_edited for r in got]) > 0.6
    assert np.mean([r.near_next for r in got]) < 0.25


def test_no_rows(no_docs):
    for run in (near_dup.near_duplicates, suffix_dedup.dedup_digest, fingerprint.fingerprint_documents):
        assert run(no_docs).collect() == []
