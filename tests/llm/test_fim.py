"""Fill-in-the-middle by rotations against plain slices."""

import hashlib
import random
import re

import pytest

from soundpairs.llm import fim
from tests.llm.conftest import rows


def plain(doc_id, text, rate=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output) by a plain reading of the rule."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text or ""
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_random_texts_and_drawn_rates(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(fim, "BLOCK", 3)
    for i in range(4000):
        text = "".join(r.choice(["\n", "a", "é", "<", ">", "S", "P", "M", "漢", "🙂", "\r", "\x85"]) for _ in range(r.randint(0, 30)))
        rate, spm = r.choice([0, 40, 100]), r.choice([0, 50, 100])
        buf = bytearray(text.encode())
        n, form, p, m = fim.transform(buf, i, rate=rate, spm=spm)
        assert (n, form, p, m, buf.decode()) == plain(i, text, rate, spm)
        fim.restore(buf, form)
        assert buf.decode() == text


def test_rotation_of_every_split(monkeypatch):
    for block in (1, 2, 5, 100):
        monkeypatch.setattr(fim, "BLOCK", block)
        for lo in range(4):
            for mid in range(lo, 12):
                for hi in range(mid, 13):
                    buf = bytearray(range(13))
                    want = buf[:lo] + buf[mid:hi] + buf[lo:mid] + buf[hi:]
                    fim.rotate(buf, lo, mid, hi)
                    assert buf == want


def test_documents(docs, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(fim, "BATCH_BYTES", 5000)
    for df in (docs, odd_docs, no_docs):
        want = []
        for r in df.collect():
            *row, output = plain(r.doc_id, r.text)
            want.append((r.doc_id, *row, sha(output), sha(r.text or "")))
        assert rows(fim.middle_digest(df)) == sorted(want, key=str)


def test_a_long_text_and_texts_with_sentinels(llm_spark):
    data = [(1, "line of some length\n" * 200_000), (2, "a\n<M>\nb"), (3, "\n"), (4, "<\nP>\n<S\n>"), (5, "x" * 3_000_000)]
    got = {r.doc_id: r for r in fim.from_middle(fim.to_middle(llm_spark.createDataFrame(data, "doc_id long, text string"))).collect()}
    for doc, text in data:
        n, form, p, m, output = plain(doc, text)
        r = got[doc]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output.decode() == output and r.restored.decode() == text
    assert got[2].form == "plain" and got[4].form != "plain"


def test_another_form_is_refused():
    buf = bytearray(b"one\ntwo\nthree\n")
    form = fim.transform(buf, 1)[1]
    with pytest.raises(ValueError):
        fim.restore(buf, "psm" if form == "spm" else "spm")
