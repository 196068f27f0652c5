"""Learned operators by held-out accuracy, the others by brute force or SQL."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundpairs.llm import ann, lang_id, licences, sharding, toxicity
from soundpairs.llm import queries as registered
from tests.llm.conftest import SF, rows

BIG = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(llm_spark):
    docs = llm_spark.read.parquet(f"{BIG}/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.rejected for r in held]) < 0.02
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_read_texts_only(llm_spark):
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit(docs, ~lang_id.held_out(docs["doc_id"]))
    again = docs.selectExpr("-doc_id as doc_id", "text", "'xx' as lang", "null as source")
    a = sorted(r.lang_pred for r in lang_id.predict(docs, model, ["doc_id"]).collect())
    b = sorted(r.lang_pred for r in lang_id.predict(again, model, ["doc_id"]).collect())
    assert a == b


def test_languages_of_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.lang_pred) for r in lang_id.identify(odd_docs).collect()}
    assert {(1, "und"), (2, "und"), (7, "und")} <= got
    assert lang_id.identify(odd_docs).count() == odd_docs.count()
    assert lang_id.identify(no_docs).collect() == []
    nothing = odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).where("lang is null")
    assert {r.lang_pred for r in lang_id.identify(nothing).collect()} <= {"und"}


def test_toxicity_of_held_out_documents(llm_spark):
    docs, labels = (llm_spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.75
    assert np.mean([r.predicted for r in clean]) < 0.02
    by_score = sorted(held, key=lambda r: r.score)
    ranks = [i for i, r in enumerate(by_score) if r.toxic]
    auc = (np.sum(ranks) - len(ranks) * (len(ranks) - 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.9


def test_copies_of_a_toxic_text_count_once(llm_spark):
    """A word of many copies of one text is no entry, a word of as many different texts is."""
    rows = [("one vexcopy text that comes again and again", 1)] * 20 + [(None, 1), ("", 1)]
    rows += [(f"a grubbish remark number w{'x' * i} of many others", 1) for i in range(20)]
    rows += [(f"a kind remark w{'y' * i} of many", 0) for i in range(20)]
    found = toxicity.mine(llm_spark.createDataFrame(rows, "text string, toxic int"))
    assert any("grubbish".startswith(e.strip()) for e in found)
    assert not any("vexcopy".startswith(e.strip()) for e in found)


def test_toxicity_of_odd_rows(odd_docs, no_docs, llm_spark):
    labels = llm_spark.createDataFrame([(3, 0, 1), (3, 0, 0), (None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.where("false")):
        got = toxicity.toxicity(odd_docs, marks).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert toxicity.toxicity(no_docs, marks).collect() == []


def test_label_model_finds_the_good_voters():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    good = [(r.random(4000) < np.where(y, 0.7, 0.01)) for _ in range(4)]
    bad = r.random(4000) < 0.08
    twin = bad.copy()
    v = np.stack([*good, bad, twin], axis=1).astype(np.int8)
    v = np.concatenate([v, -(v.sum(axis=1, keepdims=True) == 0).astype(np.int8)], axis=1)
    post, rates, rho = toxicity.label_model(v, 0.2)
    assert np.mean((post > 0.5) == y) > 0.95
    assert rho[4, 5] > 0.9 and rho[0, 1] < 0.3


def brute_nearest(data, k=5):
    ok = [(i, np.array(v, float)) for i, v in data
          if i is not None and v is not None and len(v) == 4 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for q, a in ok:
        if q % 50:
            continue
        near = sorted((-float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_neighbours_with_copies_and_unfit_vectors(llm_spark):
    r = np.random.default_rng(1)
    data = [(i, r.normal(size=4).astype(np.float32).tolist()) for i in range(120)]
    data += [(200 + i, data[50][1]) for i in range(0, 60)] + [
        (300, None), (350, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (450, [float("nan")] * 4), (500, [float("inf"), 0.0, 0.0, 1.0]),
        (550, [1.0, 2.0]), (None, data[0][1]), (600, [-0.0, 0.0, 1.0, 0.0]), (601, [0.0, -0.0, 1.0, 0.0])]
    df = llm_spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((q, n, i, round(s, 9)) for q, n, i, s in map(tuple, ann.nearest(df, ann.every_fiftieth(), share=1.0).collect()))
    assert got == brute_nearest(data)
    assert ann.nearest(df.where("vec_id is null"), ann.every_fiftieth()).collect() == []
    assert ann.nearest(df.where("vec_id in (0, 1)"), ann.every_fiftieth()).count() == 1


def test_large_cells_are_spread_over_blocks(llm_spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 2)
    r = np.random.default_rng(2)
    data = [(i, (np.array([1, 2, 3, 4]) + r.normal(size=4) * (0.01 if i % 3 else 1)).tolist()) for i in range(300)]
    df = llm_spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted((q, n, i, round(s, 9)) for q, n, i, s in map(tuple, ann.nearest(df, ann.every_fiftieth(), share=1.0).collect()))
    assert got == brute_nearest(data)


def test_repeated_rows_count_once(llm_spark):
    data = [(1, [1.0, 0.0])] * 12 + [(i, [1.0, 0.0]) for i in range(2, 9)] + [(50, [1.0, 0.1])] * 3
    df = llm_spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, ann.every_fiftieth(), share=1.0).orderBy("rank").collect()]
    assert got == [(50, i + 1, i + 1) for i in range(5)]


def test_the_share_follows_the_vectors():
    """Clustered vectors need a small part of the index, random ones in many dimensions much more."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 32))
    near = ann.unit(centres[r.integers(0, 40, 4000)] + 0.05 * r.normal(size=(4000, 32)))
    far = ann.unit(r.normal(size=(4000, 32)))
    shares = [ann.needed_share(ann.Codebooks(ann.codebook(x[:, :16], 26), ann.codebook(x[:, 16:], 26)), x, 5) for x in (near, far)]
    assert shares[0] < 0.1 < shares[1] <= 1


def test_recall_of_the_query(llm_spark):
    table = llm_spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in registered.QUERIES["op10_inverted_multi_index"](llm_spark, "/root/testdata/sf0.1").collect()}
    ids, x = zip(*sorted((r.vec_id, r.embedding) for r in table.collect()))
    x = np.array(x, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for i in np.flatnonzero(np.array(ids) % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        top = np.lexsort((ids, -s))[:5]
        hits += sum((ids[i], ids[j]) in got for j in top)
        total += 5
    assert hits / total >= 0.9


def test_walk_takes_cells_by_distance():
    r = np.random.default_rng(3)
    a, b, held = r.random(5), r.random(7), r.integers(0, 4, 35)
    cells = ann.walk(a, b, held, held.sum())
    sums = (a[:, None] + b[None, :]).ravel()[cells]
    assert (np.diff(sums) >= 0).all() and len(set(cells.tolist())) == len(cells)
    assert held[cells].sum() == held.sum()
    assert held[ann.walk(a, b, held, 10)[:-1]].sum() < 10


def test_shards(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        got = sharding.shard_documents(df).collect()
        want = sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect()), key=str)
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
        assert all(r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 for r in got)
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(no_docs).collect() == []


def test_a_changed_weight_moves_rows_only_through_its_subtree(llm_spark):
    ids = llm_spark.range(20_000)
    before = sharding.tree()
    heavy = sharding.Node("1", (), 3.0)
    rack = sharding.Node("r0k0", (before.children[0].children[0].children[0], heavy, *before.children[0].children[0].children[2:]))
    after = sharding.Node("root", (sharding.Node("r0", (rack, *before.children[0].children[1:])), before.children[1]))
    got = sharding.place(sharding.place(ids, ids["id"], before, "a"), ids["id"], after, "b").collect()
    moved = [r for r in got if r.a != r.b]
    for r in moved:         # into the region, into the rack, or to the shard itself
        assert (r.a >= 12 and r.b < 12) or (4 <= r.a < 12 and r.b < 4) or (r.a < 4 and r.b == 1)
    assert moved
    share = Counter(r.b for r in got)[1] / len(got)
    assert abs(share - 3 / 26) < 0.02


def test_licences(llm_spark):
    mit = ". ".join(s.capitalize() for n, s in licences.SENTENCES.items() if n in ("mit-grant", "mit-condition", "mit-warranty")) + "."
    data = [(1, "Hello.\n" + mit + " Bye."), (2, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
            (3, "not a licence"), (4, None), (5, ""), (6, "Licensed under the Apache License, Version 2.0.\n" * 3), (None, "x license")]
    df = llm_spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_rules) for r in licences.scan(df).collect()}
    assert got == {1: ("MIT", 1), 2: ("CC-BY-NC-4.0,MIT", 2), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("Apache-2.0", 1), None: ("", 0)}
    assert all(any(m in s for m in licences.MARKS) for s in licences.SENTENCES.values())
    assert licences.scan(df.where("false")).collect() == []


def test_small_tables_have_all_neighbours(llm_spark):
    rng = np.random.default_rng(4)
    for n in (8, 9, 11):
        data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 8)))]
        df = llm_spark.createDataFrame(data, "vec_id long, embedding array<double>")
        found = Counter(r.query_id for r in ann.nearest(df, F.lit(True)).collect())
        assert found == {i: 5 for i in range(n)}


_WRAPPED = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you
may not use this file except in compliance with the License. You may obtain
a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""}


def test_wrapped_licences(llm_spark):
    marked = [("", "", ""), ("# ", "", ""), (";; ", "", ""), (" * ", "/*\n", "\n */"), ("// ", "x = 1\r\n", "\r\ny")]
    data = [(f"{name} {i}", head + "\n".join(mark + line for line in text.split("\n")) + tail)
            for name, text in _WRAPPED.items() for i, (mark, head, tail) in enumerate(marked)]
    data += [("none 0", "This is not\nreleased under the MIT license\n\nof the kind"), ("none 1", "released under\n\nthe MIT license"),
             ("none 2", "It is not released under the MIT license.")]
    got = {r.doc_id: (r.licences, r.n_rules) for r in licences.scan(
        llm_spark.createDataFrame(data, "doc_id string, text string")).collect()}
    want = {doc: (doc.split(" ")[0], 1) for doc, _ in data} | {"none 0": ("", 0), "none 1": ("", 0), "none 2": ("", 0)}
    assert got == want


_MORE = {
    "BSD-3-Clause": _WRAPPED["BSD-2-Clause"] + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": _WRAPPED["GPL-3.0-or-later"].replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU\nAffero General"),
    "Unlicense": "This is free and unencumbered software released into the public\ndomain.\n",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "GPL-2.0-only": "// SPDX-License-Identifier: GPL-2.0-only\nint main() {}",
    "Apache-2.0": "/* SPDX-License-Identifier: Apache-2.0 */",
    "CC0-1.0": "x = 1\n# SPDX-License-Identifier: CC0-1.0"}


def licence_texts():
    data = [(i, text) for i, text in enumerate([*_MORE.values(), *_WRAPPED.values()])]
    marked = [(100 + i, "\n".join(" * " + line for line in text.split("\n"))) for i, text in data]
    odd = ["This was never\nlicensed under CC BY 4.0.", "It is not\n\nlicensed under CC BY 4.0.", "a\x01licensed under CC BY 4.0\x02b", None, "",
           "license " * 3000, "Licensed under CC BY 4.0; licensed under CC BY-NC 4.0: released under the MIT license"]
    return data + marked + [(200 + i, text) for i, text in enumerate(odd)]


def test_more_licences(llm_spark):
    df = llm_spark.createDataFrame(licence_texts(), "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_rules) for r in licences.scan(df).collect()}
    for i, name in enumerate([*_MORE, *_WRAPPED]):
        assert got[i] == (name, 1), name
        if "SPDX" not in dict(licence_texts())[i]:
            assert got[100 + i] == (name, 1), name
    assert got[200] == ("", 0) and got[201] == ("CC-BY-4.0", 1) and got[206][0] == "CC-BY-NC-4.0,CC-BY-4.0,MIT"


def test_licence_sql_on_wrapped_texts(llm_spark):
    """The SQL is that of the registered function, wrapped sentences and all."""
    texts = pd.DataFrame(licence_texts(), columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", texts)
    want = sorted((tuple(r) for r in con.execute(licences.scan_sql()).fetchall()), key=str)
    df = llm_spark.createDataFrame(licence_texts(), "doc_id long, text string")
    assert rows(licences.scan(df)) == want


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_sql(llm_spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"create view {name_} as select * from '{SF}/{name_}.parquet'")
    df = registered.QUERIES[name](llm_spark, SF)
    rel = con.execute(registered.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns) and rows(df) == want


def test_every_operator_has_one_query():
    numbers = [q.split("_")[0] for q in registered.QUERIES if q != "pipeline"]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14))
