"""Every stage of the pipeline against brute force, on the table and on odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from soundpairs.llm import lang_id, toxicity
from soundpairs.llm.common import BATCH_BYTES
from tests.llm.conftest import SF
from tests.llm.test_dedup import brute_near
from tests.llm.test_tokens import check_packing

STAGES = dict(cp.STAGES)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == [
        "toxicity", "language ID", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]


def test_filters_follow_their_operators(llm_spark, docs):
    labels = llm_spark.read.parquet(f"{SF}/labels.parquet")
    left = STAGES["toxicity"](llm_spark, docs, SF)
    assert left.columns == docs.columns
    wanted = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted}
    assert set(by_id(left)) == wanted and 0.7 * docs.count() < len(wanted)
    left = STAGES["language ID"](llm_spark, docs, SF)
    assert left.columns == docs.columns
    assert set(by_id(left)) == {r.doc_id for r in lang_id.identify(docs).collect() if not r.rejected}


def test_one_of_each_group_stays(llm_spark, docs):
    left = STAGES["MinHash near-dedup"](llm_spark, docs, SF)
    want = {d for d, _, _, kept in brute_near([(r.doc_id, r.text) for r in docs.collect()]) if kept}
    assert set(by_id(left)) == want and left.count() == len(want) and left.columns == docs.columns


def test_passages_go_and_counts_follow(llm_spark, docs):
    left, whole = by_id(STAGES["suffix-array dedup"](llm_spark, docs, SF)), by_id(docs)
    seen = {}
    for r in whole.values():
        b = r.text.encode()
        for i in range(len(b) - 199):
            seen[b[i:i + 200]] = seen.get(b[i:i + 200], 0) + 1
    for doc, r in whole.items():
        b, gone = r.text.encode(), bytearray(len(r.text.encode()))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        want = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        assert left[doc].text == want and left[doc].lang == r.lang
        assert left[doc].n_chars == (len(want) if any(gone) else r.n_chars)


def test_the_whole(llm_spark, docs):
    got = cp.run(llm_spark, SF).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    used, least = check_packing(docs, STAGES["best-fit packing"](llm_spark, docs, SF).collect())
    assert used <= 1.02 * least + 1


def test_odd_rows_and_no_rows(llm_spark, odd_docs, no_docs):
    for df in (odd_docs, no_docs.withColumn("predicted", F.lit(1))):
        for name, step in cp.STAGES[:-1]:
            out = step(llm_spark, df, SF)
            assert out.columns == df.columns and out.count() <= df.count(), name
        assert cp.STAGES[-1][1](llm_spark, df, SF).count() >= df.count()


def test_batches_are_bounded_by_bytes(llm_spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    size, rows = 100_000, 300
    docs = llm_spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), size).alias("text"))
    step = cp.stage(lambda spark, df, sf_dir: df.mapInArrow(sizes, "n long, bytes long"))
    got = step(llm_spark, docs, SF).collect()
    assert sum(r.n for r in got) == rows and max(r.bytes for r in got) < BATCH_BYTES + 2 * size


def test_a_text_goes_to_the_workers_once(llm_spark, docs):
    clash = docs.select("doc_id", "text", F.lit("clash").alias("_text"))
    lex = toxicity.lexicon([])
    for name, fn, model in (
            ("predicted", toxicity.score, toxicity.Model(lex, np.ones(lex.voters + toxicity.PATTERNS + 1))),
            ("rejected", lang_id.predict, lang_id.Model(
                np.ones(lang_id.DIM, np.float32), np.zeros((0, lang_id.DIM), np.float32), [], np.zeros(32)))):
        whole = fn(docs, model, ["doc_id", "text"])
        assert "_text" not in whole._jdf.queryExecution().toString()
        for keep in (["doc_id", "text"], ["_text", "text", "doc_id"], ["doc_id"]):
            out = fn(clash, model, keep)
            assert out.columns[:len(keep)] == keep
            assert by_id(out.select("doc_id", name)) == by_id(whole.select("doc_id", name))
