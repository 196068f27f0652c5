import numpy as np
import pytest

from soundpairs.operators import similarity


def vectors(spark, m, start=0):
    return spark.createDataFrame(
        [(start + i, [float(x) for x in row]) for i, row in enumerate(m)], "audio_id long, embedding array<float>")


def brute(q, c, k, self_too=False):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(q.astype("f4").astype("f8")) @ unit(c.astype("f4").astype("f8")).T, 9)
    out = {}
    for i, row in enumerate(sims):
        order = sorted((j for j in range(len(c)) if self_too or j != i), key=lambda j: (-row[j], j))
        out[i] = order[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["neighbor_id"])
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    m = rng.standard_normal((240, 12))
    m[100:180] = m[100]             # a third of the rows are copies of one vector
    return m


@pytest.mark.parametrize("bound", [1000, 0])
def test_nearest_is_exact_both_ways(spark, cloud, monkeypatch, bound):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 50)
    monkeypatch.setattr(similarity, "CORPUS_BLOCK", 70)
    monkeypatch.setattr(similarity, "STRIPE", 32)
    df = vectors(spark, cloud).repartition(3)
    got = similarity.nearest(df, df, 4, max_broadcast=bound)
    assert found(got) == brute(cloud, cloud, 4)


def test_nearest_keeps_self_on_request_and_small_corpora(spark):
    m = np.eye(3)
    df = vectors(spark, m)
    got = similarity.nearest(df, df, 10, exclude_self=False)
    assert found(got) == {0: [0, 1, 2], 1: [1, 0, 2], 2: [2, 0, 1]}
    assert similarity.nearest(df.where("false"), df, 2).count() == 0


def test_zero_vector_is_near_nothing(spark):
    m = np.array([[1.0, 0], [0.5, 0.5], [0, 0]])
    df = vectors(spark, m)
    assert found(similarity.nearest(df, df, 5)) == {0: [1], 1: [0]}


@pytest.mark.parametrize("bound", [1000, 0])
def test_score_is_the_full_product(spark, cloud, monkeypatch, bound):
    monkeypatch.setattr(similarity, "SCORE_BLOCK", 60)
    prompts = vectors(spark, cloud[:20]).withColumnRenamed("audio_id", "prompt_id")
    got = similarity.score(vectors(spark, cloud), prompts, max_broadcast=bound).collect()
    unit = cloud / np.linalg.norm(cloud, axis=1, keepdims=True)
    want = unit @ unit[:20].T
    assert len(got) == 240 * 20 and len({(r[0], r[1]) for r in got}) == 4800
    assert all(abs(r["sim"] - want[r["audio_id"], r["prompt_id"]]) < 1e-6 for r in got)


def test_approx_is_whole_and_mostly_right(spark, cloud, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 30)
    monkeypatch.setattr(similarity, "CORPUS_BLOCK", 25)
    df = vectors(spark, cloud).repartition(3)
    got = found(similarity.nearest_approx(df, df, 5, tables=8, bits=4, complete=True))
    exact = brute(cloud, cloud, 5)
    assert sorted(got) == list(range(240)) and {len(v) for v in got.values()} == {5}
    hits = sum(len(set(got[i]) & set(exact[i])) for i in got)
    assert hits / (240 * 5) > 0.8
    # one table of many bits leaves most rows alone in their bucket: answered exactly instead
    lonely = found(similarity.nearest_approx(df, df, 5, tables=1, bits=16, complete=True))
    assert all(len(v) == 5 for v in lonely.values()) and lonely[0] == exact[0]


def test_captions(spark, cloud):
    audio = vectors(spark, cloud[:6])
    text = spark.createDataFrame([(0, "zero"), (3, "three"), (5, "five")], "audio_id long, caption string")
    got = similarity.caption_evidence(audio, audio.join(text, "audio_id"), 2).collect()
    texts = {0: "zero", 3: "three", 5: "five"}
    assert len(got) == 12
    for r in got:
        assert r["evidence"] == texts[r["neighbor_id"]] and r["neighbor_id"] != r["audio_id"]
        assert r["caption"] == (r["evidence"] if r["rank"] == 1 else None)


def test_embed_loads_once_per_task(spark, tmp_path):
    log = tmp_path / "loads"
    log.mkdir()

    def factory():
        import os
        import uuid
        (log / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return lambda texts: [[float(len(t))] * 2 for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id long, text string").repartition(2)
    got = similarity.embed(df, "text", factory).collect()
    assert all(list(r["embedding"]) == [len(r["text"])] * 2 for r in got) and len(got) == 50
    assert len(list(log.iterdir())) == 2


def test_probed_neighbours_have_the_recall(spark):
    """Of the exact nearest, without any completion; and the hash planes are those of the formula."""
    audio = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as audio_id", "embedding")
    near = {(r["query_id"], r["neighbor_id"]) for r in similarity.nearest(audio, audio, 5).collect()}
    found = {(r["query_id"], r["neighbor_id"]) for r in similarity.nearest_probed(audio, audio, 5).collect()}
    assert len(near & found) / len(near) >= 0.9
    assert [similarity.probe_bits(n) for n in (0, 31, 32 * 15, 32 * 16, 2000, 10**9)] == [4, 4, 4, 5, 6, 25]


def test_one_full_bucket_is_cut(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CORPUS_BLOCK", 7)
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 5)
    df = spark.createDataFrame([(f"c{i:03}", [1.0, 0.5, 0.25]) for i in range(60)], "audio_id string, embedding array<double>")
    got = {}
    for r in similarity.nearest_probed(df, df, 3).collect():
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    for q, near in got.items():
        assert sorted(near) == [f"c{i:03}" for i in range(5) if f"c{i:03}" != q][:3]
    assert len(got) == 60


def test_few_cells_are_ordered(monkeypatch):
    """Once k neighbours are known, cells that can't enter are passed over, also with ties, twins and zero vectors."""
    kept, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **how: kept.append(np.size(keys[0])) or real(keys, **how))
    monkeypatch.setattr(np, "partition", lambda a, *rest, f=np.partition, **how: kept.append(np.size(a)) or f(a, *rest, **how))
    m = np.random.default_rng(5).standard_normal((10 * similarity.STRIPE, 16))
    m[40], m[9000], m[50] = m[30], m[30], 0
    ids = np.arange(len(m)) // 2 * 2                                    # ids come twice
    with np.errstate(invalid="ignore"):
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = similarity._Best(ids[:60], unit[:60], 5, True)
    best.add(ids, unit)
    assert sum(kept) < 0.2 * 60 * len(m)
    sims = np.round(np.clip(unit[:60] @ unit.T, -1, 1), similarity.TIE_DIGITS)
    want = [(ids[i], ids[j], sims[i, j]) for i in range(60) for j in sorted(
        (j for j in range(len(m)) if ids[j] != ids[i] and sims[i, j] > -2), key=lambda j: (-sims[i, j], ids[j]))[:5]]
    assert sorted(best.rows().itertuples(index=False, name=None)) == sorted(want)
