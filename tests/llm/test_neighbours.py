"""Nearest vectors against brute force."""

import numpy as np
import pytest

from strandline.llm import neighbours as N
from strandline.sources.tables import table

SCHEMA = "response_id long, chunk_id long, embedding_model string, embeddings array<array<float>>, id long, u string"


def brute(rows, k=5, least=0.9):
    """rows: (chunk_id, embeddings) -> ids, and the true similarities."""
    v = {}
    for c, e in rows:
        if c is None or e is None or len(e) != 1 or e[0] is None or len(e[0]) != 64 or any(x is None for x in e[0]):
            continue
        a = np.array(e[0], dtype=np.float64)
        if np.isfinite(a).all() and a.any():
            v[c] = a / np.linalg.norm(a)
    ids = sorted(v)
    x = np.array([v[i] for i in ids])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return ids, s


def expected(ids, s, k=5, least=0.9):
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_and_precision(spark, sf):
    responses = table(spark, f"/root/testdata/{sf}", "embed_responses")
    ids, s = brute([tuple(r) for r in responses.select("chunk_id", "embeddings").collect()])
    want = expected(ids, s)
    rows = N.similar_pairs(responses).collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got) and all(a < b for a, b in got)
    assert len(got & want) >= 0.97 * len(want)
    at = {c: k for k, c in enumerate(ids)}
    assert all(s[at[a], at[b]] >= 0.9 - 1e-6 for a, b in got)
    assert len(got - want) <= 0.02 * len(want) + 2  # ties


def test_cases(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=64)
    near = base + rnd.normal(size=64) * 0.03
    vecs = [[base.tolist()], [(base * 7).tolist()], [near.tolist()], [(-base).tolist()], [rnd.normal(size=64).tolist()], [[0.0] * 64], [[float("nan")] + [1.0] * 63], [[float("inf")] + [1.0] * 63], [[1.0] * 63], [], None, [None], [base.tolist(), base.tolist()], [[None] + [1.0] * 63]]
    rows = [(i, i, None, v, i, "clash") for i, v in enumerate(vecs)] + [(90, 0, "m", vecs[0], 1, ""), (91, None, "m", vecs[0], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.chunk_id, r.neighbour): r.similarity for r in N.nearest(df).collect()}
    assert {*got} == {(a, b) for a in (0, 1, 2) for b in (0, 1, 2) if a != b}
    assert got[0, 1] == 1.0 and 0.99 < got[0, 2] < 1
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert N.nearest(df.limit(0)).count() == 0 and N.nearest(df.where("chunk_id = 4")).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    rnd = np.random.default_rng(5)
    hot = rnd.normal(size=64).tolist()
    rows = [(i, i, None, [hot if i % 3 == 0 else rnd.normal(size=64).tolist()], 0, "") for i in range(3000)]
    got = N.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    per = {}
    for r in got:
        per.setdefault(r.chunk_id, set()).add(r.neighbour)
    assert {*per} == {*range(0, 3000, 3)} and all(len(v) == 5 and c not in v for c, v in per.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_gives_every_vector_its_nearest(spark, sf):
    from strandline.llm import queries

    ids, s = brute([tuple(r) for r in table(spark, f"/root/testdata/{sf}", "embed_responses").select("chunk_id", "embeddings").collect()])
    at, per = {c: k for k, c in enumerate(ids)}, {}
    for r in queries.p2_nearest(spark, f"/root/testdata/{sf}").collect():
        assert abs(s[at[r.chunk_id], at[r.neighbour]] - r.similarity) < 1e-5
        per.setdefault(r.chunk_id, []).append(r.similarity)
    assert {*per} == {*ids} and all(len(v) == 5 for v in per.values())
    # by similarity, so that ties don't matter
    kth = np.sort(s, axis=1)[:, -5]
    assert sum(x >= kth[at[c]] - 1e-6 for c, v in per.items() for x in v) >= 0.99 * 5 * len(ids)


def test_nearest_without_a_floor(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    vecs = rnd.normal(size=(300, 64))
    vecs[200:220] = vecs[7]
    rows = [(i, i, None, [v.tolist()], 0, "") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, SCHEMA)
    ids, s = brute([(r[1], r[3]) for r in rows])
    monkeypatch.setattr(N, "PROBED", N.CELLS)
    want = {i: np.sort(s[i])[-5:] for i in ids}
    for members, asking in ((16_384, 500_000), (20, 100)):
        monkeypatch.setattr(N, "MEMBERS", members)
        monkeypatch.setattr(N, "ASKING", asking)
        got: dict = {}
        for r in N.nearest_any(df).collect():
            got.setdefault(r.chunk_id, {})[r.neighbour] = r.similarity
        assert all(len(got[i]) == 5 and i not in got[i] and np.allclose(sorted(got[i].values()), want[i], atol=1e-5) for i in ids)
    assert N.nearest_any(df.limit(0)).count() == 0 and N.nearest_any(df.where("chunk_id = 4")).count() == 0
    assert N.nearest_any(df.where("chunk_id < 4")).count() == 12


@pytest.mark.parametrize("s", [16, 18])
def test_every_code_within_the_radius_is_retrieved(spark, s):
    rnd = np.random.default_rng(s)
    bits = rnd.integers(0, 2, (400, N.TABLES * s))
    for i in range(100, 400):  # codes at every distance of the first hundred
        bits[i] = bits[i % 100]
        bits[i, rnd.permutation(N.TABLES * s)[: i % (N.GUARANTEED + 4)]] ^= 1
    subs = (bits.reshape(400, N.TABLES, s) * (1 << np.arange(s))).sum(axis=2)
    rows = [(i, int(a | b << 32), int(c | d << 32)) for i, (a, b, c, d) in enumerate(subs)]
    codes = spark.createDataFrame(rows, "id long, w0 long, w1 long")
    got = [tuple(r) for r in N.candidate_pairs(N.entries(codes, s), s).collect()]
    apart = (bits[:, None] != bits[None]).sum(axis=2)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if apart[i, j] <= N.GUARANTEED}
    assert len(got) == len(set(got)) and want <= set(got)
    assert all(a < b and apart[a, b] <= max(N.GUARANTEED, np.ceil(N.FURTHER * N.TABLES * s)) for a, b in got)


def test_near_equal_vectors_in_great_number(spark, monkeypatch):
    rnd = np.random.default_rng(11)
    vecs = rnd.normal(size=(1200, 64))
    vecs[:400] = vecs[0] + rnd.normal(size=(400, 64)) * 0.02  # a third of all, all alike, no two the same
    vecs[400:600] = vecs[400] + rnd.normal(size=(200, 64)) * 0.2
    rows = [(i, i, None, [v.tolist()], 0, "") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, SCHEMA)
    ids, s = brute([(r[1], r[3]) for r in rows])
    want = expected(ids, s)
    monkeypatch.setattr(N, "HOT", 60)
    monkeypatch.setattr(N, "BLOCK", 150)
    codes = N._codes(N._classes(df, 5, 64)[2], 16)
    index = [r.key for r in N.entries(codes, 16).collect()]
    counts = {k: index.count(k) for k in set(index)}
    assert {r.key for r in N.hot_keys(codes, 16).collect()} == {k for k, n in counts.items() if n > 60} != set()
    got = {tuple(r) for r in N.similar_pairs(df).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_pairs_that_meet_in_vain_are_not_shuffled(spark):
    rnd = np.random.default_rng(12)
    vecs = rnd.normal(size=64) * 1.6 + rnd.normal(size=(500, 64))  # all of one topic, at about 0.7
    vecs[250:] = vecs[:250] + rnd.normal(size=(250, 64)) * np.linspace(0.05, 1.0, 250)[:, None]
    df = spark.createDataFrame([(i, i, None, [v.tolist()], 0, "") for i, v in enumerate(vecs)], SCHEMA)
    x = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    s = x @ x.T
    codes = N._codes(N._classes(df, 5, 64)[2], 16).selectExpr("id", "0L AS w0", "0L AS w1", "q")  # all meet
    index = N.entries(codes, 16)
    all_ = {tuple(r) for r in N.candidate_pairs(index.drop("q"), 16).collect()}
    left = {tuple(r) for r in N.candidate_pairs(index, 16, 0.9).collect()}
    near = {p for p in all_ if s[p] >= 0.9}
    assert near <= left <= all_ and len(near) > 50 and len(all_) == 500 * 499 // 2
    assert all(s[p] > 0.8 for p in left) and len(left) < len(all_) / 4


def test_bytes_are_as_near_as_their_bound():
    rnd = np.random.default_rng(13)
    for x in (rnd.normal(size=(2000, 64)), rnd.normal(size=(2000, 64)) ** 9, np.eye(64), rnd.normal(size=(50, 3))):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        unit, off = N._rounded(np.rint(u / np.abs(u).max(axis=1, keepdims=True) * 127).astype(np.int8))
        assert (np.linalg.norm(u - unit, axis=1) <= off).all()


def test_a_clean_cut_leaves_no_shuffle_files(spark):
    from strandline.session import CLEANUP, cut

    def files():
        infos = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle" in infos.apply(i).getName() for i in range(infos.size()))

    before = files()
    got = cut(spark.range(1000).repartition(3, "id").groupBy("id").count(), clean=True)
    assert files() == before and got.count() == 1000 and spark.conf.get(CLEANUP) == "false"
    kept = cut(spark.range(1000).repartition(3, "id").groupBy("id").count())
    assert files() > before and kept.count() == 1000
