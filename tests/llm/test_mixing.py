"""Mixtures: shares, repeats, balance of the sample."""

import random

import pytest

from strandline.llm import mixing as M
from strandline.sources.tables import table

DOCS = "doc_id long, text string, source string, name string, tokens string, p int"
TARGETS = "source string, target_share double, max_repeats long"


def test_shares_of_the_whole_table(spark):
    docs, targets = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "mix_targets"))
    report = {r.source: r for r in M.shares(spark, docs, targets).collect()}
    assert {*report} == {r.source for r in targets.collect()}
    there = sum(r.target_share for r in report.values() if r.tokens_used)
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9
    for r in report.values():
        assert r.most_copies <= r.max_repeats
        if r.tokens_used:
            assert abs(r.reached_share - r.target_share / there) < 0.006  # a few documents a source
    assert report["changelog"].tokens_used == 0


def test_cases(spark):
    rows = [(i, "some words of text " * (1 + i % 5), s, "clash", "clash", 1) for i, s in enumerate(["A", "a ", "a", "b-b", "B_B", "bs", None, "other", "b b", "a"])]
    rows += [(None, "a text", "a", "", "", 1), (99, None, "a", "", "", 1), (98, "", "a", "", "", 1), (0, "some words", "A", "", "", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b_b", 0.3, 3), ("none", 0.2, 1), (None, 0.1, 1)], TARGETS)
    got = M.mixture(spark, docs, targets).collect()
    assert {r.source for r in got} == {"a", "b_b"} and all(r.copies <= 3 for r in got) and not {6, 7, 98, 99} & {r.doc_id for r in got}
    again = M.mixture(spark, docs.repartition(5), targets).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert M.mixture(spark, docs.limit(0), targets).count() == 0 and M.mixture(spark, docs, targets.limit(0)).count() == 0
    assert M.shares(spark, docs.limit(0), targets).where("reached_share > 0").count() == 0


def test_flight_keeps_both_sums():
    rnd = random.Random(3)
    for n in (1, 2, 3, 50, 2000):
        w = [rnd.randrange(1, 900) for _ in range(n)]
        p = M.flight([0.37] * n, w, rnd)
        assert sum(0 < x < 1 for x in p) <= 2
        assert abs(sum(p) - 0.37 * n) < 1e-6 and abs(sum(a * b for a, b in zip(p, w)) - 0.37 * sum(w)) < 1e-3 * n
        q = M.land(p, w)
        assert {*q} <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(q, w)) - 0.37 * sum(w)) <= 900
    assert M.flight([0.5, 0.5, 0.5, 0.5], [7, 7, 7, 7], rnd).count(1.0) == 2


def test_flight_is_unbiased():
    hits, n, w = [0] * 12, 4000, [5, 9, 100, 3, 44, 8, 61, 7, 7, 30, 2, 15]
    rnd = random.Random(5)
    for _ in range(n):
        for i, x in enumerate(M.flight([0.3] * 12, w, rnd)):
            hits[i] += x
    assert all(abs(h / n - 0.3) < 0.04 for h in hits)


def test_blocks_meet(spark):
    rows = [(i, "hot" if i % 3 else "cold", 1 + i * 7 % 400, 0.4) for i in range(3000)]
    units = spark.createDataFrame(rows, "doc_id long, name string, tokens long, p double")
    got = M.balanced_sample(units, {"hot": 2000, "cold": 1000}, block=64).collect()
    assert len(got) == 3000 and {r.p for r in got} == {0.0, 1.0}
    for name in ("hot", "cold"):
        want = sum(t * p for _, n, t, p in rows if n == name)
        assert abs(sum(r.tokens * r.p for r in got if r.name == name) - want) < 400


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_shares_miss_by_less_than_a_document(spark, sf):
    docs, targets = (table(spark, f"/root/testdata/{sf}", t) for t in ("documents", "mix_targets"))
    mixed = M.mixture(spark, docs, targets).collect()
    wanted = {r.source: r for r in targets.collect()}
    total = sum(r.tokens * r.copies for r in mixed)
    used = {s: sum(r.tokens * r.copies for r in mixed if r.source == s) for s in wanted}
    there = sum(r.target_share for s, r in wanted.items() if used[s])
    assert all(r.copies <= wanted[r.source].max_repeats for r in mixed) and len({r.doc_id for r in mixed}) == len(mixed)
    for s, n in used.items():
        if n:
            assert abs(n - total * wanted[s].target_share / there) <= max(r.tokens for r in mixed if r.source == s)
    if sf == "sf0.1":
        assert all(abs(n / total - wanted[s].target_share / there) < 1e-4 for s, n in used.items() if n)


def test_a_document_that_exceeds_its_sources_part(spark):
    """It is no capacity: the mixture is as large as the other documents allow."""
    words = lambda i, n: (i, " word" * n, None)
    rows = [(*words(i, 20)[:2], "a", "", "", 1) for i in range(200)]
    rows += [(*words(1000 + i, 10)[:2], "b", "", "", 1) for i in range(10)] + [(2000, " word" * 1500, "b", "", "", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 4)], TARGETS)
    got = {r.source: r for r in M.shares(spark, docs, targets).collect()}
    assert got["b"].tokens_used == 400 and got["a"].tokens_used == 1600 and abs(got["b"].reached_share - 0.2) < 1e-9
    # a source that has nothing smaller gives one copy of it, or nothing
    only = spark.createDataFrame([*rows[:200], (2000, " word" * 1500, "b", "", "", 1)], DOCS)
    got = {r.source: r.tokens_used for r in M.shares(spark, only, targets, total_tokens=4000).collect()}
    assert got == {"a": 3200, "b": 1500}
    got = {r.source: r.tokens_used for r in M.shares(spark, only, targets, total_tokens=3000).collect()}
    assert got == {"a": 2400, "b": 0}


def test_too_many_targets_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_SOURCES", 2)
    targets = spark.createDataFrame([(s, 0.1, 1) for s in "abc"], TARGETS)
    with pytest.raises(ValueError):
        M.mixture(spark, spark.createDataFrame([], DOCS), targets)
