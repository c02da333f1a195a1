"""Problem 7: mixing sources to target weights by cube-method balanced sampling.

The mixture is the largest in which every source that has tokens can keep its share with
documents that are no larger than its part, none of them used more often than its source
allows: a document larger than the part would by itself exceed it, so it is no capacity
and isn't drawn (only where a source has no other, its smallest one may be). That size is the greatest fixed point of a falling sequence of bounds
(``plan``). A source then needs ``e`` copies of each of these documents on average:
floor(e) of each, and one more of a balanced sample with inclusion probability
e - floor(e). A source's tokens miss its part by less than its largest drawn document.

The sample is drawn by the flight phase of the cube method (Deville and Tille; the fast
variant of Chauvet and Tille): three units at a time move along the null space of the
two constraints, their number and their tokens, until one of them is in or out. It runs
in blocks of at most about ``BLOCK`` documents of one source; what a block leaves
undecided (two documents at most) meets the rest of other blocks in the next round, so a
source of any size is spread over tasks, and both totals stay exact until the last
sixteen documents of a source are landed together. Only the few rows of the targets and of the
totals by source reach the driver; their number is checked.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import cut

from .corpus_encoding import default_pattern, default_vocabulary, encoder_of, vocabulary_bytes

BLOCK, SEED = 4096, 17
#: Documents of a source that only the landing decides, with the two left by the flight.
HELD = 14
#: Documents are drawn in strata of falling size, as parts of their source's tokens in the
#: mixture: what a stratum gives too much or too little the next, of smaller documents,
#: makes good.
STRATA = (0.02, 0.002)
#: Rows of the targets, at most; more are an error.
MOST_SOURCES = 10_000
#: Fractions of a copy this near to none or one are none or one.
EPS = 1e-9


def source_key(c: Column) -> Column:
    """A source's name without differences of case, separators and blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def with_tokens(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, name, tokens) of every document; null and empty texts have 0 tokens."""
    import pyarrow as pa

    data = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary or default_vocabulary()))
    split = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(data.value, split).encode
        for b in batches:
            n = [len(encode(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "name", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), source_key(F.col("source")).alias("name"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, name string, tokens long")


def flight(p: list[float], w: list[int], rnd: random.Random) -> list[float]:
    """Inclusion probabilities after the flight: all but two at most are 0 or 1, and
    the sums of p and of p * w are what they were."""
    p = list(p)
    active = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (w[c] - w[b], w[a] - w[c], w[b] - w[a])
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u) if v)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u) if v)
            step = up if rnd.random() * (up + down) < down else -down
            for i2, v in zip(active, u):
                p[i2] = min(1.0, max(0.0, p[i2] + step * v))
            still = [i2 for i2 in active if EPS < p[i2] < 1 - EPS]
            for i2 in active:
                if i2 not in still:
                    p[i2] = float(round(p[i2]))
            if len(still) == 3:  # rounding held all of them back
                k = min(active, key=lambda i3: min(p[i3], 1 - p[i3]))
                p[k] = float(round(p[k]))
                still.remove(k)
            active = still
    if len(active) == 2 and w[active[0]] == w[active[1]]:  # one more step keeps both sums
        a, b = active
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if rnd.random() * (up + down) < down else -down
        p[a], p[b] = p[a] + step, p[b] - step
        for i in (a, b):
            if not EPS < p[i] < 1 - EPS:
                p[i] = float(round(p[i]))
    return p


def land(p: list[float], w: list[int]) -> list[float]:
    """Decides the last units together: of all choices that whose tokens, and less so
    whose number, are nearest to what is expected."""
    import numpy as np

    rest = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    if not rest:
        return p
    want, count = sum(p[i] * w[i] for i in rest), sum(p[i] for i in rest)
    bits = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
    off = np.abs(bits @ np.array([w[i] for i in rest]) - want) + 2 * np.abs(bits.sum(axis=1) - count)
    out = list(p)
    for i, x in zip(rest, bits[int(off.argmin())]):
        out[i] = float(x)
    return out


def balanced_sample(units: DataFrame, counts: dict[str, int], block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """units (doc_id, name, tokens, p) with p turned into 0 or 1; ``counts`` has the number
    of units of each name (one for each source: at most ``MOST_SOURCES``)."""
    import pyarrow as pa

    def step(final: bool, round_no: int):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("tokens", "ascending")])
            p, w = t.column("p").to_pylist(), t.column("tokens").to_pylist()
            name, b = t.column("name")[0].as_py(), t.column("block")[0].as_py()
            rnd = random.Random(f"{seed}|{name}|{b}|{round_no}")
            held = min(HELD, len(p)) if final else 0  # they fly no further, but land
            p = p[:held] + flight(p[held:], w[held:], rnd)
            if final:
                p = land(p, w)
            return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).select(["doc_id", "name", "tokens", "h", "p"])

        return run

    schema = "doc_id long, name string, tokens long, h long, p double"
    now = units.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    most, round_no, done = max([1, *counts.values()]), 0, None
    while True:
        blocks = math.ceil(most / block)
        if blocks > 1 and round_no == 0:  # a small source needs no more blocks than its own rows fill
            own = units.sparkSession.createDataFrame([(k, math.ceil(v / block)) for k, v in counts.items()], "name string, own long")
            now = now.join(F.broadcast(own), "name", "left").withColumn("block", F.pmod(F.shiftright("h", 3), F.coalesce("own", F.lit(1)))).drop("own")
        else:
            now = now.withColumn("block", (F.pmod(F.shiftright("h", 3 + 7 * round_no), F.lit(blocks)) if blocks > 1 else F.lit(0)).cast("long"))
        flown = now.groupBy("name", "block").applyInArrow(step(blocks == 1, round_no), schema)
        if blocks == 1:
            return flown if done is None else done.unionByName(flown)
        flown = cut(flown)
        fixed = flown.where((F.col("p") == 0) | (F.col("p") == 1))
        done = fixed if done is None else done.unionByName(fixed)
        now = flown.where((F.col("p") > 0) & (F.col("p") < 1))
        most, round_no = 2 * blocks, round_no + 1


def wanted_sources(targets: DataFrame) -> dict[str, tuple[str, float, int]]:
    """name -> (source, share, max repeats); of repeated names the shares add up."""
    rows = targets.select(F.col("source").cast("string").alias("source"), source_key(F.col("source")).alias("name"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("most")).where("source is not null and share > 0 and most > 0").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} rows of targets")
    wanted: dict[str, tuple[str, float, int]] = {}
    for r in rows:
        s = wanted.get(r.name)
        wanted[r.name] = (s[0], s[1] + r.share, s[2]) if s else (r.source, r.share, r.most)
    return wanted


def _totals(rows: DataFrame, parts: dict[str, float]) -> dict[str, tuple[int, int]]:
    """name -> (documents, tokens) of the documents that are no larger than their part."""
    most = rows.sparkSession.createDataFrame(list(parts.items()), "name string, part double")
    fits = rows.join(F.broadcast(most), "name").where(F.col("tokens") <= F.col("part"))
    return {r["name"]: (r["n"], r["tokens"]) for r in fits.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()}


def plan(rows: DataFrame, wanted: dict[str, tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, tuple[float, int, int]]:
    """name -> (part in tokens, documents, tokens of the documents that it may use).

    The size of the mixture begins with what all documents would allow and falls to what
    those allow that fit into their source's part, until it stands: every source then
    has enough, but for those all of whose documents exceed their part, which don't count
    (no size suits them together with the others). A fall at least leaves out a document that alone exceeds the part, so
    there are few rounds; each is one aggregate, of a row for each source.
    """
    have = _totals(rows, {k: float("inf") for k in wanted})
    there = sum(wanted[k][1] for k in have)
    size = float("inf") if total_tokens is None else float(total_tokens)
    fits = have
    while have:
        new = min([size, *(tokens * wanted[k][2] / (wanted[k][1] / there) for k, (_, tokens) in fits.items())])
        if new >= size * (1 - 1e-12) and fits is not have:
            break
        size = new
        fits = _totals(rows, {k: size * wanted[k][1] / there for k in have})
    return {k: (size * wanted[k][1] / there, *fits.get(k, (0, 0))) for k in have}


def _nearest_document(rows: DataFrame, lonely: dict[str, tuple[str, float]]) -> DataFrame:
    """(doc_id, source, tokens, copies): of each source all of whose documents exceed its
    part the smallest one, if with it the source is nearer to its part than with none."""
    most = rows.sparkSession.createDataFrame([(k, s, part) for k, (s, part) in lonely.items()], "name string, source string, part double")
    least = rows.join(F.broadcast(most), "name").groupBy("name", "source", "part").agg(F.min(F.struct("tokens", "doc_id")).alias("d"))
    return least.where(F.col("d.tokens") < 2 * F.col("part")).select("d.doc_id", "source", "d.tokens", F.lit(1).cast("long").alias("copies"))


def _prepared(docs: DataFrame, wanted: dict[str, tuple[str, float, int]]) -> DataFrame:
    """(doc_id, name, tokens) of the documents of wanted sources, computed once."""
    # a plural is another notation of the same source
    known = {f"{k}s": k for k in sorted(wanted, reverse=True)} | {k: k for k in wanted}
    names = docs.sparkSession.createDataFrame(list(known.items()), "key string, target string")
    counted = with_tokens(docs).where("tokens > 0 and name is not null")
    return cut(counted.join(F.broadcast(names), counted["name"] == names["key"]).select("doc_id", F.col("target").alias("name"), "tokens"))


def mixture(spark: SparkSession, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document in the mixture.

    Sources are compared without case, separators and plural; documents of no target
    source, without a source or without a token are not used, nor those larger than
    their source's part (of a source that has only such ones the smallest is used once if
    that is nearer to its part than nothing); a target source without documents gets nothing, and the other
    shares keep their proportions; repeated rows are documents of their own; null ids
    stay null; empty tables give an empty mixture; other columns are not read. More than
    ``MOST_SOURCES`` rows of targets are an error. The same seed draws the same sample.
    """
    wanted = wanted_sources(targets)
    rows = _prepared(docs, wanted)
    plans = plan(rows, wanted, total_tokens)
    parts = spark.createDataFrame([(k, p[0]) for k, p in plans.items()], "name string, part double")
    stratum = sum((F.when(F.col("tokens") <= F.col("part") * x, 1).otherwise(0) for x in STRATA[1:]), F.when(F.col("tokens") <= F.col("part") * STRATA[0], 1).otherwise(0))
    sized = rows.join(F.broadcast(parts), "name").where(F.col("tokens") <= F.col("part")).withColumn("stratum", stratum)
    sums = {(r["stratum"], r["name"]): (r["n"], r["tokens"]) for r in sized.groupBy("stratum", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()}
    name_of = {wanted[k][0]: k for k in plans}
    used: dict[str, int] = {}
    left = {k: tokens for k, (_, _, tokens) in plans.items()}
    mixed = None
    for st in range(len(STRATA) + 1):
        # each stratum is to give its part of what is still to be given, whatever those before gave
        here = {k: (part - used.get(k, 0)) / left[k] if left[k] else 0.0 for k, (part, _, _) in plans.items()}
        copies = [(wanted[k][0], k, min(float(wanted[k][2]), max(0.0, e)), sums.get((st, k), (0, 0))[0]) for k, e in here.items()]
        drawn = cut(_sampled(spark, sized.where(F.col("stratum") == st), copies, seed))
        for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens")).collect():
            k = name_of[r["source"]]
            used[k] = used.get(k, 0) + (r["tokens"] or 0)
        left = {k: v - sums.get((st, k), (0, 0))[1] for k, v in left.items()}
        mixed = drawn if mixed is None else mixed.unionByName(drawn)
    mixed = mixed.where("copies > 0")
    lonely = {k: (wanted[k][0], part) for k, (part, n, _) in plans.items() if not n}
    return mixed.unionByName(_nearest_document(rows, lonely)) if lonely else mixed


def _sampled(spark: SparkSession, rows: DataFrame, copies: list[tuple[str, str, float, int]], seed: int) -> DataFrame:
    """rows with the copies that a (source, name, copies on average, documents) asks for."""
    split = [(name, source, int(math.floor(e + EPS)), max(0.0, e - math.floor(e + EPS)), n) for source, name, e, n in copies]
    base = F.broadcast(spark.createDataFrame([x[:4] for x in split], "name string, source string, whole long, p double"))
    units = rows.select("doc_id", "name", "tokens").join(base, "name")
    sample = balanced_sample(units.where(F.col("p") > EPS).select("doc_id", "name", "tokens", "p"), {x[0]: x[4] for x in split if x[3] > EPS}, seed=seed)
    sampled = sample.join(base.select("name", "source", "whole"), "name").select("doc_id", "source", "tokens", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    return sampled.unionByName(units.where(F.col("p") <= EPS).select("doc_id", "source", "tokens", F.col("whole").alias("copies")))


def shares(spark: SparkSession, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """The report: a row for each target source with the share that was reached."""
    mixed = mixture(spark, docs, targets, total_tokens, seed)
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    all_ = used.agg(F.sum("tokens_used").alias("total"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = wanted.join(used, "source", "left").join(F.broadcast(all_))  # one row
    zero = F.lit(0).cast("long")
    return out.select("source", "target_share", "max_repeats", F.coalesce("documents_used", zero).alias("documents_used"), F.coalesce("tokens_used", zero).alias("tokens_used"), F.coalesce("most_copies", zero).alias("most_copies"), F.coalesce(F.col("tokens_used") / F.col("total"), F.lit(0.0)).alias("reached_share"))
