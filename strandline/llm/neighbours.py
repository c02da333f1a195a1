"""Problem 2: the most similar vectors of every vector, by multi-index hashing.

1. Vectors are normalised; those that point the same way (copies, at any length) form
   one class with one representative, so that copies never meet as pairs.
2. Rotations are learnt on a bounded sample (``SAMPLE`` vectors, those of least hash of
   their id) by iterative quantisation; every representative gets the binary code of
   its signs: ``TABLES`` substrings of ``s`` bits, s growing with the logarithm of the
   number of vectors, so that a bucket's expected size stays the same.
3. Each substring is indexed by all keys within one bit of it. Two substrings within two
   bits share a key, and by the pigeonhole principle two codes within ``GUARANTEED`` =
   3 * TABLES - 1 bits have such a pair of substrings: every code within that radius is
   retrieved. Codes further apart that meet all the same count up to ``FURTHER``.
4. The rows of a key stand together, sorted, and are compared in NumPy; a pair counts
   under one key only, which both codes tell, so no pair is shuffled to be made unique.
   The index holds the vectors in bytes as well: a pair that can't reach the least
   similarity, by the bound of the rounding, ends where it was met, so what is shuffled
   grows with the similar pairs and not with the met ones. Those left are ranked with the
   real vectors; each vector keeps its k best. Tables are done one after the other, and a
   table's shuffle files are removed when its pairs are there.
5. A key with more than ``HOT`` rows emits no pairs. Such keys that share vectors form
   regions (connected components of the keys), and the vectors of a region are compared
   exactly, by matrix products of blocks that emit k rows for each vector. So near-equal
   vectors in any number lose nothing, and cost products instead of rows.
6. Classes are expanded: copies of a vector are its nearest, then the members of the
   nearest classes.

``nearest`` answers for similar vectors only: its index can't meet pairs that are far
apart. ``nearest_any`` has no floor: it learns ``CELLS`` cells on the same sample and
compares every vector with all members of the ``PROBED`` cells that are nearest to it,
by matrix products, so the work is about an eighth of all pairs (it grows as the square
of the vectors; up to 1,000 vectors it is all pairs) and each vector gets its k neighbours
however far they are. What is lost are neighbours in cells that weren't asked; the
measured recall is in the README and in the tests.

Nothing that grows with the vectors is broadcast: their joins ask for a merge, because
the size of what comes out of Python is not known to the planner.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut

from .components import connected_components

#: Vectors on which the rotations are learnt, at most.
SAMPLE = 20_000
#: Substrings of a code; bits by which codes may differ and are surely retrieved; part of a
#: code's bits by which those that meet may differ.
TABLES = 4
GUARANTEED = 3 * TABLES - 1
FURTHER = 0.2
#: Rows of a key that are compared as pairs of codes; keys with more are a region's.
HOT = 2048
#: Index rows that are compared in one go, about.
AT_ONCE = 1 << 17
#: Vectors of a region that one task compares with as many.
BLOCK = 16_384
K, LEAST_SIMILARITY = 5, 0.9
#: Cells of ``nearest_any``, at most, and how many of them a vector asks.
CELLS, PROBED = 128, 16
#: Vectors of one cell in a group, and vectors that ask it, at most about.
MEMBERS, ASKING = 16_384, 500_000


def usable_vectors(responses: DataFrame, dims: int = 64) -> DataFrame:
    """(chunk_id, v): one usable vector for each chunk that has one."""
    one = responses.where((F.size("embeddings") == 1) & F.col("chunk_id").isNotNull()).select("chunk_id", F.element_at("embeddings", 1).alias("v"))
    ok = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return one.where(ok).groupBy("chunk_id").agg(F.first("v").alias("v"))


def _unit(vectors: DataFrame) -> DataFrame:
    """(id, cls, u): the unit vector, and what all vectors of its direction share."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = np.rint(x * 1e5).astype("<i4")
            cls = [hashlib.md5(r.tobytes()).hexdigest() for r in near]
            flat = pa.array(x.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, x.shape[1]), pa.int32()), flat)], ["id", "cls", "u"])

    return vectors.select(F.col("chunk_id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")).mapInArrow(run, "id long, cls string, u array<float>")


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): rotations for ``bits`` signs by iterative quantisation, from as
    many random beginnings as it takes."""
    mean = sample.mean(axis=0)
    x, out = sample - mean, []
    for seed in range(math.ceil(bits / x.shape[1])):
        r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    return mean, np.concatenate(out, axis=1)[:, :bits]


def substring_bits(n: int) -> int:
    """Bits of a substring: of n vectors about 64 share a key, however many they are."""
    return min(31, max(16, math.ceil(math.log2(max(n, 2))) - 2))


def _sample(units: DataFrame) -> np.ndarray:
    """The sampled vectors, as rows."""
    u = units.select("id", "u").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("u").toArrow().column("u").combine_chunks()
    return u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1).astype(np.float64) if len(u) else np.zeros((1, 64))


def _codes(units: DataFrame, s: int) -> DataFrame:
    """(id, w0, w1, q): codes, two substrings in a word, and the vectors in bytes."""
    import pyarrow as pa

    mean, matrix = learn_rotations(_sample(units), TABLES * s)
    weights = (1 << np.arange(s, dtype=np.int64)).reshape(1, 1, s)
    words = TABLES // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            subs = (((u - mean) @ matrix > 0).reshape(b.num_rows, TABLES, s) * weights).sum(axis=2)
            q = np.rint(u / np.abs(u).max(axis=1, keepdims=True) * 127).astype(np.int8)
            q = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, q.shape[1]), pa.int32()), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(subs[:, 2 * k] | subs[:, 2 * k + 1] << 32) for k in range(words)), q], ["id", *(f"w{k}" for k in range(words)), "q"])

    return units.select("id", "u").mapInArrow(run, "id long, " + ", ".join(f"w{k} long" for k in range(words)) + ", q array<tinyint>")


def _key(table: int) -> Column:
    """The key of a code's own substring: table and substring in one number."""
    w = F.col(f"w{table // 2}")
    sub = F.shiftrightunsigned(w, 32) if table % 2 else w.bitwiseAND(F.lit(0xFFFFFFFF))
    return sub.bitwiseOR(F.lit(table << 32))


def _around(rows: DataFrame, own: str, key: str, s: int) -> DataFrame:
    """``rows`` for each key within one bit of the key in ``own``, as ``key``."""
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << k for k in range(s)))])  # a constant
    return rows.select(*rows.columns, F.explode(masks).alias("mask")).select(*[c for c in rows.columns if c != key], F.col(own).bitwiseXOR(F.col("mask")).alias(key))


def hot_keys(codes: DataFrame, s: int) -> DataFrame:
    """(key): the keys with more than ``HOT`` rows.

    Counted from the codes' own substrings: a key's rows are those of the s + 1 substrings
    around it, so one of these has at least its even share of them.
    """
    own = codes.select(F.explode(F.array(*[_key(t) for t in range(TABLES)])).alias("own")).groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    own = cut(own, clean=True)
    maybe = _around(own.where(F.col("n") * (s + 1) > HOT).select("own"), "own", "key", s).select("key").distinct()
    parts = _around(maybe, "key", "own", s)
    return cut(parts.join(own.hint("merge"), "own").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("key"), clean=True)


def rows_under(keys: DataFrame, codes: DataFrame, s: int) -> DataFrame:
    """(key, id) of the index rows under some keys, found from the codes' own substrings."""
    own = codes.select(F.explode(F.array(*[_key(t) for t in range(TABLES)])).alias("own"), "id")
    return _around(keys, "key", "own", s).join(own.hint("merge"), "own").select("key", "id")


def entries(codes: DataFrame, s: int, tables: Sequence[int] = range(TABLES)) -> DataFrame:
    """(key, id, w0, w1 and what else the codes have): the index of some tables, every code
    under all keys within one bit."""
    own = codes.select(F.explode(F.array(*[_key(t) for t in tables])).alias("own"), *codes.columns)
    return _around(own, "own", "key", s).select("key", *codes.columns)


def _rounded(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of rows of bytes, and how far the true ones are from them at most.

    A component is off by half a unit, so a row by sqrt(dims) / 2 units, of which its length
    has |q|; the rest of the factor is for the change of the length, and for float32.
    """
    x = q.astype(np.float32)
    length = np.linalg.norm(x, axis=1)
    return x / length[:, None], 0.75 * math.sqrt(q.shape[1]) / length


def _met(key: np.ndarray, ids: np.ndarray, w: list[np.ndarray], s: int, q: np.ndarray | None = None, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows under the same key (they stand together) that count there: their codes
    are near enough, this is the first table and the first key in which they meet, and by
    ``q`` their similarity may be ``least``."""
    unit, off = _rounded(q) if q is not None else (None, None)
    most = max(GUARANTEED, math.ceil(FURTHER * TABLES * s))
    low, out = np.uint64(0xFFFFFFFF), []
    at, d = np.arange(len(key)), 0
    while True:
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        x = [v[at] ^ v[at + d] for v in w]
        near = np.flatnonzero(sum(np.bitwise_count(v).astype(np.int16) for v in x) <= most)
        if not len(near):
            continue
        i = at[near]
        k, table = key[i] & low, (key[i] >> np.uint64(32)).astype(np.int64)
        subs = [(x[t // 2][near] >> np.uint64(32 * (t % 2))) & low for t in range(TABLES)]
        apart = np.stack([np.bitwise_count(v) for v in subs])
        first = np.argmax(apart <= 2, axis=0) == table
        mine = np.stack([(w[t // 2][i] >> np.uint64(32 * (t % 2))) & low for t in range(TABLES)])
        cols = np.arange(len(i))
        own, diff = mine[table, cols], np.stack(subs)[table, cols]
        one = diff & (~diff + np.uint64(1))  # the lowest bit in which they differ
        # of the keys that they share the least of those that differ from both, or the lower substring
        here = np.where(diff == 0, own, np.where(diff == one, np.minimum(own, own ^ diff), np.minimum(own ^ one, own ^ diff ^ one)))
        keep = i[first & (here == k) & (ids[i] != ids[i + d])]
        if unit is not None and len(keep):
            keep = keep[np.einsum("ij,ij->i", unit[keep], unit[keep + d]) + off[keep] + off[keep + d] >= least]
        if len(keep):
            out.append((ids[keep], ids[keep + d]))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, np.int64),) * 2


def candidate_pairs(index: DataFrame, s: int, least: float = -1.0) -> DataFrame:
    """(a, b): the pairs that meet under a key of ``index``, each once; none under a key with
    more than ``HOT`` rows, and where the index has q none that can't reach ``least``."""
    import pyarrow as pa

    names, hot = ["key", "id", "w0", "w1", *(["q"] if "q" in index.columns else [])], HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.flatnonzero(np.append(rows[0][1:] != rows[0][:-1], True)[: len(rows[0])]) + 1
            size = np.diff(ends, prepend=0)
            if (size > hot).any():
                rows = [r[np.repeat(size <= hot, size)] for r in rows]
            a, b = _met(rows[0].astype(np.uint64), rows[1], [r.view(np.uint64) for r in rows[2:4]], s, *rows[4:], least=least)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns[:4]])
            waiting[-1] += [c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns[4:]]
            if sum(len(w[0]) for w in waiting) < AT_ONCE:
                continue
            rows, waiting = [np.concatenate(p) for p in zip(*waiting)], []
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            yield found([r[:last] for r in rows])
            waiting.append([r[last : last + hot + 1] for r in rows])  # of more there are no pairs
        if waiting:
            yield found([np.concatenate(p) for p in zip(*waiting)])

    ordered = index.select(*names).repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a long, b long")


def _similarities(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs from ``least`` on, by the real vectors."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64) for c in b.columns[2:])
                dot = np.einsum("ij,ij->i", x, y)
                at = pa.array(np.flatnonzero(dot >= least))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dot[dot >= least])], ["a", "b", "similarity"])

    one = pairs.join(reps.select(F.col("id").alias("a"), F.col("u").alias("ua")).hint("merge"), "a")
    both = one.join(reps.select(F.col("id").alias("b"), F.col("u").alias("ub")).hint("merge"), "b")
    return both.select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long, similarity double")


def regions(index: DataFrame) -> DataFrame:
    """(region, id) of the rows under hot keys: keys that share a vector are one region."""
    of = cut(index.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys")).select("id", "keys", F.element_at("keys", 1).alias("key")), clean=True)  # TABLES * (s + 1) keys at most
    edges = of.select(F.explode("keys").alias("a"), F.col("key").alias("b")).distinct()
    found = connected_components(edges)
    return of.select("id", "key").join(found.select(F.col("vertex").alias("key"), F.col("component").alias("region")).hint("merge"), "key").select("region", "id")


def best_in_regions(members: DataFrame, reps: DataFrame, k: int, least: float, dims: int, block: int | None = None) -> DataFrame:
    """(a, b, similarity): for each vector of a region, in each block of the region, the k
    most similar others from ``least`` on."""
    block = block or BLOCK
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    placed = members.join(sizes.hint("merge"), "region").join(reps.hint("merge"), "id")
    placed = placed.withColumn("parts", F.ceil(F.col("n") / block)).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    asks = placed.select("region", F.col("mine").alias("ask"), other.alias("of"), "id", "u")
    fresh = [F.col(c).alias(c) for c in ("region", "id", "u")]  # names of its own, for the same rows stand on both sides
    answers = placed.select(other.alias("ask"), F.col("mine").alias("of"), *fresh)
    return asks.groupBy("region", "ask", "of").cogroup(answers.groupBy("region", "ask", "of")).applyInArrow(_compare(k, dims, least), "a long, b long, similarity double")


def _classes(responses: DataFrame, k: int, dims: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The unit vectors, their classes (cls, rep, members), and the representatives (id, u)."""
    units = cut(_unit(usable_vectors(responses, dims)), clean=True)
    # the first k + 1 members of every class are all that anyone can need of it
    nth = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    firsts = units.select("cls", "id").withColumn("n", nth).where(F.col("n") <= k + 1)
    classes = cut(firsts.groupBy("cls").agg(F.array_sort(F.collect_list("id")).alias("members")).select("cls", F.element_at("members", 1).alias("rep"), "members"), clean=True)
    reps = cut(units.join(classes.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi").select("id", "u"), clean=True)
    return units, classes, reps


def _expanded(units: DataFrame, classes: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(chunk_id, neighbour, similarity) from the nearest representatives (a, b, similarity)."""
    lists = best.join(classes.select(F.col("rep").alias("b"), F.col("members").alias("theirs")).hint("merge"), "b")
    lists = lists.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "b", "theirs"))).alias("l"))
    around = lists.select(F.col("a").alias("rep"), F.slice(F.flatten(F.transform("l", lambda c: F.transform(c["theirs"], lambda i: F.struct(i.alias("neighbour"), (-c["d"]).alias("similarity"))))), 1, k).alias("around"))
    per = units.select("id", "cls").join(classes.hint("merge"), "cls").join(around.hint("merge"), "rep", "left")
    copies = F.transform(F.filter("members", lambda i: i != F.col("id")), lambda i: F.struct(i.alias("neighbour"), F.lit(1.0).alias("similarity")))
    of = F.slice(F.concat(copies, F.coalesce("around", F.array().cast("array<struct<neighbour:bigint,similarity:double>>"))), 1, k)
    return per.select(F.col("id").alias("chunk_id"), F.explode(of).alias("n")).select("chunk_id", "n.neighbour", F.least("n.similarity", F.lit(1.0)).alias("similarity"))


def nearest(responses: DataFrame, k: int = K, least: float = LEAST_SIMILARITY, dims: int = 64) -> DataFrame:
    """(chunk_id, neighbour, similarity): for each chunk with a usable vector its k most
    similar other chunks, of those with a cosine of at least ``least``.

    Nulls in any column, vectors of another length, with nulls, NaN or infinity and
    zero vectors make a response unusable; several responses of a chunk count once;
    ties go to the lower id; copies of a vector have similarity 1; an empty table
    gives an empty one; other columns are not read.
    """
    units, classes, reps = _classes(responses, k, dims)
    s = substring_bits(reps.count())
    codes = cut(_codes(reps, s), clean=True)
    met = [cut(candidate_pairs(entries(codes, s, [t]), s, least), clean=True) for t in range(TABLES)]
    near = cut(_similarities(reduce(DataFrame.unionByName, met), reps, least), clean=True)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    hot = hot_keys(codes, s)
    if not hot.isEmpty():
        dense = cut(regions(rows_under(hot, codes, s)), clean=True)
        both = both.unionByName(best_in_regions(dense, reps, k, least, dims)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    best = both.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("n") <= k)
    return _expanded(units, classes, best, k)


def learn_cells(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of direction by spherical k-means."""
    centres = sample[np.random.default_rng(0).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, np.argmax(sample @ centres.T, axis=1), sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-30), centres)
    return centres


def _matrix(column: object, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _part(ids: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _compare(k: int, dims: int, least: float = -1.5):
    """(asked, index) -> (a, b, similarity): for each asked vector the k most similar others
    of the index, by matrix products of 1,024 rows, from ``least`` on."""
    import pyarrow as pa

    def compare(asked: pa.Table, index: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and index.num_rows:
            ids, there = asked.column("id").to_numpy(), index.column("id").to_numpy()
            x, y = _matrix(asked.column("u").combine_chunks(), dims), _matrix(index.column("u").combine_chunks(), dims)
            some = min(len(there), k + 4)
            for i in range(0, len(ids), 1024):
                s = x[i : i + 1024] @ y.T
                s[ids[i : i + 1024, None] == there[None, :]] = -2
                top = np.argpartition(-s, some - 1, axis=1)[:, :some]
                exact = np.einsum("id,ijd->ij", x[i : i + 1024].astype(np.float64), y[top].astype(np.float64))
                who = there[top]
                exact[who == ids[i : i + 1024, None]] = -2
                order = np.lexsort((who, -exact), axis=1)[:, :k]
                keep = np.take_along_axis(exact, order, 1)
                r, c = np.nonzero(keep >= least)
                out[0].append(ids[i + r])
                out[1].append(np.take_along_axis(who, order, 1)[r, c])
                out[2].append(keep[r, c])
        kinds = [np.int64, np.int64, np.float64]
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, t)) for o, t in zip(out, kinds)], ["a", "b", "similarity"])

    return compare


def best_in_cells(reps: DataFrame, k: int, dims: int) -> DataFrame:
    """(a, b, similarity): for each vector of (id, u) the k most similar others of the
    cells that it asks."""
    import pyarrow as pa

    size = reps.count()
    centres = learn_cells(_sample(reps).astype(np.float32), max(1, min(CELLS, size // 64)))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(_matrix(b.column(0), dims) @ centres.T, axis=1).astype(np.int32))], ["cell"])

    # a cell without members answers nothing; of k + 1 others each has one at least
    sizes = {r.cell: r["count"] for r in reps.select("u").mapInArrow(own, "cell int").groupBy("cell").count().collect()}
    centres = centres[sorted(sizes)]
    parts = np.array([math.ceil(sizes[c] / MEMBERS) for c in sorted(sizes)], dtype=np.int64)
    asking = max(1, math.ceil(size / ASKING))
    probes = min(len(centres), max(k + 1, PROBED))

    def rows(b: pa.RecordBatch, at: list[np.ndarray], cell: list[np.ndarray], part: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(part).astype(np.int32)), *(c.take(pa.array(np.concatenate(at))) for c in b.columns)], ["cell", "part", "id", "u"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                all_, cell = np.arange(b.num_rows), np.argmax(_matrix(b.column(1), dims) @ centres.T, axis=1)
                part = _part(b.column(0).to_numpy(), parts[cell]) * asking
                yield rows(b, [all_] * asking, [cell] * asking, [part + a for a in range(asking)])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_matrix(b.column(1), dims) @ centres.T), axis=1, kind="stable")[:, :probes]
                mine, at, cell, part = _part(b.column(0).to_numpy(), asking), [], [], []
                for p in range(int(parts.max())):
                    i, j = np.nonzero(parts[near] > p)
                    at.append(i)
                    cell.append(near[i, j])
                    part.append(p * asking + mine[i])
                yield rows(b, at, cell, part)

    schema = "cell int, part int, id long, u array<float>"
    asked = reps.select("id", "u").mapInArrow(asks, schema).groupBy("cell", "part")
    met = asked.cogroup(reps.select("id", "u").mapInArrow(members, schema).groupBy("cell", "part")).applyInArrow(_compare(k, dims), "a long, b long, similarity double")
    return met.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("n") <= k)


def nearest_any(responses: DataFrame, k: int = K, dims: int = 64) -> DataFrame:
    """(chunk_id, neighbour, similarity): for each chunk with a usable vector its k most
    similar other chunks, however similar; fewer only where there are no k others.

    The same rules as in ``nearest``.
    """
    units, classes, reps = _classes(responses, k, dims)
    return _expanded(units, classes, cut(best_in_cells(reps, k, dims), clean=True), k)


def similar_pairs(responses: DataFrame, k: int = K, least: float = LEAST_SIMILARITY, dims: int = 64) -> DataFrame:
    """(chunk_a, chunk_b): the pairs of ``nearest`` without direction, each once."""
    n = nearest(responses, k, least, dims)
    return n.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()
