"""Boolean and phrase search over texts, ranked with BM25.

Words are lower-cased, freed of diacritics and stemmed, in texts and in queries. An
``Index`` keeps postings sorted by term in immutable segments: a query reads the row groups
of its terms, never the texts; new texts are one more segment, removed ones a list of ids.
``search`` gives the same scores without an index, by one scan. Statistics are the whole
corpus's, scope is applied afterwards.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.porter import stem as porter
from strandline.functions.text import sanitise_query

# --- fixed values: Okapi BM25 as published ------------------------------------------------
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 24
#: Words whose stems a worker keeps, at most.
KEPT_STEMS = 1 << 18
# --------------------------------------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}\p{Co}_]+"


#: Latin letters with diacritics, by decomposition, and what they become; the combining
#: marks after them become nothing.
_PLAIN = {c: b for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii() and b.islower()}
MARKED, UNMARKED = "".join(_PLAIN) + "".join(map(chr, range(0x300, 0x370))), "".join(_PLAIN.values())


def fold(text: Column | str) -> Column:
    """Lower case without diacritics of Latin letters."""
    return F.translate(F.lower(F.col(text) if isinstance(text, str) else text), MARKED, UNMARKED)


def folded(text: str) -> str:
    """The same of a query, on the driver."""
    return text.lower().translate({ord(c): _PLAIN.get(c) for c in MARKED})


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), F.lit(1))


# -- query language ------------------------------------------------------------------------
_PART = re.compile(r'\s*(?:(\()|(\))|(-?)"((?:[^"]|"")*)"(\*?)|([^\s()"]+))')


def parse_query(query: str, stem: Callable[[str], str] | None = porter) -> tuple | None:
    """A query as a tree: ("term", t), ("prefix", t), ("phrase", [t...]), ("and", a, b),
    ("or", a, b), ("not", a, b); None for an empty one. Words side by side mean AND, -x
    means NOT x, words with a hyphen or a dot are phrases, a lone * is dropped."""
    items: list = []
    for m in _PART.finditer(sanitise_query(query)):
        opening, closing, minus, quoted, star, word = m.groups()
        if opening or closing:
            items.append(opening or closing)
        elif quoted is not None:
            items.append((bool(minus), _leaf(quoted.replace('""', '"'), bool(star), stem)))
        elif word in ("AND", "OR", "NOT"):
            items.append(word)
        else:
            neg = word.startswith("-")
            items.append((neg, _leaf(word.lstrip("-"), word.endswith("*"), stem)))
    pos = 0

    def peek():
        return items[pos] if pos < len(items) else None

    def take():
        nonlocal pos
        pos += 1
        return items[pos - 1]

    def either():
        left = both()
        while peek() == "OR":
            take()
            right = both()
            left = ("or", left, right) if left and right else left or right
        return left

    def both():
        left = negated()
        while peek() is not None and peek() not in ("OR", ")"):
            if peek() == "AND":
                take()
            neg = peek() == "NOT"
            if neg:
                take()
            item = peek()
            if item is None or item in ("OR", ")"):
                break
            minus = isinstance(item, tuple) and item[0]
            right = primary()
            if right:
                left = (("not", left, right) if neg or minus else ("and", left, right)) if left else (None if neg or minus else right)
        return left

    def negated():
        if peek() == "NOT":
            take()
            right = primary()
            return ("not", None, right) if right else None
        item = peek()
        if isinstance(item, tuple) and item[0]:
            right = primary()
            return ("not", None, right) if right else None
        return primary()

    def primary():
        item = peek()
        if item is None or item in ("OR", ")", "AND"):
            return None
        take()
        if item == "(":
            inner = either()
            if peek() == ")":
                take()
            return inner
        return item[1] if isinstance(item, tuple) else None

    tree = None
    while pos < len(items):
        part = either()
        tree = ("and", tree, part) if tree and part else tree or part
        if peek() == ")":
            take()
        elif part is None and pos < len(items):
            take()
    return tree


def _leaf(text: str, prefix: bool, stem) -> tuple | None:
    words = re.findall(r"\w+", folded(text))
    if not words:
        return None
    words = [stem(w) for w in words] if stem else words
    if prefix and len(words) == 1:
        return ("prefix", words[0])
    return ("term", words[0]) if len(words) == 1 else ("phrase", tuple(words))


def leaves(tree: tuple | None, positive: bool = True) -> list[tuple]:
    """The leaves that rank: those not below a NOT, each once."""
    if tree is None:
        return []
    kind = tree[0]
    if kind in ("and", "or"):
        out = leaves(tree[1]) + leaves(tree[2])
    elif kind == "not":
        out = leaves(tree[1])
    else:
        out = [tree]
    return [x for i, x in enumerate(out) if x not in out[:i]]


def all_leaves(tree: tuple | None) -> list[tuple]:
    if tree is None:
        return []
    if tree[0] in ("and", "or", "not"):
        out = all_leaves(tree[1]) + all_leaves(tree[2])
        return [x for i, x in enumerate(out) if x not in out[:i]]
    return [tree]


def matches(tree: tuple | None, found: Callable[[tuple], Column]) -> Column:
    if tree is None:
        return F.lit(False)
    kind = tree[0]
    if kind == "and":
        return matches(tree[1], found) & matches(tree[2], found)
    if kind == "or":
        return matches(tree[1], found) | matches(tree[2], found)
    if kind == "not":
        left = F.lit(True) if tree[1] is None else matches(tree[1], found)
        return left & ~matches(tree[2], found)
    return found(tree)


def _score(names: list[str], n_docs: Column, mean: Column, df: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name in names:
        tf = F.col(name).cast("double")
        d = df[name].cast("double")
        idf = F.greatest(F.log((n_docs - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        total = total + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_tokens") / mean))).otherwise(0.0)
    return -total


def _stemmed(rows: DataFrame) -> DataFrame:
    """(key, n_tokens, w) with the stems of the words in w, an array of (pos, word)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for b in batches:
            if len(memo) > KEPT_STEMS:
                memo.clear()
            w = b.column(2)
            words = w.values.field("word").dictionary_encode()
            stems = pa.array([memo.get(x) or memo.setdefault(x, porter(x)) for x in words.dictionary.to_pylist()], pa.string())
            said = pa.StructArray.from_arrays([w.values.field("pos"), stems.take(words.indices)], ["pos", "word"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(w.offsets, said)], b.schema.names)

    kind = rows.schema[rows.columns[0]].dataType.simpleString()
    return rows.mapInArrow(run, f"`{rows.columns[0]}` {kind}, n_tokens int, w array<struct<pos:int,word:string>>")


def search(docs: DataFrame, query: str, key: str = "chunk_id", text: str = "chunk_text", stemmed: bool = True) -> DataFrame:
    """(key, bm25) of all matching documents; lower is better.

    One narrow pass without a shuffle makes frequencies and lengths; the corpus statistics
    are a scalar subquery over the same pass. A stem changes the end of a word only, so
    just the words that begin like a stem of the query leave the JVM to be stemmed.
    """
    tree = parse_query(query, porter if stemmed else None)
    every, ranked = all_leaves(tree), leaves(tree)
    names = {leaf: f"f{i}" for i, leaf in enumerate(every)} if every else {}
    rows = docs.select(key, tokens(text).alias("w")).select(key, F.size("w").alias("n_tokens"), "w")
    if stemmed and every:
        begins = sorted({w[: max(1, len(w) - 1)] for k, x in every for w in (x if k == "phrase" else [x])})
        some = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda p: F.exists(F.array(*map(F.lit, begins)), lambda b: p["word"].startswith(b)))
        rows = _stemmed(rows.select(key, "n_tokens", F.coalesce(some, F.array().cast("array<struct<pos:int,word:string>>")).alias("w")))
    elif every:
        rows = rows.withColumn("w", F.transform("w", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))))
    rows = rows.select(key, "n_tokens", *[_placed(F.col("w"), leaf).alias(n) for leaf, n in ((x, names[x]) for x in every)])
    hit = matches(tree, lambda leaf: F.col(names[leaf]) > 0)
    if not ranked:
        return rows.where(hit).select(key, F.lit(0.0).alias("bm25"))
    stats = rows.where("n_tokens is not null and n_tokens >= 0").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("n_tokens").alias("mean"), *[F.count_if(F.col(names[x]) > 0).cast("double").alias(f"d_{names[x]}") for x in ranked])
    one = stats.select(F.struct(*stats.columns)).scalar()
    scored = rows.where(hit).withColumn("s", one)
    return scored.select(key, _score([names[x] for x in ranked], F.col("s.n"), F.col("s.mean"), {names[x]: F.col(f"s.d_{names[x]}") for x in ranked}).alias("bm25"))


def _placed(words: Column, leaf: tuple) -> Column:
    """How often a leaf occurs in an array of (pos, word)."""
    kind, what = leaf
    if kind == "term":
        return F.size(F.filter(words, lambda w: w["word"] == what))
    if kind == "prefix":
        return F.size(F.filter(words, lambda w: w["word"].startswith(what)))

    def begins(term: str, back: int) -> Column:
        return F.transform(F.filter(words, lambda w: w["word"] == term), lambda w: w["pos"] - back)

    at = [begins(t, i) for i, t in enumerate(what)]
    out = at[0]
    for x in at[1:]:
        out = F.array_intersect(out, x)
    return F.size(out)


def top(scored: DataFrame, key: str = "chunk_id", limit: int = 10) -> DataFrame:
    return scored.orderBy("bm25", key).limit(limit if limit > 0 else 10)


# -- inverted index ------------------------------------------------------------------------
def build_postings(docs: DataFrame, key: str = "chunk_id", text: str = "chunk_text", stemmed: bool = True) -> DataFrame:
    """(term, doc, tf, positions, n_tokens), for writing sorted by term. Words are stemmed
    where they stand, in their document's row, so the vocabulary is neither joined nor sent
    anywhere."""
    words = docs.select(F.col(key).alias("doc"), tokens(text).alias("w")).select("doc", F.size("w").alias("n_tokens"), "w")
    if stemmed:
        said = _stemmed(words.withColumn("w", F.transform("w", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))))
        at = said.select("doc", "n_tokens", F.explode("w").alias("x")).select("doc", "n_tokens", "x.pos", F.col("x.word").alias("term"))
    else:
        at = words.select("doc", "n_tokens", F.posexplode("w").alias("pos", "term"))
    return at.groupBy("term", "doc", "n_tokens").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


class Index:
    """Postings of one text column, in a folder that all executors share.

    ``postings/s=<segment>`` holds (term, doc, tf, positions, n_tokens), range-partitioned and
    sorted by term; ``docs/s=<segment>`` (doc, n_tokens) of every document; ``gone`` what
    was removed: (doc, s) hides a document of the segments up to ``s``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "chunk_id", text: str = "chunk_text", partitions: int | None = None) -> Index:
        index = cls(docs.sparkSession, path)
        index.add(docs, key, text, partitions)
        return index

    def _read(self, part: str, schema: str) -> DataFrame:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def add(self, docs: DataFrame, key: str = "chunk_id", text: str = "chunk_text", partitions: int | None = None) -> None:
        """One more segment. Documents that are there already are replaced."""
        found = self._read("docs", "doc long, n_tokens int, s long")
        segment = (found.agg(F.max("s")).first()[0] or 0) + 1
        docs = docs.where(F.col(text).isNotNull())
        if segment > 1:
            self.remove(docs.select(key), key, segment - 1)
        postings = build_postings(docs, key, text).withColumn("doc", F.col("doc").cast("long"))
        postings = postings.repartitionByRange(partitions, "term") if partitions else postings.repartitionByRange("term")
        postings.sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{self.path}/postings/s={segment}")
        docs.select(F.col(key).cast("long").alias("doc"), F.size(tokens(text)).alias("n_tokens")).write.mode("overwrite").parquet(f"{self.path}/docs/s={segment}")

    def remove(self, ids: DataFrame, key: str = "chunk_id", upto: int | None = None) -> None:
        """Hides documents; a later segment may bring them again."""
        if upto is None:
            upto = self._read("docs", "doc long, n_tokens int, s long").agg(F.max("s")).first()[0] or 0
        ids.select(F.col(key).cast("long").alias("doc"), F.lit(upto).cast("long").alias("upto")).distinct().write.mode("append").parquet(f"{self.path}/gone")

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._read("gone", "doc long, upto long").groupBy("doc").agg(F.max("upto").alias("upto"))
        return rows.join(gone.hint("merge"), "doc", "left").where(F.col("upto").isNull() | (F.col("s") > F.col("upto"))).drop("upto")

    def search(self, query: str, key: str = "chunk_id") -> DataFrame:
        """(key, bm25) of all matching documents; lower is better."""
        docs = self._live(self._read("docs", "doc long, n_tokens int, s long"))
        size = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("n_tokens").alias("mean"))
        one = size.select(F.struct("n", "mean")).scalar()
        postings = self._read("postings", "term string, doc long, n_tokens int, tf long, positions array<int>, s long")
        return search_postings(postings, query, one["n"], one["mean"], self._live).withColumnRenamed("doc", key)


def index_of(docs: DataFrame, name: str, key: str = "chunk_id", text: str = "chunk_text") -> Index:
    """An index of ``docs`` that is built once a session and name, in the shared folder."""
    from strandline.session import shared_dir

    spark = docs.sparkSession
    known = spark.__dict__.setdefault("_strandline_indexes", {})
    if name not in known:
        known[name] = Index.build(docs, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", key, text)
    return known[name]


def search_postings(postings: DataFrame, query: str, n_docs: Column, mean: Column, live: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc, bm25) from an index; the term filter reaches the scan."""
    tree = parse_query(query)
    every, ranked = all_leaves(tree), leaves(tree)
    if not every:
        return postings.select("doc", F.lit(0.0).alias("bm25")).limit(0)
    terms = sorted({t for k, x in every for t in ([x] if k == "term" else x if k == "phrase" else [])})
    prefixes = sorted({x for k, x in every if k == "prefix"})
    wanted = F.col("term").isin(terms) if terms else F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("term").startswith(p)
    rows = postings.where(wanted)
    rows = (live(rows) if live else rows).groupBy("doc", "n_tokens").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("tf", "positions").alias("v")))).alias("m"))

    def count(leaf: tuple) -> Column:
        kind, what = leaf
        if kind == "term":
            return F.coalesce(F.try_element_at("m", F.lit(what))["tf"], F.lit(0))
        if kind == "prefix":
            return F.aggregate(F.map_values(F.map_filter("m", lambda k, v: k.startswith(what))), F.lit(0).cast("long"), lambda acc, v: acc + v["tf"])
        lists = [F.coalesce(F.try_element_at("m", F.lit(t))["positions"], F.array().cast("array<int>")) for t in what]
        return F.size(F.filter(lists[0], lambda p: _all(F.array_contains(x, p + i) for i, x in enumerate(lists[1:], 1))))

    names = {leaf: f"f{i}" for i, leaf in enumerate(every)}
    rows = rows.select("doc", "n_tokens", *[count(x).alias(n) for x, n in names.items()])
    out = rows.where(matches(tree, lambda leaf: F.col(names[leaf]) > 0))
    if not ranked:
        return out.select("doc", F.lit(0.0).alias("bm25"))
    df = rows.agg(*[F.count_if(F.col(names[x]) > 0).cast("double").alias(f"d_{names[x]}") for x in ranked])
    out = out.withColumn("s", df.select(F.struct(*df.columns)).scalar())
    return out.select("doc", _score([names[x] for x in ranked], n_docs, mean, {names[x]: F.col(f"s.d_{names[x]}") for x in ranked}).alias("bm25"))


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def snippet(text: Column | str, query: str, width: int = SNIPPET_TOKENS) -> Column:
    """The window of ``width`` words with most different hits, these in brackets. An Arrow
    UDF: it runs on the few rows after the limit."""
    tree = parse_query(query)
    terms = {t for k, x in leaves(tree) if k != "prefix" for t in (x if k == "phrase" else [x])}
    begins = tuple(x for k, x in leaves(tree) if k == "prefix")

    @F.pandas_udf("string")
    def shown(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else snippet_of(t, terms, begins, width))

    return shown(F.col(text) if isinstance(text, str) else text)


def snippet_of(text: str, terms: set[str], begins: tuple[str, ...] = (), width: int = SNIPPET_TOKENS) -> str:
    """The first of the best windows; each step moves one word in and one out."""
    words = text.split()

    def hit_of(word: str) -> str | None:
        for w in re.findall(r"\w+", folded(word)):
            s = porter(w)
            if s in terms:
                return s
            for b in begins:
                if s.startswith(b):
                    return b
        return None

    hits = [hit_of(w) for w in words]
    inside: dict[str, int] = {}
    best, most = 0, -1
    for i, h in enumerate(hits):
        if h:
            inside[h] = inside.get(h, 0) + 1
        if i >= width and (out := hits[i - width]):
            inside[out] -= 1
            if not inside[out]:
                del inside[out]
        start = max(0, i - width + 1)
        if i >= min(width, len(words)) - 1 and len(inside) > most:
            best, most = start, len(inside)
    shown = " ".join(f"[{w}]" if h else w for w, h in zip(words[best : best + width], hits[best : best + width]))
    return (" … " if best else "") + shown + (" … " if best + width < len(words) else "")
