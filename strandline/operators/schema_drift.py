"""Schemas that drift between files: one table, and a report of each file's changes.

Every valid line is loaded as a path-value map with raw JSON types and reduced at
once, per Arrow batch, to statistics by (file, path, type); only these are shuffled,
so a file of any size is a hot key of a combined aggregation at most. Which unknown
field stands for which catalogue field is learnt from the whole corpus: where the
unknown field stands, the catalogue field is missing, and its values have the
signatures that the catalogue field's values have elsewhere. The catalogue (tens of
rows) is the only thing that is sent to the workers; its size is checked.

Rules where the data leave a choice: a field with a null value stands on the line but
has no type, and counts as missing for a renaming; a value that is a renamed field's is
recognised whatever its type, by its leaves.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a catalogue, or the learnt renamings, may have to be sent to the workers.
MOST_CATALOGUE_ROWS = 10_000
#: Share of an unknown field's lines on which a catalogue field must be missing, and
#: share of its values that must have one of that field's usual signatures, to stand for it.
MISSING_SHARE, VALUE_SHARE = 0.95, 0.5
#: Share of a field's values from which a signature is a usual one.
USUAL_SHARE = 0.002
LITERAL_CHARS, LEAVES = 24, 4

_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+")
_MIXED = re.compile(r"[A-Za-z]*[0-9][A-Za-z0-9]*")


def json_type(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", dict: "object", list: "array"}[type(v)]


def leaves(v: object) -> list[str] | None:
    """A value's scalars in order, as text; None if there are too many."""
    if isinstance(v, (dict, list)):
        out: list[str] = []
        for x in v.values() if isinstance(v, dict) else v:
            inner = leaves(x)
            if inner is None or len(out) + len(inner) > LEAVES:
                return None
            out += inner
        return out
    return [str(v).lower() if isinstance(v, bool) else str(v)]


def signature(v: object) -> str:
    """What kind of value it is, whatever its type: short words stand for themselves,
    numbers and identifiers for their shape."""
    parts = leaves(v)
    if parts is None:
        return "{}" if isinstance(v, dict) else "[]"
    text = ".".join(parts)
    if len(text) > 200 or "\n" in text:
        return "text"
    if len(text) <= LITERAL_CHARS and not any(c.isdigit() for c in text):
        return text
    shape = _MIXED.sub(lambda m: "9" if m.group().isdigit() else "x", text)
    if len(shape) > LITERAL_CHARS:
        shape = _LETTERS.sub("a", shape)
    return shape


def line_fields(o: dict, nested: bool) -> dict[str, object]:
    """A line's top-level fields and, if ``nested``, those directly inside payload."""
    p = o.get("payload")
    return {**o, **{f"payload.{k}": v for k, v in p.items()}} if nested and isinstance(p, dict) else o


#: Types of codex lines that are items, and of a file's first line; fixed by the catalogue's meaning.
ITEM_TYPES, FIRST_TYPE = ("response_item", "event_msg"), "session_meta"
FACTS = "source_id long, agent string, what string, field string, value string, missing array<string>, n long, present long"


def _collected_catalogue(catalogue: DataFrame) -> dict[str, dict[str, tuple[frozenset[str], str]]]:
    rows = catalogue.select("agent", "field_name", "json_type", "presence").where("agent is not null and field_name is not null").limit(MOST_CATALOGUE_ROWS + 1).collect()
    if len(rows) > MOST_CATALOGUE_ROWS:
        raise ValueError("the catalogue is too large to be sent to the workers")
    out: dict = {}
    for r in rows:
        out.setdefault(r.agent, {})[r.field_name] = (frozenset((r.json_type or "").split("|")), r.presence or "optional")
    return out


def drift_facts(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Path-type statistics of every file, summed per Arrow batch.

    what = ``known``: value is a type of a catalogue field; ``domain``: value is a
    signature of a catalogue field (source_id null); ``unknown``: value is a
    signature of a field outside the catalogue, missing are the catalogue fields of its
    level that the line lacks; ``asked``: n lines ask for the field, present have it.
    """
    import pyarrow as pa

    known = _collected_catalogue(catalogue)
    names = [x.split()[0] for x in FACTS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            asked: Counter = Counter()
            present: Counter = Counter()
            for source, agent, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not raw:
                    continue
                try:
                    o = json.loads(raw)
                except (ValueError, RecursionError):
                    continue
                fields = known.get(agent)
                if fields is None or not isinstance(o, dict):
                    continue
                nested = any(f.startswith("payload.") for f in fields)
                d = line_fields(o, nested)
                kind = o.get("type")
                lacking: dict[bool, tuple[str, ...]] = {}
                for f, v in d.items():
                    if f in fields:
                        if v is not None:
                            n[source, agent, "known", f, json_type(v), None] += 1
                            n[None, agent, "domain", f, signature(v), None] += 1
                    else:
                        inner = nested and f.startswith("payload.")
                        if inner not in lacking:
                            lacking[inner] = tuple(c for c in fields if (nested and c.startswith("payload.")) == inner and d.get(c) is None)
                        n[source, agent, "unknown", f, signature(v), lacking[inner]] += 1
                        if kind is None and not inner and isinstance(v, str) and v in (*ITEM_TYPES, FIRST_TYPE):
                            kind = v  # stands for the type
                for f, (_, presence) in fields.items():
                    if presence == "always" or (presence == "message" and isinstance(o.get("message"), dict)) or (presence == "item" and kind in ITEM_TYPES) or (presence == "first" and kind == FIRST_TYPE):
                        asked[source, agent, f] += 1
                        present[source, agent, f] += f in d
            rows = [(s, a, w, f, v, list(m) if m is not None else None, k, 0) for (s, a, w, f, v, m), k in n.items()]
            rows += [(s, a, "asked", f, None, None, k, present[s, a, f]) for (s, a, f), k in asked.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    facts = lines.select(F.col("source_id").cast("long"), "agent", "raw_line").mapInArrow(run, FACTS)
    return facts.groupBy("source_id", "agent", "what", "field", "value", "missing").agg(F.sum("n").alias("n"), F.sum("present").alias("present"))


def _domains(facts: DataFrame) -> DataFrame:
    """(agent, c, value, share): the usual signatures of every catalogue field, 1 /
    ``USUAL_SHARE`` at most, so they can be broadcast."""
    d = facts.where("what = 'domain'").groupBy("agent", F.col("field").alias("c"), "value").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("agent", "c"))
    return d.select("agent", "c", "value", share.alias("share")).where(F.col("share") >= USUAL_SHARE)


def renamings(facts: DataFrame, domains: DataFrame) -> DataFrame:
    """(agent, field, c): the catalogue field that an unknown field stands for."""
    by_value = facts.where("what = 'unknown'").groupBy("agent", "field", "value", "missing").agg(F.sum("n").alias("n"))
    lines_of = by_value.groupBy("agent", "field").agg(F.sum("n").alias("lines"))
    pairs = by_value.select("agent", "field", "value", "n", F.explode("missing").alias("c")).groupBy("agent", "field", "c", "value").agg(F.sum("n").alias("n"))
    met = pairs.join(F.broadcast(domains), ["agent", "c", "value"], "left").groupBy("agent", "field", "c").agg(
        F.sum("n").alias("missing"), F.sum(F.when(F.col("share").isNotNull(), F.col("n")).otherwise(0)).alias("fits"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("covered")
    )
    fit = met.join(lines_of.hint("merge"), ["agent", "field"]).where((F.col("missing") >= MISSING_SHARE * F.col("lines")) & (F.col("fits") >= VALUE_SHARE * F.col("lines")))
    near = F.levenshtein(F.lower(F.regexp_replace("field", "[^A-Za-z]", "")), F.lower(F.regexp_replace("c", "[^A-Za-z]", "")))
    best = F.row_number().over(Window.partitionBy("agent", "field").orderBy(F.desc("fits"), F.desc("covered"), near, "c"))
    return fit.withColumn("best", best).where("best = 1").select("agent", "field", "c")


def drift_report(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(source_id, field_name, change_kind): each file's departures from the catalogue.

    Invalid, null and empty lines and agents without a catalogue are ignored; names are
    compared exactly; repeated lines change nothing; a null source_id is a file of its
    own; an empty table or catalogue gives an empty report. Other columns are not read.
    """
    from strandline.session import cut

    facts = cut(drift_facts(lines, catalogue))
    domains = _domains(facts)
    stands = renamings(facts, domains)
    small = _collected_catalogue(catalogue)
    spark = lines.sparkSession
    types = spark.createDataFrame([(a, f, sorted(t)) for a, fs in small.items() for f, (t, _) in fs.items()], "agent string, field string, allowed array<string>")
    retyped = facts.where("what = 'known'").join(F.broadcast(types), ["agent", "field"]).where(~F.array_contains("allowed", F.col("value"))).select("source_id", "field", F.lit("retyped").alias("change_kind"))
    unknown = facts.where("what = 'unknown'").join(stands.hint("merge"), ["agent", "field"], "left").join(F.broadcast(domains), ["agent", "c", "value"], "left")
    stood = F.col("c").isNotNull() & F.col("share").isNotNull() & F.coalesce(F.array_contains("missing", F.col("c")), F.lit(False))
    per = unknown.groupBy("source_id", "agent", "field", "c").agg(F.max(stood).alias("stood"))
    renamed = per.where("stood").select("source_id", "agent", F.col("c").alias("field")).distinct()
    added = per.where("not stood").select("source_id", "field", F.lit("added").alias("change_kind"))
    asked = facts.where("what = 'asked'").groupBy("source_id", "agent", "field").agg(F.sum("present").alias("present")).where("present = 0")
    r = renamed.select(F.col("source_id").alias("rs"), F.col("agent").alias("ra"), F.col("field").alias("rf"))
    removed = asked.join(r.hint("merge"), F.col("source_id").eqNullSafe(F.col("rs")) & (F.col("agent") == F.col("ra")) & (F.col("field") == F.col("rf")), "left_anti").select("source_id", "field", F.lit("removed").alias("change_kind"))
    out = retyped.unionByName(renamed.select("source_id", "field", F.lit("renamed").alias("change_kind"))).unionByName(added).unionByName(removed)
    return out.distinct().select("source_id", F.col("field").alias("field_name"), "change_kind")


def one_table(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every valid line as one row of typed catalogue fields.

    line_id, source_id, agent, one column a field (dots become underscores), and
    ``failed_casts``: the fields whose value could not be cast. A renamed field's
    value goes to the field that it stands for. Strings, numbers (double) and booleans
    are typed; objects, arrays and fields that allow two types are JSON text. All on the
    JVM's side, in one pass over the lines besides the pass that learns the renamings.
    """
    from strandline.session import cut

    facts = cut(drift_facts(lines, catalogue))
    learnt = renamings(facts, _domains(facts)).limit(MOST_CATALOGUE_ROWS + 1).collect()
    if len(learnt) > MOST_CATALOGUE_ROWS:
        raise ValueError("more renamings than can be part of one plan")
    small = _collected_catalogue(catalogue)
    stands: dict[tuple[str, str], list[str]] = {}
    for r in sorted(learnt):
        stands.setdefault((r.agent, r.c), []).append(r.field)
    v = F.try_parse_json("raw_line")
    rows = lines.select("line_id", "source_id", "agent", v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))

    def raw(f: str):
        steps = f.split(".", 1) if f.startswith("payload.") else [f]
        return F.try_variant_get("v", "$" + "".join(f"['{x}']" for x in steps), "variant")

    cols, failed = [], []
    every: dict[str, set[str]] = {}
    for fs in small.values():
        for f, (t, _) in fs.items():
            every.setdefault(f, set()).update(t)
    for f, kinds in sorted(every.items()):
        value = None
        for agent, fs in sorted(small.items()):
            if f in fs:
                own = F.coalesce(*[raw(x) for x in [f, *stands.get((agent, f), [])]]) if stands.get((agent, f)) else raw(f)
                value = F.when(F.col("agent") == agent, own) if value is None else value.when(F.col("agent") == agent, own)
        name = f.replace(".", "_")
        kind = next(iter(kinds)) if len(kinds) == 1 else "mixed"
        cast = {"string": "string", "number": "double", "boolean": "boolean"}.get(kind)
        typed = F.try_variant_get(value, "$", cast) if cast else F.to_json(value)
        if cast == "string":  # an object or array has a text, yet is no string
            typed = F.when(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), typed)
        cols.append(typed.alias(name))
        if cast:
            failed.append(F.when(typed.isNull() & value.isNotNull() & ~F.is_variant_null(value), F.lit(f)))
    return rows.select("line_id", "source_id", "agent", *cols, F.array_compact(F.array(*failed)).alias("failed_casts"))
