"""Vector functions as column expressions.

float32 vectors are array<float> or array<double> (arithmetic in double), int8 vectors
array<tinyint>, bit vectors binary with the first dimension in the lowest bit of the
first byte. Mismatched kinds or dimensions raise; a null in either operand gives null; the
cosine distance of a zero vector is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "strandline-vectors-1"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guard(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok | ok.isNull(), value).otherwise(F.raise_error(F.lit(message)))


def _same(a: Column, b: Column, value: Column) -> Column:
    return _guard(F.size(a) == F.size(b), "vectors of different dimensions", value)


def vec_f32(text: Column | str) -> Column:
    """A float vector from JSON text; empty or malformed text raises."""
    v = F.from_json(col(text), "array<float>")
    return F.when(col(text).isNull(), None).otherwise(_guard(F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), F.lit(False)), "not a float vector", v))


def vec_int8(text: Column | str) -> Column:
    v = F.from_json(col(text), "array<int>")
    ok = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & x.between(-128, 127)), F.lit(False))
    return F.when(col(text).isNull(), None).otherwise(_guard(ok, "not an int8 vector", F.transform(v, lambda x: x.cast("tinyint"))))


def vec_bit(blob: Column | str) -> Column:
    return _guard(F.length(col(blob)) > 0, "not a bit vector", col(blob).cast("binary"))


def vec_length(v: Column | str, kind: str = "float32") -> Column:
    return F.length(col(v)) * 8 if kind == "bit" else F.size(col(v))


def vec_type(kind: str) -> Column:
    if kind not in ("float32", "int8", "bit"):
        raise ValueError(kind)
    return F.lit(kind)


def _pairs(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _pairs(col(a), col(b), lambda x, y: x * y)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def distance_l2(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return _same(a, b, F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def distance_l1(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return _same(a, b, _pairs(a, b, lambda x, y: F.abs(x - y)))


def distance_cosine(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return _same(a, b, F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b)))


def distance_hamming(a: Column | str, b: Column | str) -> Column:
    """Of bit vectors: byte by byte through their hex digits."""
    a, b = col(a), col(b)
    at = F.sequence(F.lit(0), F.length(a) - 1)

    def byte(x: Column, i: Column) -> Column:
        return F.conv(F.hex(F.substr(x, i + 1, F.lit(1))), 16, 10).cast("int")

    bits = F.aggregate(at, F.lit(0), lambda acc, i: acc + F.bit_count(byte(a, i).bitwiseXOR(byte(b, i))))
    return _guard(F.length(a) == F.length(b), "vectors of different dimensions", bits)


def _wrapped(x: Column) -> Column:
    return (F.pmod(x.cast("int") + 128, F.lit(256)) - 128).cast("tinyint")


def vec_add(a: Column | str, b: Column | str, kind: str = "float32") -> Column:
    a, b = col(a), col(b)
    return _same(a, b, F.zip_with(a, b, (lambda x, y: _wrapped(x.cast("int") + y.cast("int"))) if kind == "int8" else (lambda x, y: x + y)))


def vec_sub(a: Column | str, b: Column | str, kind: str = "float32") -> Column:
    a, b = col(a), col(b)
    return _same(a, b, F.zip_with(a, b, (lambda x, y: _wrapped(x.cast("int") - y.cast("int"))) if kind == "int8" else (lambda x, y: x - y)))


def vec_slice(v: Column | str, start: int, end: int, kind: str = "float32") -> Column:
    """Dimensions start (included) to end (not included)."""
    if start < 0 or end < 0 or start >= end:
        raise ValueError("a slice needs 0 <= start < end")
    v = col(v)
    if kind == "bit":
        if start % 8 or end % 8:
            raise ValueError("bounds of bit vectors are multiples of 8")
        return _guard(F.length(v) * 8 >= end, "slice beyond the vector", F.substr(v, F.lit(start // 8 + 1), F.lit((end - start) // 8)))
    return _guard(F.size(v) >= end, "slice beyond the vector", F.slice(v, start + 1, end - start))


def vec_normalize(v: Column | str) -> Column:
    v = col(v)
    n = norm(v)
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), n))


def vec_to_json(v: Column | str, kind: str = "float32") -> Column:
    v = col(v)
    if kind == "bit":
        byte = F.transform(F.sequence(F.lit(0), F.length(v) - 1), lambda i: F.conv(F.hex(F.substr(v, i + 1, F.lit(1))), 16, 10).cast("int"))
        v = F.flatten(F.transform(byte, lambda x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.floor(x / F.pow(F.lit(2), k)).cast("int") % 2)))
    one = (lambda x: x.cast("string")) if kind != "float32" else (lambda x: F.when(F.isnan(x), "null").otherwise(F.format_string("%.6f", x.cast("double"))))
    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ","), F.lit("]"))


def vec_quantize_binary(v: Column | str) -> Column:
    """One bit for each dimension: is it positive; eight to a byte, lowest bit first."""
    v = col(v)
    byte = F.transform(F.sequence(F.lit(0), (F.size(v) / 8).cast("int") - 1), lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, i: acc + F.when(F.element_at(v, k * 8 + i + 1) > 0, F.pow(F.lit(2), i).cast("int")).otherwise(0)))
    return _guard(F.size(v) % 8 == 0, "dimensions are no multiple of 8", F.unhex(F.array_join(F.transform(byte, lambda x: F.lpad(F.hex(x), 2, "0")), "")))


def vec_quantize_int8(v: Column | str, mode: str = "unit") -> Column:
    """[-1, 1] onto [-128, 127], cut toward zero and held within it."""
    if mode != "unit":
        raise ValueError("the only mode is unit")
    step = F.lit(2.0 / 255.0).cast("float").cast("double")
    return F.transform(col(v), lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-128.0), (x.cast("double") + 1.0) / step - 128.0)).cast("int").cast("tinyint"))


DISTANCES = {"l2": distance_l2, "l1": distance_l1, "cosine": distance_cosine, "hamming": distance_hamming}


def register(spark) -> None:
    """The distances and vec_each by name in SQL, as SQL functions that Catalyst inlines."""
    for name, body in {
        "vec_dot": "aggregate(zip_with(a, b, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)",
        "vec_distance_l2": "sqrt(aggregate(zip_with(a, b, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (s, x) -> s + x))",
        "vec_distance_l1": "aggregate(zip_with(a, b, (x, y) -> abs(cast(x as double) - y)), 0D, (s, x) -> s + x)",
        "vec_distance_cosine": "1D - try_divide(aggregate(zip_with(a, b, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + cast(x as double) * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + cast(x as double) * x)))",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_each(v ARRAY<FLOAT>) RETURNS TABLE(rowid INT, value FLOAT) RETURN SELECT pos, col FROM (SELECT posexplode(v))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_version() RETURNS STRING RETURN '{VERSION}'")
