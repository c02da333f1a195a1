"""Text functions as column expressions; all but the marked ones stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
PLACEHOLDER = "[REDACTED]"
#: Vendors' token shapes, in the order in which they are replaced.
TOKEN_PATTERNS = [
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,255}",
    r"xox[baprs]-[A-Za-z0-9-]{10,72}",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"(sk|rk)_live_[0-9A-Za-z]{16,}",
    r"sk-(ant-|proj-)?[A-Za-z0-9_\-]{20,}",
    r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
    r"(?is)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)bearer\s+[A-Za-z0-9._\-]{10,}",
]
ENV_LINE = r"(?md)^([A-Z][A-Z0-9_]*)=(\S+)"
DENSE_RUN = r"[A-Za-z0-9+/_\-]{20,}"
MIN_ENTROPY = 4.3
TITLE_CHARS, STEM_CHARS, LEAST_TERM, PREVIEW_CHARS, BRIEF_CHARS = 80, 5, 2, 400, 360
# ------------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy(text: Column) -> Column:
    """Bits per character of a text."""
    n = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != "")), lambda x: (n - F.length(F.replace(text, x, F.lit("")))) / n)
    return -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def redact(text: Column | str, hex_strict: bool = False) -> Column:
    """Likely secrets replaced: token shapes, then the values of environment lines, then
    dense runs with a letter, a digit and enough entropy. ``hex_strict`` also replaces
    runs of 32 and more hex digits, which have too little entropy to be caught."""
    out = col(text)
    for p in TOKEN_PATTERNS:
        out = F.regexp_replace(out, p, r"\[REDACTED\]")
    out = F.regexp_replace(out, ENV_LINE, r"$1=\[REDACTED\]")
    if hex_strict:
        out = F.regexp_replace(out, r"(?i)\b[0-9a-f]{32,}\b", r"\[REDACTED\]")
    return let(out, _without_dense_runs)


def _without_dense_runs(out: Column) -> Column:
    """Runs and what is between them alternate; only texts with a run are taken apart."""
    runs = F.regexp_extract_all(out, F.lit(f"({DENSE_RUN})"), F.lit(1))
    gaps = F.split(out, DENSE_RUN, -1)
    made = F.transform(runs, lambda r: F.when(r.rlike("[A-Za-z]") & r.rlike("[0-9]") & (entropy(r) >= MIN_ENTROPY), PLACEHOLDER).otherwise(r))
    whole = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), made.alias("r")), lambda z: F.array(z["g"], F.coalesce(z["r"], F.lit(""))))), "")
    return F.when(out.rlike(DENSE_RUN), whole).otherwise(out)


def clean_pasted(text: Column | str) -> Column:
    """User text without the tags around pasted content."""
    t = col(text)
    return F.when(t.contains("pasted_content"), F.regexp_replace(F.regexp_replace(t, r'</?pasted_content(?:\s+id="[^"]*")?\s*>', ""), r"^\s+|\s+$", "")).otherwise(t)


def decode_char_refs(text: Column) -> Column:
    """Numeric character references decoded; invalid ones stay. Pieces are decoded through
    UTF-32 bytes, so any code point works without Python."""
    ref = r"&#(?:[xX][0-9a-fA-F]+|[0-9]+);"
    refs = F.regexp_extract_all(text, F.lit(f"({ref})"), F.lit(1))
    gaps = F.split(text, ref, -1)

    def one(r: Column) -> Column:
        digits = F.regexp_replace(r, "^&#[xX]?|;$", "")
        is_hex = r.rlike("^&#[xX]")
        short = F.length(F.regexp_replace(digits, "^0+", "")) <= F.when(is_hex, 6).otherwise(7)
        n = F.when(short, F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
        ok = n.isNotNull() & (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(r)

    made = F.transform(refs, one)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), made.alias("r")), lambda z: F.array(z["g"], F.coalesce(z["r"], F.lit(""))))), "")


def clean_escaped(text: Column | str) -> Column:
    """User text with numeric references decoded and escapes of _ and * undone."""
    t = col(text)
    done = F.regexp_replace(F.regexp_replace(decode_char_refs(t), r"\\([_*])", "$1"), r"^\s+|\s+$", "")
    return F.when(t.contains("&") | t.contains("\\"), done).otherwise(t)


def truncate(text: Column | str, n: int = TITLE_CHARS) -> Column:
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)


def cut_with_note(text: Column | str, n: int) -> Column:
    """A text cut to n characters, with a note of how many there were."""
    t = col(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.format_string(f" … [truncated, {n} of %d chars shown]", F.length(t)))).otherwise(t)


def compact_preview(text: Column | str, n: int = BRIEF_CHARS) -> Column:
    t = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def clean_path(path: Column | str) -> Column:
    """A path with / as separator and without ., .. and empty steps; '' becomes '.'."""
    return let(F.regexp_replace(F.trim(col(path)), r"\\", "/"), _cleaned)


def _cleaned(p: Column) -> Column:
    rooted = p.startswith("/")
    steps = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(steps, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def relative_path(path: Column | str, root: Column | str) -> Column:
    """``path`` seen from ``root``; paths outside, and relative ones, stay."""

    def seen(z: Column) -> Column:
        p, r = z["p"], z["r"]
        below = p.startswith(F.concat(F.when(r == "/", F.lit("")).otherwise(r), F.lit("/")))
        return F.when(p == r, ".").when(below, F.substr(p, F.length(F.when(r == "/", F.lit("")).otherwise(r)) + 2)).otherwise(p)

    return let(F.struct(clean_path(path).alias("p"), clean_path(root).alias("r")), seen)


def normalise_remote(url: Column | str) -> Column:
    """A git remote in any notation as host/owner/repo in lower case; null if it is none."""
    u = F.regexp_replace(F.trim(col(url)), r"\.git/?$", "")
    scheme = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:]+)(?::\d+)?/(.+)$", 1)
    scheme_path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:]+)(?::\d+)?/(.+)$", 2)
    host, path = F.regexp_extract(u, r"^(?:[^@/:]+@)([^:/]+):(?!//)(.+)$", 1), F.regexp_extract(u, r"^(?:[^@/:]+@)([^:/]+):(?!//)(.+)$", 2)
    return F.lower(F.when(scheme != "", F.concat_ws("/", scheme, scheme_path)).when(host != "", F.concat_ws("/", host, path)))


def split_actions(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def commit_range(first: Column | str, last: Column | str, source: Column | str) -> Column:
    """'abc..def' of the first twelve characters of two commits, with a mark of doubt."""
    a, z = F.left(F.nullif(col(first), F.lit("")), F.lit(12)), F.left(F.nullif(col(last), F.lit("")), F.lit(12))
    span = F.when(a.isNull() & z.isNull(), None).when(a.isNull(), z).when(z.isNull() | (a == z), a).otherwise(F.concat(a, F.lit(".."), z))
    return F.concat(span, F.when(F.coalesce(col(source), F.lit("")).isin("head", "unverified"), F.concat(F.lit(" ("), col(source), F.lit(")"))).otherwise(""))


def short_commit(commit: Column | str) -> Column:
    return F.left(F.nullif(col(commit), F.lit("")), F.lit(12))


def git_line(branch: Column | str, first: Column | str, last: Column | str, source: Column | str) -> Column:
    """'branch @ range', or the one of them that is known; empty if none is."""
    return F.concat_ws(" @ ", F.nullif(col(branch), F.lit("")), commit_range(first, last, source))


def worse(a: Column, b: Column, order: list[str]) -> Column:
    """Of two marks the one further down the list; unknown and empty ones don't count."""
    rank = F.array(*map(F.lit, order))
    x, y = (F.coalesce(F.array_position(rank, c), F.lit(0)) for c in (a, b))
    return F.when(y > x, b).when(x > 0, a).otherwise(F.coalesce(F.nullif(a, F.lit("")), b))


def project_path(path: Column | str, cwd: Column | str, root: Column | str, tool: bool = False) -> Column:
    """A path as seen from the repository's root; those outside it stay. A relative one
    stands below ``cwd``, but a tool's relative path is left as it is."""
    p, c = col(path), F.coalesce(col(cwd), F.lit(""))
    full = F.when(p.startswith("/") | (c == ""), p).otherwise(F.concat_ws("/", c, p))
    moved = F.when(F.coalesce(col(root), F.lit("")) == "", clean_path(p)).when(full.startswith("/"), relative_path(full, root)).otherwise(clean_path(p))
    kept = F.when(moved.startswith("/") & ~p.startswith("/"), clean_path(p)).otherwise(moved)  # outside of the root
    return F.when(p.startswith("/"), kept).otherwise(clean_path(p)) if tool else kept


def utc_now() -> Column:
    """The time of the query, to the second, as the store's tables have it."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- of queries, on the driver ---------------------------------------------------------
_PIECE = re.compile(r'"[^"]*"|\S+')


def _plain(word: str) -> bool:
    """Whether a word can stand in a query as it is: letters, digits and underscores of
    ASCII, perhaps excluded, perhaps a prefix, perhaps in brackets."""
    core = word.lstrip("(").removeprefix("-").rstrip(")").removesuffix("*")
    return all(c == "_" or c.isascii() and c.isalnum() for c in core)


def sanitise_query(query: str) -> str:
    """A query in which every word that isn't plain is a quoted phrase."""
    out = []
    for p in _PIECE.findall(query):
        if (p[0] == p[-1] == '"' and len(p) > 1) or p in ("AND", "OR", "NOT") or _plain(p):
            out.append(p)
        else:
            out.append('"' + p.replace('"', '""') + '"')
    return " ".join(out)


def query_terms(query: str) -> list[str]:
    """The stems that a preview looks for: in order, without operators and exclusions."""
    words = (w for w in query.split() if w not in ("AND", "OR", "NOT") and not w.startswith("-"))
    stems = (p.lower()[:STEM_CHARS] for w in words for p in re.split(r"[^\w]+", w) if len(p) >= LEAST_TERM)
    return list(dict.fromkeys(stems))


def centred_preview(text: Column | str, query: str, width: int = PREVIEW_CHARS) -> Column:
    """The window of ``width`` characters, begun a quarter of it before a hit, with most
    different terms; of equal ones the earliest term's first. An Arrow UDF: it runs on
    the few rows after the limit."""
    terms = query_terms(query)

    @F.pandas_udf("string")
    def preview(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else preview_of(t, terms, width))

    return preview(col(text))


def preview_of(text: str, terms: list[str], width: int = PREVIEW_CHARS) -> str:
    from bisect import bisect_left

    n = len(text)
    if n <= width:
        return text
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = {k: [m.start() for m in re.finditer(rf"(?<!\w){re.escape(t)}", low)] for k, t in enumerate(terms)}
    best, most = None, 0
    for k in sorted(places):
        for at in places[k]:
            start = min(max(0, at - width // 4), n - width)
            seen = sum(bisect_left(p, start) < bisect_left(p, start + width) for p in places.values())
            if seen > most:
                best, most = start, seen
    if best is None:
        return text[:width] + " …"
    return ("… " if best else "") + text[best : best + width] + (" …" if best + width < n else "")
