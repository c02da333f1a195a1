"""Named queries: a registry that is asked by name, with named parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import fulltext, store, transcript, vector_search

_QUERIES: dict[str, Callable[..., DataFrame]] = {}


def named(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    _QUERIES["".join(w.title() for w in f.__name__.split("_"))] = f
    return f


def load_query(name: str) -> Callable[..., DataFrame]:
    if not name or name not in _QUERIES:
        raise KeyError(f"no query named {name!r}; there are {', '.join(sorted(_QUERIES))}")
    return _QUERIES[name]


def _scoped(chunks: DataFrame, sessions: DataFrame, project_id: int | None, agent: str | None) -> DataFrame:
    s = sessions
    if project_id is not None:
        s = s.where(F.col("project_id") == project_id)
    if agent is not None:
        s = s.where(F.col("agent") == agent)
    return chunks.join(s.select("session_id", "agent", "title", "started_at", "project_id"), "session_id")


@named
def search_chunks(index: fulltext.Index, chunks: DataFrame, sessions: DataFrame, query: str, project_id: int | None = None, agent: str | None = None, limit: int = 10) -> DataFrame:
    """Keyword search: statistics over all chunks, hits within the scope, best first. Ids are
    ranked first, from the index; texts are joined to the few that are left."""
    hits = index.search(query)
    scoped = hits.join(_scoped(chunks.select("chunk_id", "session_id"), sessions, project_id, agent), "chunk_id")
    best = scoped.orderBy("bm25", "chunk_id").limit(limit if limit > 0 else 10)
    shown = best.join(chunks.select("chunk_id", "first_seq", "last_seq", "chunk_text"), "chunk_id")
    return shown.withColumn("snippet", fulltext.snippet("chunk_text", query)).drop("chunk_text").orderBy("bm25", "chunk_id")


def rank_lists(index: fulltext.Index, chunks: DataFrame, sessions: DataFrame, vectors: DataFrame, query: str, embedding: list[float], project_id: int | None, agent: str | None) -> tuple[DataFrame, DataFrame]:
    ids = _scoped(chunks.select("chunk_id", "session_id"), sessions, project_id, agent)
    kw = vector_search.ranked(index.search(query).join(ids.select("chunk_id"), "chunk_id", "left_semi"), "bm25")
    where: Column | None = None
    for c, v in (("project_id", project_id), ("agent", agent)):
        if v is not None:
            where = (F.col(c) == v) if where is None else where & (F.col(c) == v)
    near = vector_search.knn(vectors, embedding, vector_search.DEPTH, "cosine", where=where, floor=vector_search.FLOOR)
    return kw, vector_search.ranked(near, "distance")


@named
def search_hybrid(index: fulltext.Index, chunks: DataFrame, sessions: DataFrame, vectors: DataFrame, query: str, embedding: list[float], project_id: int | None = None, agent: str | None = None, limit: int = 10) -> DataFrame:
    """Keyword and vector ranks fused; scope before the ranks, the distance floor after."""
    fused = vector_search.fuse(*rank_lists(index, chunks, sessions, vectors, query, embedding, project_id, agent))
    best = fused.orderBy(F.desc("score"), "chunk_id").limit(limit if limit > 0 else 10)
    shown = best.join(chunks.select("chunk_id", "session_id", "first_seq", "last_seq", "chunk_text"), "chunk_id").join(sessions.select("session_id", "agent", "title", "started_at"), "session_id")
    return shown.orderBy(F.desc("score"), "chunk_id").withColumn("preview", T.centred_preview("chunk_text", query)).drop("chunk_text")


def best_available(index: fulltext.Index, chunks: DataFrame, sessions: DataFrame, vectors: DataFrame | None, query: str, embedder=None, **scope) -> tuple[list, bool, str | None]:
    """(rows, whether vectors were used, why not): hybrid if an embedder is given, and
    keyword search on any error of it."""
    reason = None
    if embedder is not None and vectors is not None:
        try:
            return search_hybrid(index, chunks, sessions, vectors, query, embedder.embed([query])[0], **scope).collect(), True, None
        except Exception as e:  # any failure of the richer plan falls back
            reason = str(e)
    return search_chunks(index, chunks, sessions, query, **scope).collect(), False, reason


@named
def get_chunk(chunks: DataFrame, sessions: DataFrame, messages: DataFrame, chunk_id: int, project_id: int) -> DataFrame:
    """One chunk of a project with its time; its text is cut at 12,000 characters."""
    one = chunks.where(F.col("chunk_id") == chunk_id).join(sessions.where(F.col("project_id") == project_id).select("session_id", "agent"), "session_id")
    one = one.select("chunk_id", "session_id", "agent", "first_seq", "last_seq", T.cut_with_note("chunk_text", 12_000).alias("chunk_text"))
    return transcript.chunk_times(one, messages, sessions)



_QUERIES["RecentSessions"] = transcript.recent
_QUERIES["SessionsTouching"] = transcript.sessions_touching
_QUERIES["ExplainFile"] = transcript.explain_file
_QUERIES["GetSessionMessages"] = transcript.page
_QUERIES["FirstMessageSeqAfter"] = transcript.first_seq_after
_QUERIES["SearchNotes"] = store.search_notes
_QUERIES["PendingChunks"] = store.pending_chunks
_QUERIES["InsertNote"] = store.add_note


def flags_first(arguments: list[str], with_value: tuple[str, ...] = ()) -> list[str]:
    """A command's arguments with its flags (and the values of those in ``with_value``) before
    the others; what follows ``--`` stays where it is."""
    flags, others, rest = [], [], list(arguments)
    while rest:
        a = rest.pop(0)
        if a == "--":
            others += [a, *rest]
            break
        if a.startswith("-") and a != "-":
            flags.append(a)
            if "=" not in a and a.lstrip("-") in with_value and rest:
                flags.append(rest.pop(0))
        else:
            others.append(a)
    return flags + others
