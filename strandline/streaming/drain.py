"""The embedding loop: batches until nothing waits, then again after a while."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from strandline.operators.store import pending_chunks
from strandline.sources.embedding import Embedder, embed

log = logging.getLogger(__name__)


def embed_batch(chunks: DataFrame, sessions: DataFrame, vectors: DataFrame, make: Callable[[], Embedder], limit: int = 50) -> DataFrame:
    """The rows of the vector table for the next ``limit`` waiting chunks. Waiting is an
    anti-join with the vectors, so a crash between two writes leaves nothing behind."""
    rows = embed(pending_chunks(chunks, sessions, vectors, limit), make)
    return rows.where("embedding is not null").select("chunk_id", "project_id", "agent", "embedding", "session_id")


def drain(step: Callable[[], int], most: int = 1_000_000) -> int:
    """Runs ``step`` until it handles nothing; how much it handled."""
    total = 0
    for _ in range(most):
        n = step()
        if n <= 0:
            break
        total += n
    return total


class Loop:
    """``drain`` at once and then every ``interval`` seconds; the same error is logged once,
    and so is its end."""

    def __init__(self, step: Callable[[], int], interval: float = 30.0, sleep: Callable[[float], None] = time.sleep):
        self.step, self.interval, self.sleep, self.error = step, interval, sleep, None

    def turn(self) -> int:
        try:
            n = drain(self.step)
        except Exception as e:  # the loop outlives the service
            if str(e) != self.error:
                log.warning("embedding failed: %s", e)
            self.error = str(e)
            return 0
        if self.error is not None:
            log.info("embedding works again")
            self.error = None
        return n

    def run(self, turns: int | None = None) -> None:
        while turns is None or turns > 0:
            self.turn()
            turns = None if turns is None else turns - 1
            if turns != 0:
                self.sleep(self.interval)
