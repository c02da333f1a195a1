"""Commit histories and repository roots, looked up once for each directory."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

MOST_COMMITS = 20_000


def run_git(directory: str, *args: str) -> str | None:
    try:
        out = subprocess.run(["git", "-C", directory, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout if out.returncode == 0 else None


def parse_history(text: str) -> list[tuple[str, int]]:
    """(hash, seconds) of lines ``hash seconds``, newest first; others are dropped."""
    rows = [line.split() for line in text.splitlines()]
    good = [(r[0], int(r[1])) for r in rows if len(r) == 2 and r[1].lstrip("-").isdigit()]
    return sorted(good, key=lambda r: -r[1])


def history(spark: SparkSession, homes: list[tuple[str, str | None]]) -> DataFrame:
    """(cwd, branch, hash, at, source) of (directory, branch): the branch's commits, or
    else the head's. A driver-side lookup, as large as the histories asked for."""
    rows = []
    for cwd, branch in dict.fromkeys(homes):
        for ref, source in ((branch, "branch"), ("HEAD", "head")):
            text = run_git(cwd, "log", "--first-parent", "-n", str(MOST_COMMITS), "--format=%H %ct", ref) if ref else None
            if text:
                rows += [(cwd, branch, h, at, source) for h, at in parse_history(text)]
                break
    return spark.createDataFrame(rows, "cwd string, branch string, hash string, at long, source string")


def roots(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(cwd, root, git_remote) of directories; nulls where there is no repository."""
    rows = []
    for d in dict.fromkeys(directories):
        top, url = run_git(d, "rev-parse", "--show-toplevel"), run_git(d, "remote", "get-url", "origin")
        rows.append((d, top.strip() if top else None, url.strip() if url else None))
    return spark.createDataFrame(rows, "cwd string, root string, git_remote string")
