"""History of a repository as (sha, path) rows, from its log."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..errors import ModelUnavailable

COMMITS = "sha string, path string"


def _git(root: str, *args: str, timeout: int) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout)


def top(root: str) -> str:
    """The repository's top folder, which log paths are relative to; what is no repository is refused."""
    out = _git(root, "rev-parse", "--show-toplevel", timeout=60)
    if out.returncode:
        raise ModelUnavailable(f"not a git repository: {out.stderr.decode(errors='replace').strip()}")
    return os.path.realpath(out.stdout.decode().strip())


def parse_log(log: str) -> list[tuple[str, str]]:
    """Rows of a NUL-separated `log -z --numstat --format=%H`. A renamed file counts under its new name, merges give nothing."""
    rows, sha, fields = [], None, iter(log.split("\0"))
    for f in fields:
        counts = f.lstrip("\n").split("\t", 2)
        if len(counts) < 3:
            sha = f.strip() or sha
        elif counts[2]:
            rows.append((sha, counts[2]))
        else:
            next(fields, None)
            rows.append((sha, next(fields, "")))
    return [r for r in rows if r[0] and r[1]]


def commits(spark: SparkSession, root: str) -> DataFrame:
    at = top(root)
    out = _git(at, "log", "-z", "--numstat", "--format=%H", timeout=600)
    if out.returncode:
        err = out.stderr.decode(errors="replace")
        if "does not have any commits" in err:
            return spark.createDataFrame([], COMMITS)
        raise ModelUnavailable(f"git log failed in {at}: {err.strip()}")
    return spark.createDataFrame([(s, os.path.realpath(os.path.join(at, p))) for s, p in parse_log(out.stdout.decode(errors="replace"))], COMMITS)
