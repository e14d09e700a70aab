"""The tables of a log export. Each is a map over deduplicated records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftwork.operators import parsing as P


def records(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deduplicated good records and bad records. Bad ones go first: without a sha they would merge."""
    good, bad = P.split_bad(P.parse_header(log))
    return P.dedupe(good), bad


def commits(good: DataFrame, *keep: str) -> DataFrame:
    """Commits with columns of their records to keep."""
    out = P.parse_message(P.parse_parents(P.parse_times(good)))
    return out.select("repo", "sha", "parents", "author_name", "author_email", "authored_at", "author_offset", "committed_at", "subject", "body", "trailers", *keep)


def file_changes(good: DataFrame, *keep: str) -> DataFrame:
    """File changes with columns of their commit to keep."""
    return P.parse_paths(P.parse_numstat(good, *keep)).select("repo", "sha", "pos", "path", "old_path", "added", "deleted", "is_binary", *keep)


def bad_lines(good: DataFrame) -> DataFrame:
    """(repo, sha, pos, raw, reason): lines of file changes that are malformed."""
    return P.split_numstat(good)[1]
