"""Parsing jobs over log records. All but dedupe, its conflicts and the parent join are maps without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import record as R


def parse_header(df: DataFrame, *keep: str) -> DataFrame:
    """(repo, raw, n_parts, fields, tail) and columns to keep from (repo, raw); a short record has nulls for what it lacks."""
    # Generated, so that filters on the parts don't split the record again for each of them.
    parts = df.select("*", F.explode(F.array(F.split("raw", R.FIELD))).alias("parts"))
    return parts.select("repo", "raw", F.size("parts").alias("n_parts"), *(F.get("parts", F.lit(i)).alias(k) for i, k in enumerate(R.FIELDS)), F.get("parts", F.lit(len(R.FIELDS))).alias("tail"), *keep)


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and (repo, raw, reason) of those with another number of parts, no sha, or no readable time with a zone."""
    reason = (
        F.when(F.col("n_parts") != len(R.FIELDS) + 1, "parts")
        .when(F.coalesce(F.trim("sha"), F.lit("")) == "", "sha")
        .when(R.instant(F.col("authored")).isNull() | R.instant(F.col("committed")).isNull(), "time")
    )
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("repo", "raw", "reason")


def _rank(df: DataFrame) -> list:
    """What copies of a commit are ordered by: the length of the tail, then all values. Unlike copies never tie."""
    values = [c for c in df.columns if c not in ("repo", "sha")]
    size = [F.coalesce(F.octet_length("tail"), F.lit(-1)).alias("_size")] if "tail" in values else []
    return size + [F.col(f"`{c}`") for c in sorted(values, key=lambda c: c != "raw")]


def dedupe(df: DataFrame) -> DataFrame:
    """One row for each (repo, sha), before anything is exploded: of unlike copies that with the longest tail.

    A maximum, so it is the same for any order of the rows, and copies combine in the tasks before the shuffle. Parsed
    records, with the columns of parse_header, are shuffled as their text alone and parsed once more.
    """
    rank = _rank(df)
    if not rank:
        return df.distinct()
    if set(df.columns) == {"repo", "raw", "n_parts", *R.FIELDS, "tail"}:
        best = df.groupBy("repo", "sha").agg(F.max(F.struct(*rank[:2])).alias("_best"))
        return parse_header(best.select("repo", "_best.raw")).select(*df.columns)
    best = df.groupBy("repo", "sha").agg(F.max(F.struct(*rank)).alias("_best"))
    return best.select(*(F.col(c) if c in ("repo", "sha") else F.col("_best")[c].alias(c) for c in df.columns))


def conflicts(df: DataFrame) -> DataFrame:
    """(repo, sha, raw, copies, kept): each version of the commits whose copies are unlike, and whether dedupe keeps it.

    Records must not be deduplicated yet. Which commits these are is found by hashes of 64 bits. Texts are shuffled once and
    alone, unless so few commits are unlike that their keys are broadcast.
    """
    h = F.xxhash64("raw")
    unlike = df.groupBy("repo", "sha").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low < high").select("repo", "sha")
    size = F.coalesce(F.octet_length("tail"), F.lit(-1)).alias("_size")
    versions = df.select("repo", "sha", "raw", size).join(unlike, ["repo", "sha"], "left_semi").groupBy("repo", "sha", "raw", "_size").agg(F.count("*").alias("copies"))
    # The versions of a commit have met by now, so no further shuffle is needed.
    best = F.max(F.struct("_size", "raw")).over(Window.partitionBy("repo", "sha"))
    return versions.withColumn("_best", best).select("repo", "sha", "raw", "copies", (F.col("raw") == F.col("_best.raw")).alias("kept"))


def parse_times(df: DataFrame) -> DataFrame:
    return df.withColumns({"authored_at": R.instant(F.col("authored")), "author_offset": R.offset(F.col("authored")), "committed_at": R.instant(F.col("committed"))})


def parse_parents(df: DataFrame) -> DataFrame:
    return df.withColumn("parents", R.parents(F.col("parents")))


def parent_edges(df: DataFrame, *keep: str) -> DataFrame:
    """(repo, child, parent, ordinal) and columns to keep from parsed parents; the first parent has ordinal 0."""
    return df.select("repo", F.col("sha").alias("child"), F.posexplode("parents").alias("ordinal", "parent"), *keep).select("repo", "child", "parent", "ordinal", *keep)


def join_parents(edges: DataFrame, commits: DataFrame, *fields: str) -> DataFrame:
    """Edges with fields of the parent, as parent_<field>; null where the parent was not exported."""
    of = commits.select("repo", F.col("sha").alias("parent"), *(F.col(f).alias(f"parent_{f}") for f in fields))
    return edges.join(of, ["repo", "parent"], "left")


def parse_message(df: DataFrame) -> DataFrame:
    m = F.col("message")
    return df.withColumns({"subject": R.subject(m), "trailers": R.trailers(m)}).withColumn("body", R.body(m, F.size("trailers")))


def split_numstat(df: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The lines of the tails as file changes, and the malformed ones apart.

    Changes are (repo, sha, pos, printed, added, deleted, is_binary) and columns to keep; pos is the line's place among the
    tail's lines that aren't blank, from 0. A line is malformed if it lacks a part, or if its counts are neither whole
    numbers that a long holds nor both `-`: such lines are (repo, sha, pos, raw, reason), and the commit's others stay.
    """
    lines = F.filter(F.split("tail", "\n"), lambda x: F.trim(x) != "")
    parts = df.select("repo", "sha", *keep, F.posexplode(lines).alias("pos", "raw")).select("*", F.explode(F.array(F.split("raw", "\t", 3))).alias("p"))
    added, deleted, printed = (F.get("p", F.lit(i)) for i in range(3))
    count = lambda x: x.rlike("^[0-9]+$") & x.try_cast("long").isNotNull()
    binary = (added == "-") & (deleted == "-")
    marked = parts.withColumn("ok", F.coalesce((F.trim(printed) != "") & (binary | (count(added) & count(deleted))), F.lit(False)))
    good = marked.where("ok").select("repo", "sha", "pos", printed.alias("printed"), added.try_cast("long").alias("added"), deleted.try_cast("long").alias("deleted"), binary.alias("is_binary"), *keep)
    return good, marked.where("not ok").select("repo", "sha", "pos", "raw", F.lit("numstat").alias("reason"))


def parse_numstat(df: DataFrame, *keep: str) -> DataFrame:
    """The well-formed lines of the tails as file changes; see split_numstat."""
    return split_numstat(df, *keep)[0]


def parse_paths(df: DataFrame) -> DataFrame:
    """printed replaced by path and old_path."""
    return df.select(*(c for c in df.columns if c != "printed"), F.inline(F.array(R.paths(F.col("printed")))))
