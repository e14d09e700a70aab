"""What held last before a moment: values carried along time, as-of joins, files over renames, and work sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import Steps


def carry_last(df: DataFrame, by: list[str], order: list[str], value: str, name: str, steps: Steps, before: bool = False) -> DataFrame:
    """df with `name`: the last value that isn't null at each row of its group or before it, in order; null if none is.

    With `before` the row's own value doesn't count.

    Rows are dealt to slices by ranges of group and order, so a group of any size takes as many slices as it needs. Each
    slice carries its own values on; what the slices before it end with comes from a table with a row for each group and
    slice. Rows that are equal in group and order see the value of one of them, so order should end in what tells rows
    apart. Null groups are a group.
    """
    dealt = df.repartitionByRange(*(F.col(c) for c in [*by, *order])).withColumn("_slice", F.spark_partition_id())
    dealt = steps.write(dealt)
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow))
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_value")))).alias("_last")
    ends = dealt.groupBy(*by, "_slice").agg(last)
    carried = F.last("_last._value", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    ends = steps.write(ends.select(*by, "_slice", carried.alias("_before")).where("_before is not null"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*by, "_slice"]]
    joined = dealt.withColumn("_own", own).alias("d").join(ends.alias("e"), same, "left")
    return joined.select(*(F.col(f"d.{c}") for c in df.columns), F.coalesce("_own", "_before").alias(name))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, fields: list[str], tie: list[str]) -> DataFrame:
    """left with fields of the last row of right, in the same group, at or before its time; nulls if there is none.

    Columns of left with the names of fields are replaced. Of rows of right at one time the greatest by `tie`, columns of right, is last. Rows of left keep their number, copies
    too; a null time has no row before it. Both sides meet in one ordered stream, so nothing is compared in pairs.
    """
    steps = Steps(left.sparkSession, "asof")
    # Each value once: what rows of one time are ordered by also holds the fields.
    held = F.struct(*tie, *(f for f in fields if f not in tie))
    moments = right.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"), held.alias("_held"), F.lit(0).alias("_side"))
    rest = [c for c in left.columns if c not in (*by, at, *fields)]
    asked = left.select(*by, F.col(at).alias("_at"), F.lit(None).cast(moments.schema["_held"].dataType).alias("_held"), F.lit(1).alias("_side"), (F.struct(*rest) if rest else F.lit(True)).alias("_row"))
    moments = moments.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    both = carry_last(moments.unionByName(asked), by, ["_at", "_side", "_held"], "_held", "_found", steps).where("_side = 1")
    found = F.when(F.col("_at").isNotNull(), F.col("_found"))
    own = lambda c: F.col(c) if c in by else F.col("_at").alias(c) if c == at else F.col("_row")[c].alias(c)
    return both.select(*(own(c) for c in left.columns if c not in fields), *(found[f].alias(f) for f in fields))


def file_identities(changes: DataFrame) -> DataFrame:
    """changes (repo, sha, pos, path, old_path, committed_at, ...) with file_path: the first name of the file each one is of.

    A path names a file from a rename to it until the next, or from its first change. That is the file which the old path
    named before the commit, so all names of a file lead to the first. So a -> b -> a is one file; two paths that a commit
    swaps keep their files; renames of one path in parallel branches share their file; changes of an old name after its
    rename, as branches bring, stay with the file; and a path that a rename takes over goes from one file to another. Order
    is that of committed_at and sha, null times first; (repo, sha, pos) is a key, of repeated rows one is told.
    """
    steps = Steps(changes.sparkSession, "files")
    order = ["_at", "_sha", "_pos"]
    rest = F.struct(*(c for c in changes.columns if c not in ("repo", "sha", "pos", "path", "committed_at")))
    rows = steps.write(changes.select("repo", "path", F.col("committed_at").alias("_at"), F.col("sha").alias("_sha"), F.col("pos").alias("_pos"), rest.alias("_rest"), F.monotonically_increasing_id().alias("_row")))
    renamed = F.col("_rest.old_path").isNotNull()
    moment = F.struct(F.col("_at").alias("at"), F.col("_sha").alias("sha"), F.col("_pos").alias("pos"))
    named = rows.withColumns({"start": F.when(renamed, moment), "is_change": F.lit(True)})
    # What the old path named is asked in the same stream, before all changes of the commit.
    nothing = {c: F.lit(None).cast(named.schema[c].dataType) for c in ("start", "_rest")}
    asked = named.where(renamed).withColumns({"path": F.col("_rest.old_path"), "_pos": F.lit(-1).cast(rows.schema["_pos"].dataType), "is_change": F.lit(False)}).withColumns(nothing)
    held = steps.write(carry_last(named.unionByName(asked), ["repo", "path"], [*order, "is_change", "_row"], "start", "since", steps).drop("start"))
    steps.keep(held)
    changed = held.where("is_change")
    renames = changed.where(renamed).select("_row", "repo", "path", moment.alias("since"))
    asked = held.where("not is_change").select("_row", F.col("path").alias("up_path"), F.col("since").alias("up_since"))
    up = F.min(F.struct("up_since", "up_path")).alias("up")
    at = steps.write(renames.join(asked, "_row").groupBy("repo", "path", "since").agg(up).select("repo", "path", "since", "up.up_path", "up.up_since"))
    # Each name points to the one before; pointers jump until all lead to a first name.
    while not at.where("up_since is not null").isEmpty():
        to = at.select("repo", F.col("path").alias("up_path"), F.col("since").alias("up_since"), F.col("up_path").alias("p2"), F.col("up_since").alias("s2"))
        jumped = at.join(to, ["repo", "up_path", "up_since"], "left")
        new = steps.write(jumped.select("repo", "path", "since", F.coalesce("p2", "up_path").alias("up_path"), F.col("s2").alias("up_since")))
        steps.drop(at)
        at = new
    # Changes before any rename to their path have its own name and need no join.
    first = at.select("repo", "path", "since", "up_path")
    under = changed.where("since is not null").join(first, ["repo", "path", "since"], "left").select(*changed.columns, F.coalesce("up_path", "path").alias("file_path"))
    out = changed.where("since is null").withColumn("file_path", F.col("path")).unionByName(under)
    name = {"sha": "_sha", "pos": "_pos", "committed_at": "_at", "repo": "repo", "path": "path"}
    return out.select(*(F.col(name.get(c, f"_rest.{c}")).alias(c) for c in changes.columns), "file_path")


def work_sessions(commits: DataFrame, gap: str, by: list[str], at: str = "committed_at") -> DataFrame:
    """(by, started_at, ended_at, commits): stretches of commits of one group, each no more than `gap` after the one before.

    The same as session windows of that gap, whose end is the last commit here; but a group is dealt to slices by time, so
    an author with a third of all commits is no single task. Commits without a time have no session; null groups are a group.
    """
    steps = Steps(commits.sparkSession, "sessions")
    times = commits.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("_at"))
    times = carry_last(times, by, ["_at"], "_at", "_was", steps, before=True)
    begins = F.col("_was").isNull() | (F.col("_at") > F.col("_was") + F.expr(f"interval {gap}"))
    # Of commits at one moment only the first begins a session, so they see one start whatever their order.
    begun = times.groupBy(*by, "_at").agg(F.count("*").alias("n"), F.max(begins).alias("begins")).withColumn("_start", F.when(F.col("begins"), F.col("_at")))
    held = carry_last(begun, by, ["_at"], "_start", "started_at", steps)
    return held.groupBy(*by, "started_at").agg(F.max("_at").alias("ended_at"), F.sum("n").alias("commits"))
