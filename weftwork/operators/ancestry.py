"""How deep each commit's ancestry is, over parent edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.session import Steps

KEY = ["repo", "sha"]


def _anchors(steps: Steps, single: DataFrame, most: int) -> DataFrame:
    """(repo, sha, up, w) for commits of one parent: the first ancestor that isn't one of them, and the steps to it.

    Every commit's pointer jumps to where its target's points, so a chain takes as many rounds as its length has bits.
    Pointers that would pass more commits than there are run in a circle and are left out.
    """
    at = steps.write(single.select(*KEY, "up", F.lit(1).cast("long").alias("w"), F.lit(False).alias("done")))
    while not at.where("not done").isEmpty():
        to = at.select("repo", F.col("sha").alias("up"), F.col("up").alias("up2"), F.col("w").alias("w2"), F.col("done").alias("done2"))
        jumped = at.join(to, ["repo", "up"], "left")
        new = jumped.select(*KEY, F.coalesce("up2", "up").alias("up"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), (F.col("up2").isNull() | F.coalesce("done2", F.lit(False))).alias("done"))
        new = steps.write(new.where(F.col("w") <= most))
        steps.drop(at)
        at = new
    return at.drop("done")


def ancestry_depth(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, sha, depth) for each commit: the edges on its longest way back to a commit without parents.

    Parents that weren't exported don't count, nor do edges from a commit to itself; repeated edges and commits are one.
    Commits in a circle, which no history has, and those after it have depth null. Commits of one parent, most by far,
    are settled by pointer jumping; what is left are merges, level by level: a merge is settled once all its parents are,
    and each edge is passed on once. So rows grow with the edges, never with the ways through them, and rounds with the
    merges that lie on one way.
    """
    spark = edges.sparkSession
    steps = Steps(spark, "ancestry")
    nodes = steps.write(commits.select(*KEY).distinct())
    n = nodes.count()
    e = edges.select("repo", F.col("child").alias("sha"), F.col("parent").alias("up")).where("sha <> up").distinct()
    e = e.join(nodes, KEY, "left_semi").join(nodes.withColumnRenamed("sha", "up"), ["repo", "up"], "left_semi")
    e = steps.write(e.select(*KEY, "up"))
    parents = steps.write(e.groupBy(*KEY).agg(F.count("*").alias("parents"), F.min("up").alias("up")))
    single = parents.where("parents = 1")
    chains = _anchors(steps, single, n)
    merges = parents.where("parents > 1").select(*KEY)
    # Each parent of a merge stands for the end of its chain, so many steps further.
    chain = chains.select("repo", F.col("sha").alias("up"), F.col("up").alias("anchor"), "w")
    circled = single.select("repo", F.col("sha").alias("up")).join(chains.select("repo", F.col("sha").alias("up")), ["repo", "up"], "left_anti")
    ends = e.join(merges, KEY, "left_semi").join(chain, ["repo", "up"], "left").join(circled.withColumn("circled", F.lit(True)), ["repo", "up"], "left")
    # A merge after a circle waits for a commit that never settles.
    anchor = F.when(F.col("circled"), F.lit(None)).otherwise(F.coalesce("anchor", "up"))
    ends = steps.write(ends.select(*KEY, anchor.alias("anchor"), (1 + F.coalesce("w", F.lit(0))).alias("w")).groupBy(*KEY, "anchor").agg(F.max("w").alias("w")))
    need = steps.write(ends.groupBy(*KEY).agg(F.count("*").alias("need")))
    known = "repo string, sha string, depth long"
    frontier = nodes.join(parents, KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("depth"))
    frontier.write.parquet(steps.path("known"))
    frontier = spark.read.schema(known).parquet(steps.path("known"))
    level = 0
    while not frontier.isEmpty():
        level += 1
        told = ends.join(frontier.withColumnRenamed("sha", "anchor"), ["repo", "anchor"]).groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.col("w") + F.col("depth")).alias("depth"))
        told.write.parquet(f"{steps.path('told')}/level={level}")
        told = spark.read.schema("repo string, sha string, n long, depth long, level int").parquet(steps.path("told"))
        touched = told.where(F.col("level") == level).select(*KEY)
        ready = told.join(touched, KEY, "left_semi").groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("depth").alias("depth")).join(need, KEY).where("n = need")
        frontier = steps.write(ready.select(*KEY, "depth"))
        frontier.write.mode("append").parquet(steps.path("known"))
    settled = spark.read.schema(known).parquet(steps.path("known"))
    behind = chains.join(settled.select("repo", F.col("sha").alias("up"), F.col("depth").alias("of")), ["repo", "up"]).select(*KEY, (F.col("w") + F.col("of")).alias("depth"))
    return nodes.join(settled.unionByName(behind), KEY, "left")
