"""Files that change together, counted exactly above a support without the square of a commit's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import Steps

#: Files of a commit that meet in one block.
BLOCK_FILES = 1024
#: Commits of up to so many files have all their pairs counted at once, at most 7.5 for each file.
SMALL_FILES = 16


def _each(changes: DataFrame) -> DataFrame:
    """(repo, path, c, d): each path of each commit once; 128 bits of hashes stand for the commit."""
    commit = [F.xxhash64(F.lit(i), "repo", "sha").alias(k) for i, k in ((1, "c"), (2, "d"))]
    return changes.where("path is not null").select("repo", "path", *commit).distinct()


def _classes(steps: Steps, each: DataFrame, support: int) -> DataFrame:
    """(repo, path, of, commits); what paths of equal commits share is their number and the hashes of all, in any order."""
    hashes = [F.count("*").alias("commits"), F.bit_xor("c").alias("_c"), F.bit_xor("d").alias("_d")]
    paths = steps.write(each.groupBy("repo", "path").agg(*hashes).where(F.col("commits") >= support))
    classes = paths.groupBy("repo", "commits", "_c", "_d").agg(F.min("path").alias("of"))
    return paths.join(classes, ["repo", "commits", "_c", "_d"]).select("repo", "path", "of", "commits")


def path_classes(changes: DataFrame, support: int = 2) -> DataFrame:
    """The members alone of changed_together, for which nothing is paired."""
    return _classes(Steps(changes.sparkSession, "classes"), _each(changes), support)


def _small(sized: DataFrame) -> DataFrame:
    """(a, b, n), a < b: in how many small commits two paths are."""
    lists = sized.where(F.col("size") <= SMALL_FILES).groupBy("c", "d").agg(F.array_sort(F.collect_list("p")).alias("l")).where("size(l) > 1")
    pairs = lists.select("l", F.posexplode("l").alias("i", "a")).where("i + 1 < size(l)").select("a", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def _large(big: DataFrame, support: int) -> DataFrame:
    """(a, b), a < b: pairs that may share `support` commits and none of the small ones.

    Two paths that share so many share one that isn't among the last support - 1 of both, in any order of the commits. In that of
    their size the largest commits come last and, for most paths, need not be paired at all. Whole sizes are left
    out as long as they hold no more than support - 1 of a path's commits, so counts by size tell which.
    """
    larger = F.sum("n").over(Window.partitionBy("p").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    levels = big.groupBy("p", "size").agg(F.count("*").alias("n")).withColumn("larger", larger)
    first = big.join(levels.where(F.col("larger") >= support).select("p", "size"), ["p", "size"], "left_semi")
    met = first.groupBy("c", "d").agg(F.count("*").alias("met")).where("met > 1").withColumn("blocks", F.ceil(F.col("met") / BLOCK_FILES).cast("int"))
    own = first.join(met, ["c", "d"]).select("c", "d", "p", "blocks", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int").alias("own"))
    # A block meets itself and each other block once: the lower one stands on the left.
    left = own.select("c", "d", F.col("own").alias("low"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("high"), "p")
    right = own.select("c", "d", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("low"), F.col("own").alias("high"), F.col("p").alias("q"))
    pairs = left.join(right, ["c", "d", "low", "high"]).where((F.col("p") != F.col("q")) & ((F.col("low") < F.col("high")) | (F.col("p") < F.col("q"))))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _candidates(small: DataFrame, big: DataFrame, support: int) -> DataFrame:
    """(a, b, n): pairs that may share `support` commits, with the number of the small ones."""
    none = _large(big, support).withColumn("n", F.lit(0).cast("long"))
    return small.unionByName(none).groupBy("a", "b").agg(F.sum("n").alias("n"))


def changed_together(changes: DataFrame, support: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pairs (repo, path_a, path_b, commits) and members (repo, path, of, commits) of the paths in at least `support` commits.

    Paths with just the same commits, such as those that a license header touched, are one class: members tells the class of
    each path by its first path, and pairs are of classes, path_a being before path_b, with at least `support` commits in
    common. So two paths of one class share all their commits, two of different ones what their classes share, and pairs
    that aren't there share fewer. Repeated rows count once; null paths are left out. Commits and classes are told by 128 bits.
    Numbers stand for the names of paths until pairs are found, and a table that nothing reads any more is deleted.
    """
    steps = Steps(changes.sparkSession, "together")
    each = steps.write(_each(changes))
    members = steps.write(_classes(steps, each, support))
    firsts = steps.write(members.where("path = of").select("repo", "path", F.monotonically_increasing_id().alias("p")))
    at = steps.write(each.join(firsts, ["repo", "path"]).select("p", "c", "d"))
    steps.keep(members, firsts, at)
    sized = steps.write(at.join(at.groupBy("c", "d").agg(F.count("*").alias("size")).where("size > 1"), ["c", "d"]))
    steps.keep(members, firsts, sized)
    big = sized.where(F.col("size") > SMALL_FILES)
    found = steps.write(_candidates(_small(sized), big, support) if not big.isEmpty() else _small(sized).where(F.col("n") >= support))
    if not big.isEmpty():
        # Of the large commits, those of the path that is in fewer are looked up for the other.
        in_big = steps.write(big.groupBy("p").agg(F.count("*").alias("m")))
        m = lambda k: in_big.select(F.col("p").alias(k), F.col("m").alias(f"m_{k}"))
        more = F.least(F.coalesce("m_a", F.lit(0)), F.coalesce("m_b", F.lit(0)))
        found = steps.write(found.join(m("a"), "a", "left").join(m("b"), "b", "left").withColumn("more", more).where(F.col("n") + F.col("more") >= support))
        rarer = F.col("m_a") <= F.col("m_b")
        asked = found.where("more > 0").select("a", "b", F.when(rarer, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(rarer, F.col("b")).otherwise(F.col("a")).alias("other"))
        both = asked.join(big.select("p", "c", "d"), "p").select("a", "b", "c", "d", F.col("other").alias("p")).join(big, ["c", "d", "p"], "left_semi")
        shared = both.groupBy("a", "b").agg(F.count("*").alias("in_big"))
        found = steps.write(found.join(shared, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("in_big", F.lit(0))).alias("n")).where(F.col("n") >= support))
    steps.keep(members, firsts, found)
    name = lambda k: firsts.select("repo", F.col("path").alias(f"path_{k}"), F.col("p").alias(k))
    named = found.join(name("a"), "a").join(name("b").drop("repo"), "b")
    return named.select("repo", F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"), F.col("n").alias("commits")), members
