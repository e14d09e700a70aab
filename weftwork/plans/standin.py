"""Orders and their lines rendered as a log export: commits with parents, messages and file changes.

The driver's tables hold no history, so the parsing jobs are checked on what is rendered from them: customers stand
for authors and their orders, in order of date, for a chain of commits; lines stand for changed files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.functions.record import FIELD, RECORD
from weftwork.session import free_shuffles, path_exists, shared_dir

REPOS = 8


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines share."""
    return f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"


def sha(key: Column) -> Column:
    return F.lpad(F.lower(F.hex(key)), 40, "0")


def rendered(spark: SparkSession, sf_dir: str, flawed: bool = False) -> DataFrame:
    """(repo, value): each order once, again if it is open as if from a second export, and cut short for some.

    A flawed export has malformed lines before the tails of some, and for some two unlike copies more: one that lacks its
    tail and one with a trailer added.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = F.col("l_partkey").cast("string")
    path = (
        F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("src/{a => b"), number, F.lit("}/main")))
        .when(F.col("l_partkey") % 7 == 1, F.concat(F.lit('"caf\\303\\251 \\"'), number, F.lit('\\""')))
        .when(F.col("l_partkey") % 7 == 2, F.concat(F.lit("old"), number, F.lit(' => "n\\303\\251w\\t'), number, F.lit('"')))
        .otherwise(F.concat(F.lit("part/"), number))
    )
    binary = F.col("l_returnflag") == "R"
    stat = F.concat_ws("\t", F.when(binary, "-").otherwise(F.col("l_quantity").cast("long").cast("string")), F.when(binary, "-").otherwise(F.col("l_linenumber").cast("string")), path)
    tails = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(stat)), "\n").alias("tail"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    zone = F.when(F.col("o_orderkey") % 3 == 0, "+05:30").when(F.col("o_orderkey") % 3 == 1, "-08:00").otherwise("Z")
    time = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    key = F.col("o_orderkey").cast("string")
    message = F.concat(F.lit("Order "), key, F.lit("\n\nFirst line of "), key, F.lit("\nNote: not a trailer\n\nPriority: "), F.col("o_orderpriority"), F.lit("\nStatus: "), F.col("o_orderstatus"), F.lit("\nStatus: again\n"))
    customer = F.col("o_custkey").cast("string")
    head = F.concat_ws(FIELD, sha(F.col("o_orderkey")), F.coalesce(sha(before), F.lit("")), F.concat(F.lit('C, "'), customer, F.lit('"')), F.concat(customer, F.lit("@example.com")), time, time, message)
    late = F.concat_ws(FIELD, sha(F.col("o_orderkey")), F.coalesce(sha(before), F.lit("")), F.concat(F.lit('C, "'), customer, F.lit('"')), F.concat(customer, F.lit("@example.com")), time, time, F.concat(message, F.lit("Late: note\n")))
    full = orders.select("o_orderkey", "o_orderstatus", late.alias("late"), F.concat(F.lit("repo"), (F.col("o_custkey") % REPOS).cast("string")).alias("repo"), head.alias("head")).join(tails, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    tail = F.concat(F.lit(f"{FIELD}\n\n"), F.coalesce("tail", F.lit("")), F.lit("\n"))
    more = []
    if flawed:
        okey = F.col("o_orderkey").cast("string")
        bad = F.concat(F.lit("garbage "), okey, F.lit("\n12\tx"), okey, F.lit("\n-\t3\tp"), okey, F.lit("\n99999999999999999999\t1\tq"), okey, F.lit("\n"))
        tail = F.concat(F.lit(f"{FIELD}\n\n"), F.when(F.col("o_orderkey") % 11 == 0, bad).otherwise(F.lit("")), F.coalesce("tail", F.lit("")), F.lit("\n"))
        twice = F.col("o_orderkey") % 13 == 0
        more = [F.when(twice, F.concat("head", F.lit(f"{FIELD}\n\n\n"))), F.when(twice, F.concat("late", tail))]
    whole = F.concat("head", tail)
    again = F.when(F.col("o_orderstatus") == "O", whole)
    short = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("cut"), F.lit(FIELD), F.col("o_orderkey").cast("string")))
    return full.select("repo", F.explode(F.array_compact(F.array(whole, again, short, *more))).alias("value"))


#: Exports rendered by this application, by input folder.
_WRITTEN: dict[tuple[str, str, bool], str] = {}


def write_log(spark: SparkSession, sf_dir: str, flawed: bool = False) -> str:
    """The folder of the export, which an application renders once for each input.

    A repository is rebalanced into files of the advised size, so their number follows the text and not the tasks.
    """
    key = (spark.sparkContext.applicationId, sf_dir, flawed)
    if key not in _WRITTEN or not path_exists(spark, f"{_WRITTEN[key]}/_SUCCESS"):
        path = f"{shared_folder(spark)}/export"
        rendered(spark, sf_dir, flawed).hint("rebalance", "repo").write.partitionBy("repo").option("lineSep", RECORD).text(path)
        free_shuffles(spark)
        _WRITTEN[key] = path
    return _WRITTEN[key]
