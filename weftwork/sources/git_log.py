"""Log exports as text: a directory for each repository, records ending or starting with \\x1e."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions.record import RECORD, repo_of
from weftwork.session import free_shuffles


def read_log(spark: SparkSession, path: str, levels: int = 1) -> DataFrame:
    """(repo, raw): one row for each record; blank ones are dropped. Uncompressed files are read in splits.

    The last `levels` folders of a file are the name of its repository, so a/tool and b/tool are told apart by two.
    """
    raw = spark.read.option("lineSep", RECORD).option("recursiveFileLookup", "true").text(path)
    return raw.select(repo_of(F.col("_metadata.file_path"), levels).alias("repo"), F.col("value").alias("raw")).where(F.col("raw").rlike(r"\S"))


def write_tables(commits: DataFrame, file_changes: DataFrame, path: str, bad_records: DataFrame | None = None, bad_lines: DataFrame | None = None) -> None:
    """Parquet by month of the commit. A month is rebalanced into files of the advised size, however large it is.

    File changes that carry committed_at need no join for their month; others are joined to their commits. Bad records
    and bad lines of file changes make a table each. The tables are written anew; streaming.log_stream appends to them.
    """
    month = F.date_format(F.date_trunc("month", "committed_at"), "yyyy-MM")
    commits = commits.withColumn("month", month)
    if "committed_at" in file_changes.columns:
        changes = file_changes.withColumn("month", month).drop("committed_at")
    else:
        changes = file_changes.join(commits.select("repo", "sha", "month"), ["repo", "sha"])
    commits.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/commits")
    # Each table deduplicates the records for itself; the shuffles of one go before the next is made.
    free_shuffles(commits.sparkSession)
    changes.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/file_changes")
    free_shuffles(commits.sparkSession)
    for name, bad in (("bad_records", bad_records), ("bad_lines", bad_lines)):
        if bad is not None:
            bad.write.mode("overwrite").parquet(f"{path}/{name}")
