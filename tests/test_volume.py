"""What jobs read, write and shuffle: in proportion to what is new, each text once."""

import glob
import random
import re
from datetime import datetime

import pytest
from test_cochange import brute, expanded
from test_parsing import rec
from test_streams import A, B, arrive, rows

from weftwork.operators import cochange
from weftwork.operators import parsing as P
from weftwork.operators.timeline import asof_join, file_identities
from weftwork.plans import standin
from weftwork.session import shared_dir
from weftwork.sources.git_log import read_log
from weftwork.streaming import log_stream as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_record_is_split_once(spark, tmp_path):
    arrive(tmp_path, 1, A, B)
    good, _ = P.split_bad(P.parse_header(read_log(spark, str(tmp_path / "log"))))
    assert len(re.findall(r"\bsplit\(", plan(P.parse_times(good)))) == 1


def test_files_of_the_export_follow_its_text(spark):
    path = standin.write_log(spark, "/root/testdata/sf0.001").removeprefix("file://")
    files = {r.f for r in spark.read.text(path).selectExpr("_metadata.file_path as f").collect()}
    assert len(files) <= standin.REPOS


def test_a_batch_without_news_writes_no_tables(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    arrive(tmp_path, 1, A, B, rec("c"))
    log = read_log(spark, str(tmp_path / "log"))
    S.append_batch(log, 0, out, "log")
    want, made = rows(spark, f"{out}/commits"), []
    real = S.tables.file_changes
    monkeypatch.setattr(S.tables, "file_changes", lambda *a: made.append(1) or real(*a))
    S.append_batch(log, 0, out, "again")
    assert rows(spark, f"{out}/commits") == want and len(want) == 3 and not made


@pytest.mark.parametrize("small", [0, 2, 4])
def test_pairs_of_small_and_large_commits_add_up(spark, monkeypatch, small):
    monkeypatch.setattr(cochange, "SMALL_FILES", small)
    rng = random.Random(small)
    rows = [("r", f"{i}", f"f{rng.randrange(12)}") for i in range(40) for _ in range(rng.choice([1, 2, 3, 6]))]
    want = brute(rows, 2)
    assert expanded(spark, rows, 2) == want and want


def stored(spark, name):
    root = shared_dir(spark).removeprefix("file://")
    return {p for p in glob.glob(f"{root}/{name}-*/*")}


def test_tables_that_nothing_reads_are_deleted(spark):
    rows = [("r", f"{i}", 0, f"n{i + 1}", f"n{i}" if i % 2 else None, datetime(2024, 1, 1 + i)) for i in range(8)]
    changes = spark.createDataFrame(rows, "repo string, sha string, pos int, path string, old_path string, committed_at timestamp")
    had = stored(spark, "together")
    pairs, members = cochange.changed_together(changes, 1)
    assert len(stored(spark, "together") - had) == 3 and members.count() == 8 and pairs.count() == 0
    had = stored(spark, "files")
    assert file_identities(changes).count() == 8 and len(stored(spark, "files") - had) == 2
    # Classes alone pair nothing and need one table.
    had = stored(spark, "classes")
    assert cochange.path_classes(changes, 1).count() == 8 and len(stored(spark, "classes") - had) == 1


def test_an_asof_join_holds_each_value_once(spark):
    right = spark.createDataFrame([("g", datetime(2024, 1, 1), "x", 1)], "g string, at timestamp, v string, n int")
    had = stored(spark, "asof")
    asof_join(right.select("g", "at"), right, ["g"], "at", ["v", "n"], ["n"])
    dealt = next(p for p in sorted(stored(spark, "asof") - had) if p.endswith("/1"))
    assert spark.read.parquet(dealt).columns == ["g", "_at", "_held", "_side", "_row", "_slice"]


def test_versions_of_commits_are_shuffled_once(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    arrive(tmp_path, 1, A, B, A, A.replace("2024-03", "2023-03"))
    found = P.conflicts(P.split_bad(P.parse_header(read_log(spark, str(tmp_path / "log"))))[0])
    exchanges = plan(found).count("Exchange hashpartitioning")
    got = sorted((r.sha, r.copies, r.kept) for r in found.collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("a", 1, False), ("a", 2, True)] and exchanges == 2
