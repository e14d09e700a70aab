"""Streams of log files, file by file."""

import os

import pytest
from test_parsing import RS, export, rec

from weftwork.sources.git_log import read_log
from weftwork.streaming import log_stream as S


def test_stream_keeps_old_commits_and_bad_records(spark, tmp_path):
    (tmp_path / "log" / "r1").mkdir(parents=True)
    old = "2005-01-01T00:00:00Z"
    for k, records in enumerate(([rec("a"), rec("b")], [rec("old", at=old, ct=old), rec("a"), "junk"], [rec("c")])):
        (tmp_path / "log" / "r1" / f"{k}.txt").write_text(RS.join(records))
        S.write_available(S.stream_records(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "at"))
        S.write_available(S.stream_bad_records(spark, str(tmp_path / "log")), str(tmp_path / "bad"), str(tmp_path / "bad_at"))
    assert sorted(r.sha for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "old"]
    assert [(r.repo, r.raw, r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("r1", "junk", "parts")]


def test_stream_drops_a_commit_that_comes_again(spark, tmp_path):
    export(spark, tmp_path)
    for _ in range(2):
        S.write_available(S.stream_records(spark, str(tmp_path / "log")).select("repo", "sha"), str(tmp_path / "out"), str(tmp_path / "at"))
        (tmp_path / "log" / "r1" / "later.txt").write_text(RS + rec("new") + RS + rec("root"))
    assert sorted(r.sha for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(["bin", "body", "empty", "merge", "name", "ren", "root", "new"])


def arrive(tmp_path, name, *records):
    (tmp_path / "log" / "r1").mkdir(parents=True, exist_ok=True)
    (tmp_path / "log" / "r1" / f"{name}.txt").write_text(RS.join(records))


def rows(spark, path):
    return sorted((r.sha, r.month, r.batch) for r in spark.read.schema("sha string, month string, batch string").parquet(path).collect())


A, B, OLD = (rec(k, at=t, ct=t, tail=f"\n1\t1\t{k}\nbad {k}\n") for k, t in (("a", "2024-03-01T10:00:00Z"), ("b", "2024-04-01T10:00:00Z"), ("old", "2005-01-01T00:00:00Z")))


def test_copies_of_any_age_are_appended_once(spark, tmp_path):
    """The stream forgets, the tables don't: a file that comes again, at once or in a stream of its own later, adds nothing."""
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    arrive(tmp_path, 1, A, B, A, "junk")
    S.append_available(spark, str(tmp_path / "log"), out, at)
    arrive(tmp_path, 2, A, OLD)
    S.append_available(spark, str(tmp_path / "log"), out, at)
    want = [("a", "2024-03", "log-000000000"), ("b", "2024-04", "log-000000000"), ("old", "2005-01", "log-000000001")]
    assert rows(spark, f"{out}/commits") == rows(spark, f"{out}/file_changes") == want
    # Nothing that only a checkpoint remembers: a new one reads all files once more.
    S.append_available(spark, str(tmp_path / "log"), out, str(tmp_path / "new"), "again", files=1)
    assert rows(spark, f"{out}/commits") == rows(spark, f"{out}/file_changes") == want
    assert sorted((r.sha, r.raw) for r in spark.read.parquet(f"{out}/bad_lines").collect()) == [("a", "bad a"), ("b", "bad b"), ("old", "bad old")]
    assert [r.raw for r in spark.read.parquet(f"{out}/bad_records").where("batch like 'log%'").collect()] == ["junk"]


@pytest.mark.parametrize("fails_at", ["file_changes", "commits", None])
def test_a_batch_that_comes_again_gives_the_same_rows(spark, tmp_path, monkeypatch, fails_at):
    out = str(tmp_path / "out")
    arrive(tmp_path, 1, A)
    S.append_batch(read_log(spark, str(tmp_path / "log")), 0, out, "log")
    arrive(tmp_path, 2, B, OLD, A)
    second = read_log(spark, str(tmp_path / "log"))
    if fails_at:
        real = getattr(S.tables, fails_at)

        def broken(*args):
            raise RuntimeError("lost")

        monkeypatch.setattr(S.tables, fails_at, broken)
        with pytest.raises(RuntimeError):
            S.append_batch(second, 1, out, "log")
        monkeypatch.setattr(S.tables, fails_at, real)
    for _ in range(2):
        S.append_batch(second, 1, out, "log")
        want = [("a", "2024-03", "log-000000000"), ("b", "2024-04", "log-000000001"), ("old", "2005-01", "log-000000001")]
        assert rows(spark, f"{out}/commits") == rows(spark, f"{out}/file_changes") == want
    S.append_batch(second.limit(0), 2, out, "log")
    assert rows(spark, f"{out}/commits") == want


def test_parents_that_arrive_later_or_never(spark, tmp_path):
    day = 86_400

    def step(name, at, *records):
        arrive(tmp_path, name, *records)
        os.utime(tmp_path / "log" / "r1" / f"{name}.txt", (at, at))
        S.write_available(S.stream_parents(spark, str(tmp_path / "log"), "author_name", wait="4 days", by_file=True), str(tmp_path / "out"), str(tmp_path / "at"))
        return sorted((r.child, r.parent, r.ordinal, r.parent_author_name) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    joined = [("child", "late", 0, "L"), ("merge", "late", 1, "L")]
    assert step(1, 100 * day, rec("child", "late"), rec("merge", "never late")) == []
    # The parent comes a batch later, twice.
    assert step(2, 103 * day, rec("late", name="L"), rec("late", name="L")) == joined
    # An arrival well after the time to wait shows that the other parent did not come; then it is too late.
    done = [*joined, ("merge", "never", 0, None)]
    assert step(3, 120 * day, rec("other")) == done
    assert step(4, 121 * day, rec("never"), rec("another")) == done


def test_sessions_wait_for_late_commits(spark, tmp_path):
    def step(name, *commits):
        arrive(tmp_path, name, *(rec(k, mail=m, ct=f"2024-03-{t}:00Z") for k, m, t in commits))
        S.write_available(S.stream_sessions(spark, str(tmp_path / "log"), "2 hours", "1 day"), str(tmp_path / "out"), str(tmp_path / "at"))
        return sorted((r.author_email, f"{r.started_at:%d %H:%M}", f"{r.ended_at:%d %H:%M}", r.commits) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert step(1, ("a", "x", "01T10:00"), ("b", "x", "01T11:00"), ("c", "y", "01T11:30"), ("a", "x", "01T10:00")) == []
    # Late, and between two stretches that it joins to one; copies count once.
    assert step(2, ("d", "x", "01T14:00"), ("e", "x", "01T12:30"), ("b", "x", "01T11:00")) == []
    done = [("x", "01 10:00", "01 14:00", 4), ("y", "01 11:30", "01 11:30", 1)]
    assert step(3, ("f", "y", "05T00:00")) == done
    # Too late, so dropped; the open session comes through at last.
    assert step(4, ("g", "x", "01T15:00"), ("h", "z", "09T00:00")) == [*done, ("y", "05 00:00", "05 00:00", 1)]
