"""Hand-written log records: the cases that rendered exports don't have."""

from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.functions import record as R
from weftwork.operators import parsing as P
from weftwork.plans import tables
from weftwork.sources.git_log import read_log, write_tables

RS, FS = "\x1e", "\x1f"


def rec(sha="a1", parents="", name="A", mail="a@x", at="2024-03-01T10:00:00+05:30", ct="2024-03-01T04:30:00Z", msg="s\n", tail="\n"):
    return FS.join([sha, parents, name, mail, at, ct, msg, tail])


LOG = [
    rec("root", msg="first\n", tail="\n\n1\t2\tf\n"),
    rec("merge", "root side", msg="merge\n"),
    rec("body", "root", msg="subject\n\nline one\nline two\n\nFixes: 1\nFixes: 2\nCo-By: x,\n y\n"),
    rec("name", name='Doe, "J" é'),
    rec("bin", tail="\n\n-\t-\timg.png\n3\t0\tb.txt\n"),
    rec("ren", tail='\n\n0\t0\tf1 => "d \\303\\251.txt"\n1\t1\ta/{b => c}/d\n2\t2\ta/{ => x}/d\n4\t4\t"q\\t\\"\\\\"\n'),
    rec("empty"),
    rec("empty"),
    "cut" + FS + "x",
    rec("sep", msg="a" + FS + "b"),
    rec("time", at="junk"),
    rec(""),
]


def export(spark, tmp_path, records=LOG, leading=True):
    (tmp_path / "log" / "r1").mkdir(parents=True, exist_ok=True)
    (tmp_path / "log" / "r1" / "export.txt").write_text((RS if leading else "") + RS.join(records))
    return read_log(spark, str(tmp_path / "log"))


def test_records_and_bad_records(spark, tmp_path):
    good, bad = tables.records(export(spark, tmp_path))
    assert sorted(r.sha for r in good.collect()) == ["bin", "body", "empty", "merge", "name", "ren", "root"]
    assert sorted(r.reason for r in bad.collect()) == ["parts", "parts", "sha", "time"]
    assert {r.repo for r in good.collect()} == {"r1"}


def test_commits(spark, tmp_path):
    rows = {r.sha: r for r in tables.commits(tables.records(export(spark, tmp_path))[0]).collect()}
    assert rows["root"].parents == [] and rows["merge"].parents == ["root", "side"]
    assert rows["root"].author_offset == "+05:30"
    assert rows["root"].authored_at == rows["root"].committed_at
    assert rows["body"].subject == "subject" and rows["body"].body == "line one\nline two"
    assert [(t.key, t.value) for t in rows["body"].trailers] == [("Fixes", "1"), ("Fixes", "2"), ("Co-By", "x, y")]
    assert rows["root"].trailers == [] and rows["root"].body == ""
    assert rows["name"].author_name == 'Doe, "J" é'


def test_file_changes(spark, tmp_path):
    rows = tables.file_changes(tables.records(export(spark, tmp_path))[0]).collect()
    got = {(r.sha, r.pos): (r.path, r.old_path, r.added, r.deleted, r.is_binary) for r in rows}
    assert got == {
        ("root", 0): ("f", None, 1, 2, False),
        ("bin", 0): ("img.png", None, None, None, True),
        ("bin", 1): ("b.txt", None, 3, 0, False),
        ("ren", 0): ("d é.txt", "f1", 0, 0, False),
        ("ren", 1): ("a/c/d", "a/b/d", 1, 1, False),
        ("ren", 2): ("a/x/d", "a/d", 2, 2, False),
        ("ren", 3): ('q\t"\\', None, 4, 4, False),
    }


def test_edges_join_parents(spark, tmp_path):
    good = P.parse_parents(tables.records(export(spark, tmp_path))[0])
    rows = {(r.child, r.parent): r.parent_author_name for r in P.join_parents(P.parent_edges(good), good, "author_name").collect()}
    assert rows == {("merge", "root"): "A", ("merge", "side"): None, ("body", "root"): "A"}


def test_order_of_records_and_second_dedupe_change_nothing(spark, tmp_path):
    one = tables.commits(tables.records(export(spark, tmp_path / "a"))[0])
    two = tables.commits(tables.records(export(spark, tmp_path / "b", LOG[::-1], leading=False))[0])
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert P.dedupe(one).count() == one.count()


def test_written_tables_come_back(spark, tmp_path):
    good = tables.records(export(spark, tmp_path))[0]
    write_tables(tables.commits(good), tables.file_changes(good), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/commits")).where("month = '2024-03'").count() == 7
    assert spark.read.parquet(str(tmp_path / "out/file_changes")).count() == 7


def test_empty_export(spark, tmp_path):
    good, bad = tables.records(export(spark, tmp_path, []))
    assert tables.commits(good).count() == tables.file_changes(good).count() == bad.count() == 0


def test_nulls_pass(spark):
    df = spark.createDataFrame([(None,)], "x string")
    from pyspark.sql import functions as F

    x = F.col("x")
    row = df.select(R.instant(x).alias("a"), R.offset(x).alias("b"), R.parents(x).alias("c"), R.subject(x).alias("d"), R.trailers(x).alias("e"), R.paths(x).alias("f")).first()
    assert row.a is None and row.b is None and row.c is None and row.d is None and row.e == [] and row.f.path is None


def quoted(path: str) -> str:
    special = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r", 34: '"', 92: "\\"}
    return '"' + "".join("\\" + special[b] if b in special else chr(b) if 32 <= b < 127 else f"\\{b:03o}" for b in path.encode()) + '"'


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), min_size=1, max_size=20), min_size=1, max_size=30))
def test_unquote_inverts_quoting(spark, names):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n, quoted(n)) for n in names], "n string, q string")
    assert df.where(~R.unquote(F.col("q")).eqNullSafe(F.col("n"))).count() == 0


def test_folder_names_are_decoded(spark, tmp_path):
    for name in ("my repo%", "a+b", "ü", "repo=x%2520y"):
        (tmp_path / "log" / name).mkdir(parents=True)
        (tmp_path / "log" / name / "e.txt").write_text(rec(name))
    got = {r.sha: r.repo for r in tables.records(read_log(spark, str(tmp_path / "log")))[0].collect()}
    # The writer of `repo=` folders escapes values, here x%20y.
    assert got == {"my repo%": "my repo%", "a+b": "a+b", "ü": "ü", "repo=x%2520y": "x%20y"}


def test_bad_records_are_written(spark, tmp_path):
    good, bad = tables.records(export(spark, tmp_path))
    write_tables(tables.commits(good), tables.file_changes(P.parse_times(good), "committed_at"), str(tmp_path / "out"), bad)
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "out/bad_records")).collect()) == ["parts", "parts", "sha", "time"]
    assert spark.read.parquet(str(tmp_path / "out/file_changes")).columns == ["repo", "sha", "pos", "path", "old_path", "added", "deleted", "is_binary", "month"]


def test_malformed_lines_are_set_aside_and_others_stay(spark, tmp_path):
    tail = "\n\n1\t2\tf\ngarbage\n12\tx\n-\t3\tp\n99999999999999999999\t1\tq\n3\t-\tr\n+1\t1\ts\n 1\t1\tt\n1\t1\t\n1\t1\n\t\tu\n-\t-\timg\n7\t8\ta\tb\n"
    good = tables.records(export(spark, tmp_path, [rec("a", tail=tail), rec("b", tail="\n\nnothing good\n"), rec("c")]))[0]
    changes = [(r.sha, r.pos, r.path, r.added, r.is_binary) for r in tables.file_changes(good).collect()]
    assert sorted(changes, key=repr) == [("a", 0, "f", 1, False), ("a", 11, "img", None, True), ("a", 12, "a\tb", 7, False)]
    bad = {(r.sha, r.pos): r.raw for r in tables.bad_lines(good).collect()}
    assert bad == {("a", k + 1): x for k, x in enumerate(["garbage", "12\tx", "-\t3\tp", "99999999999999999999\t1\tq", "3\t-\tr", "+1\t1\ts", " 1\t1\tt", "1\t1\t", "1\t1", "\t\tu"])} | {("b", 0): "nothing good"}
    assert {r.reason for r in tables.bad_lines(good).collect()} == {"numstat"}
    write_tables(tables.commits(good), tables.file_changes(good), str(tmp_path / "out"), bad_lines=tables.bad_lines(good))
    assert spark.read.parquet(str(tmp_path / "out/bad_lines")).count() == 11


UNLIKE = [rec("a"), rec("a", tail="\n1\t1\tf\n"), rec("a", tail="\n1\t1\tg\n"), rec("a", msg="other\n", tail="\n1\t1\tf\n"), rec("a", tail="\n1\t1\tf\n"), rec("a", name="Z", tail=""), rec("b"), rec("b"), rec("c", tail="")]


def test_which_of_unlike_copies_stays_is_no_chance(spark, tmp_path):
    log = export(spark, tmp_path, UNLIKE)
    for parts in (1, 3, 7):
        good, _ = P.split_bad(P.parse_header(log.repartition(parts, "raw").orderBy("raw", ascending=parts == 3)))
        kept = {r.sha: (r.message, r.tail) for r in P.dedupe(good).collect()}
        # Three tails are equally long; the greatest record of these stays.
        assert kept == {"a": ("s\n", "\n1\t1\tg\n"), "b": ("s\n", "\n"), "c": ("s\n", "")}
    found = {r.raw: (r.sha, r.copies, r.kept) for r in P.conflicts(good).collect()}
    assert found == {x: ("a", UNLIKE.count(x), x == UNLIKE[2]) for x in UNLIKE[:6]}
    assert P.dedupe(good.select("repo", "sha")).count() == 3 and P.conflicts(good.where("sha <> 'a'")).count() == 0


def test_times_without_a_zone_are_bad_in_any_session(spark, tmp_path):
    good, bad = tables.records(export(spark, tmp_path, [rec("a", at="2024-03-01T10:00:00"), rec("b", ct="2024-03-01 10:00:00"), rec("c")]))
    assert [r.sha for r in good.collect()] == ["c"] and [r.reason for r in bad.collect()] == ["time", "time"]


def test_repositories_of_one_name_are_told_apart_by_more_levels(spark, tmp_path):
    for name in ("a/tool", "b/tool"):
        (tmp_path / "log" / name).mkdir(parents=True)
        (tmp_path / "log" / name / "e.txt").write_text(rec("x"))
    assert sorted(r.repo for r in read_log(spark, str(tmp_path / "log"), levels=2).collect()) == ["a/tool", "b/tool"]
    assert [r.repo for r in tables.records(read_log(spark, str(tmp_path / "log")))[0].collect()] == ["tool"]
