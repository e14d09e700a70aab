"""Files changed together against a count of all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest

from weftwork.operators import cochange


def brute(rows, support):
    """Counts of all pairs of paths with that support."""
    commits = {}
    for repo, sha, path in set(rows):
        if path is not None:
            commits.setdefault((repo, sha), set()).add(path)
    count = Counter((repo, a, b) for (repo, _), paths in commits.items() for a, b in combinations(sorted(paths), 2))
    return {k: n for k, n in count.items() if n >= support}


def expanded(spark, rows, support):
    """All pairs, from those of classes and their members."""
    pairs, members = cochange.changed_together(spark.createDataFrame(rows, "repo string, sha string, path string").repartition(3), support)
    of = {}
    for r in members.collect():
        of.setdefault((r.repo, r.of), []).append((r.path, r.commits))
    out = {}
    for (repo, _), paths in of.items():
        out |= {(repo, *sorted((a, b))): n for (a, n), (b, _) in combinations(paths, 2)}
    for r in pairs.collect():
        assert r.path_a < r.path_b
        out |= {(r.repo, *sorted((a, b))): r.commits for a, _ in of[r.repo, r.path_a] for b, _ in of[r.repo, r.path_b]}
    return out


@pytest.mark.parametrize("support, block", [(1, 1024), (2, 3), (3, 2), (5, 1024)])
def test_counts_of_all_pairs(spark, monkeypatch, support, block):
    monkeypatch.setattr(cochange, "BLOCK_FILES", block)
    rng = random.Random(support)
    rows = []
    for i in range(60):
        repo, size = rng.choice("rs"), rng.choice([1, 2, 3, 5, 12])
        rows += [(repo, f"{i}", f"f{rng.randrange(25)}") for _ in range(size)]
        if i % 20 == 0:
            rows += [(r, f"{r}big{i}", f"f{k}") for r in "rs" for k in range(25)] + [("r", f"{i}", p) for p in ("twin1", "twin2", "twin3")]
    rows += rows[:30] + [("r", "0", None)]
    want = brute(rows, support)
    assert expanded(spark, rows, support) == want and want


def test_large_commits_are_not_paired(spark, monkeypatch):
    """Two commits of all files, and one more for each file alone: nothing shares three, so hardly a pair is looked at."""
    looked = []
    real = cochange._candidates
    monkeypatch.setattr(cochange, "_candidates", lambda *a: (lambda c: looked.append(c.count()) or c)(real(*a)))
    files = [f"f{k}" for k in range(3000)]
    rows = [("r", sha, f) for sha in ("all1", "all2") for f in files] + [("r", f"own{f}", f) for f in files] + [("r", f"pair{k}", files[k % 6]) for k in range(18)]
    got = expanded(spark, rows, 3)
    assert got == {} and looked == [0]
    # A class takes the place of files that only ever changed together.
    pairs, members = cochange.changed_together(spark.createDataFrame([r for r in rows if r[1] in ("all1", "all2")], "repo string, sha string, path string"), 2)
    assert pairs.count() == 0 and members.select("of").distinct().count() == 1 and members.count() == 3000


def test_a_large_commit_is_dealt_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cochange, "BLOCK_FILES", 16)
    files = [f"f{k:03}" for k in range(150)]
    rows = [("r", "all", f) for f in files] + [("r", f"c{k}", files[k]) for k in range(150)] + [("r", "two", files[3]), ("r", "two", files[140])]
    assert expanded(spark, rows, 1) == brute(rows, 1)


def test_no_changes(spark):
    assert expanded(spark, [("r", "1", "a"), ("r", "1", "b")], 2) == {}
    pairs, members = cochange.changed_together(spark.createDataFrame([], "repo string, sha string, path string"))
    assert pairs.count() == members.count() == 0
