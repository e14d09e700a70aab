"""Depth of ancestry against a plain search, on chains, merges and malformed graphs."""

import random

import pytest

from weftwork.operators.ancestry import ancestry_depth


def brute(nodes, edges):
    """Depths by settling commits whose exported parents are settled, until nothing changes."""
    parents = {n: {p for r, c, p in edges if (r, c) == n and (r, p) in nodes and p != c} for n in nodes}
    depth = {}
    while True:
        new = {(r, s): 1 + max((depth[r, p] for p in ps), default=-1) for (r, s), ps in parents.items() if (r, s) not in depth and all((r, p) in depth for p in ps)}
        if not new:
            return {n: depth.get(n) for n in nodes}
        depth |= new


def check(spark, nodes, edges):
    e = spark.createDataFrame(edges, "repo string, child string, parent string").repartition(3)
    c = spark.createDataFrame([(*n, "x") for n in nodes], "repo string, sha string, depth string").repartition(2)
    got = ancestry_depth(e, c).collect()
    assert len(got) == len(set(nodes))
    assert {(r.repo, r.sha): r.depth for r in got} == brute(set(nodes), edges)


@pytest.mark.parametrize("seed", range(2))
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    nodes, edges = [], []
    for r in ("a", "b"):
        for i in range(50):
            nodes.append((r, f"{i}"))
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3]) if i else 0):
                # Near parents make long ways, and merges of merges.
                edges.append((r, f"{i}", f"{max(0, i - rng.choice([1, 2, 5, 9, 30]))}"))
    # Repeated rows, parents that weren't exported, an edge to itself, and ids that both repositories have.
    check(spark, nodes + nodes[:9], edges + edges[:20] + [("a", "3", "gone"), ("a", "7", "7"), ("c", "1", "2"), ("a", "gone", "1")])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from weftwork import session

    written = []
    write = session.Steps.write
    monkeypatch.setattr(session.Steps, "write", lambda self, df: written.append(1) or write(self, df))
    n = 600
    check(spark, [("a", f"{i}") for i in range(n)], [("a", f"{i + 1}", f"{i}") for i in range(n - 1)])
    assert len(written) < 20


def test_rows_grow_with_edges_not_ways(spark):
    # A ladder of diamonds has two to the number of diamonds ways through it.
    nodes, edges = [("a", "m0")], []
    for k in range(8):
        nodes += [("a", f"l{k}"), ("a", f"r{k}"), ("a", f"m{k + 1}")]
        edges += [("a", f"l{k}", f"m{k}"), ("a", f"r{k}", f"m{k}"), ("a", f"m{k + 1}", f"l{k}"), ("a", f"m{k + 1}", f"r{k}")]
    check(spark, nodes, edges)


def test_circles_and_what_follows_them_have_no_depth(spark):
    edges = [("a", "1", "2"), ("a", "2", "3"), ("a", "3", "1"), ("a", "4", "1"), ("a", "5", "4"), ("a", "5", "0"), ("a", "6", "0"), ("a", "7", "6"), ("a", "7", "5"), ("a", "8", "9"), ("a", "8", "0"), ("a", "9", "8"), ("a", "9", "0")]
    check(spark, [("a", f"{i}") for i in range(10)], edges)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "repo string, child string, parent string")
    assert ancestry_depth(none, spark.createDataFrame([], "repo string, sha string")).count() == 0
    check(spark, [("a", "1"), ("b", "1")], [("a", "2", "1")])
