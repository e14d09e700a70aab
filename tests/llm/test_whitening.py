"""Whitening against numpy on the whole table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import registry, whitening

DATA = "/root/testdata/sf0.001"


def plain(vectors):
    """Whole entries of each row, distinct ones, their sums, the variances and the components."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    away = fit - s / n
    e, v = np.linalg.eigh(away.T @ away / n)
    return x, n, s, e[::-1], v[:, ::-1]


def same_up_to_sign(got, want):
    sign = np.sign((got * want).sum(axis=0))
    return np.allclose(got * sign, want, atol=1e-7)


@pytest.mark.parametrize("rows, columns, blocks", [(1024, 1024, 64), (7, 5, 2)])
def test_registered_query(spark, tmp_path, monkeypatch, rows, columns, blocks):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", rows)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", columns)
    monkeypatch.setattr(whitening, "SPLIT_BLOCKS", blocks)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 120").select("vec_id", F.slice("embedding", 1, 12).alias("embedding"))
    v = [float(c) for c in df.first().embedding]
    odd = [(900, None), (901, [None, *v[1:]]), (902, [float("nan"), *v[1:]]), (903, [float("inf"), *v[1:]]), (904, [*v[1:], -float("inf")]), (None, v), (905, [c + 1e-6 for c in v])]
    more = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    df.unionAll(more).unionAll(df.where("vec_id < 5")).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect() if r.vec_id is None or r.vec_id < 900 or r.vec_id == 905]
    x, n, s, e, vectors = plain([v for _, v in good])
    got = registry.op12_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and n < len(good)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    total = e.sum()
    place = {i: k for k, (i, _) in enumerate(good)}
    ids = sorted(place, key=repr)
    whitened = np.array([[by[i][c][0].whitened for c in (1, 2, 3, 4)] for i in ids])
    at = [place[i] for i in ids]
    assert same_up_to_sign(whitened, (x[at] - s / n) @ vectors[:, :4] / np.sqrt(e[:4]))
    for i in ids:
        for c in (1, 2, 3, 4):
            for r in by[i][c]:
                assert r.deviation == int(((n * x[place[i]] - s) ** 2).sum()) and abs(r.explained - e[c - 1] / total) < 1e-9
    assert {r.identity_error for r in got}.pop() < 1e-9
    assert sum(len(by[i][1]) for i in by) == len(good)


def test_ragged_large_and_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, whole string")
    rows = [(i, [float(i % 3), float(i * i % 7), 1.0][: 2 + i % 2], "x", "x") for i in range(20)]
    got = whitening.whiten(frame([*rows, (20, [], "x", "x")])).collect()
    assert len(got) == 21 and {len(r.whole) for r in got} == {3} and {len(r.whitened) for r in got} == {3}
    x, n, s, e, vectors = plain([*(v + [0.0] * (3 - len(v)) for _, v, _, _ in rows), [0.0] * 3])
    order = sorted(got, key=lambda r: r.vec_id)
    assert same_up_to_sign(np.array([r.whitened for r in order]), (x - s / n) @ vectors / np.sqrt(e))
    # A constant entry has no variance and gives no component; a single vector gives no row; a sum may be beyond a long.
    flat = whitening.whiten(frame([(i, [float(i), 4.0], "x", "x") for i in range(5)])).collect()
    assert len(flat) == 5 and {len(r.whitened) for r in flat} == {1}
    assert whitening.whiten(frame([(1, [1.0, 2.0], "x", "x")] * 3)).count() == 0
    huge = whitening.whiten(frame([(i, [float(i), 1e15 * i], "x", "x") for i in range(9)])).collect()
    assert len(huge) == 9 and {r.deviation for r in huge} == {None, 0} and all(np.isfinite(r.whitened).all() for r in huge)
    assert whitening.whiten(frame([(1, None, "x", "x"), (2, [], "x", "x")])).count() == 0


def test_a_hot_vector_is_one_row_of_the_fit(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") / 100, F.sin("id"))).alias("embedding"))
    got = whitening.whiten(df.repartition(5)).collect()
    x, n, s, e, vectors = plain([r.embedding for r in df.collect()])
    assert len(got) == 3000 and {r.n for r in got} == {n} and n <= 2001
    order = sorted(got, key=lambda r: r.vec_id)
    assert same_up_to_sign(np.array([r.whitened for r in order]), (x - s / n) @ vectors / np.sqrt(e))
