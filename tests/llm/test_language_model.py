"""Which documents the language model learns from, and how they are dealt out."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftwork.llm import lm
from weftwork.llm.common import crc_of_id


def test_all_training_documents_are_learned_from_in_spread_replicas(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    most = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(lm, "REPLICA_TOKENS", 200)
    monkeypatch.setattr(lm, "SUMMED", 4)
    train = lm.Network.train

    def counted(self, docs, streams):
        n = train(self, docs, streams)
        seen.add(n)
        most.add(n * n)
        return n

    sent = lm.Shared

    class Counting(sent):
        @property
        def value(self):
            out = sent.value.fget(self)
            if isinstance(out, lm.Network):
                out.train = counted.__get__(out)
            return out

    monkeypatch.setattr(lm, "Shared", Counting)
    df = spark.createDataFrame([(i, "one text that all share") for i in range(400)], "doc_id long, text string").repartition(3)
    got = lm.score_documents(df, F.lit(False)).collect()
    assert len(got) == 400 and seen.value == 400 * 6
    # Copies of one text in one replica would make this the square of all tokens.
    assert most.value < (400 * 6) ** 2 / 4


def test_training_takes_every_token_in_chunks(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 300)
    v = lm.Vocabulary([b"", b"a", b"b"], [1, 5, 5])
    v.finish(np.zeros(v.tails), np.zeros(v.tails))
    net, tokens = lm.Network(v), []
    windows = net._windows
    net._windows = lambda x, y, *rest: (tokens.extend(y.tolist()), windows(x, y, *rest))[1]
    docs = [np.array([1, 2] * k + [0]) for k in (1, 200, 3, 77, 40, 5)]
    assert net.train(iter(docs), 64) == len(tokens) and tokens == np.concatenate(docs).tolist()


def test_shipped_settings_and_tables_without_training_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = docs.withColumns({c: F.lit("x") for c in ("id", "key", "units", "score", "rare", "base", "held_out")})
    got = lm.score_documents(wide, crc_of_id("doc_id") % 7 == 2).collect()
    assert len(got) == docs.count() and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    none = lm.score_documents(docs.limit(5), F.lit(True)).collect()
    assert len(none) == 5 and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in none)
    assert lm.score_documents(docs.limit(0), F.lit(False)).count() == 0


def test_a_document_scored_in_parts_is_scored_alike(monkeypatch):
    v = lm.Vocabulary([b"", *(f"w{i}".encode() for i in range(50))], [9] * 51)
    v.finish(np.zeros(v.tails), np.zeros(v.tails))
    net, rng = lm.Network(v), np.random.default_rng(1)
    docs = [rng.integers(0, 51, n) for n in (1, 40, 17, 300, 16, 2)]
    whole = net.score(docs)
    monkeypatch.setattr(lm, "SCORE_ROWS", 20)
    assert np.allclose(net.score(docs), whole, atol=1e-3)


def base_of(rows, tokens):
    """What the contract fixes, by a plain count over all rows."""
    c = Counter(w for _, t in rows for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows}


def test_the_end_token_counts_where_every_word_is_as_rare(spark):
    """At shipped settings, with more words of one count than the table of frequent ones holds."""
    tokens = lambda t: [*t.encode().split(), b""]
    for rows in ([(1, " ".join(f"w{i}" for i in range(lm.TABLE + 1)))], [(k, " ".join(f"w{i} w{i}" for i in range(lm.TABLE + 1)) if k < 2 else "w1 x") for k in range(3)]):
        got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
        assert {r.id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got} == base_of(rows, tokens)
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_the_end_token_is_in_the_vocabulary_once(spark, monkeypatch):
    for size, want in ((2, [b"", b"a", b"b"]), (3, [b"", b"a", b"b"]), (9, [b"", b"a", b"b", b"c", b"d"])):
        monkeypatch.setattr(lm, "TABLE", size)
        counts = spark.createDataFrame([(w, c) for w, c in ((b"a", 90), (b"b", 80), (b"c", 5), (b"", 4), (b"d", 3))], "word binary, c long")
        v = lm.Vocabulary(*lm.most_frequent(counts))
        assert v.words[: len(want)] == want and v.count[0] == 4 and v.words.count(b"") == 1
    monkeypatch.setattr(lm, "TABLE", 2)
    flat = spark.createDataFrame([(w, 7) for w in (b"e", b"c", b"d", b"a", b"b")], "word binary, c long")
    assert lm.most_frequent(flat) == ([b"a", b"b"], [7, 7])


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    once = {r.id: r.score for r in lm.score_documents(docs, crc_of_id("doc_id") % 7 == 2).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = {r.id: r.score for r in lm.score_documents(docs, crc_of_id("doc_id") % 7 == 2).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert once == again


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 10)
    texts = ["a" * 4, "b" * 6, None, "c" * 25, "", "d", "e" * 9, None, "f" * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = [s.column(0).to_pylist() for s in lm.text_slices(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]))]
    assert sum(got, []) == texts + texts[3:5] and all(len(s) == 1 or sum(len(t or "") for t in s) <= 10 for s in got)
    assert got[0] == ["a" * 4, "b" * 6, None]
