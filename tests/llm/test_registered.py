"""The registered queries without SQL against plain versions, and all of them on empty tables and clashing columns."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_pipeline import grams, leaks, top
from test_text_operators import brute_components, brute_fingerprint

from weftwork.llm import langid, registry, sentencepiece_scan

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "benchmark", "conversations", "embeddings"]


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with nulls, empty and odd texts, shared ids and repeated rows; the path and the documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(None, None, "en"), (None, "null id \n text", None), (3, "", "fr"), (7, "  two  spaces ", "de"), (7, "漢字 " * 30, None), (10_001, "12 !! 34", "en"), (10_002, None, None)]
    more = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in extra], docs.schema)
    docs.unionAll(more).unionAll(docs.where("doc_id < 8")).write.parquet(f"{path}/documents.parquet")
    for t in TABLES[1:]:
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return path, [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_op2(spark, tables):
    path, rows = tables
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t, _ in rows if crc(i) % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)
    got = registry.op2_lm_score(spark, path).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], [(i, crc(i) % 7 == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base(t)) for i, t, _ in rows])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_op5(spark, tables):
    path, rows = tables
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = registry.op5_decontamination(spark, path).collect()
    want = [(i, leaks(t or "", items)) for i, t, _ in rows]
    same([(r.doc_id, r.contaminated, r.item_ids) for r in got], [(i, bool(x), sorted(x)) for i, x in want])
    assert any(x for _, x in want) and all(r.n_matches >= len(r.item_ids) for r in got)


def test_op6(spark, tables):
    path, rows = tables
    got = registry.op6_sharding(spark, path).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows])
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    groups = Counter()
    for _, t, _ in rows:
        groups[t] += len((t or "").encode()) + 1
    assert max(sizes.values()) <= sum(sizes.values()) / 16 + max(groups.values())


def test_op7(spark, tables):
    path, rows = tables
    encoder = sentencepiece_scan.Encoder(sentencepiece_scan.Vocabulary(registry.MODEL_FILE))
    got = registry.op7_sentencepiece(spark, path).collect()
    count = lambda t: len(encoder.ids_of([" " + t])[0]) if t else 0
    same([(r.doc_id, r.n_tokens, r.round_trip) for r in got], [(i, None if t is None else count(t), True) for i, t, _ in rows])
    library = sentencepiece.SentencePieceProcessor(model_file=registry.MODEL_FILE)
    mine, theirs = sum(r.n_tokens or 0 for r in got), sum(len(library.encode(t)) for _, t, _ in rows if t)
    assert 0.9 * theirs < mine < 1.1 * theirs


def test_op8(spark, tables):
    path, rows = tables
    fps = [brute_fingerprint(t, 4) for _, t, _ in rows]
    of = brute_components([i for i, _, _ in rows], np.array(fps, np.uint64), 4)
    got = registry.op8_simhash(spark, path).collect()
    same([(r.doc_id, r.fingerprint, r.component_id) for r in got], [(i, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, of, strict=True)])


def test_op10(spark, tables):
    path, rows = tables
    by = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and crc(i) % 3 != 1:
            by.setdefault(lang, Counter()).update(grams(t))
    profiles = {k: top(c) for k, c in sorted(by.items()) if c}

    def predict(t):
        mine = top(grams(t or ""))
        if not mine:
            return "und", 0.0
        least, lang = min((sum(abs(p[g] - r) if g in p else langid.TOP for g, r in mine.items()), k) for k, p in profiles.items())
        return lang, round(1 - least / (langid.TOP * len(mine)), 9)

    got = registry.op10_language_id(spark, path).collect()
    same([(r.doc_id, r.held_out, (r.lang_pred, round(r.score, 9))) for r in got], [(i, crc(i) % 3 == 1, predict(t)) for i, t, _ in rows])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_and_clashing_columns(spark, tables, tmp_path, name):
    clash = ["id", "fp", "h", "n", "key", "row", "run", "b", "salt", "units", "rare", "score", "matches", "kept_text", "ids", "bucket", "shard", "capture_id", "message_id", "seq", "kept", "lang_pred", "held_out", "chunk", "size", "digest", "whole", "n_words", "runs", "entity", "term", "terms", "deviation", "centred"]
    for t in TABLES:
        df = spark.read.parquet(f"{tables[0]}/{t}.parquet").limit(30)
        df.limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
        df.withColumns({c: F.lit("clash") for c in clash}).write.parquet(f"{tmp_path}/wide/{t}.parquet")
    query = registry.QUERIES[name]
    assert query(spark, f"{tmp_path}/none").count() == (1 if name == "op3_chat_format" else 0)
    wide = query(spark, f"{tmp_path}/wide")
    table = "pages" if name == "op1_warc" else "documents"
    if name == "op12_whitening":
        assert wide.count() == 4 * 30
    elif name == "op3_chat_format":
        assert wide.count() == spark.read.parquet(f"{tmp_path}/wide/conversations.parquet").select("conv_id").distinct().count() + 1
    else:
        assert wide.count() == spark.read.parquet(f"{tmp_path}/wide/{table}.parquet").count()


def test_only_small_tables_are_broadcast(spark):
    from weftwork.llm.common import broadcast_if_small

    marked = lambda df, **kw: "ResolvedHint" in broadcast_if_small(df, **kw)._jdf.queryExecution().analyzed().toString()
    few = spark.range(50).select("id", F.struct(F.lit("x").alias("url"), F.array("id").alias("h")).alias("s"))
    assert marked(few) and not marked(few, rows=49) and marked(few.limit(0))
    assert marked(few.select("id", F.array(F.lit("x"), F.lit(None)).alias("a"))) and not marked(spark.range(50).select("id", F.array(F.lit("x"), F.repeat(F.lit("x"), 400_000)).alias("a")))
    assert not marked(spark.range(50).select("id", F.struct(F.repeat(F.lit("x"), 400_000).alias("url")).alias("s")))


def test_scratch_is_cleared(spark, tables):
    from pathlib import Path

    from weftwork.llm import common

    out = registry.op4_substring_dedup(spark, tables[0])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weft_")]
    out = out.collect()
    assert out and any(Path(f.removeprefix("file://")).exists() for f in common._FOLDERS)
    made = list(common._FOLDERS)
    common.clear_scratch(spark)
    assert not any(Path(f.removeprefix("file://")).exists() for f in made)
