"""WARC and chat operators: exact round trips and hand-made logs."""

import base64
import gzip
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from weftwork.llm import chat, warc


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.b/x?y#z", "same\r\n\r\nWARC/1.1\r\n\r\n"), (2, "http://a.b/2", "same\r\n\r\nWARC/1.1\r\n\r\n"), (3, None, None), (4, "q\r\nx", ""), (5, "http://c", "tail\r\n"), (6, "http://d", "\r\n" * 5), (7, "http://e", "é\x00"), (None, "http://n", "zz"), (None, "http://n", "zz"), (8, "http://f", "x\r"), (9, "u", "a\r\n\r"), (10, "l", "long " * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_captures(df, str(tmp_path / "w"))
    got = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    # Rows that repeat are a capture each.
    assert len(got) == len(pages) == 12
    ids = {r.capture_id: r.metadata[0].payload.decode().split()[1:] for r in got}
    by = {(int(ids[r.capture_id][0]) if ids[r.capture_id] else None): r for r in got}
    for i, _, html in pages:
        r, payload = by[i].response, (html or "").encode()
        if r.type == "response":
            assert bytes(r.payload) == payload and r.payload_digest == sha1(payload) and r.declared_digest == "sha1:" + sha1(payload)
        else:
            assert ids[r.refers_to] == [{1: "2", 3: "4"}[i]] and r.payload_bytes == 0
        assert not r.truncated and by[i].request.type == "request" and len(by[i].metadata) == 1
    assert {i for i, r in by.items() if r.response.type == "revisit"} == {1, 3}


def test_warc_split_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        blocks = [b"".join(rng.choice([b"\r\n", b"\r", b"\n", b"x", b"WARC/1.1", b"\r\n\r\n"]) for _ in range(rng.randrange(9))) for _ in range(4)]
        raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
        assert [b for _, b, _ in warc.split_records(iter(raw.split(b"\r\n\r\n")))] == blocks


def test_warc_links_in_both_directions_and_bad_records(spark, tmp_path):
    def record(kind, me, block=b"", **links):
        more = "".join(f"WARC-Concurrent-To: {t}\r\n" for t in links.get("to", []))
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {me}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    raw = record("warcinfo", "<i>", b"software: x") + record("response", "<r1>", b"body", to=["<q1>"]) + record("request", "<q1>") + record("metadata", "<m1>", b"via: q", to=["<q1>"]) + record("response", "<r2>") + record("metadata", "<m0>", to=["<none>"]) + b"junk\r\n\r\n" + record("response", "<r3>", b"cut off")[:-9]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw[:200]) + gzip.compress(raw[200:]))
    records = warc.read_records(spark, str(tmp_path))
    assert records.where("type = 'invalid'").count() == 1
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert got["<r1>"].request.record_id == "<q1>" and [m.record_id for m in got["<r1>"].metadata] == ["<m1>"]
    assert got["<r2>"].request is None and got["<r2>"].metadata == []
    assert got["<r3>"].response.truncated and set(got) == {"<r1>", "<r2>", "<r3>"}


def test_chat_round_trip(spark):
    texts = [None, "", "\\", "<|", "<\\p|", "\\b\\p<|im_end|>\n<|im_start|>user\nx", "a" * 10_000, "é😀<|<|\\\\|>"]
    rows = [(c, t, r, x) for c, r in ((1, "user"), (2, "assistant"), (None, "assistant"), (3, None), (4, "we\nird<|")) for t, x in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:4], "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.render(chat.fold_events(chat.conversation_events(df, delta_chars=7)))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in (1, 2, None, 3, 4):
        # A row that repeats is a turn of its own.
        mine = [(r or "", x or "") for k, t, r, x in rows if k == c for _ in range(1 + (c == 1 and t < 4))]
        assert [(t.role, t.text) for t in got[c].t] == mine
        assert got[c].loss == "".join(x for r, x in mine if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len(mine)
    assert chat.render(chat.fold_events(chat.conversation_events(df.limit(0)))).count() == 0


def test_chat_ties_and_clashing_columns(spark):
    rows = [(1, 3, r, t) for t in "fbdaec" for r in ("user", "assistant")] + [(1, None, "user", "z"), (1, 0, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("message_id", "seq", "kind", "log", "turns", "events")})
    got = chat.fold_events(chat.conversation_events(df)).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3]))
    assert [(t.role, t.text) for t in got[0].turns] == [(r or "", t) for _, _, r, t in want]


def test_long_conversations_take_time_in_proportion(spark):
    def took(df):
        began = time.monotonic()
        out = chat.render(chat.fold_events(df))
        row = out.select(F.size(chat.parse(F.col("formatted"))).alias("n"), F.length(chat.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("loss")).collect()[0]
        return time.monotonic() - began, row

    ids = spark.range(40_000)
    deltas = ids.select(F.lit(1).alias("conv_id"), F.lit("m").alias("message_id"), F.col("id").alias("seq"), F.lit("assistant").alias("role"), F.lit("delta").alias("kind"), F.lit("abc ").alias("text"))
    turns = ids.select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("abc ").alias("text"))
    for df, n in ((deltas, 1), (chat.conversation_events(turns), 40_000)):
        seconds, row = took(df)
        assert row == (n, 160_000) and seconds < 30


@pytest.mark.parametrize("again", [1, 2])
def test_chat_fold(spark, again):
    log = [
        (1, "a", 0, "user", "message", "hi"), (1, "b", 1, "assistant", "delta", "wr"), (1, "b", 2, "assistant", "delta", "ong"),
        (1, "b", 3, "assistant", "regenerate", None), (1, "b", 4, "assistant", "delta", "ri"), (1, "b", 5, "assistant", "delta", "ght"),
        (1, "c", 6, "user", "message", "typo"), (1, "c", 7, "user", "edit", "fixed"), (1, "c", 8, "user", "delta", "!"),
        (1, "d", 9, "user", "message", "gone"), (1, "d", 10, "user", "delete", None),
        (2, "x", 5, "user", "message", "b"), (2, "y", 3, "system", "message", "a"), (2, "z", 9, "user", "delta", "only"),
    ]
    df = spark.createDataFrame(log * again, "conv_id long, message_id string, seq long, role string, kind string, text string").repartition(3)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.fold_events(df).collect()}
    assert got[1] == [("user", "hi"), ("assistant", "right"), ("user", "fixed!")]
    assert got[2] == [("system", "a"), ("user", "b"), ("user", "only")]
