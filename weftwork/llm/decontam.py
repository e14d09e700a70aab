"""Benchmark decontamination: edit-distance matches of test items inside documents, by the pigeonhole principle.

An item of m characters may differ by k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece survives
unedited, so exact hits of pieces find all candidates; each is verified by Myers' bit-parallel distance.

Texts are compared in lower case, with every run of other than letters, marks and digits as one space. Defined
results: null and empty texts match nothing; null items and items without a letter or digit are in no text; items under
MIN_ITEM_CHARS after this occur by chance, so they are searched for as whole words and reported apart; repeated items
are each reported; repeated documents are each answered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, texts_of

#: Edits allowed as a share of an item's characters.
MAX_ERROR_RATE = 0.07
#: Shorter items occur by chance and are reported apart.
MIN_ITEM_CHARS = 20
#: Characters of items in one block: what is searched for, and broadcast, at once.
BLOCK_CHARS = 2_000_000

MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("distance", T.IntegerType())]))
ARROW_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))


def normal(column: str):
    return F.trim(F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{M}\p{N}]+", " "))


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """Least distance of the pattern to any part of the text and the end of its first such part; (most + 1, -1) if over."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    return [(j * m // (k + 1), (j + 1) * m // (k + 1)) for j in range(k + 1)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, int(rate * len(t)) if len(t) >= MIN_ITEM_CHARS else 0) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for s, e in pieces(len(t), k):
                where.setdefault(t[s:e], []).append((n, e))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, at)
        if where:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> tuple[list[dict], list[dict]]:
        """Matches of items, and of short ones."""
        if not text or not len(self.automaton):
            return [], []
        starts: dict[int, set[int]] = {}
        for last, at in self.automaton.iter(text):
            for n, e in at:
                starts.setdefault(n, set()).add(last + 1 - e)
        out, short = [], []
        for n, found in starts.items():
            item, pattern, k = self.items[n]
            m, done = len(pattern), -1
            if m < MIN_ITEM_CHARS:
                whole = [s for s in found if (s == 0 or text[s - 1] == " ") and (s + m == len(text) or text[s + m] == " ")]
                short += [{"item_id": item, "start": s, "end": s + m, "distance": 0} for s in whole]
                continue
            # Overlapping windows of one item are searched as one; its best place is reported.
            spans: list[list[int]] = []
            for s in sorted(found):
                low, high = max(0, s - k), s + m + k
                if spans and low <= spans[-1][1] - m:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            for low, high in spans:
                distance, end = 0, text.find(pattern, max(low, done), high) + m
                if end < m:
                    distance, end = myers(pattern, text[low:high], k)
                    end += low
                if distance <= k and end > done:
                    # The same search backwards from the end gives the start.
                    back = text[max(0, end - m - k) : end][::-1]
                    start = end - (m if distance == 0 else myers(pattern[::-1], back, k)[1])
                    out.append({"item_id": item, "start": start, "end": end, "distance": distance})
                    done = end
        order = lambda x: (x["start"], x["end"], x["item_id"] is not None, x["item_id"])
        return sorted(out, key=order), sorted(short, key=order)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), normal(text_col).alias("t")).where("t <> ''").orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        chars += len(r.t)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _with_block(df: DataFrame, block: list[tuple[int, str]], rate: float, names: list[str]) -> DataFrame:
    items = df.sparkSession.sparkContext.broadcast(block)

    def make():
        matcher = Matcher(items.value, rate)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [matcher.find(t) for t in texts_of(batch, "__weft_normal")]
            return [pa.array([f[i] for f in found], ARROW_MATCHES) for i in range(2)]

        return run

    return append_columns(df, [T.StructField(name, MATCHES) for name in names], make)


def find_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = MAX_ERROR_RATE) -> DataFrame:
    """df with matches: items found, with their span in the normalised text and their distance; and short_matches.

    The documents are not shuffled and read once if one block holds the benchmark. Otherwise they are written once, with
    a key; each block reads keys and normalised texts alone and writes what it finds, which is joined to them at the end.
    A task holds one block at a time.
    """
    names = ["matches", "short_matches"]
    blocks = _blocks(benchmark, item_id, item_text)
    first, second = next(blocks, []), next(blocks, None)
    rows = df.drop(*names).withColumn("__weft_normal", normal(text_col))
    if second is None:
        return _with_block(rows, first, rate, names).drop("__weft_normal")
    scratch = Scratch(df.sparkSession, "decontam")
    rows = scratch.write(rows.withColumn("__weft_key", F.monotonically_increasing_id()))
    path = scratch.new_path("found")
    for block in chain([first, second], blocks):
        found = _with_block(rows.select("__weft_key", "__weft_normal"), block, rate, names).drop("__weft_normal")
        found.where((F.size("matches") > 0) | (F.size("short_matches") > 0)).write.mode("append").parquet(path)
    found = df.sparkSession.read.schema(found.schema).parquet(path).groupBy("__weft_key").agg(*(_in_order(F.flatten(F.collect_list(k))).alias(k) for k in names))
    out = rows.drop("__weft_normal").join(found, "__weft_key", "left").drop("__weft_key")
    return out.withColumns({k: F.coalesce(k, F.array().cast(MATCHES)) for k in names})


def _in_order(matches: Column) -> Column:
    """Matches by place, then item, as those of one block are."""
    key = F.transform(matches, lambda m: F.struct(m["start"], m["end"], m["item_id"], m["distance"]))
    return F.transform(F.array_sort(key), lambda m: F.struct(m["item_id"].alias("item_id"), m["start"].alias("start"), m["end"].alias("end"), m["distance"].alias("distance")))
