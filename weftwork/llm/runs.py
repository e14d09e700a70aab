"""Periodic runs of words, by a dictionary of basic factors.

Each stretch of 2^k words gets a number that equal stretches of a document share, made from the numbers of its two halves.
Where a stretch occurs again within twice its length, and once more after the same step, that arithmetic progression
proposes the step as a period. A run of period q holds such a progression at the least length that is q or more, as it
has four periods or more. Proposals are extended as far as words a period apart are equal, and those that mean the same
stretch of words are one run, with the least period.

Only stretches that occur again are kept for the next length, so texts without repeats end after a few lengths. The texts
of a batch are numbered together: a word's first number tells its document too, so nothing is equal across documents.

Defined results: null, empty and word-free texts have no run, no best run (null) and an empty collapsed text; repeated
rows are each answered; a text is handled whole in one task, however long. Columns of df with the names of the results
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bind

#: A run has this many words and this many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words of texts that are numbered together; only a longer single text takes more.
CHUNK_WORDS = 400_000
#: Words compared at first when a proposal is extended; then twice as many each time.
STEP = 64

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _proposals(names: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where arithmetic progressions of three occurrences begin, and their steps; of neighbours with one step the first.

    at: rising positions of stretches of `size` words that occur again; names: their numbers.
    """
    order = np.argsort(names, kind="stable")
    where, of = at[order], names[order]
    step = np.zeros(len(at), np.int64)
    step[:-1] = np.where(of[1:] == of[:-1], where[1:] - where[:-1], 0)
    again = np.zeros(len(at), bool)
    again[:-1] = (step[:-1] > 0) & (step[:-1] <= 2 * size) & (step[:-1] == step[1:])
    hit = order[again]
    by = np.argsort(hit)
    place, step = at[hit[by]], step[again][by]
    head = np.ones(len(place), bool)
    head[1:] = (place[1:] != place[:-1] + 1) | (step[1:] != step[:-1])
    return place[head], step[head]


def _reach(words: np.ndarray, left: int, right: int, step: int, low: int, high: int) -> int:
    """How far words[left + t] == words[right + t] for t = 0, step, 2 * step, ..., within low <= position < high."""
    n, size = 0, STEP
    while True:
        room = (high - right - n) if step > 0 else (left - n - low + 1)
        size = min(size, room)
        if size <= 0:
            return n
        a = words[left + n : left + n + size] if step > 0 else words[left - n - size + 1 : left - n + 1][::-1]
        b = words[right + n : right + n + size] if step > 0 else words[right - n - size + 1 : right - n + 1][::-1]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n, size = n + size, 2 * size


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start, then period; codes: its words as numbers, text after text."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(sizes))]
    n = len(codes)
    if not n:
        return [[] for _ in found]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    _, words = np.unique(doc * (int(codes.max()) + 1) + codes, return_inverse=True)
    names, at, size = words.astype(np.int64), np.arange(n), 1
    while True:
        # Only what occurs again can make progressions, or parts of longer stretches that do.
        more = np.bincount(names)[names] > 1
        names, at = names[more], at[more]
        if not len(at):
            break
        for i, d in zip(*(x.tolist() for x in _proposals(names, at, size)), strict=True):
            k = int(doc[i])
            low, high, mine = int(starts[k]), int(ends[k]), found[k]
            left = _reach(words, i - 1, i - 1 + d, -1, low, high)
            right = _reach(words, i, i + d, 1, low, high)
            length = left + right + d
            if length >= max(MIN_WORDS, MIN_PERIODS * d):
                key = (i - left - low, length)
                mine[key] = min(mine.get(key, d), d)
        number = np.full(n + size, -1, np.int64)
        number[at] = names
        both = number[at + size] >= 0
        names, at = names[both] * n + number[at[both] + size], at[both]
        if not len(at):
            break
        names = np.unique(names, return_inverse=True)[1]
        size *= 2
    return [sorted((s, length, d) for (s, length), d in mine.items()) for mine in found]


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def words_in(column: pa.Array) -> pa.ListArray:
    """The words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
    kind = pa.LargeListArray if pa.types.is_large_string(flat.type) else pa.ListArray
    return kind.from_arrays(pa.array(before[ends], pa.int64() if kind is pa.LargeListArray else pa.int32()), flat.filter(some))


def find_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, runs (start, length, period; by start, then period), best_run and collapsed_text.

    best_run has the greatest length / period; collapsed_text has the words left when each run keeps its first period
    alone, with one space between. A map: nothing is shuffled.
    """

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = words_in(batch.column(batch.schema.get_field_index(text_col)))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            runs: list[list[tuple[int, int, int]]] = []
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                base = int(ends[first] - sizes[first])
                last = max(first + 1, int(np.searchsorted(ends, base + CHUNK_WORDS, "right")))
                runs += runs_of(codes[base : int(ends[last - 1])], sizes[first:last])
                first = last
            text = pc.binary_join(lists, " ")
            some = [i for i, r in enumerate(runs) if r]
            if some:
                text = text.to_pylist()
                for i in some:
                    keep = np.flatnonzero(~dropped(runs[i], int(sizes[i]))) + int(ends[i] - sizes[i])
                    text[i] = " ".join(flat.take(pa.array(keep)).to_pylist())
                text = pa.array(text, pa.string())
            as_rows = lambda x: dict(zip(("start", "length", "period"), x, strict=True)) if x else None
            return [pa.array(sizes), pa.array([[as_rows(x) for x in r] for r in runs], pa.list_(ARROW_RUN)), pa.array([as_rows(best_run(r)) for r in runs], ARROW_RUN), text]

        return run

    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best_run", RUN), T.StructField("collapsed_text", T.StringType())]
    return append_columns(df, fields, make, 512)


def with_planted_runs(text: Column, h: Column) -> Column:
    """A text in which, if h % 10 is 0, words from one on repeat those after it, as h tells; other texts as they are.

    With g = h / 10 whole tenths and n words, each word i from a = g % n on is word a + (i - a) % p, p being
    1 + (n - a) / (3 + g % 8) rounded down.
    """
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        # The head, then its repeating part as often as needed, cut to what is left.
        return bind(F.struct(n.alias("n"), a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(w, F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))), " "))

    return F.when(h % 10 == 0, bind(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))).otherwise(text)
