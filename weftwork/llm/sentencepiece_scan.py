"""SentencePiece segmentation as a max-plus parallel scan, and its inverse.

The segmentation is the path of pieces with the largest sum of weights. A giant document is cut into chunks; a chunk's
matrix holds, for each number of characters that a piece reaches in from the left and out to the right, the best weight
between. Matrices combine associatively under (max, +); the combined ones give the best weights at each chunk's start.
From these each chunk tells on its own where the best path to each of its ends comes in, these maps are composed from
the right, and each chunk is then segmented between its two boundary states.

Weights are the scores of a unigram file. A file whose scores are ranks, as of the BPE kind, has no weights of its own;
a piece of rank r then has the logarithm of Zipf's probability, in proportion to 1 / (r + 1).

A character that is in no piece becomes its UTF-8 bytes, as does U+2581, which pieces use for a space; so decoding
returns each text exactly. Defined results: a null text has null ids; an empty text has none; rows repeat as given. Of
equally good paths the one with the longest last pieces is taken, in giant documents too.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Shared, append_columns, bytes_of, texts_of

#: Longer documents are cut into chunks of so many characters.
GIANT_CHARS, CHUNK_CHARS = 32_768, 16_384
#: Chunks whose matrices are combined in one group.
GROUP = 64
#: Chunks that a task segments at once, and documents.
CHUNKS_AT_ONCE, ROWS_AT_ONCE = 64, 512
#: Words whose pieces a task keeps.
WORD_CACHE = 120_000
#: Words learned in one go, and the longest that are.
LEARN_ROWS, LONG_WORD = 2048, 40
#: Slots of a table of pieces, as a power of two; a vocabulary of millions of pieces needs more.
TABLE_BITS = 20
#: Weights are integers of this unit, so sums are exact in any order.
UNIT = 1 << 30
LOW = -(1 << 60)


def roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes with one more character."""
    h = (h ^ code) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def slots(h):
    return h >> (64 - TABLE_BITS), h >> (48 - TABLE_BITS) & ((1 << TABLE_BITS) - 1)


def hashes(texts: list[str]) -> list[np.uint64]:
    out = []
    for t in texts:
        h = np.zeros(1, np.uint64)
        for c in t:
            h = roll(h, np.array([ord(c)], np.uint64))
        out.append(h[0])
    return out


class Vocabulary:
    """Pieces, weights and bytes of a model file, as plain values that can be broadcast (its size is the file's)."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes: list[bytes] = []
        self.piece: dict[str, tuple[int, int]] = {}
        self.byte_id = [0] * 256
        scores = [m.get_score(i) for i in range(m.get_piece_size())]
        normal = [x for i, x in enumerate(scores) if x > -1e8 and not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        # Ranks are distinct whole numbers that leave few out.
        if len(normal) > 1 and all(x <= 0 and x == int(x) for x in normal) and len(set(normal)) == len(normal) > -min(normal) / 2:
            total = math.log(sum(1 / (1 - x) for x in normal))
            scores = [-math.log(1 - x) - total if -1e8 < x <= 0 else x for x in scores]
        least = min((x for x in scores if x > -1e8), default=0.0)
        for i in range(m.get_piece_size()):
            # Marks for `never` count as twice the least score, so that sums over long texts stay in range.
            p, score = m.id_to_piece(i), max(scores[i], 2 * least)
            if m.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.bytes.append(bytes([int(p[1:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes.append(b"")
            else:
                text = p.replace("▁", " ")
                self.piece[text] = (round(score * UNIT), i)
                self.bytes.append(text.encode())
        self.longest = max(map(len, self.piece))
        # Hashes of the pieces in two tables by different bits; the last entry stands for none.
        self.keys = np.append(hashes(list(self.piece)), np.uint64(0))
        self.key_weight = np.array([*(w for w, _ in self.piece.values()), LOW], np.int64)
        self.key_id = np.array([*(i for _, i in self.piece.values()), -1], np.int32)
        none = len(self.piece)
        self.tables = np.full((2, 1 << TABLE_BITS), none, np.int32)
        for n, h in enumerate(self.keys[:-1].tolist()):
            table, slot = next((t, x) for t, x in enumerate(slots(h)) if self.tables[t, x] == none)
            self.tables[table, slot] = n
        #: What a piece starts with, up to all of it.
        self.starts: dict[str, tuple[int, int] | None] = {p[:n]: None for p in self.piece for n in range(1, len(p))}
        self.starts |= self.piece
        self.fallback = round((least - 10) * UNIT)
        # No piece goes on past a space, so the start of each run of spaces cuts every path; so does a line's end if it
        # is in no longer piece.
        self.words = not any(" " in p.lstrip(" ") for p in self.piece)
        self.lines = self.words and not any("\n" in p for p in self.piece if len(p) > 1)
        self.cut = re.compile(r"\n| *[^ \n]+| +" if self.lines else r" *[^ ]+| +" if self.words else r"(?s).+")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, the last number where there is none."""
        one, two = (np.take(table, x.view(np.int64)) for table, x in zip(self.tables, slots(h), strict=True))
        found = np.where(np.take(self.keys, one) == h, one, two)
        return np.where(np.take(self.keys, found) == h, found, len(self.keys) - 1)


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v, self.words, self.weights = v, {}, {}

    def edges(self, text: str, start: int) -> list[tuple[int, int]]:
        """(length, weight) of the pieces that start there."""
        get = self.v.piece.get
        out = [(n, hit[0]) for n in range(1, min(self.v.longest, len(text) - start) + 1) if (hit := get(text[start : start + n]))]
        if not out or out[0][0] != 1:
            out.append((1, self.v.fallback))
        return out

    def best(self, word: str) -> tuple[int, bytes]:
        """Weight of the best path over a word, and its ids as 32-bit integers."""
        starts, n = self.v.starts, len(word)
        total: list = [None] * (n + 1)
        back = [(0, -1)] * (n + 1)
        total[0] = 0
        for s in range(n):
            here, e = total[s], s + 1
            hit = starts.get(word[s])
            if hit is None and word[s] not in self.v.piece:
                x = here + self.v.fallback
                if total[e] is None or x > total[e]:
                    total[e], back[e] = x, (s, -1)
            while True:
                if hit is not None:
                    x = here + hit[0]
                    if total[e] is None or x > total[e]:
                        total[e], back[e] = x, (s, hit[1])
                e += 1
                if e > n:
                    break
                part = word[s:e]
                if part not in starts:
                    break
                hit = starts[part]
        ids, j = [], n
        while j:
            s, i = back[j]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.v.byte_id[b] for b in reversed(word[s:j].encode("utf-8", "surrogatepass"))]
            j = s
        return total[n], array("i", reversed(ids)).tobytes()

    def learn(self, words: list[str]) -> None:
        """Ids of many words at once: the same recurrence, a column of all words of one length at a time."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, group in by.items():
            if n == 0 or n > LONG_WORD:
                self.words |= {w: self.best(w)[1] for w in group}
                continue
            for at in range(0, len(group), LEARN_ROWS):
                self._learn(group[at : at + LEARN_ROWS], n)

    def _learn(self, group: list[str], n: int) -> None:
        v, m = self.v, len(group)
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64)
        most = min(v.longest, n)
        # By the character that a piece ends before, and its length.
        weights, ids = np.empty((n + 1, most, m), np.int64), np.empty((n + 1, most, m), np.int32)
        h = np.zeros((n, m), np.uint64)
        for length in range(1, most + 1):
            h = roll(h[: n - length + 1], codes[length - 1 :])
            slot = v.find(h)
            weights[length:, length - 1] = v.key_weight[slot]
            ids[length:, length - 1] = v.key_id[slot]
        np.copyto(weights[:, 0], v.fallback, where=ids[:, 0] < 0)
        total, size = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int64)
        rows = np.arange(m)
        for e in range(1, n + 1):
            k = min(most, e)
            x = total[e - k : e] + weights[e, :k][::-1]
            longest_first = x.argmax(axis=0)
            size[e] = k - 1 - longest_first
            total[e] = x[longest_first, rows]
        at, back = np.full(m, n), []
        whole = np.ones(m, bool)
        while at.any():
            length = size[at, rows]
            i = np.where(at > 0, ids[at, length, rows], -2)
            whole &= i != -1
            back.append(i)
            at = np.maximum(at - length - 1, 0)
        out = np.array(back[::-1], np.int32).T
        counts = (out >= 0).sum(axis=1)
        ends = 4 * np.cumsum(counts)
        flat = out[out >= 0].tobytes()
        # Words with fallbacks go one by one, as does one that a hash has taken for a piece that it isn't.
        for w, ok, e, c in zip(group, whole.tolist(), ends.tolist(), counts.tolist(), strict=True):
            found = flat[e - 4 * c : e]
            if not ok or b"".join(map(v.bytes.__getitem__, memoryview(found).cast("i"))) != w.encode():
                found = self.best(w)[1]
            self.words[w] = found

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each between forced cuts or boundary states."""
        split = [self.v.cut.findall(t) for t in texts]
        needed = list({w for words in split for w in words})
        get = dict(zip(needed, self._ids_of_words(needed), strict=True)).__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in split]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as 32-bit integers."""
        missing = [w for w in words if w not in self.words]
        if len(self.words) + len(missing) > WORD_CACHE:
            self.words.clear()
            missing = words
        self.learn(missing)
        return list(map(self.words.__getitem__, words))

    def ids_of_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and how many each has. Words are looked up once each."""
        texts = pc.fill_null(column, "")
        if not self.v.words:
            parts = self.ids_of([" " + t if t else t for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, np.int32), *parts]), np.array([len(x) for x in parts], np.int64)
        n_docs = len(texts)
        lines = pc.split_pattern(texts, "\n") if self.v.lines else pa.ListArray.from_arrays(pa.array(range(n_docs + 1), pa.int32()), texts)
        n_lines = pc.list_value_length(lines).to_numpy().astype(np.int64)
        split = pc.split_pattern(lines.flatten(), " ")
        parts, n_parts = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
        begin = np.cumsum(n_parts) - n_parts
        doc_of_line = np.repeat(np.arange(n_docs), n_lines)
        first_line = np.zeros(len(n_parts), bool)
        first_line[np.cumsum(n_lines) - n_lines] = True
        # A part has the space before it, but for what begins a later line.
        spaced, last = np.ones(len(parts), bool), np.zeros(len(parts), bool)
        spaced[begin[~first_line]] = False
        last[begin + n_parts - 1] = True
        empty = pc.binary_length(parts).to_numpy() == 0
        line_of, doc_of = np.repeat(np.arange(len(n_parts)), n_parts), np.repeat(doc_of_line, n_parts)
        coded = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), parts, "").dictionary_encode()
        words = [*coded.dictionary.to_pylist(), "\n"]
        # Between two lines of a document stands the line's end as a word.
        full = np.full(len(parts) + len(n_parts) - n_docs, len(words) - 1)
        full[np.arange(len(parts)) + line_of - doc_of] = coded.indices.to_numpy()
        blobs = self._ids_of_words(words)
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        at = np.cumsum(size) - size
        sizes = size[full]
        source = np.repeat(at[full] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        ids = np.frombuffer(b"".join(blobs), np.int32)[source]
        n_words = np.bincount(doc_of, minlength=n_docs) + n_lines - 1
        counts = np.add.reduceat(sizes, np.cumsum(n_words) - n_words) if n_docs else np.zeros(0, np.int64)
        # Runs of several spaces are one word with what follows; such documents go by the rule of cuts, empty ones have none.
        odd = np.unique(np.concatenate([doc_of[spaced & empty & ~last], np.flatnonzero(pc.binary_length(texts).to_numpy() == 0)]))
        if len(odd):
            own = dict(zip(odd.tolist(), self.ids_of([" " + t if t else t for t in texts.take(pa.array(odd)).to_pylist()]), strict=True))
            pieces = [own.get(i, x) for i, x in enumerate(np.split(ids, np.cumsum(counts)[:-1]))]
            ids, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return ids, counts

    def weight(self, word: str) -> int:
        found = self.weights.get(word)
        if found is None:
            if len(self.weights) >= WORD_CACHE:
                self.weights.clear()
            found = self.weights[word] = self.best(word)[0]
        return found

    def matrix(self, text: str, right: str) -> np.ndarray:
        """Best scores of a chunk from each number of characters taken on its left to each taken on its right."""
        size, whole, n = self.v.longest, text + right, len(text)
        cuts = [m.start() for m in self.v.cut.finditer(whole)]
        inner = [c for c in cuts if size <= c <= n]
        if not inner:
            return self.paths(whole, n, list(range(min(size, n + 1))))
        head, tail = inner[0], inner[-1]
        middle = sum(self.weight(w) for w in self.v.cut.findall(whole[head:tail]))
        left = np.array([self.best(whole[i:head])[0] if i <= head else LOW for i in range(size)], np.int64)
        last = self.paths(whole[tail:], n - tail, [0])[0]
        out = np.maximum(left[:, None] + middle + last[None, :], LOW)
        out[:, last <= LOW] = LOW
        return out

    def paths(self, whole: str, n: int, starts: list[int]) -> np.ndarray:
        """One row for each start: best scores from there to the places at n and after."""
        size = self.v.longest
        far = np.full((len(whole) + 1, len(starts)), LOW, np.int64)
        for k, s in enumerate(starts):
            far[s, k] = 0
        for p in range(n):
            for length, weight in self.edges(whole, p):
                np.maximum(far[p + length], np.maximum(far[p] + weight, LOW), out=far[p + length])
        out = np.full((size, size), LOW, np.int64)
        reach = far[n : n + size]
        out[: len(starts), : len(reach)] = reach.T
        out[out < LOW // 2] = LOW
        return out


    def comes_in(self, text: str, right: str, start: np.ndarray) -> list[int]:
        """For each number of characters taken on a chunk's right, that on its left on the best path there.

        start has the best weights of paths up to the chunk, by characters taken; of equal ones the longest last pieces win.
        """
        size, whole, n = self.v.longest, text + right, len(text)
        inner = next((m.start() for m in self.v.cut.finditer(whole) if size <= m.start() <= n), None)
        # All paths pass a cut.
        end, whole = (n, whole) if inner is None else (inner, whole[:inner])
        total: list = [None] * (len(whole) + size + 1)
        came = [-1] * len(total)
        for i, x in enumerate(start.tolist()):
            if x > LOW // 2:
                total[i] = x
        for p in range(end):
            if total[p] is not None:
                for length, weight in self.edges(whole, p):
                    x = total[p] + weight
                    if total[p + length] is None or x > total[p + length]:
                        total[p + length], came[p + length] = x, p

        def entry(p: int) -> int:
            while came[p] >= 0:
                p = came[p]
            return p

        if inner is not None:
            return [entry(end)] * size
        return [entry(end + o) if end + o <= len(whole) and total[end + o] is not None else 0 for o in range(size)]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, less its largest entry so that sums of any length stay in range."""
    out = np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOW)
    top = out.max()
    return np.where(out > LOW // 2, out - top, LOW)


def _giant_states(chunks: DataFrame, vocabulary) -> DataFrame:
    """(key, chunk, entry, exit) of all chunks.

    Weights go from left to right over products of groups, then within each group; maps of ends to starts go back likewise.
    """
    size = vocabulary.value.longest

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            made = [encoder.matrix(t, r).tobytes() for t, r in zip(texts_of(batch, "text"), texts_of(batch, "right"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["key", "chunk", "m"])

    def square(b: bytes) -> np.ndarray:
        return np.frombuffer(b, np.int64).reshape(size, size)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for b in pdf.sort_values("chunk").m:
            out = square(b) if out is None else times(out, square(b))
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "group": [pdf.group.iloc[0]], "p": [out.tobytes()]})

    def along(start: np.ndarray, steps: list[bytes]) -> list[bytes]:
        """Weights before each step."""
        out = []
        for b in steps:
            out.append(start.tobytes())
            start = times(start[None, :], square(b))[0]
        return out

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        first = np.full(size, LOW, np.int64)
        first[0] = 0
        return pd.DataFrame({"key": pdf.key, "group": pdf.group, "first": along(first, list(pdf.p))})

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        return pd.DataFrame({"key": pdf.key, "chunk": pdf.chunk, "start": along(np.frombuffer(pdf["first"].iloc[0], np.int64), list(pdf.m))})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            made = [encoder.comes_in(t, r, np.frombuffer(x, np.int64)) for t, r, x in zip(*(batch.column(k).to_pylist() for k in range(2, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int32()))], names=["key", "chunk", "back"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.arange(size)
        for b in pdf.sort_values("chunk", ascending=False).back:
            out = np.asarray(b)[out]
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "group": [pdf.group.iloc[0]], "back": [out.astype(np.int32)]})

    def back(pdf: pd.DataFrame, by: str, last: int) -> pd.DataFrame:
        pdf = pdf.sort_values(by, ascending=False)
        ends = [last]
        for b in pdf.back:
            ends.append(int(b[ends[-1]]))
        return pd.DataFrame({"key": pdf.key, by: pdf[by], "entry": ends[1:], "exit": ends[:-1]})

    scratch = Scratch(chunks.sparkSession, "scan")
    group = (F.col("chunk") / GROUP).cast("int")
    made = scratch.write(chunks.select("key", "chunk", "text", "right").mapInArrow(matrices, "key long, chunk int, m binary").withColumn("group", group))
    products = made.groupBy("key", "group").applyInPandas(product, "key long, group int, p binary")
    firsts = products.groupBy("key").applyInPandas(outer, "key long, group int, first binary")
    starts = made.join(firsts, ["key", "group"]).groupBy("key", "group").applyInPandas(inner, "key long, chunk int, start binary")
    maps = chunks.join(starts, ["key", "chunk"]).select("key", "chunk", "text", "right", "start").mapInArrow(entries, "key long, chunk int, back array<int>")
    maps = scratch.write(maps.withColumn("group", group))
    of_groups = maps.groupBy("key", "group").applyInPandas(composed, "key long, group int, back array<int>")
    ends = of_groups.groupBy("key").applyInPandas(lambda pdf: back(pdf, "group", 0), "key long, group int, entry int, exit int").select("key", "group", F.col("exit").alias("end"))
    return maps.join(ends, ["key", "group"]).groupBy("key", "group").applyInPandas(lambda pdf: back(pdf, "chunk", int(pdf.end.iloc[0])), "key long, chunk int, entry int, exit int")


def _cut(batches: Iterator[pa.RecordBatch], text_col: str, longest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(batch.schema.get_field_index("__weft_key")).to_pylist(), texts_of(batch, text_col), strict=True):
            text = " " + text
            starts = list(range(0, max(1, len(text) - longest), CHUNK_CHARS))
            ends = [*starts[1:], len(text)]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([text[s:e] for s, e in zip(starts, ends, strict=True)]), pa.array([text[e : e + longest - 1] for e in ends])], names=["key", "chunk", "text", "right"])


def texts_of_ids(table: pa.Array, column: pa.Array) -> list[bytes | None]:
    """The text of each list of ids, given the bytes of each piece."""
    found = table.take(column.flatten())
    ends = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    # The pieces lie one after another, so a text is a stretch of their bytes; its first is the space put before it.
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1][ends].tolist()
    data = memoryview(data or b"")
    return [data[s + 1 : e].tobytes() if ok else None for s, e, ok in zip(at, at[1:], column.is_valid().to_pylist(), strict=False)]


def encode(df: DataFrame, model_file: str, text_col: str = "text", giant_chars: int | None = None, round_trip: str | None = None) -> DataFrame:
    """df with ids: the pieces of each text. Documents beyond giant_chars are spread over tasks by chunk.

    A name given as round_trip is that of a further column: whether decoding the ids gives the text again.
    """
    spark = df.sparkSession
    vocabulary = Shared(spark, Vocabulary(model_file))
    giant_chars = giant_chars or GIANT_CHARS
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(round_trip, T.BooleanType())] if round_trip else [])]

    def make():
        encoder = Encoder(vocabulary.value)
        table = pa.array(encoder.v.bytes, pa.binary())

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids, counts = encoder.ids_of_column(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids), mask=texts.is_null())
            if not round_trip:
                return [lists]
            return [lists, pa.array([a == b for a, b in zip(texts_of_ids(table, lists), bytes_of(batch, text_col), strict=True)], pa.bool_())]

        return run

    is_giant = F.coalesce(F.length(text_col) > giant_chars, F.lit(False))
    small = append_columns(df.where(~is_giant), fields, make, ROWS_AT_ONCE)
    scratch = Scratch(spark, "encode")
    giant = scratch.write(df.drop("ids").where(is_giant).withColumn("__weft_key", F.monotonically_increasing_id()))
    if giant.isEmpty():
        return small
    longest = vocabulary.value.longest
    cut = giant.select("__weft_key", text_col).mapInArrow(lambda b: _cut(b, text_col, longest), "key long, chunk int, text string, right string")
    chunks = scratch.write(cut.repartition("key", "chunk"))

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS_AT_ONCE):
                some = batch.slice(at, CHUNKS_AT_ONCE)
                out = encoder.ids_of([(t + r)[i : len(t) + o] for t, r, i, o in zip(*(some.column(k).to_pylist() for k in range(2, 6)), strict=True)])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, pa.list_(pa.int32()))], names=["key", "chunk", "part"])

    parts = chunks.join(_giant_states(chunks, vocabulary), ["key", "chunk"]).select("key", "chunk", "text", "right", "entry", "exit").mapInArrow(between, "key long, chunk int, part array<int>")
    whole = parts.groupBy(F.col("key").alias("__weft_key")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("ids"))
    giant = giant.drop(*(f.name for f in fields)).join(whole, "__weft_key").drop("__weft_key")
    if round_trip:
        giant = decode(giant, model_file, name="__weft_decoded").withColumn(round_trip, F.col("__weft_decoded").eqNullSafe(F.col(text_col))).drop("__weft_decoded")
    return small.unionByName(giant)


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for."""
    pieces = df.sparkSession.sparkContext.broadcast(Vocabulary(model_file).bytes)

    def make():
        table = pa.array(pieces.value, pa.binary())
        return lambda batch: [pa.array(texts_of_ids(table, batch.column(batch.schema.get_field_index(ids_col))), pa.binary()).cast(pa.string())]

    return append_columns(df, [T.StructField(name, T.StringType())], make, ROWS_AT_ONCE)
