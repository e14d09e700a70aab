"""Removes word windows that repeat an earlier one, with count-min sketches ahead of the exact grouping.

The rows are written once in chunks of bounded size, bucketed by chunk, so that no later pass shuffles a text. Pass one
sketches each chunk's windows by ranges of their hashes. A range's sketches are merged in one task, where they never
count too few, and each chunk is told which of its cells hold two or more. So there are as many sketches as the windows
need, each of fixed size, and none is broadcast. In pass two only windows in such cells are grouped, by 84 bits of
hashes of their words, so no repeat is lost. Of equal windows a chunk hands on one, so a hot window makes a row a chunk.

A window repeats if its words also start at a smaller (id, position). Defined results: null texts have no words;
texts under one window stay; a null id is less than any other; rows of one id are versions of one document, each judged
by its own text, so equal rows get equal results and don't repeat each other. A text of over 2^28 words, which takes
more than half a gigabyte, ends the job with an error that says so, since positions have 28 bits.

A chunk makes a row for each range of which it has windows. Beyond SCALE_BYTES of text, chunks and ranges both grow with
the root of the input, so that these rows stay in proportion to it; so does the memory of a task, ten times at 100 TB.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, bytes_of, free_shuffles, shuffle_partitions

#: A word window.
WINDOW = 20
#: Rows of a sketch, and the cells of a row as a power of two.
DEPTH, CELLS = 2, 22
#: Text of a range of hashes: some million windows, for which a sketch has cells enough.
RANGE_BYTES = 6_000_000
#: Text from which on chunks and ranges grow.
SCALE_BYTES = 1_000_000_000_000
#: Buckets of a table at most, which is Spark's limit; larger inputs get larger buckets.
MAX_BUCKETS = 100_000
#: Text of a chunk, what a row counts besides its text, and text of a bucket of chunks.
CHUNK_BYTES, ROW_BYTES, BUCKET_BYTES = 8_000_000, 64, 32_000_000
#: Bits of a row's place in its chunk, and of a chunk's place in its task.
ROW_BITS, LOCAL_BITS = 20, 20
#: Bits of a window's start, and of its second hash that go to the shuffle; with the place they leave bytes of zeros.
POS_BITS, MORE_BITS = 28, 20
#: Text that is split into words at once, words hashed at once, and words whose hashes a task keeps.
PIECE, CHUNK_WORDS, WORD_CACHE = 1 << 20, 200_000, 200_000
ROLL = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
ROW_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACE, WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, of a long one piece by piece."""
    at, size = 0, len(text or b"")
    while at < size:
        cut = SPACE.search(text, at + PIECE)
        end = cut.start() if cut else size
        yield text[at:end].split()
        at = end


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(word: np.ndarray, roll: int, window: int) -> np.ndarray:
    """Hash of each window of the word hashes: sums of powers, taken from prefix sums."""
    n = len(word) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * _powers(roll, len(word)), dtype=np.uint64)])
    return (prefix[window:] - prefix[:-window]) * _powers(pow(roll, -1, 1 << 64), n)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def windows_of(texts: list[bytes | None], rows: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and position of each whole window of the texts with these numbers, and its two hashes."""
    cache, out = WordHashes(), []
    held_rows, held, n = [], [], 0

    def flush() -> None:
        sizes = np.array([len(h) for h in held])
        flat = np.concatenate(held)
        row = np.repeat(np.array(held_rows), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ok = np.flatnonzero((at <= np.repeat(sizes, sizes) - window)[: max(0, len(flat) - window + 1)])
        out.append((row[ok], at[ok], window_hashes(flat, ROLL[0], window)[ok], window_hashes(_mix(flat), ROLL[1], window)[ok]))

    for i in rows:
        h = [np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)) for w in words_of(texts[i])]
        h = h[0] if len(h) == 1 else np.concatenate([np.zeros(0, np.uint64), *h])
        if len(h) >> POS_BITS:
            raise ValueError(f"a text has {len(h)} words, more than the {1 << POS_BITS} whose positions can be held; cut it into several")
        if len(h) >= window:
            held_rows.append(i)
            held.append(h)
            n += len(h)
            if n >= CHUNK_WORDS:
                flush()
                held_rows, held, n = [], [], 0
    if held:
        flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Plan(NamedTuple):
    """How the windows are dealt out: text of a chunk, ranges of hashes, and cells of a range as a power of two."""

    chunk: int
    ranges: int
    cells: int


def plan_of(size: int) -> Plan:
    """For so many bytes of text; a range keeps its share of cells for a window as it grows."""
    grown = max(1.0, (size / SCALE_BYTES) ** 0.5)
    return Plan(int(CHUNK_BYTES * grown), max(1, int(size / (RANGE_BYTES * grown))), CELLS + math.ceil(math.log2(grown)))


def sketch_cells(h: np.ndarray, row: int, plan: Plan) -> np.ndarray:
    """Range and cell of each hash in a row of the sketches, as one number."""
    of = ((h >> np.uint64(32)) * np.uint64(plan.ranges)) >> np.uint64(32)
    cell = (h * np.uint64(ROW_MIX[row])) >> np.uint64(64 - plan.cells)
    return (of << np.uint64(plan.cells) | cell).view(np.int64)


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted distinct cells as gaps of two bytes each; 65535 goes on."""
    gap = np.diff(cells, prepend=0)
    more = gap // 65535
    out = np.full(int(more.sum()) + len(gap), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = gap % 65535
    return out.tobytes()


def _cells(gaps: bytes) -> np.ndarray:
    step = np.frombuffer(gaps, np.uint16)
    return np.cumsum(step, dtype=np.int64)[step != 65535]


def _chunked(df: DataFrame, text_col: str, scratch: Scratch) -> tuple[DataFrame, Plan]:
    """df as a written table with __weft_chunk and __weft_row, bucketed by chunk; and how to deal its windows out."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    plan = plan_of(size)

    def make():
        partition, local, row, held = TaskContext.get().partitionId(), 0, 0, 0

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal local, row, held
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
            chunks, rows = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int32)
            for i, n in enumerate(sizes.tolist()):
                if held and held + n + ROW_BYTES > plan.chunk or row >> ROW_BITS:
                    local, row, held = local + 1, 0, 0
                chunks[i], rows[i] = partition << LOCAL_BITS | local, row
                row += 1
                held += n + ROW_BYTES
            return [pa.array(chunks), pa.array(rows)]

        return run

    fields = [T.StructField("__weft_chunk", T.LongType()), T.StructField("__weft_row", T.IntegerType())]
    buckets = min(MAX_BUCKETS, max(shuffle_partitions(df.sparkSession), size // BUCKET_BYTES))
    return scratch.write_buckets(append_columns(df, fields, make), "__weft_chunk", buckets), plan


def repeated_cells(docs: DataFrame, window: int, plan: Plan) -> DataFrame:
    """(chunk, of, hits0, hits1): for each chunk and range of hashes, bits of the chunk's cells that count twice or more.

    The bits follow the order of the chunk's cells; where a row of a sketch has none, the range is left out.
    """
    schema = "of long, chunk long, " + ", ".join(f"seen{r} binary, again{r} binary" for r in range(DEPTH))
    names = ["of", "chunk", *(f"{k}{r}" for r in range(DEPTH) for k in ("seen", "again"))]
    types = [pa.int64(), pa.int64(), *[pa.binary()] * (2 * DEPTH)]

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        texts = bytes_of(table.combine_chunks().to_batches()[0], "text")
        h = windows_of(texts, range(len(texts)), window)[2]
        found: dict[int, list[bytes]] = {}
        for r in range(DEPTH):
            cell = sketch_cells(h, r, plan)
            cell.sort()
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
            again = np.diff(np.append(first, len(cell))) > 1
            cell = cell[first]
            of, inside = cell >> plan.cells, cell & ((1 << plan.cells) - 1)
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(of)], strict=False):
                part = inside[s:e]
                found.setdefault(int(of[s]), []).extend([_gaps(part), _gaps(part[again[s:e]])])
        columns = zip(*((of, key[0].as_py(), *parts) for of, parts in found.items()), strict=True) if found else [[]] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        hits = []
        for r in range(DEPTH):
            seen, twice = np.zeros(1 << plan.cells, bool), np.zeros(1 << plan.cells, bool)
            blobs = table.column(f"seen{r}").to_pylist()
            for s, a in zip(blobs, table.column(f"again{r}").to_pylist(), strict=True):
                cells = _cells(s)
                twice[cells] |= seen[cells]
                twice[_cells(a)] = True
                seen[cells] = True
            hits.append([np.packbits(twice[_cells(s)]).tobytes() for s in blobs])
        some = pa.array([all(any(b) for b in x) for x in zip(*hits, strict=True)], pa.bool_())
        return pa.table([table.column("chunk"), table.column("of"), *(pa.array(x, pa.binary()) for x in hits)], names=["chunk", "of", *(f"hits{r}" for r in range(DEPTH))]).filter(some)

    parts = docs.select(F.col("__weft_chunk").alias("chunk"), "text").groupBy("chunk").applyInArrow(sketch, schema)
    return parts.groupBy("of").applyInArrow(merge, "chunk long, of long, " + ", ".join(f"hits{r} binary" for r in range(DEPTH)))


def _hit(h: np.ndarray, hits: pa.Table, plan: Plan) -> np.ndarray:
    """Which windows lie in cells that count twice or more, in each row of the sketches."""
    out = np.ones(len(h), bool)
    of = hits.column("of").to_pylist()
    for r in range(DEPTH):
        cells, place = np.unique(sketch_cells(h, r, plan), return_inverse=True)
        on = np.zeros(len(cells), bool)
        starts = np.searchsorted(cells, np.array(of, np.int64) << plan.cells).tolist()
        ends = np.searchsorted(cells, (np.array(of, np.int64) + 1) << plan.cells).tolist()
        for s, e, bits in zip(starts, ends, hits.column(f"hits{r}").to_pylist(), strict=True):
            on[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s)
        out &= on[place]
    return out


def _versions(ids: list[int | None]) -> np.ndarray:
    """Numbers of the ids in order, a null before all; equal ids have one number."""
    rank = {x: i for i, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x or 0)))}
    return np.array([rank[x] for x in ids], np.int64)


def _pack(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return pos.astype(np.int64) << POS_BITS | n.astype(np.int64)


def repeats(docs: DataFrame, hits: DataFrame, window: int, plan: Plan) -> DataFrame:
    """(chunk, row, run): runs of windows that start earlier elsewhere, for one of the rows that tie in (id, position).

    A row of the shuffle has a window's hash, its id, its row, and its place with more of the hash; or, with the sign
    bit set, a run that is known to repeat.
    """

    def candidates(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        def rows(h, row, k) -> pa.Table:
            return pa.table([pa.array(h.view(np.int64)), ids.take(pa.array(row)), pa.array(base | places[row]), pa.array(k)], names=["h", "id", "key", "k"])

        batch = left.combine_chunks().to_batches()[0] if left.num_rows else None
        if batch is None or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=["h", "id", "key", "k"])
        ids, texts, base = batch.column(batch.schema.get_field_index("id")), bytes_of(batch, "text"), key[0].as_py() << ROW_BITS
        places = batch.column(batch.schema.get_field_index("row")).to_numpy().astype(np.int64)
        version = _versions(ids.to_pylist())
        row, pos, h1, h2 = windows_of(texts, range(len(texts)), window)
        hit = np.flatnonzero(_hit(h1, right, plan))
        row, pos, h1, h2 = row[hit], pos[hit], h1[hit], h2[hit]
        # Of equal windows only the first here goes to the shuffle.
        by = np.lexsort((pos, version[row], h2, h1))
        row, pos, h1, h2 = row[by], pos[by], h1[by], h2[by]
        first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(h1)]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h1)), 0))
        later = np.flatnonzero((version[row] != version[row[lead]]) | (pos != pos[lead]))
        out = [rows(h1[first], row[first], (h2[first] >> np.uint64(64 - MORE_BITS) << np.uint64(POS_BITS)).view(np.int64) | pos[first])]
        if len(later):
            later = later[np.lexsort((pos[later], row[later]))]
            row, pos, h1 = row[later], pos[later], h1[later]
            start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)]))
            n = np.diff(np.append(start, len(row)))
            out.append(rows(h1[start], row[start], _pack(pos[start], n) | np.iinfo(np.int64).min))
        return pa.concat_tables(out)

    def later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            h, k = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            own = batch.column(1).fill_null(0).to_numpy()
            dup, words, pos = k < 0, k >> POS_BITS, k & ((1 << POS_BITS) - 1)
            # Runs known as repeats pass; of windows, all but those at the least place of their words do.
            start = np.concatenate([[True], (h[1:] != h[:-1]) | (words[1:] != words[:-1]) | dup[:-1]]) | dup
            head = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
            least = [known[head], own[head], pos[head]]
            if last and not dup[0] and (h[0], words[0]) == last[0]:
                least = [np.where(head == 0, x, y) for x, y in zip(last[1], least, strict=True)]
            again = dup | (known != least[0]) | (own != least[1]) | (pos != least[2])
            last = None if dup[-1] else ((h[-1], words[-1]), [x[-1] for x in least])
            if again.any():
                key = batch.column(2).to_numpy()[again]
                code = np.where(dup, k & np.iinfo(np.int64).max, _pack(pos, np.ones(len(pos), np.int64)))[again]
                yield pa.RecordBatch.from_arrays([pa.array(key >> ROW_BITS), pa.array((key & ((1 << ROW_BITS) - 1)).astype(np.int32)), pa.array(code)], names=["chunk", "row", "run"])

    left = docs.select(F.col("__weft_chunk").alias("chunk"), F.col("__weft_row").alias("row"), "id", "text").groupBy("chunk")
    found = left.cogroup(hits.groupBy("chunk")).applyInArrow(candidates, "h long, id long, key long, k long")
    ordered = found.repartition("h").sortWithinPartitions("h", F.shiftright("k", POS_BITS), "id", "k")
    return ordered.mapInArrow(later_ones, "chunk long, row int, run long")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of these spans (first, last + 1), which are in order and apart.

    Of the blanks on both sides of a span those with more line ends stay, the later ones if equal, so that the next line
    keeps its indent; at the start of a text the indent alone.
    """
    parts, words, at, done, word = [], WORD.finditer(text), 0, 0, None
    for first, last in spans:
        if first > at:
            word = next(islice(words, first - at - 1, None))
        low = word.end() if word else 0
        begin = end = next(words)
        if last - first > 1:
            end = next(islice(words, last - first - 2, None))
        word, at = next(words, None), last + 1
        before, after = text[low : begin.start()], text[end.end() : word.start() if word else len(text)]
        blank = after if after.count(b"\n") >= before.count(b"\n") else before
        if not first:
            blank = after.rpartition(b"\n")[2] if b"\n" in after else before
        parts += [text[done:low], blank]
        done = word.start() if word else len(text)
    return b"".join([*parts, text[done:]])


def _removed(batch: pa.RecordBatch, text_col: str, ids: list, runs: pa.Table, window: int) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts and lengths of the runs of windows to remove, by row of a chunk, ties of what was found included."""
    place = batch.column(batch.schema.get_field_index("__weft_row")).to_numpy()
    at = np.empty(int(place.max()) + 1, np.int64)
    at[place] = np.arange(len(place))
    row, code = at[runs.column("row").to_numpy()], runs.column("run").to_numpy()
    by = np.argsort(row, kind="stable")
    row, pos, n = row[by], code[by] >> POS_BITS, code[by] & ((1 << POS_BITS) - 1)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    out = {int(row[s]): [(pos[s:e], n[s:e])] for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(row)], strict=False)}
    version = _versions(ids)
    shared = np.flatnonzero(np.bincount(version)[version] > 1)
    if not len(shared) or not len(row):
        return out
    # Of windows that tie in id and position one row was told; the others have the same words there.
    w_row, w_pos, h, _ = windows_of(bytes_of(batch, text_col), shared.tolist(), window)
    gone = np.zeros(len(w_row), bool)
    new = np.flatnonzero(np.concatenate([[True], w_row[1:] != w_row[:-1]])[: len(w_row)])
    first = dict(zip(w_row[new].tolist(), new.tolist(), strict=True))
    for r, found in out.items():
        if r in first:
            for p, k in found:
                for s, m in zip(p.tolist(), k.tolist(), strict=True):
                    gone[first[r] + s : first[r] + s + m] = True
    mark = (h ^ _mix((version[w_row] << POS_BITS | w_pos).astype(np.uint64))) * np.uint64(ROLL[1])
    told = np.flatnonzero(np.isin(mark, mark[gone]) & ~gone)
    for r in np.unique(w_row[told]).tolist():
        p = w_pos[told[w_row[told] == r]]
        out.setdefault(r, []).append((p, np.ones(len(p), np.int64)))
    return out


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, layout: bool = False) -> DataFrame:
    """df with n_words, n_removed, kept_text (kept words, one space between) and removed (spans of words, from 0).

    With layout, kept_text is the text as it was, from which the removed spans are cut; so lines and indents of the rest
    stay, and a text that loses nothing, or is null, stays as it is.
    One shuffle carries cells of all windows in few bytes each, one the windows that may repeat, one the runs found.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "substrings")
    new = ["n_words", "n_removed", "kept_text", "removed"]
    table, plan = _chunked(df.drop(*new), text_col, scratch)
    docs = table.select("__weft_chunk", "__weft_row", F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hits = scratch.write(repeated_cells(docs, window, plan))
    free_shuffles(spark)
    runs = scratch.write(repeats(docs, hits, window, plan))
    scratch.drop(hits)
    free_shuffles(spark)

    def one(text: bytes | None, runs: list, n_words: int) -> tuple[int, bytes, list[dict]]:
        change = np.zeros(n_words + 1, np.int64)
        for pos, n in runs:
            np.add.at(change, pos, 1)
            np.add.at(change, np.minimum(pos + n + window - 1, n_words), -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        spans = [{"start": s, "n": e - s} for s, e in edge.reshape(-1, 2).tolist()]
        if layout:
            return int(gone.sum()), cut_words(text, [(x["start"], x["start"] + x["n"]) for x in spans]), spans
        kept, at = [], 0
        for words in words_of(text):
            kept += [w for w, g in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not g]
            at += len(words)
        return int(gone.sum()), b" ".join(kept), spans

    kept_columns = [f.name for f in table.schema.fields if not f.name.startswith("__weft_")]

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = left.combine_chunks().to_batches()[0]
        texts = bytes_of(batch, text_col)
        runs = _removed(batch, text_col, pc.cast(batch.column(batch.schema.get_field_index("__weft_id")), pa.int64()).to_pylist(), right, window) if right.num_rows else {}
        out = []
        for i, text in enumerate(texts):
            if i in runs:
                n = sum(map(len, words_of(text)))
                out.append((n, *one(text, runs[i], n)))
            else:
                parts = [(len(w), b"" if layout else b" ".join(w)) for w in words_of(text)]
                out.append((sum(n for n, _ in parts), 0, text if layout else b" ".join(w for n, w in parts if n), []))
        n_words, removed, kept, spans = zip(*out, strict=True)
        made = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))]
        return pa.table([*(batch.column(batch.schema.get_field_index(c)) for c in kept_columns), *made], names=[*kept_columns, *new])

    fields = [*(table.schema[c] for c in kept_columns), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", SPAN)]
    left = table.withColumn("__weft_id", F.col(id_col).cast("long")).groupBy("__weft_chunk")
    return left.cogroup(runs.groupBy(F.col("chunk").alias("__weft_chunk"))).applyInArrow(apply, T.StructType(fields))
