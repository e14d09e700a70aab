"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Every position of a fingerprint has a nonzero vector of radius + 1 bits, and table v keeps the positions whose
vector has an odd product with v. Any `radius` positions leave some v orthogonal to all their vectors, so a pair
within the radius agrees on all that this table keeps: each such pair meets in some table.

Defined results: null, empty and word-free texts have fingerprint zero and link like any other; rows with equal
ids are separate rows with the same id; null ids are ignored in the least id of a component unless all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, broadcast_if_small, bytes_of, components, free_shuffles, slices

BITS = 64
#: A table's bucket with more distinct fingerprints is linked through midpoints, whose number is linear in it.
HOT_BUCKET = 4096
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16


def shingle_hashes(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of so many lower-case words, text after text, and their number in each."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    xxh64 = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        tokens = text.lower().split() if text else []
        if not tokens:
            continue
        flat = b" ".join(tokens)
        if len(tokens) <= words:
            hashes.append(xxh64(flat, 42))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = [0, *ends[:-words].tolist()]
        hashes += [xxh64(flat[s:e], 42) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
        counts[i] = len(tokens) - words + 1
    return np.array(hashes, np.uint64), counts


def majority_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each text from its shingles' hashes."""
    set_bits = np.zeros((len(counts), BITS), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(h), BLOCK):
        own = owner[at : at + BLOCK]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(h[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(set_bits, own[first], np.add.reduceat(bits, first, axis=0, dtype=np.int64))
    on = 2 * set_bits > counts[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(texts: list[bytes | None], words: int) -> np.ndarray:
    return majority_bits(*shingle_hashes(texts, words))


def with_fingerprint(df: DataFrame, text_col: str = "text", words: int = 4) -> DataFrame:
    """df with column fp (long): the fingerprint's bits."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = bytes_of(batch, text_col)
            parts = [fingerprints(texts[i : i + 512], words) for i in range(0, len(texts), 512)]
            return [pa.array(np.concatenate(parts).view(np.int64))]

        return run

    return append_columns(df, [T.StructField("fp", T.LongType())], make)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each nonzero v."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of one bucket, by breadth-first search; never all pairs."""
    left, a, b = fps, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                queue += list(found)
                left = left[~near]
    return a, b


def bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """(hot, a, b) from rows (t, b, fp) sorted by bucket: links, or midpoints of hot buckets with their members.

    Two members of a bucket within the radius differ only where the mask is off, and some point is within half the
    radius of both; a hot bucket makes one row for each member and such point, in proportion to its size.
    """
    masks, half = covering_masks(radius), (radius + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_t, held, hot = None, 0, np.zeros(0, np.uint64), False

        def flips(t: int) -> np.ndarray:
            free = [i for i in range(BITS) if not masks[t] >> i & 1]
            return np.array([sum(1 << i for i in c) for n in range(half + 1) for c in combinations(free, n)], np.uint64)

        def out(hot: bool, a, b) -> pa.RecordBatch:
            a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(a), pa.array(b)], names=["hot", "a", "b"])

        def midpoints() -> Iterator[pa.RecordBatch]:
            f = flips(held_t)
            for i in range(0, len(held), 64):
                part = held[i : i + 64]
                yield out(True, (part[:, None] ^ f).ravel(), np.repeat(part, len(f)))

        def close() -> Iterator[pa.RecordBatch]:
            if hot:
                yield from midpoints()
            elif len(held) > 1:
                yield out(False, *_forest(held, radius))

        for batch in batches:
            b = batch.column(0).to_numpy()
            t = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy().view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            ends = np.append(first[1:], len(b))
            # All runs but the first and the last lie within this batch: pairs at once, larger ones each.
            sizes = ends - first
            inner = np.arange(len(first))[1:-1]
            two = first[inner[sizes[inner] == 2]]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            la, lb = [fp[near]], [fp[near + 1]]
            more = [i for i in inner[sizes[inner] > 2]]
            for i in [0, *more, *([len(first) - 1] if len(first) > 1 else [])]:
                key, part = b[first[i]], fp[first[i] : ends[i]]
                if key != held_b:
                    yield from close()
                    held_b, held_t, held, hot = key, int(t[first[i]]), np.zeros(0, np.uint64), False
                held = np.concatenate([held, part])
                if len(held) > HOT_BUCKET:
                    hot = True
                    yield from midpoints()
                    held = held[:0]
            if len(near):
                yield out(False, np.concatenate(la), np.concatenate(lb))
        yield from close()

    return buckets.mapInArrow(run, "hot boolean, a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for each row: the least id that links of `radius` bits or fewer reach.

    Exact copies share a fingerprint, so only distinct ones enter the tables; the texts are read once and never
    shuffled.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    docs = scratch.write(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", words).select("id", "fp"))
    distinct = docs.groupBy("fp").agg(F.min("id").alias("least"))
    tables = F.explode(F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("b")) for i, m in enumerate(covering_masks(radius)))))
    buckets = distinct.select("fp", tables.alias("x")).select("x.b", "x.t", "fp").repartition("b").sortWithinPartitions("b", "fp")
    links = scratch.write(bucket_links(buckets, radius))
    middle = links.where("hot").select("a", "b")
    stars = middle.join(middle.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < x").select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    roots = components(spark, links.where("not hot").select("a", "b").unionAll(stars))
    rooted = scratch.write(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Written, so that the join sees two plain shuffles and may split a component that has a large share of all.
    least = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of = scratch.write(rooted.join(least, "root").select("fp", "component_id"))
    return docs.join(of, "fp").select("id", "fp", "component_id")


#: Of pairs at the least similarity, the share that may meet in no table; bits in which they differ, of all.
MISSED, DIFFER = 1.5e-4, 0.152
#: A block's bits at least, and rows to a bucket of unlike texts from which blocks get wider.
BLOCK_BITS, MET = 27, 256
#: The majority of so few hashes strays from its mean: such sets have twice the blocks.
FEW = 40
#: Bits of 128 in which members of a bucket may differ; from so many members on they aren't compared by these.
NEAR_BITS, CROWD = 40, 1024
#: Bits of a set's sketch at least; members of a bucket, and bytes of their sketches, that one task compares.
SKETCH_BITS, BUCKET_ROWS, BUCKET_BYTES = 1024, 4096, 32 << 20
#: Pairs of a node that are verified one by one, and its buckets that look for them at first.
PAIRS, LOOKS = 2, 4


def shingle_sets(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    return [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])] if len(counts) else []


def blocks_of(rows: int) -> tuple[int, int]:
    """Bits of a block and 64-bit words of a wide fingerprint for so many rows.

    A block's three masks keep two thirds of its bits each, so a pair with at most one differing bit in some block meets
    for certain, and in a block at all with the probability below. The blocks are as many as MISSED asks for.
    """
    bits = min(48, max(BLOCK_BITS, math.ceil(1.5 * math.log2(max(rows, 1) / MET + 1))))
    kept = [m.bit_count() for m in covering_masks(1, bits)]
    meets = sum((1 - DIFFER) ** k for k in kept) - 2 * (1 - DIFFER) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - meets) / (64 // bits))


def majority_words(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits that over half of a row's n words have; what fills the row is zero. Adds 64 bits at once, plane by plane."""
    planes = [x]
    while planes[0].shape[1] > 1:
        if planes[0].shape[1] % 2:
            planes = [np.concatenate([p, np.zeros((len(p), 1), np.uint64)], axis=1) for p in planes]
        half, carry, sums = planes[0].shape[1] // 2, None, []
        for p in planes:
            a, b = p[:, :half], p[:, half:]
            odd, both = a ^ b, a & b
            sums.append(odd if carry is None else odd ^ carry)
            carry = both if carry is None else both | odd & carry
        planes = [*sums, carry]
    more, same = np.zeros(len(x), np.uint64), np.full(len(x), ~np.uint64(0))
    for k in reversed(range(len(planes))):
        p, limit = planes[k][:, 0], np.where(n // 2 >> k & 1, ~np.uint64(0), np.uint64(0))
        more |= same & p & ~limit
        same &= ~(p ^ limit)
    return more


def wide_fingerprints(sets: list[np.ndarray], words: int) -> list[bytes]:
    """SimHash of each set in so many words of 64 bits, twice as many for small sets; each word has its own hash."""
    odd = np.random.default_rng(11).integers(0, 1 << 63, 2 * words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = np.array([len(s) for s in sets], np.int64)
    by, out, at = np.argsort(size, kind="stable"), [b""] * len(sets), 0
    while at < len(by):
        # Sets of about one size, filled up with zeros, which stay zero below.
        least = size[by[at]]
        most = FEW if least <= FEW else least + least // 8
        end = min(int(np.searchsorted(size[by], most, "right")), at + max(1, (1 << 17) // max(1, int(least))))
        some, width = by[at:end], words * (1 + (least <= FEW))
        x = np.zeros((len(some), max(1, size[some[-1]])), np.uint64)
        x[np.arange(x.shape[1]) < size[some, None]] = np.concatenate([sets[i] for i in some])
        x ^= x >> np.uint64(31)
        made = np.empty((len(some), width), np.uint64)
        # Words of few hashes are made together, as each call of numpy has its own cost.
        step = max(1, (1 << 17) // x.size)
        for k in range(0, width, step):
            y = (odd[k : min(k + step, width), None, None] * x).reshape(-1, x.shape[1])
            y ^= y >> np.uint64(32)
            made[:, k : k + step] = majority_words(y, np.tile(size[some], len(y) // len(x))).reshape(-1, len(x)).T
        for i, w in zip(some.tolist(), made, strict=True):
            out[i] = w.tobytes()
        at = end
    return out


def in_tables(points: DataFrame, bits: int) -> DataFrame:
    """(b, f1, f2) from rows (f1, f2, wide): a row for each block and mask, b being the table and the bits that it keeps."""
    masks, places = np.array(covering_masks(1, bits), np.uint64), 64 // bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f1, f2, wide = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            width = np.array([len(w) for w in wide])
            for n in np.unique(width):
                some = np.flatnonzero(width == n)
                words = np.frombuffer(b"".join(wide[i] for i in some), np.uint64).reshape(len(some), -1, 1)
                blocks = (words >> (np.arange(places, dtype=np.uint64) * np.uint64(bits))).reshape(len(some), -1, 1)
                tables = np.arange(blocks.shape[1] * len(masks), dtype=np.uint64).reshape(-1, len(masks))
                b = (blocks & masks) | tables << np.uint64(48)
                yield pa.RecordBatch.from_arrays([pa.array(b.ravel().view(np.int64)), *(pa.array(np.repeat(f[some], tables.size)) for f in (f1, f2))], names=["b", "f1", "f2"])

    return points.mapInArrow(run, "b long, f1 long, f2 long")


def near_in_buckets(buckets: DataFrame) -> DataFrame:
    """Of rows (b, f1, f2) sorted by bucket, those that have another within NEAR_BITS in their bucket.

    Equal groups of many tables get one b. Buckets of a crowd stay whole, to be compared in blocks.
    """

    def close(b: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        crowd = np.repeat(*(lambda n: (n > CROWD, n))(np.diff(np.append(first, len(b)))))
        near, at, step = crowd.copy(), np.flatnonzero(~crowd), 1
        while len(at):
            at = at[at + step < len(b)]
            at = at[b[at + step] == b[at]]
            ok = at[np.bitwise_count(f1[at] ^ f1[at + step]) + np.bitwise_count(f2[at] ^ f2[at + step]) <= NEAR_BITS]
            near[ok] = near[ok + step] = True
            step += 1
        b, f1, f2, crowd = (x[near] for x in (b, f1, f2, crowd))
        if len(b):
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            x = (f1 ^ f2 >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) ^ f2
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xD1342543DE82EF95)
            group = np.repeat(np.add.reduceat(x ^ x >> np.uint64(29), first), np.diff(np.append(first, len(b))))
            b = np.where(crowd, b, group)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (b, f1, f2)], names=["b", "f1", "f2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = tuple(np.zeros(0, np.uint64) for _ in range(3)), None
        for batch in batches:
            rows = tuple(c.to_numpy().view(np.uint64) for c in batch.columns)
            if hot is not None and len(rows[0]):
                n = int(np.argmax(rows[0] != hot)) if rows[0][-1] != hot else len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(x[:n].view(np.int64)) for x in rows], names=["b", "f1", "f2"])
                rows = tuple(x[n:] for x in rows)
                hot = hot if not len(rows[0]) else None
            if not len(rows[0]):
                continue
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            # The last bucket may go on in the next batch.
            last = len(rows[0]) - int(np.argmax(rows[0][::-1] != rows[0][-1])) if rows[0][0] != rows[0][-1] else 0
            if len(rows[0]) - last > CROWD:
                hot, last = rows[0][-1], len(rows[0])
            yield close(*(x[:last] for x in rows))
            held = tuple(x[last:] for x in rows)
        yield close(*held)

    return buckets.mapInArrow(run, "b long, f1 long, f2 long")


def sketch_bits(n: int) -> int:
    """A power of two that is no less than the number of hashes, so that a sketch tells long sets apart as well as short ones."""
    return max(SKETCH_BITS, 1 << max(0, n - 1).bit_length())


def odd_sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parities of the number of hashes in each of a set's cells: two sketches of one width differ in no more bits than the sets in hashes.

    The halves of a sketch combine to that of half the width.
    """
    out = []
    for s in sets:
        bits = sketch_bits(len(s))
        cell = (s * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32) & np.uint64(bits - 1)
        out.append(np.packbits((np.bincount(cell.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def halved(sketches: np.ndarray) -> np.ndarray:
    """Sketches, one a row, at half their width."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def row_key(df: DataFrame) -> list:
    """128 bits of a row's values as two columns: the same in each run, and shared by equal rows alone."""
    nulls = F.concat(*(F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns))
    return [F.xxhash64(F.lit(i), nulls, *(F.col(f"`{c}`") for c in df.columns)).alias(f"__weft_k{i}") for i in (1, 2)]


def _jaccard_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, shingles) have at least this Jaccard similarity."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sa, sb = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (sa, sb))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _packed(rows: list[tuple]) -> dict[int, tuple]:
    """Rows (node, n, root, sketch, ...) by the width of their sketches: places in the list, sizes, roots, sketches, and these at half the width."""
    by_width: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_width.setdefault(len(r[3]), []).append(i)
    made = {}
    for w, places in by_width.items():
        sketch = np.array([np.frombuffer(rows[i][3], np.uint64) for i in places])
        made[w] = (np.array(places), *(np.array([rows[i][k] for i in places]) for k in (1, 2)), sketch, halved(sketch) if w > SKETCH_BITS // 8 else None)
    return made


def _not_ruled_out(made: dict[int, tuple], size: int, of: int, bits: bytes, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of packed rows of other roots that may be similar to a set of this size, root and sketch, and bits that differ.

    Sets with this similarity differ in few hashes, so their sketches differ in as few bits at most.
    """
    own = np.frombuffer(bits, np.uint64)
    met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    # Sets of less than half the hashes, whose sketches are narrower still, can't be similar.
    for w, a, narrow in ((len(bits), own, False), (2 * len(bits), own, True), (len(bits) // 2, halved(own), False)):
        if w in made:
            place, n, root, sketch, half = made[w]
            differ = np.bitwise_count((half if narrow else sketch) ^ a).sum(axis=1).astype(np.int64)
            # Sets of sizes x and y with similarity s differ in (1 - s) / (1 + s) * (x + y) hashes.
            ok = np.flatnonzero((differ * (1 + least) <= (1 - least) * (n + size) + 1e-6) & (np.minimum(n, size) >= least * np.maximum(n, size)) & (root != of))
            met.append((place[ok], differ[ok]))
    return tuple(np.concatenate(x) for x in zip(*met, strict=True))


def _across(blocks: DataFrame, least: float, most: int) -> DataFrame:
    """(node, a, b, cut) from rows (b, salt, node, n, root, sketch, other, mine) by block: pairs of different roots that may be similar.

    Each row marked as other is compared with its block's own rows, and gives the `most` nearest pairs, so their number
    is in proportion to the rows; cut says that the node has more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, others = None, [], []

        def close() -> pa.RecordBatch:
            out, made = [], _packed(mine) if others else {}
            for other, size, of, bits in others if made else ():
                place, differ = _not_ruled_out(made, size, of, bits, least)
                node = np.array([mine[i][0] for i in place.tolist()], np.int64)
                near = np.lexsort((node, differ))[:most]
                out += [(other, x, d, len(node) > most) for x, d in zip(node[near].tolist(), differ[near].tolist(), strict=True)]
            node, near, differ, more = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64()), pa.array(differ, pa.int64()), pa.array(more, pa.bool_())], names=["node", "near", "differ", "more"])

        for batch in slices(batches):
            for bucket, salt, node, n, root, sketch, other, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, salt) != key:
                    yield close()
                    key, mine, others = (bucket, salt), [], []
                row = (node, n, root, sketch)
                if own:
                    mine.append(row)
                if other:
                    others.append(row)
        yield close()

    # A node meets the same one in several buckets; of what all its buckets and blocks give, the nearest go on.
    met = blocks.mapInArrow(run, "node long, near long, differ long, more boolean").groupBy("node", "near").agg(F.min("differ").alias("differ"), F.max("more").alias("more"))
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("differ", "near")))
    cut = F.max(F.col("more") | (F.col("rank") > most)).over(Window.partitionBy("node")).alias("cut")
    return met.select("node", F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b"), "rank", cut).where(F.col("rank") <= most).drop("rank")


def _near_rows(blocks: DataFrame, least: float) -> DataFrame:
    """Of rows (b, salt, node, n, root, sketch, other, mine) by block, those that sketches do not tell apart from all that they are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> pa.RecordBatch:
            own = [i for i, r in enumerate(rows) if r[7]]
            made, near = _packed([rows[i][2:6] for i in own]), np.zeros(len(rows), bool)
            for i, (_, _, _, n, root, sketch, other, _) in enumerate(rows):
                if other and own:
                    place = _not_ruled_out(made, n, root, sketch, least)[0]
                    near[np.array(own)[place]] = True
                    near[i] |= len(place) > 0
            kept = [rows[i] for i in np.flatnonzero(near)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], t) for k, t in enumerate(types)], names=names)

        for batch in slices(batches):
            names, types = batch.schema.names, batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if rows:
                        yield close()
                    key, rows = row[:2], []
                rows.append(row)
        if rows:
            yield close()

    return blocks.mapInArrow(run, blocks.schema)


def _linked_in_blocks(blocks: DataFrame, least: float) -> DataFrame:
    """(a, b) from rows (b, salt, node, n, root, sketch, other, mine, shingles) by block, own rows first: links that join its roots.

    Whole sets are compared here, so a pair that sketches do not tell from a similar one makes no row, and a block makes
    fewer links than it has roots. A task holds the own rows of one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, made, up, out = None, [], None, {}, []

        def top(root: int) -> int:
            while (over := up.get(root, root)) != root:
                up[root] = root = up.get(over, over)
            return root

        def compare(row: tuple) -> None:
            node, n, root, sketch, _, shingles = row
            place, differ = _not_ruled_out(made, n, root, sketch, least)
            for i in place[np.argsort(differ, kind="stable")].tolist():
                near, size, of, _, _, theirs = mine[i]
                if top(of) != top(root):
                    common = len(np.intersect1d(np.frombuffer(shingles, np.uint64), np.frombuffer(theirs, np.uint64), assume_unique=True))
                    if common >= least * (n + size - common):
                        up[top(of)] = top(root)
                        out.append((min(node, near), max(node, near)))

        def close() -> None:
            """All own rows are there."""
            nonlocal made
            if made is None:
                made = _packed(mine)
                for row in mine:
                    if row[4]:
                        compare(row)

        def links() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in slices(batches, 64):
            for bucket, salt, node, n, root, sketch, other, own, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, salt) != key:
                    close()
                    key, mine, made, up = (bucket, salt), [], None, {}
                row = (node, n, root, sketch, other, shingles)
                if own:
                    mine.append(row)
                else:
                    close()
                    compare(row)
            yield links()
        close()
        yield links()

    return blocks.mapInArrow(run, "a long, b long").distinct()


def _joined_roots(spark, roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) when new links are added to components: only their roots take part, most of which no link touches."""
    between = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
    between = between.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
    now = components(spark, between).distinct().select(F.col("node").alias("root"), F.col("root").alias("now"))
    moved = roots.join(now, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return moved.unionAll(now.select(F.col("root").alias("node"), F.col("now").alias("root"))).distinct()


def keep_one_of_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of texts whose sets of shingles have a Jaccard similarity of `least` or more.

    The row with the least (id, nulls last; shingle set; row) stays. Equal sets are one node. Candidates are nodes
    whose SimHash fingerprints are near. At 0.8 about 15 % of the bits differ, so fingerprints are of many words, and blocks
    of their bits have covering masks each; members of a bucket count as near if 128 bits tell so. First each node is
    verified with the first of some of its buckets. Then every pair of a bucket whose roots still differ is compared by sketches
    that rule out no similar pair and are as wide as the sets are large, so that few unlike pairs pass at any length;
    of those that do, the nearest of each node are verified. Copies of one text share most of their tables, so at first a
    node looks in its largest buckets alone, twice, and in all of them once these have joined the copies. Nodes that still
    have more near ones than were verified are compared on the whole sets within the blocks, which give links alone: no
    step makes pairs by the square of a group. Every link is verified on the whole sets; only candidates' texts are read for that.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    keyed = df.select("*", *row_key(df))
    key = ["__weft_k1", "__weft_k2"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*shingle_hashes(bytes_of(batch, "text"), words))
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            wide = wide_fingerprints(sets, width)
            f1, f2 = (pa.array(np.array([np.frombuffer(w, np.int64, 2)[k] for w in wide], np.int64)) for k in (0, 1))
            sketches = pa.array(odd_sketches(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.array(nodes, np.uint64).view(np.int64)), f1, f2, pa.array([len(s) for s in sets], pa.int64()), pa.array(wide, pa.binary()), sketches], names=["id", *key, "node", "f1", "f2", "n", "wide", "sketch"])

    bits, width = blocks_of(df.count())
    kind = df.schema[id_col].dataType.simpleString()
    columns = keyed.select(F.col(id_col).alias("id"), *key, F.col(text_col).alias("text"))
    rows = scratch.write(columns.mapInArrow(mark, f"id {kind}, __weft_k1 long, __weft_k2 long, node long, f1 long, f2 long, n long, wide binary, sketch binary"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", *key)).alias("best")
    nodes = scratch.write(rows.groupBy("node").agg(best, *(F.min(c).alias(c) for c in ("f1", "f2", "n", "wide", "sketch"))))
    tables = in_tables(nodes.select("f1", "f2", "wide"), bits).repartition("b").sortWithinPartitions("b")
    met = scratch.write(near_in_buckets(tables).distinct())
    # The tables' shuffle is the largest by far.
    free_shuffles(spark)
    buckets = scratch.write(met.join(nodes.select("node", "n", "f1", "f2"), ["f1", "f2"]).select("b", "node", "n", "f1"))
    first = buckets.groupBy("b").agg(F.count("*").alias("size"), F.sum(F.greatest("n", F.lit(SKETCH_BITS)) / 4).alias("bytes"), F.sum("n").alias("hashes"), F.min(F.struct("f1", "node", "n")).alias("first")).where("size > 1")
    first = broadcast_if_small(scratch.write(first))
    buckets = scratch.write(buckets.join(first, "b"))
    ratio = F.least("n", "first.n") >= least * F.greatest("n", "first.n")
    stars = buckets.where((F.col("node") != F.col("first.node")) & ratio).select("node", "first").distinct()
    stars = stars.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("first"))).where(F.col("rank") <= PAIRS)
    stars = scratch.write(stars.select(F.least("first.node", "node").alias("a"), F.greatest("first.node", "node").alias("b")).distinct())

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*shingle_hashes(bytes_of(batch, "text"), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    wanted = scratch.write(buckets.select("node").distinct().join(nodes.select("node", "best"), "node").select("node", "best.__weft_k1", "best.__weft_k2"))
    texts = keyed.select(*key, F.col(text_col).alias("text")).join(broadcast_if_small(wanted), key).select("node", "text")
    sets = scratch.write(texts.mapInArrow(sets_of, "node long, shingles binary").dropDuplicates(["node"]))
    links = scratch.write(_jaccard_links(stars, sets, least))
    roots = scratch.write(components(spark, links).distinct())

    def blocks(looks: int | None = None, cut: DataFrame | None = None, whole: bool = False) -> DataFrame:
        """Rows of buckets with several roots, by block: those to be compared go to all blocks of a bucket, each also to its own.

        Compared are the rows of other roots than the main one, up to so many of a node and without those that were cut; or, on
        whole sets, only these, as a node that was cut may have joined a main root since.
        """
        rooted = scratch.write(buckets.select("b", "node", "n", "size", "bytes", "hashes").join(roots, "node", "left").select("b", "node", "n", "size", "bytes", "hashes", F.coalesce("root", "node").alias("root")))
        # Buckets of one component go here. Of the others, the root with the most members is dealt to blocks, the rest to all.
        main = rooted.groupBy("b", "root").agg(F.count("*").alias("n")).groupBy("b").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("b", "main.root")
        main = scratch.write(main.withColumnRenamed("root", "main"))
        number = F.greatest(F.ceil(F.col("size") / BUCKET_ROWS), F.ceil((F.col("hashes") * 8 if whole else F.col("bytes")) / BUCKET_BYTES)).cast("int")
        out = rooted.join(broadcast_if_small(main), "b").withColumns({"own": F.pmod(F.xxhash64("node"), number).cast("int"), "other": F.col("root") != F.col("main")})
        if cut:
            was_cut = F.col("cut").isNotNull()
            out = out.join(broadcast_if_small(cut), "node", "left").withColumn("other", was_cut if whole else F.col("other") & ~was_cut)
        if looks:
            rank = F.row_number().over(Window.partitionBy("node", "other").orderBy(F.desc("size"), "b"))
            out = out.withColumn("other", F.col("other") & (rank <= looks))
        if cut or looks:
            out = scratch.write(out)
            out = out.join(broadcast_if_small(scratch.write(out.where("other").select("b").distinct())), "b", "left_semi")
        out = out.withColumn("salt", F.explode(F.when(F.col("other"), F.sequence(F.lit(0), number - 1)).otherwise(F.array("own"))))
        return out.join(nodes.select("node", "sketch"), "node").select("b", "salt", "node", "n", "root", "sketch", "other", (F.col("salt") == F.col("own")).alias("mine"))

    verified, cut = stars, None
    for look, looks in enumerate((LOOKS, LOOKS, None)):
        found = scratch.write(_across(blocks(looks, cut).repartition("b", "salt").sortWithinPartitions("b", "salt"), least, PAIRS))
        new = scratch.write(found.select("a", "b").distinct().join(verified, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            roots = scratch.write(_joined_roots(spark, roots, scratch.write(_jaccard_links(new, sets, least))))
            verified = verified.unionAll(new)
        # What the first look cuts has mostly joined a component by now; what a later one cuts stays apart from near ones.
        if look:
            more = found.where("cut").select("node", "cut").distinct()
            cut = scratch.write(cut.unionAll(more) if cut else more)
    if not cut.isEmpty():
        # Only the rows that sketches leave take their sets along.
        some = scratch.write(_near_rows(blocks(cut=cut, whole=True).repartition("b", "salt").sortWithinPartitions("b", "salt"), least))
        free_shuffles(spark)
        some = some.join(sets, "node").select("b", "salt", "node", "n", "root", "sketch", "other", "mine", "shingles")
        links = scratch.write(_linked_in_blocks(some.repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("mine")), least))
        roots = scratch.write(_joined_roots(spark, roots, links))
    rooted = scratch.write(nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best"))
    kept = scratch.write(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.__weft_k1", "best.__weft_k2"))
    # Equal rows have one key, by which the join has dealt them out.
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(df.columns)


def fingerprint_hex(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
