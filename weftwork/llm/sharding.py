"""Shards by minimax contiguous partition, in DataFrame functions only.

Rows with equal texts are one group that stays whole. Groups stand in the order of a hash of their text, and the
smallest capacity is searched for which a greedy pass over the group sizes needs no more than the given shards; there
the order is cut. The search works on sums of the groups by the first digits of their hash, which are few. They bound
how far each shard of a capacity reaches; only where the bounds differ are sums by more digits asked for, so a handful
of jobs over a narrow table give the exact capacity and the driver never has a list of all groups.

Defined results: a null text has no bytes, and all null texts are one group apart from the empty text; rows that
repeat take a slot each; with fewer groups than shards, some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Digits of the hash by which groups are summed at first, and digits that are added where that is too coarse.
DIGITS, MORE_DIGITS = 3, 2
#: Parts into which each group's rows are dealt.
SALTS = 256


def group_key(text: str):
    """SHA-256 of the text; a byte that no text holds stands for null."""
    return F.coalesce(F.sha2(F.col(text), 256), F.sha2(F.unhex(F.lit("FF")), 256))


def _cells(rows: DataFrame) -> DataFrame:
    """One row for each group and salt in group order: its rows and bytes, rows before it in its bucket, and its group's bytes.

    A bucket has the groups whose hash begins alike, so none is large.
    """
    cells = rows.groupBy(F.substring("key", 1, DIGITS).alias("bucket"), "key", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    inside = Window.partitionBy("bucket").orderBy("key", "salt")
    before = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.when(F.lag("key").over(inside).eqNullSafe(F.col("key")), 0).otherwise(1)
    return cells.withColumns({"before": before, "first": first, "group_bytes": F.sum("bytes").over(Window.partitionBy("bucket", "key"))})


class Sums:
    """Sums of groups by prefixes of their hash, in order; those of one group are exact places to cut."""

    def __init__(self, found: list) -> None:
        self.found = sorted(found)
        self.ends = list(accumulate(f[1] for f in self.found))
        self.total = self.ends[-1]

    def reach(self, to: int) -> tuple[int, int]:
        """Bounds of the last group end at or before a place."""
        if to >= self.total:
            return self.total, self.total
        i = bisect.bisect_right(self.ends, to)
        low = self.ends[i - 1] if i else 0
        return low, low if self.found[i][3] == 1 else to

    def path(self, capacity: int, shards: int, most: bool) -> list[int]:
        """Where shards of a capacity end at least, or at most."""
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at + capacity)[most]
            out.append(at)
        return out

    def least(self, low: int, high: int, shards: int, most: bool) -> int:
        """The least capacity whose shards hold all, going by one of the bounds; high does."""
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.path(middle, shards, most)[-1] == self.total else (middle + 1, high)
        return high

    def coarse(self, low: int, high: int) -> list[int]:
        """Prefixes of several groups that hold a place between."""
        first, last = bisect.bisect_right(self.ends, low), bisect.bisect_right(self.ends, high)
        return [i for i in range(first, min(last, len(self.ends) - 1) + 1) if self.found[i][3] > 1]


def smallest_capacity(cells: DataFrame, shards: int) -> tuple[int, list[tuple[str, int]]]:
    """The least capacity that suffices, and for each shard the hash prefix where it begins and the rows before that."""

    def ask(digits: int, prefixes: list[str]) -> list:
        some = cells.where(F.col("bucket").isin(sorted({p[:DIGITS] for p in prefixes}))) if prefixes else cells
        prefix = F.substring("key", 1, digits)
        if prefixes:
            some = some.where(F.substring("key", 1, digits - MORE_DIGITS).isin(prefixes))
        found = some.groupBy(prefix.alias("p")).agg(F.sum("bytes"), F.sum("n"), F.sum("first"), F.max("group_bytes"))
        return [tuple(r) for r in found.collect()]

    sums = Sums(ask(DIGITS, []))
    low, high = max(max(f[4] for f in sums.found), -(-sums.total // shards)), max(f[4] for f in sums.found) + -(-sums.total // shards)
    while True:
        low, high = sums.least(low, high, shards, True), sums.least(low, high, shards, False)
        least, most = sums.path(low, shards, False), sums.path(high, shards, True)
        wanted = {i for a, b in zip([0, *least], [0, *most], strict=True) for i in sums.coarse(a + low, b + high)}
        if not wanted:
            break
        kept, more = [f for i, f in enumerate(sums.found) if i not in wanted], {}
        for i in wanted:
            more.setdefault(len(sums.found[i][0]), []).append(sums.found[i][0])
        sums = Sums(kept + [f for n, prefixes in more.items() for f in ask(n + MORE_DIGITS, sorted(prefixes))])
    starts, rows = [0, *sums.ends], list(accumulate((f[2] for f in sums.found), initial=0))
    begin = [bisect.bisect_left(starts, e) for e in [0, *least[:-1]]]
    return high, [(sums.found[i][0], rows[i]) for i in begin if i < len(sums.found)]


def minimax_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row. Texts are read once; a narrow table is shuffled."""
    scratch = Scratch(df.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key(text_col).alias("key"))
    rows = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")))
    cells = scratch.write(_cells(rows))
    begins = smallest_capacity(cells, shards)[1] if not cells.isEmpty() else []
    # At most 16 ** DIGITS rows.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    shard = sum((F.when(F.col("key") >= p, 1).otherwise(0) for p, _ in begins[1:]), F.lit(0)).cast("int")
    first = F.element_at(F.array(*(F.lit(n).cast("long") for _, n in begins or [("", 0)])), shard + 1)
    placed = cells.join(F.broadcast(offsets), "bucket").select("key", "salt", shard.alias("shard"), (F.col("offset") + F.col("before") - first).alias("from"))
    order = F.row_number().over(Window.partitionBy("key", "salt").orderBy("id", "row"))
    out = rows.withColumn("order", order).join(placed, ["key", "salt"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("from") + F.col("order") - 1).cast("long").alias("slot"))
