"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent 1- to 3-grams in order; a document goes to the profile from which its
own most frequent n-grams are least out of place.

Defined results: null texts, and texts without a letter, are `und` with score 0; so is every text if nothing was
learned. Equal counts rank by n-gram, equal distances go to the language first by name. Repeated rows count and
are answered as often as they occur. Columns named lang_pred or score are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, texts_of

#: n-grams in a profile.
TOP = 300
#: Characters that are handled at once; only longer single texts take more memory.
CHUNK_CHARS, CHUNK_DOCS = 600_000, 2048
EDGE = 1  # stands for a word's edge in a packed n-gram, below all letters


class Grams:
    """Counts of n-grams over letters and word edges, by owner."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.code = np.zeros(0x110000, np.int32)

    def count(self, texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners, codes (compact, to self.symbols) and counts, ordered by owner and code."""
        low = [t.lower() for t in texts]
        chars = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(owner, [len(t) + 1 for t in low]).astype(np.int64)
        of = np.concatenate([of[:1], of])
        is_letter = self.letter[chars]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] = True
        chars, of, is_letter = chars[keep], of[keep], is_letter[keep]
        present = np.zeros(0x110000, bool)
        present[chars[is_letter]] = True
        self.symbols = np.flatnonzero(present)
        self.code[self.symbols] = np.arange(1, len(self.symbols) + 1)
        k = self.base = len(self.symbols) + 1
        self.size = k + k * k + k * k * k
        c = np.where(is_letter, self.code[chars], 0).astype(np.int64)
        one, two = c[is_letter], k + c[:-1] * k + c[1:]
        middle = is_letter[1:-1]
        three = (k + k * k + (c[:-2] * k + c[1:-1]) * k + c[2:])[middle]
        two_of = np.where(is_letter[:-1], of[:-1], of[1:])
        keys = np.concatenate([of[is_letter] * self.size + one, two_of * self.size + two, of[1:-1][middle] * self.size + three])
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        return keys // self.size, keys % self.size, counts

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Compact codes to n-grams of 21 bits a character, the same in every task."""
        k, real = self.base, np.concatenate([[EDGE], self.symbols]).astype(np.int64)
        one, two = codes < k, codes < k + k * k
        rest = np.where(one, codes, np.where(two, codes - k, codes - k - k * k))
        c, b, a = rest % k, rest // k % k, rest // (k * k)
        return np.where(one, 0, np.where(two, 0, real[a])) << 42 | np.where(one, 0, real[b]) << 21 | real[c]

    def unpack(self, grams: np.ndarray) -> np.ndarray:
        """Packed n-grams to compact codes, -1 where a letter isn't among self.symbols."""
        k = self.base
        digits = [grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]
        known = np.ones(len(grams), bool)
        code = []
        for d in digits:
            at = np.searchsorted(self.symbols, d)
            hit = (at < len(self.symbols)) & (self.symbols[np.minimum(at, len(self.symbols) - 1)] == d) if len(self.symbols) else np.zeros(len(d), bool)
            known &= hit | (d <= EDGE)
            code.append(np.where(hit, at + 1, 0))
        a, b, c = code
        out = np.where(digits[1] == 0, c, np.where(digits[0] == 0, k + b * k + c, k + k * k + (a * k + b) * k + c))
        return np.where(known, out, -1)


def chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of texts with characters, so many at once as the chunk limits allow."""
    at, chars = [], 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            chars += len(t)
            if chars >= CHUNK_CHARS or len(at) >= CHUNK_DOCS:
                yield at
                at, chars = [], 0
    if at:
        yield at


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """Profiles from all rows with a text and a language: packed n-grams by falling count.

    Counts are summed in the tasks before the shuffle. The driver gets `top` n-grams for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, n = Grams(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lang, gram, count = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((gram, lang))
            lang, gram, count = lang[order], gram[order], count[order]
            first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (lang[1:] != lang[:-1])]))
            return lang[first], gram[first], np.add.reduceat(count, first)

        names: list[str] = []
        ids: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            lang, gram, count = merged()
            return pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(lang.astype(np.int32), names).cast(pa.string()), pa.array(gram), pa.array(count)], names=["lang", "gram", "n"])

        for batch in batches:
            texts, langs = texts_of(batch, "text"), texts_of(batch, "lang")
            for x in langs:
                if x not in ids:
                    ids[x] = len(names)
                    names.append(x)
            for at in chunks(texts):
                lang, code, count = grams.count([texts[i] for i in at], np.array([ids[langs[i]] for i in at], np.int64))
                held.append((lang, grams.pack(code), count.astype(np.int64)))
                n += len(code)
                if n > 3_000_000:
                    held[:] = [merged()]
                    n = len(held[0][0])
                    if n > 1_500_000:
                        yield rows()
                        held.clear()
                        n = 0
        if held:
            yield rows()

    trained = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = trained.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


def identify(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """df with lang_pred and score: 1 less the least distance as a share of the largest possible."""
    langs = sorted(profiles)
    gram = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.full((len(gram) + 1, len(langs)), -1, np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(gram, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def make():
        grams = Grams()

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch, text_col)
            pred, score = np.full(len(texts), -1), np.zeros(len(texts))
            for at in chunks(texts) if langs else ():
                of, code, count = grams.count([texts[i] for i in at], np.arange(len(at), dtype=np.int64))
                if not len(of):
                    continue
                most = int(count.max())
                bits, shift = most.bit_length(), grams.size.bit_length()
                if len(at).bit_length() + bits + shift < 63:
                    key = of << (bits + shift) | (most - count) << shift | code
                    key.sort()
                    of, code = key >> (bits + shift), key & ((1 << shift) - 1)
                else:
                    order = np.lexsort((code, -count, of))
                    of, code = of[order], code[order]
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
                keep = rank < top
                of, code, rank = of[keep], code[keep], rank[keep]
                mine = grams.unpack(gram)
                order = np.argsort(mine, kind="stable")
                slot = np.searchsorted(mine[order], code)
                slot = np.where(slot < len(mine), slot, 0)
                slot = np.where(mine[order][slot] == code, order[slot], len(gram))
                theirs = ranks[slot]
                away = np.where(theirs < 0, top, np.abs(theirs - rank[:, None]))
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                total = np.add.reduceat(away, first, axis=0)
                best = total.argmin(axis=1)
                rows = np.array(at)[of[first]]
                pred[rows] = best
                score[rows] = 1 - total[np.arange(len(best)), best] / (top * np.diff(np.append(first, len(of))))
            return [pa.array([langs[p] if p >= 0 else "und" for p in pred], pa.string()), pa.array(score)]

        return run

    return append_columns(df, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
