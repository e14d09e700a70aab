"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import math
import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.compute as pc
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from weftwork.llm import decontam, langid, lm, quality, registry, sentencepiece_scan, sharding, simhash, substring_dedup
from weftwork.llm.common import Scratch, components, crc_of_id

MODEL = registry.MODEL_FILE


def docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def mixed(seed=3, n=60):
    rng = random.Random(seed)
    passage = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(3)]
    rows = []
    for _ in range(n):
        rows.append((rng.choice([None, *range(15)]), rng.choice([None, "", " \n", "a b", *passage, passage[0] + " x " + passage[1], " ".join(rng.choice("xyz") for _ in range(5000)), "q " * 9000])))
    return rows + rows[:20]


# op4


def brute_dedup(rows, window=20, flags=None):
    """flags, a list, gets which words of each row go."""
    key = lambda i: (i is not None, i or 0)
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            x = tuple(w[j : j + window])
            first[x] = min(first.get(x, ((9, 0), 0)), (key(i), j))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (key(i), j):
                gone[j : j + window] = [True] * window
        if flags is not None:
            flags.append(gone)
        yield i, t, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode()


@pytest.mark.parametrize("cells", [22, 10])
def test_substring_dedup(spark, monkeypatch, cells):
    monkeypatch.setattr(substring_dedup, "CELLS", cells)
    rows = mixed()
    got = substring_dedup.dedup_substrings(docs(spark, rows)).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_dedup(rows)))


@pytest.mark.parametrize("parts", [1, 5])
def test_substring_dedup_of_rows_that_share_an_id(spark, monkeypatch, parts):
    run = lambda k, n: " ".join(f"{k}{j}" for j in range(n))
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 5000)
    rng = random.Random(2)
    # Versions of one id that share a part of a passage: the start of the third row is innocent but for that part.
    rows = [(1, run("p", 40)), (5, run("p", 40) + " " + run("x", 30)), (5, run("p", 20) + " " + run("y", 30))]
    rows += [(None, run("h", 30) + " " + run(f"u{rng.randrange(300)}_", rng.randrange(30)) + " " + run("t", rng.randrange(15, 40))) for _ in range(1000)]
    rows += [(None, run("h", 50)), (3, run("h", 50))] * 3
    got = substring_dedup.dedup_substrings(docs(spark, rows, parts)).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_dedup(rows)))


def test_few_unrepeated_windows_pass_the_sketch_at_any_size(spark, monkeypatch):
    share = []
    for n in (40, 160):
        rng = random.Random(n)
        df = docs(spark, [(i, " ".join(f"w{rng.randrange(1 << 30)}" for _ in range(300))) for i in range(n)])
        monkeypatch.setattr(substring_dedup, "CELLS", 14)
        monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 40_000)
        table, plan = substring_dedup._chunked(df, "text", substring_dedup.Scratch(spark, "test"))
        d = table.select("__weft_chunk", "__weft_row", F.col("doc_id").alias("id"), "text")
        passed = substring_dedup.repeats(d, substring_dedup.repeated_cells(d, 20, plan), 20, plan)
        assert passed.count() == 0
        hits = substring_dedup.repeated_cells(d, 20, plan).toArrow()
        h = [substring_dedup.windows_of([r.text.encode()], [0], 20)[2] for r in table.where("__weft_chunk = 0").orderBy("__weft_row").collect()]
        share.append(substring_dedup._hit(np.concatenate(h), hits.filter(pc.equal(hits.column("chunk"), 0)), plan).mean())
    assert share[1] < 0.15 and abs(share[0] - share[1]) < 0.05


def test_substring_dedup_long_runs_and_other_columns(spark):
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(12_000))
    df = spark.createDataFrame([(1, long, "a", 5), (2, long + " end", "b", 6)], "doc_id long, text string, kept_text string, n_words int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text, [(s.start, s.n) for s in r.removed]) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == {1: (12_000, 0, long, []), 2: (12_001, 12_000, "end", [(0, 12_000)])}
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_rows_of_the_sketches_grow_with_the_input(spark, monkeypatch):
    """Beyond SCALE_BYTES a chunk still makes a row for each range, but there are fewer of both than in proportion."""
    for name, value in (("CHUNK_BYTES", 4000), ("RANGE_BYTES", 4000), ("SCALE_BYTES", 20_000), ("BUCKET_BYTES", 1000), ("MAX_BUCKETS", 9), ("CELLS", 12)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = []
    for n in (20, 80, 320):
        rng = random.Random(n)
        texts = [(i, " ".join(f"w{rng.randrange(1 << 30)}" for _ in range(100))) for i in range(n)]
        table, plan = substring_dedup._chunked(docs(spark, texts, 2), "text", substring_dedup.Scratch(spark, "test"))
        chunks = table.select("__weft_chunk").distinct().count()
        rows.append(chunks * plan.ranges)
        assert table.groupBy("__weft_chunk").agg(F.sum(F.length("text") + 64).alias("n")).agg(F.max("n")).first()[0] <= plan.chunk
        got = substring_dedup.dedup_substrings(docs(spark, texts + [(n, texts[0][1])], 2)).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_dedup(texts + [(n, texts[0][1])])))
    assert rows[2] < 6 * rows[1] < 36 * rows[0] and rows[2] > rows[1]


def test_a_text_of_too_many_words_is_refused(monkeypatch):
    monkeypatch.setattr(substring_dedup, "POS_BITS", 6)
    with pytest.raises(ValueError, match="65 words"):
        substring_dedup.windows_of([b"w " * 63, b"w " * 65], [0, 1], 20)


def test_layout_of_what_stays(spark):
    twice = " ".join(f"p{j}" for j in range(25))
    rows = [(1, f"\tdef f():\n\n    {twice}\n  end"), (2, f"  first\n\n{twice}\n\n\tlast  line\n"), (3, twice), (4, " no\nrepeat "), (5, f"{twice}\n\nx {twice}\n"), (6, None), (7, "")]
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in substring_dedup.dedup_substrings(docs(spark, rows), layout=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("  first\n\n\tlast  line\n", 25), 3: ("", 25), 4: (" no\nrepeat ", 0), 5: ("x\n", 50), 6: (None, 0), 7: ("", 0)}


# op8


def brute_fingerprint(text, n):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(spark):
    rng = random.Random(1)
    base = [[f"t{rng.randrange(500)}" for _ in range(120)] for _ in range(6)]
    rows = [(None, None), (None, "Only"), (3, ""), (4, "one two"), (4, "one two"), (5, "ONE two three four"), (6, "z " * 4000)]
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "new"
        rows.append((10 + i, " ".join(w)))
    got = simhash.near_duplicates(docs(spark, rows).select("doc_id", "text"), words=4, radius=4).collect()
    fps = np.array([brute_fingerprint(t, 4) for _, t in rows], np.uint64)
    want = [(i, int(f), c) for i, f, c in zip([i for i, _ in rows], fps, brute_components([i for i, _ in rows], fps, 4), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r.id, r.fp % (1 << 64), r.component_id)) for r in got)


def test_covering_masks_miss_no_pair():
    rng, masks = random.Random(2), simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(20_000):
        differ = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not differ & m for m in masks)


def test_hot_buckets_link_through_midpoints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_BUCKET", 5)
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(120)})
    monkeypatch.setattr(simhash, "with_fingerprint", lambda df, *_: df.select("id", F.col("text").cast("long").alias("fp")))
    rows = [(i, str(f - (1 << 64) if f >> 63 else f)) for i, f in enumerate(fps)]
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert list(got[i] for i in range(len(fps))) == brute_components(list(range(len(fps))), np.array(fps, np.uint64), 4)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


# op5


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_the_least_distance():
    rng = random.Random(5)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 60))
        d = distance(p, t)
        assert decontam.myers(p, t, len(p))[0] == d


def test_decontamination(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(12)) for _ in range(8)]
    rows = [(None, None), (1, ""), (2, items[0].upper().replace(" ", ",\n"))]
    for i in range(60):
        t = list(rng.choice(items))
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice(["x", "", "zz"])
        rows.append((10 + i, " ".join(word() for _ in range(30)) + " " + "".join(t) + " " + " ".join(word() for _ in range(20))))
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "short")], "item_id long, text string")
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = {i: {n for n, x in enumerate(items) if distance(plain(x), plain(t)) <= int(0.07 * len(plain(x)))} for i, t in rows}
    for block in (decontam.BLOCK_CHARS, 100):
        monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
        got = decontam.find_contamination(docs(spark, rows), bench).collect()
        assert {r.doc_id: {m.item_id for m in r.matches} for r in got} == want
        assert all(m.start < m.end for r in got for m in r.matches)
    assert any(len(x) for x in want.values())


def test_many_blocks_write_the_rows_once(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(9)] + [(50, "the end"), (None, "no id of its own but many words")]
    rows = [(i, " ".join([word(), items[i % 9][1], word(), items[(i * 5) % 9][1], "the end", items[10][1] if i % 7 == 0 else word()])) for i in range(60)]
    rows += [(None, None), (7, ""), (7, "the end"), (8, "nothing")] + rows[:3]
    df, bench = docs(spark, rows).withColumn("matches", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    one = decontam.find_contamination(df, bench).collect()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    assert len(list(decontam._blocks(bench, "item_id", "text"))) >= 3
    written = []
    monkeypatch.setattr(decontam, "Scratch", lambda *a: written.append(Scratch(*a)) or written[-1])
    many = decontam.find_contamination(df, bench).collect()
    assert sorted(map(repr, many)) == sorted(map(repr, one)) and any(len(r.matches) > 2 for r in one) and any(r.short_matches for r in one)
    # The texts, and their normal forms, stand in one table, whatever the number of blocks; the rest are matches.
    root = Path(written[0].root.removeprefix("file://"))
    assert written[0].n == 1 and sorted(p.name for p in root.iterdir()) == ["1", "found"]
    assert not {"text", "__weft_normal"} & set(spark.read.parquet(f"{written[0].root}/found").columns)


def test_short_items_are_reported_apart(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "a b!"), (3, "?"), (None, "x"), (4, "漢字")], "item_id long, text string")
    rows = [(1, "In paris, A: B"), (2, "Parisian a bc"), (3, "x"), (4, "漢字 x 漢字"), (5, None)]
    got = {r.doc_id: (r.matches, [(m.item_id, m.start, m.end) for m in r.short_matches]) for r in decontam.find_contamination(docs(spark, rows), bench).collect()}
    assert got == {1: ([], [(1, 3, 8), (2, 9, 12)]), 2: ([], []), 3: ([], [(None, 0, 1)]), 4: ([], [(4, 0, 2), (None, 3, 4), (4, 5, 7)]), 5: ([], [])}


# op7


def test_pieces_round_trip_and_chunks(spark, monkeypatch):
    rng = random.Random(7)
    texts = [None, "", " ", "  a  b ", "▁ x\n", "😀é\u0000z", "the " * 3000, "thetion" * 3000, " " * 5000, "".join(rng.choice("the tion\né☃") for _ in range(9000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "  a  b ")]
    monkeypatch.setattr(sentencepiece_scan, "CHUNK_CHARS", 500)
    monkeypatch.setattr(sentencepiece_scan, "GROUP", 3)
    whole = sentencepiece_scan.encode(docs(spark, rows), MODEL, giant_chars=1 << 30)
    cut = sentencepiece_scan.decode(sentencepiece_scan.encode(docs(spark, rows), MODEL, giant_chars=600), MODEL)
    a, got = {r.doc_id: r.ids for r in whole.collect()}, cut.collect()
    # Periodic texts without a cut have many best paths, of which both take the same.
    assert all(r.ids == a[r.doc_id] for r in got) and len(got) == len(rows)
    assert all(r.decoded == r.text for r in got)


def unigram_file(path, pieces):
    """A unigram model file without normalisation, written as the protocol buffer that it is: pieces with their scores."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda n, b: number(n << 3 | 2) + number(len(b)) + b
    flag = lambda n, x: number(n << 3) + number(x)
    one = lambda p, score, kind: field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + flag(3, kind))
    body = one("<unk>", 0, 2) + one("<s>", 0, 3) + one("</s>", 0, 3) + b"".join(one(f"<0x{i:02X}>", 0, 6) for i in range(256))
    body += b"".join(one(p, score, 1) for p, score in pieces)
    path.write_bytes(body + field(2, flag(3, 1) + flag(35, 1)) + field(3, field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1)))
    return str(path)


def test_ids_of_a_unigram_file_are_those_of_the_library(spark, monkeypatch, tmp_path):
    rng = random.Random(17)
    letters = "abcde▁é"
    pieces = {c: -rng.uniform(2, 6) for c in letters}
    pieces |= {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))): -rng.uniform(3, 11) for _ in range(400)}
    pieces |= {"▁" + "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))): -rng.uniform(3, 11) for _ in range(200)}
    # Equal scores make ties.
    pieces |= {p: -5.0 for p in ("ab", "ba", "aba", "bab", "abab", "a", "b")}
    model = unigram_file(tmp_path / "small.model", pieces.items())
    texts = ["".join(rng.choice("aaabbbcde  é\n☃") for _ in range(rng.choice([0, 1, 5, 60, 3000]))) for _ in range(60)] + ["ab" * 4000, "a" * 3000 + " " + "ba" * 2000]
    monkeypatch.setattr(sentencepiece_scan, "CHUNK_CHARS", 100)
    monkeypatch.setattr(sentencepiece_scan, "GROUP", 4)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for giant in (1 << 30, 150):
        got = sentencepiece_scan.encode(docs(spark, list(enumerate(texts))), model, giant_chars=giant, round_trip="same").collect()
        assert all(r.ids == library.encode(r.text) and r.same for r in got) and len(got) == len(texts)


def test_best_path_is_the_best():
    v = sentencepiece_scan.Vocabulary(MODEL)
    e, rng = sentencepiece_scan.Encoder(v), random.Random(8)
    words = ["".join(rng.choice(" theantioné☃▁") for _ in range(rng.randint(1, 50))) for _ in range(800)]
    e.learn(words)
    for w in words:
        total = [0] + [None] * len(w)
        for j in range(1, len(w) + 1):
            found = [total[s] + v.piece[w[s:j]][0] for s in range(max(0, j - v.longest), j) if w[s:j] in v.piece]
            total[j] = max(found + ([total[j - 1] + v.fallback] if w[j - 1] not in v.piece else []))
        weight, ids = e.best(w)
        assert weight == total[-1] and e.words[w] == ids


# op10


def test_language_id(spark):
    rng = random.Random(9)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(2)) for _ in range(60))
    syllables = {"aa": ["ba", "du", "ki"], "bb": ["zo", "xe", "qu"], "cc": ["ßä", "öl", "ün"]}
    rows = [(i, make(syllables[k]), k) for i, k in enumerate(sorted(syllables) * 20)] + [(None, None, "aa"), (90, "", "aa"), (91, "12 -- !", None), (92, "12 -- !", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df)
    assert set(profiles) == {"aa", "bb", "cc"} and all(len(p) <= langid.TOP for p in profiles.values())
    got = langid.identify(df, profiles).collect()
    assert all(r.lang_pred == r.lang for r in got if r.text and r.doc_id < 90)
    assert all((r.lang_pred, r.score) == ("und", 0) for r in got if r.doc_id is None or r.doc_id >= 90)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(df, langid.learn_profiles(df.limit(0))).collect()} == {"und"}


def test_profile_counts_are_exact(spark):
    texts = ["Aba, abá!", "ab a", None]
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    want = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
            p = f"\x01{w}\x01"
            want.update(list(w))
            want.update(p[i : i + 2] for i in range(len(p) - 1))
            want.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    order = sorted(want, key=lambda g: (-want[g], code(g)))
    assert langid.learn_profiles(df, top=10_000)["x"] == [code(g) for g in order]


# op6


@pytest.mark.parametrize(("shards", "digits"), [(1, 3), (3, 3), (16, 3), (16, 1)])
def test_shards(spark, monkeypatch, shards, digits):
    monkeypatch.setattr(sharding, "DIGITS", digits)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 3 - 2 * (digits == 1))
    rows = mixed(11)
    rows += [(i, f"text {i} " * (i % 50)) for i in range(3000 if digits == 1 else 0)]
    got = sharding.minimax_shards(docs(spark, rows), shards).collect()
    assert len(got) == len(rows)
    sizes, counts = Counter(), Counter()
    for r in got:
        sizes[r.shard] += r.size
        counts[r.shard] += 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == want
    import hashlib

    groups = Counter()
    for _, t in rows:
        groups[hashlib.sha256(b"\xff" if t is None else t.encode()).hexdigest()] += len((t or "").encode()) + 1
    ordered = [groups[k] for k in sorted(groups)]

    def needed(capacity):
        n, full = 1, 0
        for x in ordered:
            n, full = (n, full + x) if full + x <= capacity else (n + 1, x)
        return n

    least = next(c for c in range(max(ordered), sum(ordered) + 1) if needed(c) <= shards)
    assert max(sizes.values()) == least
    assert sharding.minimax_shards(docs(spark, rows).limit(0), shards).count() == 0


# op9


def test_quality_edges(spark):
    def repeats(w):
        n = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        c = Counter(n)
        return len({j for i, x in enumerate(n) if c[x] > 1 for j in range(i, i + 8)})

    common = "Shared   header line of the site"
    texts = [None, "", "\n\n", " ".join("ab cd".split() * 30), "a " * 9, "x y z\nx y z\n\r\n", "# $ %%", *(f"{common}\n" + " ".join(f"w{i}k{j}" for j in range(40)) for i in range(12)), common + " \n" + common.upper() + " " + " ".join(["pad"] * 0)]
    rows = [(i, t, None if i % 2 else "h") for i, t in enumerate(texts)]
    rows += [(50 + i, common.lower() + "\n" + common + "\n" + " ".join(common for _ in range(4)) + f" {i}", "h") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        assert (got[i].n_words, got[i].word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert got[i].n_repeat_words == repeats(w)
        assert got[i].base_failed == (len(w) < 20 or 100 * repeats(w) > 30 * len(w))
    assert got[5].n_dup_lines == 1 and got[6].n_symbols == 4
    assert got[8].n_lines_removed == 1 and got[8].kept and common not in got[8].kept_text
    assert got[0].kept_text is None and quality.quality_rules(df.limit(0)).count() == 0


def test_many_frequent_lines_meet_their_rows_in_a_join(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = df.unionAll(spark.createDataFrame([(900 + i, "One line\nTwo lines \n" + "x" * i, None, None if i % 2 else "s", 0) for i in range(40)], df.schema)).withColumn("h", F.lit("clash"))
    few = quality.quality_rules(df).collect()
    monkeypatch.setattr(quality, "LIST_LINES", 0)
    assert sorted(map(repr, quality.quality_rules(df).collect())) == sorted(map(repr, few))
    assert sum(r.n_lines_removed for r in few) >= 80


def test_depleted_documents_are_rejected(spark):
    unique = lambda i, n: " ".join(f"w{i}k{j}" for j in range(n))
    boiler = " ".join(f"b{j}" for j in range(60))
    rows = [(i, f"{boiler}\n{unique(i, 60)}", "h") for i in range(15)] + [(100 + i, f"{boiler.upper()}  \n{unique(100 + i, 3)}", "h") for i in range(5)] + [(200, f"{boiler}\n{unique(200, 3)}", "other")]
    got = {r.doc_id: (r.kept, r.base_failed, r.n_lines_removed) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (True, False, 1) for i in range(15))
    assert all(got[i] == (False, False, 1) for i in range(100, 105))
    assert got[200] == (True, False, 0)


def test_the_limit_of_lines_does_not_loosen_and_copies_are_one_document(spark):
    body = lambda i: " ".join(f"w{i}k{j}" for j in range(30))
    few, many = " ".join(f"f{j}" for j in range(120)), " ".join(f"m{j}" for j in range(120))
    rows = [(i, f"{few if i < 10 else many if i < 31 else f'x{i}'}\n{body(i)}", "h") for i in range(1000)]
    # A text of which there are many copies has lines in many rows, but in one document.
    rows += [(2000 + i, f"{many}y\n{body(-1)}", "h") for i in range(300)]
    got = {r.doc_id: (r.kept, r.n_lines_removed) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (True, 0) for i in (*range(10), *range(31, 1000), *range(2000, 2300)))
    assert all(got[i] == (False, 1) for i in range(10, 31))


def test_lines_alone_reject_some_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = quality.quality_rules(docs)
    assert 0 < out.where("not base_failed and not kept").count() < 0.01 * docs.count()


# op2


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 60)
    monkeypatch.setattr(lm, "STREAMS", 4)
    monkeypatch.setattr(lm, "RATE", 1e-2)
    rng = random.Random(12)
    langs = [[f"{p}{i}" for i in range(30)] for p in ("da", "ko", "ri")]
    text = lambda: " ".join(rng.choice(langs[k]) for k in [rng.randrange(3)] for _ in range(60))
    rows = [(i, text()) for i in range(400)] + [(None, None), (7, ""), (8, "never Seen " * 3), (8, "never Seen " * 3)]
    got = lm.score_documents(docs(spark, rows), crc_of_id("doc_id") % 7 == 2).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted(repr((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6))) for i, t in rows)
    assert sorted(repr((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == want
    out = [r for r in got if r.held_out and r.n_tokens > 30]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_network_gradients_and_probabilities():
    words = [b"", *(f"w{i}".encode() for i in range(70))]
    v = lm.Vocabulary(words, [5] * len(words))
    v.finish(np.array([3.0] * v.tails), np.array([2.0] * v.tails))
    net = lm.Network(v)
    h = np.random.default_rng(1).normal(0, 1, (2, lm.STATE)).astype(np.float32)
    h = h.T
    total = np.zeros(2)
    for y in [*range(v.head), *(v.head + k for k in range(v.tails))]:
        total += np.exp(net.output(h, np.array([y, y]))[0])
    assert np.allclose(total, 1, atol=1e-4)
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    h, y = h.astype(np.float64), np.array([3, 40])
    grads = {}
    _, dh = net.output(h, y, grads)
    for k, at in (("C", (2, 1)), ("c", (0,)), ("W", (0, 3, 3)), ("w", (1, 8))):
        was = net.p[k][at]
        ends = []
        for d in (1e-5, -1e-5):
            net.p[k][at] = was + d
            ends.append(-net.output(h, y)[0].sum())
        net.p[k][at] = was
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][at]) < 1e-5


def test_state_is_carried_over_windows():
    v = lm.Vocabulary([b"", b"a", b"b"], [1, 5, 5])
    v.finish(np.zeros(v.tails), np.zeros(v.tails))
    net = lm.Network(v)
    net.p["G"] *= 10
    docs = [np.array([1, 2, 2, 1] * 13 + [0]), np.array([0]), np.array([2] * 40 + [0])]
    want = []
    for d in docs:
        h, x, total = np.zeros((lm.STATE, 1), np.float32), 0, 0.0
        for y in d:
            h = net.step(net.p["G"][[x]].T, h)[0]
            total += net.output(h, np.array([y]))[0][0]
            x = y
        want.append(total / math.log(10))
    assert np.allclose(net.score(docs), want, atol=1e-4)


def test_recurrent_gradients_through_time():
    words = [b"", *(f"w{i}".encode() for i in range(40))]
    v = lm.Vocabulary(words, [5] * len(words))
    v.finish(np.array([3.0] * v.tails), np.array([2.0] * v.tails))
    net, rng = lm.Network(v), np.random.default_rng(3)
    net.p = {k: (a if k in "cw" else 4 * a).astype(np.float64) for k, a in net.p.items()}
    x, y = (rng.integers(0, v.head, (7, 5)) for _ in range(2))
    keep, h = np.ones((7, 5)), rng.normal(0, 1, (lm.STATE, 5))
    keep[3, 2] = keep[0, 1] = 0
    _, grads, after = net.gradients(x, y, keep, h)
    assert after.shape == h.shape
    for k, at in [("G", (int(x[2, 2]), j)) for j in range(0, 72, 5)] + [("G", (int(x[6, 0]), 3))] + [("U", (i, j)) for i in (0, 7, 23) for j in range(0, 72, 7)] + [("C", (1, 1)), ("W", (0, 2, 5)), ("w", (1, 3)), ("c", (0,))]:
        was, ends = net.p[k][at], []
        for d in (1e-5, -1e-5):
            net.p[k][at] = was + d
            ends.append(net.gradients(x, y, keep, h)[0])
        net.p[k][at] = was
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][at]) < 1e-5 * max(1, abs(grads[k][at]))
