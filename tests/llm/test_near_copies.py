"""The pipeline's near-copy stage against brute-force Jaccard over five-word shingles, with null and shared ids."""

import random

import numpy as np

import corpus_pipeline
from weftwork.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows, least=0.8):
    """The row of each component with the least id, nulls last."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for r, row in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(row)
    return [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]


def stage(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df.repartition(3), "").collect()]


def test_near_copies_are_linked_at_0_8(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        rows.append((10 * i, " ".join(w)))
        for k in range(3):
            v = list(w)
            for _ in range(rng.randrange(1, 5)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(5000)}"
            rows.append((10 * i + k + 1, " ".join(v)))
    got, want = stage(spark, rows), brute(rows)
    assert sorted(got) == sorted(want) and 60 <= len(want) < 200


def test_near_copies_of_the_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_null_and_shared_ids_keep_different_texts(spark):
    text = lambda k: " ".join(f"{k}word{j}" for j in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (None, text("c")), (9, text("e")), (9, text("e"))]
    got = stage(spark, rows)
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (9, text("e"))]))


def test_drifting_copies_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 16)
    monkeypatch.setattr(simhash, "PAIRS", 1)
    rng = random.Random(8)
    rows = []
    for k in range(2):
        w = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for i in range(90):
            # The last words change at first, so all share most bands, though their ends are unlike.
            w[110 - i // 2 if k else rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * k + i, " ".join(w)))
    rng.shuffle(rows)
    assert sorted(stage(spark, rows)) == sorted(brute(rows))


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 2000)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 100)), dtype=np.uint64)]))
        x, y = (np.frombuffer(s, np.uint64) for s in simhash.odd_sketches([a, b]))
        while len(x) != len(y):
            x, y = (simhash.halved(s) if len(s) == max(len(x), len(y)) else s for s in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 2, 7, 40, 41, 300, 5000, 333)]
    odd = np.random.default_rng(11).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for s, wide in zip(sets, simhash.wide_fingerprints(sets, 4), strict=True):
        assert len(wide) == 8 * (8 if len(s) <= simhash.FEW else 4)
        for a, got in zip(odd, np.frombuffer(wide, np.uint64), strict=False):
            y = (s ^ s >> np.uint64(31)) * a
            y ^= y >> np.uint64(32)
            assert int(got) == sum(1 << k for k in range(64) if 2 * int((y >> np.uint64(k) & np.uint64(1)).sum()) > len(s))


def test_pairs_at_0_8_meet_in_some_table():
    rng = np.random.default_rng(6)
    bits, width = simhash.blocks_of(10**5)
    masks = np.array(simhash.covering_masks(1, bits), np.uint64)
    for common, more, pairs in ((4, (0, 1), 5000), (12, (0, 3), 5000), (88, (11, 11), 3000)):
        x = [rng.integers(0, 1 << 63, common + sum(more), dtype=np.uint64) for _ in range(pairs)]
        a = simhash.wide_fingerprints([v[: common + more[0]] for v in x], width)
        b = simhash.wide_fingerprints([np.delete(v, slice(common, common + more[0])) for v in x], width)
        differ = np.array([np.frombuffer(v, np.uint64) ^ np.frombuffer(w, np.uint64) for v, w in zip(a, b, strict=True)])
        blocks = differ[:, :, None] >> (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits))
        met = (blocks[..., None] & masks == 0).any(axis=(1, 2, 3)) & (np.bitwise_count(differ[:, :2]).sum(axis=1) <= simhash.NEAR_BITS)
        assert (~met).sum() <= 5


def test_simhash_makes_the_candidates(spark, monkeypatch):
    """Without its fingerprints no copy is found, whatever the texts share."""
    rows = [(i, " ".join(f"w{j}" for j in range(100)) + f" x{i}") for i in range(4)]
    assert stage(spark, rows) == rows[:1]
    monkeypatch.setattr(simhash, "wide_fingerprints", lambda sets, words: [np.random.default_rng(int(s.sum(dtype=np.uint64))).bytes(8 * words) for s in sets])
    assert sorted(stage(spark, rows)) == rows


def test_groups_of_a_bucket_over_batches(spark, monkeypatch):
    """Near ones of a bucket, however batches cut it; of a crowd all go on."""
    monkeypatch.setattr(simhash, "CROWD", 6)
    rows = [(1, 0, 0), (1, -1, -1), (1, 1, 0), (2, 5, 5), (3, 7, 0), (3, 7, 1), *((4, k * 0x123456789ABCDE, ~k) for k in range(9)), (5, 3, 3), (5, 3, 7)]
    df = spark.createDataFrame(rows, "b long, f1 long, f2 long").coalesce(1)
    for size in (2, 5, 100):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = simhash.near_in_buckets(df).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        groups = {}
        for r in got:
            groups.setdefault(r.b, []).append((r.f1, r.f2))
        assert sorted(map(sorted, groups.values())) == sorted(sorted((x, y) for b, x, y in rows if b == k and (k != 1 or x >= 0)) for k in (1, 3, 4, 5))


def test_candidates_grow_with_the_nodes(spark, monkeypatch):
    """Copies that are near to one text, but not to each other, don't meet in pairs."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(200), 3):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    verified = []
    links = simhash._jaccard_links
    monkeypatch.setattr(simhash, "_jaccard_links", lambda pairs, *rest: (verified.append(pairs.count()), links(pairs, *rest))[1])
    assert sorted(stage(spark, rows)) == sorted(brute(rows))
    assert sum(verified) < 10 * len(rows)


def test_long_texts_that_share_a_part_are_not_verified_in_pairs(spark, monkeypatch):
    """Pages of one template: 4,000 words of which about six in ten are shared, none of them copies but two."""
    verified = []
    links = simhash._jaccard_links
    monkeypatch.setattr(simhash, "_jaccard_links", lambda pairs, *rest: (verified.append(pairs.count()), links(pairs, *rest))[1])
    count = []
    for n in (20, 40, 80):
        rng = random.Random(n)
        shared = [f"w{rng.randrange(5000)}" for _ in range(3000)]
        rows = [(i, " ".join([*shared, *(f"x{rng.randrange(10**6)}" for _ in range(1000))])) for i in range(n)]
        rows.append((n, rows[3][1] + " and a few words more"))
        verified.clear()
        assert sorted(stage(spark, rows)) == sorted(rows[:n])
        count.append(sum(verified))
    # The stars, and little else: in proportion to the rows, where all pairs would be 16 times as many at the last.
    assert count[2] < 3 * count[1] < 9 * count[0] + 100 and count[2] < 400


def rows_made(spark, monkeypatch):
    """Counts the rows that the functions on pairs of nodes give."""
    count = spark.sparkContext.accumulator(0)
    kind = type(spark.range(1))
    plain = kind.mapInArrow

    def counting(df, f, schema, *args, **kwargs):
        def g(batches):
            for batch in f(batches):
                count.add(batch.num_rows)
                yield batch

        return plain(df, g if str(schema).startswith(("node long, near long", "a long, b long")) else f, schema, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", counting)
    return count


def test_copies_that_share_most_tables_make_few_rows(spark, monkeypatch):
    """A pair of copies meets in many of the 192 tables, which must not give it as many times."""
    made = rows_made(spark, monkeypatch)
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(200), 2):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert sorted(stage(spark, rows)) == sorted(brute(rows))
    assert made.value < 20 * len(rows)


def test_rows_of_texts_just_unlike_grow_with_their_number(spark, monkeypatch):
    """Pairs at 0.79, which sketches don't tell from similar ones, and a few at 0.806, which are no nearer by sketches."""
    made, count = rows_made(spark, monkeypatch), []
    for n in (30, 120):
        rng = random.Random(n)
        core, rows = [f"w{rng.randrange(5000)}" for _ in range(885)], []
        for i in range(n):
            tail = [f"x{rng.randrange(10**6)}" for _ in range(115)]
            if i % 2 and i < 20:
                tail[:8] = rows[-1][1].split()[885:893]
            rows.append((i, " ".join([*core, *tail])))
        before, want = made.value, brute(rows)
        assert sorted(stage(spark, rows)) == sorted(want) and len(want) == n - 10
        count.append(made.value - before)
    # All pairs of the larger table would be 7,140.
    assert count[1] < 6 * count[0] and count[1] < 20 * 120


def test_links_in_blocks_join_all_roots(spark, monkeypatch):
    """Own rows first, then those of other blocks, however batches cut them; of links that join the same roots one is given."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(3)]
    sets = {10 * k + i: np.unique(np.concatenate([s[i:], rng.integers(0, 1 << 63, i, dtype=np.uint64)])) for k, s in enumerate(sets) for i in range(1, 6)}
    # Nodes 1 and 2 have one root; of bucket 8, node 23 has none to meet; bucket 9 has two blocks.
    place = [(7, 0, x, True, True) for x in (1, 2, 3, 4, 11, 12)] + [(8, 0, 23, True, True)] + [(9, salt, x, True, x % 2 == salt) for salt in (0, 1) for x in (21, 22, 24)] + [(9, 1, 25, False, True)]
    rows = [(b, salt, x, len(sets[x]), 1 if x == 2 else x, simhash.odd_sketches([sets[x]])[0], other, mine, sets[x].tobytes()) for b, salt, x, other, mine in place]
    schema = "b long, salt int, node long, n long, root long, sketch binary, other boolean, mine boolean, shingles binary"
    df = spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("b", "salt", "mine", ascending=[True, True, False])
    for size in (1, 4, 100):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [(r.a, r.b) for r in simhash._linked_in_blocks(df, 0.8).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        root = {x: x for x in sets} | {2: 1}
        for a, b in got:
            root = {x: root[a] if r == root[b] else r for x, r in root.items()}
        assert (1, 2) not in got and len([a for a, _ in got if a < 10]) == 2
        assert [len({root[x] for x in g}) for g in ((1, 2, 3, 4), (11, 12), (21, 22, 24, 25))] == [1, 1, 1] and root[23] == 23 and root[1] != root[11]


def test_roots_after_new_links(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    roots = frame([(1, 1), (2, 1), (3, 3), (4, 3), (8, 8), (9, 8)], "node long, root long")
    got = simhash._joined_roots(spark, roots, frame([(2, 4), (5, 6), (6, 4)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (8, 8), (9, 8)]
