"""Identifiers against plain expressions, and revealing terms against a count over all documents."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from weftwork.llm import pii, registry

DATA = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, rule in PLAIN.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]  # noqa: B023
            if ok():
                out.append((kind, *m.span()))
    return out


def plain_terms(texts):
    """Replacements of the revealing terms by counts over all texts, and the spans they take in each."""
    words = []
    for t in texts:
        spans = plain_spans(t)
        words.append(([m for m in re.finditer(r"[^\x20\x09-\x0D]+", t)], spans, {(k, re.sub("[^0-9]", "", t[s:e]) if k in ("card", "phone") else t[s:e].lower()): [] for k, s, e in spans}))
    term = lambda w: (lambda x: x if len(x) >= 3 else None)(re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()))
    form = lambda t: t[:3] + "*" if len(t) >= 5 else None
    n, n_c, both, texts_of = {}, {}, {}, {}
    for t, (ms, spans, entities) in zip(texts, words, strict=True):
        for x in {y for m in ms if term(m[0]) for y in (term(m[0]), form(term(m[0])))} - {None}:
            n[x] = n.get(x, 0) + 1
        free = [None if any(s < m.end() and m.start() < e for _, s, e in spans) else term(m[0]) for m in ms]
        for c in entities:
            n_c[c] = n_c.get(c, 0) + 1
            near = set()
            for k, s, e in spans:
                if (k, re.sub("[^0-9]", "", t[s:e]) if k in ("card", "phone") else t[s:e].lower()) == c:
                    before, after = [i for i, m in enumerate(ms) if m.end() <= s], [i for i, m in enumerate(ms) if m.start() >= e]
                    near |= {free[i] for i in before[-10:] + after[:10]}
            for x in {y for w in near - {None} for y in (w, form(w))} - {None}:
                both[c, x] = both.get((c, x), 0) + 1
                texts_of.setdefault((c, x), set()).add(t)
    told = {}
    for (c, x), k in both.items():
        if len(texts_of[c, x]) >= 2 and n_c[c] < len(texts):
            share = math.log2(len(texts) * k / (n_c[c] * n[x])) / math.log2(len(texts) / n_c[c])
            if share >= 0.9 - 1e-12:
                told[x] = max(share, told.get(x, 0))
    replace = {x: None if form(x) is None or form(x) in told else form(x) for x in told if not x.endswith("*")}
    out = []
    for t, (ms, spans, _) in zip(texts, words, strict=True):
        own = []
        for m in ms:
            x = term(m[0])
            if x in replace and not any(s < m.end() and m.start() < e for _, s, e in spans):
                s = m.start() + m[0].lower().find(x)
                own.append(("term", s, s + len(x)))
        out.append(spans + own)
    return replace, out


def test_identifiers_of_random_signs():
    rng = random.Random(4)
    card = next(c for c in iter(lambda: "".join(rng.choice("0123456789") for _ in range(16)), None) if luhn(c))
    found = 0
    for _ in range(20_000):
        t = "".join(rng.choice(rng.choice(["0123456789.-+() @aB", "12.@a +-(", "0123456789. -\n+@x"])) for _ in range(rng.randrange(50)))
        k = rng.randrange(len(t) + 1)
        t = t[:k] + rng.choice(["", card, f"{card[:4]}-{card[4:]}", "1.2.3.4", "+1 (223) 555-0000", "a@b.c", "255.1.01.256"]) + t[k:]
        assert pii.base_spans(t) == plain_spans(t)
        found += len(pii.base_spans(t))
    assert found > 5000


def test_long_odd_texts_take_time_in_proportion():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 300_000, "+" * 300_000, "+1" + " " * 300_000, "a@" * 200_000, "0" * 6000 + "1.1.1.1"):
        pii.base_spans(t)


WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "fox", "golf", "hotel", "india", "kilo", "Über-x", "(lima),"]


def corpus():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(200)]
    secret = ["x.1@mail.example.com", "+1 (223) 555-0100", "10.20.30.40", "4111111111111111"]
    for i in range(60):
        k = rng.randrange(len(texts))
        near = [f"nickname{i % 4}", "the", f"zq{i % 4}", ["zebra", "zebu", "zed", "zeal"][i % 4]]
        texts[k] += f" {near[0].title()}! {near[1]} {secret[i % 4]} {near[2]}, {near[3]} {rng.choice(WORDS)}"
    return [*texts, *texts[:20], "", "nickname0 zq0 elsewhere zebra", "zebras zeb", "nickname1" * 3]


@pytest.mark.parametrize("few", [100_000, 0])
def test_revealing_terms(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", few)
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, None, "x")], "doc_id long, text string, term_spans string").repartition(3)
    replace, want = plain_terms([*texts, ""])
    assert {r.term: r.replacement for r in pii.disclosures(df).collect()} == replace
    assert None in replace.values() and any(replace.values())
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert {i: [tuple(s) for s in [*got[i].base_spans, *got[i].term_spans]] for i, _, _ in rows} == dict(enumerate(want[:-1]))
    assert got[None].base_spans == got[None].term_spans == [] and got[None].sanitised_text is None
    for i, t, _ in rows:
        cut, done = "", 0
        new = {"term": lambda s: replace[s.lower()] or "[removed]"}
        for k, s, e in sorted(want[i], key=lambda x: x[1]):
            cut, done = cut + t[done:s] + (new[k](t[s:e]) if k == "term" else f"[{k}]"), e
        assert got[i].sanitised_text == cut + t[done:]


def test_words_whose_lower_case_is_longer_and_clean_documents(spark):
    texts = [f"İİstan x.1@mail.example.com word{i}" for i in range(4)] + ["plain words alone"] * 30
    got = pii.sanitise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(texts[r.doc_id][r.term_spans[0].start : r.term_spans[0].end] == "İİstan" for r in got[:4])
    assert all(r.sanitised_text == texts[r.doc_id] for r in got[4:])


def test_a_table_that_one_entity_fills(spark):
    df = spark.createDataFrame([(i, f"call +1 (223) 555-0100 now {i}") for i in range(30)], "doc_id long, text string")
    got = pii.sanitise(df).collect()
    assert all(len(r.base_spans) == 1 and not r.term_spans for r in got) and pii.sanitise(df.limit(0)).count() == 0


def test_registered_query(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(i + 10_000, t, "en", None, None) for i, t in enumerate(corpus())] + [(None, None, None, None, None)], docs.schema)
    docs.unionAll(extra).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    _, want = plain_terms([r.text or "" for r in rows])
    listed = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    count = lambda spans, kind: sum(k == kind for k, _, _ in spans)
    base = [[s for s in x if s[0] != "term"] for x in want]
    got = registry.op11_pii(spark, str(tmp_path)).collect()
    expected = [(r.doc_id, *(count(x, k) for k in pii.KINDS), hashlib.sha256(listed(b).encode()).hexdigest(), listed(x), count(x, "term")) for r, x, b in zip(rows, want, base, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert any(count(x, "term") for x in want) and spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.col("text").isNull()).count()
