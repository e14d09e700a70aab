"""Personal data: identifiers by their form, and terms that reveal them by co-occurrence.

Identifiers (e-mail and IP addresses, card and phone numbers) are the protected entities. How strongly a term reveals one
is estimated over all documents: with N documents, the pointwise mutual information of entity c and term t is
log2(N * n(c, t) / (n(c) * n(t))), at most the entity's own information log2(N / n(c)). A term that tells at least the
share DISCLOSURE of that is replaced by its general form (its first letters) if this form tells less of all entities, and
is removed otherwise. n counts documents; n(c, t) those that have t within WINDOW words of c. Chance neighbours are told
apart by SUPPORT: so many different texts at least must have the pair.

A term is a word in lower case without signs at its edges, of MIN_CHARS or more, that no identifier overlaps. Pairs are
only made within the window, so a document of very many identifiers makes rows in proportion to its words.

Defined results: a null text is an empty one and has no spans; a repeated row counts as often as it occurs, though not as
a different text; an entity that all documents hold can't be revealed; positions are code points, ends exclusive. Columns of df
with the names of the results are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, append_columns, broadcast_if_small, slices, texts_of
from .runs import words_in

#: Kinds of identifiers in their order, and the kind of a term that reveals one.
KINDS, TERM = ("email", "ip", "card", "phone"), "term"
#: Share of an entity's information from which a term reveals it, texts that must have both, and words on either side.
DISCLOSURE, SUPPORT, WINDOW = 0.9, 2, 10
#: Characters of a term at least; of a general form, and those of a term that has one at least.
MIN_CHARS, GENERAL_CHARS, LONG_CHARS = 3, 3, 5
#: Distinct terms that a task counts before it hands them on, if it has no list of those to count.
COUNT_FLUSH = 200_000

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A digit, and what may go on from there; what begins within a run of digits would begin with the run.
NUMBER = re.compile(r"[0-9](?:[ .-]?[0-9])*+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has the longest local part before it that no earlier match has taken; so a long word costs its length."""
    low, at = 0, text.find("@")
    while at >= 0:
        part = text[low:at]
        start = len(part.rstrip(LOCAL)) + low
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    # Addresses and cards lie within runs of digits with single signs between, of which most are too short.
    ips, cards = [], []
    for run in NUMBER.finditer(text):
        low, high = run.span()
        if high - low < 7:
            continue
        for m in ADDRESS.finditer(text, low, high):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                ips.append(("ip", *m.span()))
        for m in CARD.finditer(text, low, high):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", *m.span()))
    out += ips + cards
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity(kind: str, found: str) -> str:
    """What copies of an identifier share, however they are written."""
    if kind in ("card", "phone"):
        return f"{kind}:{re.sub('[^0-9]', '', found)}"
    return f"{kind}:{found.lower()}"


def term_of(word: str) -> str | None:
    term = EDGES.sub("", word.lower())
    return term if len(term) >= MIN_CHARS else None


def general(term: str) -> str | None:
    """A term's general form, which no term equals since it ends with a sign."""
    return f"{term[:GENERAL_CHARS]}*" if len(term) >= LONG_CHARS else None


class _Words:
    """The words of a text that no identifier overlaps, as spans without the signs at their edges, and their terms."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]) -> None:
        self.starts, self.ends, self.terms = [], [], []
        taken: list[list[int]] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if taken and s <= taken[-1][1]:
                taken[-1][1] = max(e, taken[-1][1])
            else:
                taken.append([s, e])
        k = 0
        for m in WORD.finditer(text):
            s, e = m.span()
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            self.starts.append(s)
            self.ends.append(e)
            self.terms.append(None if k < len(taken) and taken[k][0] < e else term_of(m[0]))

    def near(self, start: int, end: int) -> set[str]:
        """Terms of the words within WINDOW of what stands from start to end."""
        first, last = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return {t for t in [*self.terms[max(0, first - WINDOW) : first], *self.terms[last : last + WINDOW]] if t}


def mentions(df: DataFrame, text_col: str) -> DataFrame:
    """(entity, text, terms): a row for each entity of a document, with a hash of its text and the terms near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch, "text"):
                spans = base_spans(text) if text else []
                if not spans:
                    continue
                words, near = _Words(text, spans), {}
                for kind, s, e in spans:
                    near.setdefault(entity(kind, text[s:e]), set()).update(words.near(s, e))
                h = xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
                rows += [(c, h, sorted(t)) for c, t in near.items()]
            entities, hashes, terms = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(hashes, pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=["entity", "text", "terms"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "entity string, text long, terms array<string>")


def _forms(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Terms and general forms of words; null where there is none."""
    terms = pc.utf8_lower(words)
    # Arrow's lower case and letters aren't always Python's; ASCII words between letters or digits, most by far, need no care.
    odd = pc.or_(pc.invert(pc.string_is_ascii(words)), pc.match_substring_regex(words, r"^[^A-Za-z0-9]|[^A-Za-z0-9]$"))
    if pc.any(odd).as_py():
        terms = pc.replace_with_mask(terms, odd, pa.array([EDGES.sub("", w.lower()) for w in words.filter(odd).to_pylist()], terms.type))
    size = pc.utf8_length(terms)
    none = pa.scalar(None, terms.type)
    forms = pc.binary_join_element_wise(pc.utf8_slice_codeunits(terms, 0, GENERAL_CHARS), pa.scalar("*", terms.type), pa.scalar("", terms.type))
    return pc.if_else(pc.greater_equal(size, MIN_CHARS), terms, none), pc.if_else(pc.greater_equal(size, LONG_CHARS), forms, none)


def document_counts(df: DataFrame, text_col: str, wanted: list[str] | None) -> DataFrame:
    """(term, n): in how many documents each term or general form stands, of those wanted, or of all.

    Tasks count first, so a frequent term makes few rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if sent.value is None else pa.array(sent.value, pa.string())
        total = np.zeros(0 if only is None else len(only), np.int64)
        held: Counter = Counter()
        rows = lambda terms, n: pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64())], names=["term", "n"])
        for batch in slices(batches):
            lists = words_in(batch.column(0))
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for forms in _forms(coded.dictionary.cast(pa.string())):
                if only is None:
                    own = forms.dictionary_encode()
                    names, index = own.dictionary.to_pylist(), own.indices
                else:
                    names, index = None, pc.index_in(forms, value_set=only)
                index = pc.fill_null(index, -1).to_numpy().astype(np.int64)[code] if len(forms) else code
                ok = index >= 0
                size = max(1, len(only) if names is None else len(names))
                n = np.bincount(np.unique(of[ok] * size + index[ok]) % size, minlength=size)
                if names is None:
                    total += n[: len(total)]
                else:
                    held.update(dict(zip(names, n.tolist(), strict=False)))
            if len(held) > COUNT_FLUSH:
                yield rows(held.keys(), held.values())
                held.clear()
        if held:
            yield rows(held.keys(), held.values())
        if only is not None:
            some = np.flatnonzero(total)
            yield rows(only.take(pa.array(some)), total[some])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _few(table: DataFrame, *columns: str) -> list | None:
    """The rows of a written table if they are few and short, as is counted first; else None."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    n, size = table.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return [tuple(r) for r in table.select(*columns).collect()] if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else None


def disclosures(df: DataFrame, text_col: str = "text", share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, entity, told, replacement) of each term that reveals an entity: the one of which it tells most.

    told is the share of the entity's information. replacement is the term's general form, or null if that tells too much too.
    """
    scratch = Scratch(df.sparkSession, "disclosures")
    documents = df.count()
    found = scratch.write(mentions(df, text_col))
    # A text's hash is part of the key first, so that neither a hot entity nor a hot term is one group.
    texts = found.groupBy("entity", "text").agg(F.count("*").alias("n"))
    entities = texts.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    entities = scratch.write(entities.where(F.col("n_entity") < documents))
    near = found.join(broadcast_if_small(entities), "entity")
    forms = lambda t: F.when(F.length(t) >= LONG_CHARS, F.concat(F.substring(t, 1, GENERAL_CHARS), F.lit("*")))
    terms = F.array_union("terms", F.array_compact(F.transform("terms", forms)))
    pairs = near.select("entity", "n_entity", "text", F.explode(terms).alias("term")).groupBy("entity", "n_entity", "term", "text").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "n_entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    pairs = scratch.write(pairs)
    wanted = scratch.write(pairs.select("term").distinct())
    few = _few(wanted, "term")
    counts = scratch.write(document_counts(df, text_col, None if few is None else [t for (t,) in few]))
    told = F.log2(F.lit(documents) * F.col("n_both") / (F.col("n_entity") * F.col("n"))) / F.log2(F.lit(documents) / F.col("n_entity"))
    known = pairs.join(broadcast_if_small(counts), "term").withColumn("told", told).where(F.col("told") >= share)
    known = scratch.write(known.groupBy("term").agg(F.max(F.struct("told", "entity")).alias("most")).select("term", "most.entity", "most.told"))
    terms, forms_known = known.where(~F.col("term").endswith("*")), known.where(F.col("term").endswith("*")).select(F.col("term").alias("form"))
    of = terms.withColumn("form", forms(F.col("term")))
    out = of.join(forms_known.withColumn("also", F.lit(True)), "form", "left")
    return scratch.write(out.select("term", "entity", "told", F.when(F.col("also").isNull(), F.col("form")).alias("replacement")))


def _with_terms(df: DataFrame, text_col: str, revealing: DataFrame) -> DataFrame:
    """df with __weft_terms, the revealing terms of its words with their replacements, by a join; for long lists of terms."""
    scratch = Scratch(df.sparkSession, "terms")
    rows = scratch.write(df.withColumn("__weft_row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = words_in(batch.column(1))
            coded = lists.flatten().dictionary_encode()
            of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            size = max(1, len(coded.dictionary))
            pair = np.unique(of * size + coded.indices.to_numpy())
            terms = _forms(coded.dictionary.cast(pa.string()))[0].take(pa.array(pair % size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair // size)), terms], names=["row", "term"]).filter(terms.is_valid())

    own = rows.select(F.col("__weft_row").alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "row long, term string").join(revealing.select("term", "replacement"), "term")
    own = own.groupBy("row").agg(F.collect_set(F.struct("term", "replacement")).alias("__weft_terms"))
    return rows.join(own, F.col("__weft_row") == F.col("row"), "left").drop("__weft_row", "row")


def sanitise(df: DataFrame, text_col: str = "text", share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """df with base_spans (identifiers), term_spans (terms that reveal one) and sanitised_text.

    There, an identifier is its kind in brackets, a term its general form or [removed]; overlapping identifiers are
    replaced as one, by the kind of the first. The texts are read three times and shuffled only if very many terms reveal something.
    """
    revealing = disclosures(df, text_col, share, support)
    df = df.drop("base_spans", "term_spans", "sanitised_text")
    few = _few(revealing, "term", "replacement")
    sent = df.sparkSession.sparkContext.broadcast(None if few is None else dict(few))
    rows = df if few is not None else _with_terms(df, text_col, revealing)

    def make():
        known = sent.value
        listed = pa.array(list(known or ()), pa.string())

        def touched(column: pa.Array) -> np.ndarray:
            """Which texts have a word whose term is listed."""
            lists = words_in(column)
            coded = lists.flatten().dictionary_encode()
            some = pc.is_in(_forms(coded.dictionary.cast(pa.string()))[0], value_set=listed).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            hit = np.concatenate([[0], np.cumsum(some[coded.indices.to_numpy()])]) if len(some) else np.zeros(int(sizes.sum()) + 1)
            ends = np.cumsum(sizes)
            return hit[ends] > hit[ends - sizes]

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(text_col))
            if known is None:
                own = [{x["term"]: x["replacement"] for x in t} if t else {} for t in texts_of(batch, "__weft_terms")]
            else:
                own = [known if t else {} for t in touched(column).tolist()] if known else [{}] * len(column)
            base, terms, out = [], [], []
            for text, replace in zip(column.to_pylist(), own, strict=True):
                spans = base_spans(text) if text else []
                hits = []
                if replace and text:
                    words = _Words(text, spans)
                    for s, e, t in zip(words.starts, words.ends, words.terms, strict=True):
                        if t in replace:
                            low = text[s:e].lower()
                            # Lower case may be longer; then the whole word goes.
                            s, e = (s + low.find(t), s + low.find(t) + len(t)) if len(low) == e - s else (s, e)
                            hits.append((s, e, replace[t] or "[removed]"))
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                terms.append([{"kind": TERM, "start": s, "end": e} for s, e, _ in hits])
                if spans or hits:
                    parts, done = [], 0
                    for s, e, new in sorted([*((s, e, f"[{k}]") for k, s, e in spans), *hits]):
                        if s >= done:
                            parts += [text[done:s], new]
                        done = max(done, e)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            return [pa.array(base, ARROW_SPANS), pa.array(terms, ARROW_SPANS), pa.array(out, pa.string())]

        return run

    made = append_columns(rows, [T.StructField("base_spans", SPANS), T.StructField("term_spans", SPANS), T.StructField("sanitised_text", T.StringType())], make)
    return made.drop("__weft_terms")
