"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; a line that more documents of a host hold than a limit is taken out, and documents
left with too little are rejected. Before that stand rules on words, repeated 8-word windows among them. The limit is a
share of the host's documents, but no more than MOST_DOCS, so that it doesn't loosen as a host grows. Copies of one text
are one document there: a text is not depleted by being copied.

Defined results: a null text has no words or lines; a null host is a host of its own; each row is answered. Columns of df with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, bind

SPACE = r"[\x20\x09-\x0D]+"
#: A line goes if over this share of its host's different documents hold it, or over MOST_DOCS, and at least MIN_DOCS do.
MAX_SHARE, MIN_DOCS, MOST_DOCS = 0.1, 10, 10
#: A document whose lines lose more than this percentage of their characters is depleted.
MAX_REMOVED = 70
#: Rules on words: fewer than MIN_WORDS, or over MAX_REPEATED per cent in repeated windows, fails.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
#: The most frequent lines of one host that its documents may be searched for in lists, and into how many these are dealt.
LIST_LINES, LISTS = 65_536, 256


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def doubled(k: int) -> Callable[[Column], Column]:
    """From the hashes of all stretches of k words, at least k of them, those of all stretches of 2 k."""
    return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda a, b: F.xxhash64(a, b))


def repeat_words(w: Column) -> Column:
    """Words within windows that occur twice or more in the text.

    A window's hash is made from those of its halves, pairs first. Most texts repeat no window, which the number of
    distinct hashes shows; else equal ones are neighbours when sorted, and sorted starts tell what they cover.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    for k in (1, 2, 4):
        hashes = bind(hashes, doubled(k))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = bind(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        gaps = bind(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(w) <= WINDOW, 0).otherwise(bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def base(text: Column) -> Column:
    """Struct of the measures of one text."""
    t = F.coalesce(text, F.lit(""))
    line = bind(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bind(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            line.cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def line_hashes(text: Column) -> Column:
    """Hashes of the distinct normalised lines."""
    return F.array_distinct(F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: F.xxhash64(normal_line(x))))


def frequent_lines(df: DataFrame, host_col: str, text_col: str, max_share: float, min_docs: int, most_docs: int) -> DataFrame:
    """(__weft_host, h): hashes of the lines above the limit of their host.

    A line counts once in a document, and documents of one text, told by 64 bits, count once. Counts combine in the tasks
    before the shuffle, so neither a hot host nor a hot line makes a large group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(host_col).alias("__weft_host"), F.xxhash64(text).alias("text"), line_hashes(text).alias("hashes")).dropDuplicates(["__weft_host", "text"])
    hosts = df.select(F.col(host_col).alias("__weft_of"), F.xxhash64(text).alias("text")).distinct().groupBy("__weft_of").agg(F.count("*").alias("docs"))
    counts = docs.select("__weft_host", F.explode("hashes").alias("h")).groupBy("__weft_host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    limit = F.least(max_share * F.col("docs"), F.lit(float(most_docs)))
    return counts.join(hosts, F.col("__weft_host").eqNullSafe(F.col("__weft_of"))).where(F.col("n") > limit).select("__weft_host", "h")


def line_info(text: Column) -> Column:
    """(h, n) of each line with a word: the hash and the length of its normal form."""
    return F.transform(lines(F.coalesce(text, F.lit(""))), lambda x: bind(normal_line(x), lambda k: F.struct(F.xxhash64(k).alias("h"), F.length(k).alias("n"))))


def with_common(df: DataFrame, common: DataFrame, host_col: str, text_col: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """df with __weft_common, which holds each frequent line of the row, null if it has none; and whether a hash is in it.

    Short lists of few hosts are broadcast, as their number, length and bytes are counted first: a list for each value of
    a hash's last bits, so that a line is compared with few. Otherwise lines meet the frequent ones in a join by host
    and line, and each different text of a host gets its own; no text is shuffled for that unless kept_text is asked for.
    """
    n, size = F.count("*").alias("n"), (8 * F.count("*") + F.coalesce(F.max(F.octet_length(F.col("__weft_host").cast("string"))), F.lit(0))).alias("size")
    total, longest, size = common.groupBy("__weft_host").agg(n, size).agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.max("n"), F.sum("size")))).first()
    if total <= BROADCAST_ROWS and longest <= LIST_LINES and size <= BROADCAST_BYTES:
        by = common.groupBy("__weft_host", F.pmod("h", F.lit(LISTS)).cast("int").alias("of")).agg(F.collect_list("h").alias("list"))
        lists = by.groupBy("__weft_host").agg(F.map_from_entries(F.collect_list(F.struct("of", "list"))).alias("lists"))
        every = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda i: F.try_element_at("lists", i.cast("int")))
        joined = df.join(F.broadcast(lists.select("__weft_host", every.alias("__weft_common"))), F.col(host_col).eqNullSafe(F.col("__weft_host")), "left").drop("__weft_host")
        return joined, lambda h: F.coalesce(F.array_contains(F.get("__weft_common", F.pmod(h, F.lit(LISTS)).cast("int")), h), F.lit(False))
    keys = [f"__weft_k{i}" for i in (1, 2)]
    rows = df.withColumns({k: F.xxhash64(F.lit(i), F.coalesce(F.col(text_col), F.lit(""))) for i, k in enumerate(keys)})
    own = rows.select(*keys, F.col(host_col).alias("__weft_of"), F.explode(line_hashes(F.col(text_col))).alias("own"))
    met = own.join(common, (F.col("own") == F.col("h")) & F.col("__weft_of").eqNullSafe(F.col("__weft_host")))
    lists = met.groupBy("__weft_host", *(F.col(k).alias(f"{k}o") for k in keys)).agg(F.collect_set("h").alias("__weft_common"))
    same = [F.col(k) == F.col(f"{k}o") for k in keys] + [F.col(host_col).eqNullSafe(F.col("__weft_host"))]
    joined = rows.join(lists, same, "left").drop("__weft_host", *keys, *(f"{k}o" for k in keys))
    return joined, lambda h: F.array_contains("__weft_common", h)


def quality_rules(df: DataFrame, text_col: str = "text", host_col: str = "source", max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, most_docs: int = MOST_DOCS) -> DataFrame:
    """df with the measures, base_failed, n_lines_removed, kept_text (text without frequent lines) and kept.

    The texts are read twice and never shuffled unless there are very many frequent lines and kept_text is asked for.
    """
    scratch = Scratch(df.sparkSession, "quality")
    common = scratch.write(frequent_lines(df, host_col, text_col, max_share, min_docs, most_docs))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "kept_text", "kept"]
    measured = df.drop(*new).withColumns({"__weft_base": base(F.col(text_col)), "__weft_lines": line_info(F.col(text_col))})
    joined, hit = with_common(measured, common, host_col, text_col)
    sized = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    removed = F.when(F.col("__weft_common").isNull(), F.struct(F.lit(0).alias("n"), F.lit(False).alias("depleted"))).otherwise(
        bind(F.filter("__weft_lines", lambda x: hit(x["h"])), lambda r: F.struct(F.size(r).alias("n"), ((F.size(r) > 0) & (100 * sized(r) > MAX_REMOVED * sized(F.col("__weft_lines")))).alias("depleted")))
    )
    out = joined.withColumn("__weft_removed", removed)
    failed = (F.col("__weft_base.n_words") < MIN_WORDS) | (100 * F.col("__weft_base.n_repeat_words") > MAX_REPEATED * F.col("__weft_base.n_words"))
    gone = lambda x: x.rlike(r"[^\x20\x09-\x0D]") & hit(F.xxhash64(normal_line(x)))
    kept_text = F.when(F.col("__weft_removed.n") == 0, F.col(text_col)).otherwise(F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~gone(x)), "\n"))
    columns = {k: F.col(f"__weft_base.{k}") for k in new[:5]} | {"base_failed": failed, "n_lines_removed": F.col("__weft_removed.n").cast("long"), "kept_text": kept_text, "kept": ~failed & ~F.col("__weft_removed.depleted")}
    return out.withColumns(columns).drop("__weft_base", "__weft_lines", "__weft_removed", "__weft_common")
