"""Column expressions for parts of a log record. None fails on a bad value: it gives null instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"
#: Fields of a record, in order; what follows the last separator is the numstat tail.
FIELDS = ["sha", "parents", "author_name", "author_email", "authored", "committed", "message"]
#: The single-letter escapes of quoted paths and the bytes they stand for.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}
ZONE = r"(Z|[+-]\d\d:\d\d)$"
QUOTED = r'"(?:[^"\\]|\\.)*"'


def repo_of(file_path: Column, levels: int = 1) -> Column:
    """The last so many folders of a file, decoded; `repo=` before them marks a value that the writer has escaped once more."""
    # Most names have nothing to decode, and each record asks for its file's.
    decode = lambda x: F.when(F.contains(x, F.lit("%")), F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))).otherwise(x)
    folder = decode(F.substring_index(F.substring_index(file_path, "/", -levels - 1), "/", levels))
    return F.when(folder.startswith("repo="), decode(F.substring(folder, F.lit(6), F.length(folder)))).otherwise(folder)


def instant(text: Column) -> Column:
    """The instant of a time with its zone; without one the text means no instant, so it gives null in any session."""
    return F.when(text.rlike(ZONE), F.try_to_timestamp(text))


def offset(text: Column) -> Column:
    """Z or the signed hours and minutes at the end; null if there are none."""
    found = F.regexp_extract(text, ZONE, 1)
    return F.when(found != "", found)


def parents(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def subject(message: Column) -> Column:
    return F.trim(F.regexp_extract(message, r"^\s*([^\n]*)", 1))


def paragraphs(message: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(message, r"^\s+|\s+$", ""), r"\n[ \t]*\n\s*"), lambda x: F.trim(x) != "")


def is_trailers(paragraph: Column) -> Column:
    """Whether each line of a paragraph is `key: value` or goes on the line before."""
    return paragraph.rlike(r"^[A-Za-z0-9-]+:[ \t].*(\n([A-Za-z0-9-]+:[ \t].*|[ \t]+\S.*))*$")


def trailers(message: Column) -> Column:
    """Key and value of each trailer line, in order, repeated keys too. Only a last paragraph after the subject has any."""
    last = F.try_element_at(paragraphs(message), F.lit(-1))
    lines = F.split(F.regexp_replace(last, r"\n[ \t]+", " "), "\n")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]*):", 1).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.when(F.coalesce((F.size(paragraphs(message)) > 1) & is_trailers(last), F.lit(False)), pairs).otherwise(none)


def body(message: Column, n_trailers: Column) -> Column:
    """What stands between the subject and the trailers, if there are any."""
    p = paragraphs(message)
    head = F.trim(F.regexp_replace(F.get(p, F.lit(0)), r"^[^\n]*\n?", ""))
    n = F.size(p) - F.when(n_trailers > 0, 2).otherwise(1)
    rest = F.slice(p, 2, F.greatest(n, F.lit(0)))
    return F.array_join(F.filter(F.concat(F.array(head), rest), lambda x: x != ""), "\n\n")


def unquote(path: Column) -> Column:
    """A path as git prints it: in quotes with C escapes, three octal digits for a byte, or as it is."""

    def to_hex(x: Column) -> Column:
        letters = F.create_map(*(F.lit(v) for kv in ESCAPES.items() for v in kv))
        octal = F.lpad(F.conv(F.substring(x, 2, 3), 8, 16), 2, "0")
        return F.when(x.rlike(r"^\\[0-7]{3}$"), octal).when(x.startswith("\\"), F.coalesce(F.try_element_at(letters, F.substring(x, 2, 1)), F.hex(F.encode(F.substring(x, 2, 1), "UTF-8")))).otherwise(F.hex(F.encode(x, "UTF-8")))

    inner = F.substring(path, F.lit(2), F.length(path) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(\\[0-7]{3}|\\.|[^\\]+)"), 1)
    return F.when(path.rlike(f"^{QUOTED}$"), F.unhex(F.array_join(F.transform(pieces, to_hex), "")).cast("string")).otherwise(path)


def paths(printed: Column) -> Column:
    """Struct of path and old_path from a numstat path: plain, quoted, `old => new` or `{old => new}` between shared parts.

    Nothing marks an arrow that belongs to a plain name, so such a name reads as a rename.
    """
    brace, arrow = r"^([^\"]*)\{([^\"]*) => ([^\"]*)\}([^\"]*)$", rf"^({QUOTED}|.*?) => ({QUOTED}|.*)$"
    part = lambda *n: F.regexp_replace(F.concat(*(F.regexp_extract(printed, brace, i) for i in n)), "//+", "/")
    plain = F.struct(unquote(printed).alias("path"), F.lit(None).cast("string").alias("old_path"))
    in_braces = F.struct(part(1, 3, 4).alias("path"), part(1, 2, 4).alias("old_path"))
    renamed = F.struct(unquote(F.regexp_extract(printed, arrow, 2)).alias("path"), unquote(F.regexp_extract(printed, arrow, 1)).alias("old_path"))
    return F.when(~F.contains(printed, F.lit(" => ")), plain).when(printed.rlike(brace), in_braces).when(printed.rlike(arrow), renamed).otherwise(plain)
