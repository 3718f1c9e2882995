"""Text, heading and token expressions over Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, and words too common in technical notes.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same "
    "so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
DOMAIN_STOP = "Config Memory Data Strategy Class Function Implementation".split()
#: One token of the counter that needs no vocabulary.
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
HEADING = r"^(#{2,6})[ \t]*(?:([0-9]+(?:\.[0-9]+)*)\.[ \t]*)?([^ \t].*)$"
NUMBERED = r"^#{2,6}[ \t]*(?:[0-9]+(?:\.[0-9]+)*)?\.[ \t]*(.+)$"


def lines(text: Column) -> Column:
    """Lines without their ends; a final empty line does not count. Null for null."""
    parts = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def token_count(text: Column) -> Column:
    """Tokens by a fixed pattern: letter runs, up to three digits, runs of other signs."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def slugify(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), F.lit("_"))


def topic_from_filename(path: Column) -> Column:
    """Base name without its extension, first and last word (by underscore)."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r".{3}$", "")
    words = F.split(stem, "_")
    return F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), "_")


# The marks of version, date, description and purpose lines.
_VERSION = r"Library Version Context:[ \t]*(\S+)"
_DATED, _DATE = r"(?m)^.*(?:Context|Date|date).*?(\d{4}-\d{2}-\d{2})", r"(?m)^\s*(\d{4}-\d{2}-\d{2})\s*$"
_DESCRIPTION, _PURPOSE = r"(?m)^\*[ \t]*Description:[ \t]*(.+)$", r"(?m)^\*\*[ \t]*[0-9.]+[ \t]*Purpose:[ \t]*(.+)$"


def version_context(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _VERSION, 1), F.lit(""))


def outline_date(text: Column) -> Column:
    """A date on a version-context or outline line, else a line that is just a date among the first ten; stays text."""
    first = F.array_join(F.slice(lines(text), 1, 10), "\n")
    return F.coalesce(F.nullif(F.regexp_extract(text, _DATED, 1), F.lit("")), F.nullif(F.regexp_extract(first, _DATE, 1), F.lit("")))


def keywords(text: Column, extra_stop: list[str] | None = None, limit: int = 7) -> Column:
    """Back-ticked terms and CamelCase words in code-point order, without stop words and short ones."""
    code = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    camel = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)*$"))
    stop = F.array(*[F.lit(w) for w in [*DOMAIN_STOP, *STOP_WORDS, *(extra_stop or [])]])
    kept = F.filter(F.array_except(F.array_union(code, camel), stop), lambda w: F.length(w) > 2)
    return F.slice(F.array_sort(kept), 1, limit)


def description(text: Column) -> Column:
    """The first description line, else the first numbered purpose line, else an empty text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, _DESCRIPTION, 1), F.lit("")), F.nullif(F.regexp_extract(text, _PURPOSE, 1), F.lit("")), F.lit(""))


def is_header_only(text: Column, when_blank: bool = True) -> Column:
    """Whether the only non-blank line is a heading; a text without such lines counts as when_blank."""
    full = F.filter(lines(text), lambda x: F.trim(x) != "")
    return F.when(F.size(full) == 0, F.lit(when_blank)).otherwise((F.size(full) == 1) & F.element_at(full, 1).rlike(r"^\s*#+\s+"))


def snippet(text: Column, most: int = 150) -> Column:
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("..."), F.right(text, F.lit(half))))


def fences_out(text: Column) -> Column:
    """Text with every closed fence replaced by a numbered placeholder, and the fences in order: struct<text, code>."""
    code = F.regexp_extract_all(text, F.lit(r"(?s)```.*?```"), F.lit(0))
    rest = F.split(text, r"(?s)```.*?```")
    swapped = F.array_join(F.transform(rest, lambda p, i: F.when(i < F.size(code), F.concat(p, F.lit("__CODE"), i.cast("string"), F.lit("__"))).otherwise(p)), "")
    return F.struct(F.when(F.size(code) == 0, text).otherwise(swapped).alias("text"), code.alias("code"))


def fences_in(text: Column, code: Column) -> Column:
    """The inverse of fences_out."""
    return F.aggregate(code, F.struct(text.alias("t"), F.lit(0).alias("i")), lambda a, c: F.struct(F.replace(a.t, F.concat(F.lit("__CODE"), a.i.cast("string"), F.lit("__")), c).alias("t"), (a.i + 1).alias("i")), lambda a: a.t)


def synthetic_number(title: Column) -> Column:
    """The next number after the numeric parts of a title, else 1."""
    numbers = F.filter(F.split(F.coalesce(title, F.lit("")), r"\."), lambda p: p.rlike("^[0-9]+$"))
    up = F.transform(numbers, lambda p, i: F.when(i == F.size(numbers) - 1, (p.cast("bigint") + 1).cast("string")).otherwise(p.cast("bigint").cast("string")))
    return F.when(F.size(numbers) == 0, "1").otherwise(F.array_join(up, "."))


def chunk_id(topic: Column, number: Column, start: Column, cluster: str = "memory") -> Column:
    return F.concat(F.lit(f"{cluster}_"), topic, F.lit("_sec"), number, F.lit("_L"), start.cast("string"))


def section_prefix(name: Column) -> Column:
    """Name of a chunk file up to its line suffix."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*?)_L\d+\.md$", 1), F.lit("")), F.regexp_replace(name, r"\.[^.]*$", ""))


def output_path(path: Column, root: str, topic: Column, ident: Column) -> Column:
    """<relative folder>/<file slug>/<topic slug>/<id>.md below the input root."""
    relative = F.regexp_replace(path, "^" + root.rstrip("/").replace(".", r"\.") + "/?", "")
    folder = F.nullif(F.regexp_replace(relative, r"/?[^/]*$", ""), F.lit(""))
    stem = slugify(F.regexp_replace(F.substring_index(relative, "/", -1), r"\.[^.]*$", ""))
    return F.concat_ws("/", folder, stem, slugify(topic), F.concat(ident, F.lit(".md")))
