"""Oversized Markdown sections cut into pieces under a size limit, at natural boundaries and with an overlap.

One regular expression per profile does the cutting: alternatives ordered by the strength of the boundary (heading,
paragraph, line, sentence, clause, blank), each a bounded quantifier up to the limit, with bare characters as the last
resort. Its matches are the new text of the pieces, side by side without gaps; the overlap is looked back from the piece
before with array functions. Everything stays in the JVM and in the row: no shuffle.

The expression reads stand-ins of equal length where characters would mislead it: within fenced code a line that begins like a
heading is none, and a blank line parts no paragraphs. The pieces are then cut from the text as stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Profile of sections whose own is null or unknown.
DEFAULT_PROFILE = "standard"
#: Profiles are broadcast only up to this many rows.
PROFILE_ROWS = 100_000

# A fence runs from a line of three back-ticks or tildes to the next line that begins so, or to the end.
_FENCE = r"(?ms)^ {0,3}(?:(```)[^`\r\n]*|(~~~)[^\r\n]*)$.*?(?:^ {0,3}(?:\1|\2)[^\r\n]*$|\z)"
_BREAK = r"(?:\r\n|\n|\r)"
_INSIDE = r"(?!(?<=[\r\ufffc])\n)"  # not between the two characters of one line end
# {X}: limit of new characters; {H}, {Q}: a half and a third of it, the least that strong boundaries must fill.
_ALTERNATIVES = [
    r".{1,X}\z",
    r".{H,X}(?<=[\r\n])(?=#{1,6}[ \t])",
    r".{H,X}(?<=[\r\n][ \t]{0,8}[\r\n])(?<!(?<![\r\n \t])\r\n)(?![ \t]*[\r\n])",
    r".{Q,X}(?<=[\r\n])(?![\r\n])",
    r".{Q,X}(?<=[.!?…。！？][\"'”’»)\]*_`]{0,3}\s)(?!\s)",
    r".{1,X}(?<=[\r\n])(?![\r\n])",
    r".{1,X}(?<=[.!?…。！？][\"'”’»)\]*_`]{0,3}\s)(?!\s)",
    r".{Q,X}(?<=[,;:–—]\s)(?!\s)",
    r".{1,X}(?<=\s)(?!\s)",
    r".{1,X}(?<=\s)" + _INSIDE,
    r".{1,X}(?<!‍)(?![\p{M}‍️])" + _INSIDE,
    r".{1,X}" + _INSIDE,
    r".{1,X}",
]


def _pattern(first: Column, later: Column) -> Column:
    """The expression for a first piece of up to first characters and later ones of up to later new characters."""
    template = "(?s)(?:\\A(?:" + "|".join(_ALTERNATIVES) + ")"
    rest = "|".join(_ALTERNATIVES) + ")"

    def fill(t: str, size: Column) -> Column:
        # The stronger alternatives come first, so the first that fits decides; a heading or paragraph must fill a half.
        half, third = F.greatest(F.lit(1), F.floor(size / 2)), F.greatest(F.lit(1), F.floor(size / 3))
        c: Column = F.lit(t)
        for token, value in (("{H,X}", F.concat(F.lit("{"), half.cast("string"), F.lit(","), size.cast("string"), F.lit("}"))), ("{Q,X}", F.concat(F.lit("{"), third.cast("string"), F.lit(","), size.cast("string"), F.lit("}"))), ("{1,X}", F.concat(F.lit("{1,"), size.cast("string"), F.lit("}")))):
            c = F.replace(c, F.lit(token), value)
        return c

    return F.concat(fill(template, first), F.lit("|"), fill(rest, later))


def _limits(profiles: DataFrame) -> DataFrame:
    """One row per profile (the least limit if it is given twice) with its pattern; a limit below 1 splits nothing."""
    p = profiles.filter(F.col("profile").isNotNull()).groupBy("profile").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("v"))
    top = F.when(F.col("v.max_chars") >= 1, F.col("v.max_chars"))
    overlap = F.greatest(F.lit(0), F.least(F.coalesce(F.col("v.overlap_chars"), F.lit(0)), F.col("v.max_chars") - 1))
    p = p.select(F.col("profile").alias("__profile"), top.alias("__max"), overlap.alias("__overlap"))
    return p.withColumn("__pattern", _pattern(F.col("__max"), F.col("__max") - F.col("__overlap")))


def _breaks(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_BREAK), F.lit(0)))


def _settled(s: DataFrame, name: str) -> DataFrame:
    """The same rows; a generator keeps the column from being worked out again wherever it is used or filtered on."""
    return s.select(*[c for c in s.columns if c != name], F.explode(F.array(name)).alias(name))


def _unmarked(text: Column) -> Column:
    """The text with stand-ins for what looks like a heading or a blank line within its fences; every character keeps its place."""
    fences, rest = F.regexp_extract_all(text, F.lit(_FENCE), F.lit(0)), F.split(text, _FENCE)

    def plain(c: Column) -> Column:
        for pattern, sign in ((r"(?m)^#", "\ufffd"), (r"(?<=[\r\n])[ \t](?=[ \t]*[\r\n])", "\ufffd"), (r"(?<=\n)\r(?=\n)", "\ufffc"), (r"(?<=\n)\n|(?<=\r)\r", "\ufffd")):
            c = F.regexp_replace(c, pattern, sign)
        return c

    return F.array_join(F.transform(rest, lambda r, i: F.when(i < F.size(fences), F.concat(r, plain(fences[i]))).otherwise(r)), "")


def split_sections(sections: DataFrame, profiles: DataFrame) -> DataFrame:
    """section_id, piece_no, n_pieces, text, overlap, start_line, end_line: every section as pieces of at most max_chars.

    Cut in this order of preference: before a heading, after a blank line, after a line, after a sentence, after a clause,
    at a blank, between characters (never inside a line end or before a combining mark if that can be avoided). Each piece
    after the first begins with the last overlap_chars characters of the one before, or with fewer so that it begins at a
    word. Without their overlaps the pieces give the text back exactly. Characters are code points of the text as stored.

    Null and empty texts give no piece. A null or unknown profile means standard; a profile without a positive limit leaves
    its sections whole. Lines are 0-based and end exclusive, counted from the lower of start_line and end_line, from the end
    if start_line is null, and null if both are; repeated rows give repeated pieces; other columns are ignored.
    """
    limits = _limits(profiles)
    if profiles.limit(PROFILE_ROWS + 1).count() <= PROFILE_ROWS:
        limits = F.broadcast(limits)
    s = sections.filter("text is not null and text <> ''").select("section_id", F.col("text").alias("__text"), F.col("start_line").alias("__a"), F.col("end_line").alias("__b"), F.coalesce("profile", F.lit(DEFAULT_PROFILE)).alias("__own"))
    own, usual = limits, limits.filter(F.col("__profile") == DEFAULT_PROFILE)
    s = s.join(own, s["__own"] == own["__profile"], "left")
    usual = usual.select(*[F.col(c).alias(c + "_u") for c in usual.columns])
    s = s.join(usual, F.col("__profile").isNull() & (F.col("__profile_u") == DEFAULT_PROFILE), "left")
    s = s.select("section_id", "__text", "__a", "__b", *[F.when(F.col("__profile").isNotNull(), F.col(c)).otherwise(F.col(c + "_u")).alias(c) for c in ("__max", "__overlap", "__pattern")])
    # Characters of two code units would make the bounded quantifiers recurse, so stand-ins take their places.
    wide, fenced = F.col("__text").rlike(r"[\x{10000}-\x{10FFFF}]"), F.col("__text").rlike(r"(?m)^ {0,3}(?:```|~~~)")
    flat = F.when(wide, F.regexp_replace("__text", r"[\x{10000}-\x{10FFFF}]", "\ufffd")).otherwise(F.col("__text"))
    s = s.withColumn("__other", wide | fenced).withColumn("__flat", F.when(fenced & (F.length("__text") > F.col("__max")), _unmarked(flat)).otherwise(flat))
    s = s.withColumn("__parts", F.when(F.col("__max").isNull() | (F.length("__text") <= F.col("__max")), F.array("__text")).otherwise(F.regexp_extract_all("__flat", F.col("__pattern"), F.lit(0))))
    s = _settled(s, "__parts")
    # Where there are stand-ins the pieces are cut from the text as stored, by running offsets.
    ends = F.aggregate("__parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a.at + F.length(p)).alias("at"), F.concat(a.out, F.array(a.at + F.length(p))).alias("out")), lambda a: a.out)
    s = s.withColumn("__ends", F.when(F.col("__other") & (F.size("__parts") > 1), ends))
    recut = F.transform("__ends", lambda e, i: F.substring(F.col("__text"), F.when(i == 0, 1).otherwise(F.get("__ends", i - 1) + 1), e - F.when(i == 0, 0).otherwise(F.get("__ends", i - 1))))
    s = _settled(s.withColumn("__parts", F.coalesce(recut, F.col("__parts"))), "__parts")
    piece = "array<struct<text:string,overlap:int,first:int,last:int>>"

    def step(a: Column, new: Column) -> Column:
        # The last overlap_chars of the piece before; the character ahead of them tells whether they begin at a word.
        ahead, tail = F.right(a.piece, F.col("__overlap") + 1), F.right(a.piece, F.col("__overlap"))
        whole = (F.length(ahead) <= F.col("__overlap")) | F.left(ahead, F.lit(1)).rlike(r"\s")
        kept = F.when(F.col("__overlap") == 0, "").when(whole & ~tail.startswith("\n"), tail).when(tail.rlike(r"(?s)^\S*\s+\S"), F.regexp_replace(tail, r"^\S*\s+(?=\S)", "")).otherwise(F.when(tail.rlike(r"\s"), F.lit("")).otherwise(tail))
        kept = F.when(F.size(a.out) == 0, "").otherwise(kept)
        text = F.concat(kept, new)
        begin, end = a.line - _breaks(kept), a.line + _breaks(new)
        stop = end + F.when(text.rlike(r"[\r\n]\z"), 0).otherwise(1)
        row = F.struct(text.alias("text"), F.length(kept).alias("overlap"), begin.alias("first"), stop.alias("last"))
        return F.struct(text.alias("piece"), end.alias("line"), F.concat(a.out, F.array(row)).alias("out"))

    s = s.withColumn("__pieces", F.aggregate("__parts", F.struct(F.lit("").alias("piece"), F.lit(0).alias("line"), F.array().cast(piece).alias("out")), step, lambda a: a.out))
    s = _settled(s, "__pieces")
    lines = F.try_element_at(F.col("__pieces"), F.lit(-1))["last"]
    base = F.when(F.col("__a").isNotNull(), F.least("__a", F.coalesce("__b", "__a"))).otherwise(F.col("__b") - lines)
    s = s.select("section_id", F.size("__pieces").alias("n_pieces"), base.alias("__base"), F.posexplode("__pieces").alias("__no", "p"))
    return s.select("section_id", (F.col("__no") + 1).alias("piece_no"), "n_pieces", F.col("p.text").alias("text"), F.col("p.overlap").alias("overlap"), (F.col("__base") + F.col("p.first")).alias("start_line"), (F.col("__base") + F.col("p.last")).alias("end_line"))


def oversized(sections: DataFrame, profiles: DataFrame) -> DataFrame:
    """section_id of every section that the splitter had to cut."""
    return split_sections(sections, profiles).filter("n_pieces > 1 and piece_no = 1").select("section_id")
