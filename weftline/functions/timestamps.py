"""Date and time texts of many formats to one UTC instant.

Every supported format is a branch of one regular expression with named groups. The expression runs once per value (one
regexp_replace that writes the groups side by side), ranges are checked on integers, and the instant is put together
by integer day arithmetic. Only values without an offset touch a time zone database, through to_utc_timestamp, whose
rules for repeated local times (the first) and skipped ones (the offset before the change) are the wanted ones.

Results: null for null, blank, vague ("yesterday", "TBA") and impossible values (month 13, 30 February, 25:00).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, in the order of the months (English, German, French, Spanish).
MONTHS = [
    "january jan januar jänner janvier janv enero ene",
    "february feb februar februar février fevrier févr febrero",
    "march mar märz maerz mrz mars marzo",
    "april apr avril avr abril abr",
    "may mai mayo",
    "june jun juni juin junio",
    "july jul juli juillet juil julio",
    "august aug août aout agosto ago",
    "september sept sep septembre septiembre setiembre",
    "october oct oktober okt octobre octubre",
    "november nov novembre noviembre",
    "december dec dezember dez décembre decembre déc diciembre dic",
]
# Zone abbreviations and their offsets in minutes.
ZONES = {
    "utc": 0, "ut": 0, "gmt": 0, "z": 0, "wet": 0,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "jst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
}

_MONTH = "|".join(sorted({w for line in MONTHS for w in line.split()}, key=lambda w: (-len(w), w)))
_ABBR = "|".join(sorted(ZONES, key=lambda w: (-len(w), w)))
_WEEKDAY = r"\p{L}{2,12}\.?,?\s+"
_LABEL = r"\p{L}+(?:\s+\p{L}+){0,2}\s*:?\s+"
_GROUPS: list[str] = []


def _g(name: str, pattern: str) -> str:
    _GROUPS.append(name)
    return f"(?<{name}>{pattern})"


def _clock(n: str) -> str:
    """hour:minute[:second[.fraction]] [am|pm], its groups numbered n."""
    return (
        _g(f"h{n}", r"\d{1,2}") + "[:.h]" + _g(f"i{n}", r"\d{2}")
        + "(?::" + _g(f"s{n}", r"\d{2}") + "(?:[.,]" + _g(f"f{n}", r"\d+") + ")?)?"
        + r"(?:\s*" + _g(f"p{n}", r"[ap]\.?m\b\.?") + r")?(?:\s+uhr)?"
    )


def _zone(n: str) -> str:
    """Z, an abbreviation, an offset, an IANA name, or an offset with a bracketed IANA name."""
    return (
        r"(?:\s*(?:(?:utc|gmt)?" + _g(f"o{n}", r"[+\-−]\d{2}(?::?\d{2})?") + "|" + _g(f"a{n}", _ABBR)
        + "|" + _g(f"r{n}", r"[a-z]+(?:/[a-z_+\-0-9]+)+") + r"))?(?:\s*\[" + _g(f"b{n}", r"[a-z]+(?:/[a-z_+\-0-9]+)*") + r"\])?"
    )


_BRANCHES = [
    # 2024-03-17[T07:39:51.6[zone]], 2024/03/17 07:39:51
    _g("y1", r"\d{4}") + r"[-/.]" + _g("m1", r"\d{1,2}") + r"[-/.]" + _g("d1", r"\d{1,2}") + r"(?:(?:t|\s+|,\s*)" + _clock("1") + r")?" + _zone("1"),
    # 20240317T073951Z
    _g("y2", r"\d{4}") + _g("m2", r"\d{2}") + _g("d2", r"\d{2}") + r"(?:(?:t|\s+)?" + _g("h2", r"\d{2}") + _g("i2", r"\d{2}") + "(?:" + _g("s2", r"\d{2}") + "(?:[.,]" + _g("f2", r"\d+") + ")?)?" + _zone("2") + ")?",
    # 17/03/2024 07:39, 17.03.2024 - 07:39 Uhr, 3-17-2024 7:39 pm
    f"(?:{_LABEL})??" + _g("u3", r"\d{1,2}") + _g("q3", r"[/.\-]") + _g("v3", r"\d{1,2}") + r"\k<q3>" + _g("y3", r"\d{4}|\d{2}") + r"(?:(?:\s*[,–-]\s*|\s+)(?:(?:at|um|à|a las)\s+)?" + _clock("3") + r")?" + _zone("3"),
    # Fri, 15 Nov 2024 06:04:28 +0000, Wednesday, 21-Jun-23 ..., 24 de junio de 2025, 14:09, 28. Juni 2025, 03:18 Uhr
    f"(?:{_LABEL})??(?:{_WEEKDAY})??" + _g("d4", r"\d{1,2}") + r"(?:st|nd|rd|th|er|º|\.)?(?:\s+|-)(?:de\s+)?" + _g("n4", _MONTH) + r"\.?,?(?:\s+|-)(?:del?\s+)?" + _g("y4", r"\d{4}|\d{2}") + r"(?:(?:\s*,\s*|\s+)(?:(?:at|um|à|a las)\s+)?" + _clock("4") + r")?" + _zone("4"),
    # May 17, 2025 at 4:59 AM EDT
    f"(?:{_LABEL})??(?:{_WEEKDAY})??" + _g("n5", _MONTH) + r"\.?\s+" + _g("d5", r"\d{1,2}") + r"(?:st|nd|rd|th)?(?:,\s*|\s+)" + _g("y5", r"\d{4}") + r"(?:(?:\s*,\s*|\s+)(?:at\s+)?" + _clock("5") + r")?" + _zone("5"),
    # Thu May  8 16:19:44 [zone] 2025
    f"(?:{_WEEKDAY})?" + _g("n6", _MONTH) + r"\s+" + _g("d6", r"\d{1,2}") + r"\s+" + _clock("6") + _zone("6") + r"\s+" + _g("y6", r"\d{4}"),
    # seconds (below 10^11), milliseconds (below 10^14) or microseconds since 1970; four digits alone are a year, no instant
    _g("e7", r"-?(?:\d{1,3}|\d{5,7}|\d{9,13}|\d{15,18})") + "(?:[.,]" + _g("f7", r"\d+") + ")?",
]
PATTERN = r"(?iu)^\s*(?:" + "|".join(f"(?:{b})" for b in _BRANCHES) + r")\s*$"
_SEP = "\u001f"
_EXTRACT = _SEP.join("${" + g + "}" for g in _GROUPS)


def _lookup(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def components(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add column out: all named groups of the one pattern, an array in the pattern's order; null where nothing matches.

    regexp_replace leaves a value that does not match as it is, so the separator tells matches from the rest and the
    pattern runs once.
    """
    blanks = F.regexp_replace(F.col(value), "[\\s\\x1f\\u00a0\\u2000-\\u200a\\u202f\\u3000]+", " ")
    df = df.withColumn(out, F.regexp_replace(blanks, PATTERN, _EXTRACT))
    return df.withColumn(out, F.when(F.contains(F.col(out), F.lit(_SEP)), F.split(F.col(out), _SEP)))


def _pick(parts: Column, letter: str) -> Column:
    """The text of a component, whichever branch gave it; null if none did."""
    return F.coalesce(*[F.nullif(parts[i], F.lit("")) for i, g in enumerate(_GROUPS) if g[0] == letter])


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic alone (years from 0)."""
    early = (m <= 2).cast("long")
    yy = y - early
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468


def days_in_month(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def with_instant(df: DataFrame, value: str, zone: str | None = None, day_first: str | None = None, out: str = "utc_micros") -> DataFrame:
    """Add column out: microseconds since 1970-01-01T00:00Z of the text in column value, or null.

    zone names a column with the IANA zone of values without one (null and no column: UTC; its names must be valid, so
    pass the small table they come from through canonical_zone first); day_first a boolean column for numeric dates that end in the year (null and no column: false). Dotted dates are day first.
    A two-digit year is 20xx, finer digits than microseconds are cut off, 24:00 ends the day.
    """
    t = "__wl_"
    zone_col = F.col(zone) if zone else F.lit(None).cast("string")
    first = F.coalesce(F.col(day_first), F.lit(False)) if day_first else F.lit(False)
    keep = df.columns
    df = components(df, value, t + "p")
    p = F.col(t + "p")
    number = lambda x: x.cast("long")
    month = _lookup({w: i + 1 for i, line in enumerate(MONTHS) for w in dict.fromkeys(line.split())})
    year_text = _pick(p, "y")
    u, v = number(_pick(p, "u")), number(_pick(p, "v"))
    fraction = F.rpad(F.coalesce(_pick(p, "f"), F.lit("")), 6, "0")
    df = df.withColumn(t + "zone", zone_col).withColumn(t + "first", first)
    by_day = F.col(t + "first") | (_pick(p, "q") == ".")
    df = df.select(
        *keep,
        F.col(t + "zone"),
        number(year_text).alias(t + "y0"),
        F.length(year_text).alias(t + "yl"),
        F.coalesce(number(_pick(p, "m")), F.try_element_at(month, F.lower(_pick(p, "n"))).cast("long"), F.when(by_day, v).otherwise(u)).alias(t + "m"),
        F.coalesce(number(_pick(p, "d")), F.when(by_day, u).otherwise(v)).alias(t + "d"),
        F.coalesce(number(_pick(p, "h")), F.lit(0).cast("long")).alias(t + "h0"),
        F.coalesce(number(_pick(p, "i")), F.lit(0).cast("long")).alias(t + "i"),
        F.coalesce(number(_pick(p, "s")), F.lit(0).cast("long")).alias(t + "s"),
        fraction.cast("long").alias(t + "f"),
        F.lower(F.left(_pick(p, "p"), F.lit(1))).alias(t + "half"),
        F.regexp_replace(_pick(p, "o"), "[:]", "").alias(t + "o"),
        F.lower(_pick(p, "a")).alias(t + "a"),
        F.coalesce(_pick(p, "r"), _pick(p, "b")).alias(t + "r"),
        _pick(p, "e").alias(t + "e"),
    )
    c = lambda n: F.col(t + n)
    year = F.when(c("yl") == 2, c("y0") + 2000).otherwise(c("y0"))
    hour = F.when(c("half").isNull(), c("h0")).otherwise(c("h0") % 12 + F.when(c("half") == "p", 12).otherwise(0))
    ends = (c("h0") == 24) & (c("i") == 0) & (c("s") == 0) & (c("f") == 0) & c("half").isNull()
    fits = (
        year.between(1, 9999) & c("m").between(1, 12) & c("d").between(1, days_in_month(year, c("m")))
        & F.when(c("half").isNull(), c("h0").between(0, 23) | ends).otherwise(c("h0").between(0, 12))
        & c("i").between(0, 59) & c("s").between(0, 59)
    )
    micro = F.lit(1_000_000).cast("long")
    local = (((days_from_civil(year, c("m"), c("d")) * 24 + hour) * 60 + c("i")) * 60 + c("s")) * micro + c("f")
    digits = F.length(F.regexp_replace(c("e"), "-", ""))
    number_e = c("e").cast("long")
    epoch = F.when(digits <= 11, number_e * 1_000_000 + c("f")).when(digits <= 14, number_e * 1000 + F.floor(c("f") / 1000)).otherwise(number_e)
    size = F.length(c("o"))
    sign = F.when(F.left(c("o"), F.lit(1)) == "+", 1).otherwise(-1)
    offset = F.when(size.isNotNull(), sign * (F.substring(c("o"), 2, 2).cast("long") * 60 + F.when(size > 3, F.substring(c("o"), 4, 2).cast("long")).otherwise(0)))
    offset_ok = size.isNull() | ((F.substring(c("o"), 2, 2).cast("int") <= 18) & ((size <= 3) | (F.substring(c("o"), 4, 2).cast("int") <= 59)))
    offset = F.coalesce(offset, F.try_element_at(_lookup(ZONES), F.coalesce(c("a"), F.when(F.lower(c("r")).isin(*ZONES), F.lower(c("r"))))).cast("long"))
    df = df.select(*keep, epoch.alias(t + "e"), F.when(fits & offset_ok, local).alias(t + "l"), offset.alias(t + "o"), F.coalesce(canonical_zone(c("r")), c("zone"), F.lit("UTC")).alias(t + "z"))
    zoned = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("l")), c("z")))
    instant = F.coalesce(c("e"), F.when(c("o").isNotNull(), c("l") - c("o") * 60 * 1_000_000).otherwise(zoned))
    # A generator is a barrier: without it the optimizer would push a filter on the result through every projection above
    # and copy the whole chain of expressions into it, once per reference.
    return df.withColumn(t + "x", instant).select(*keep, F.explode_outer(F.array(F.col(t + "x"))).alias(out))


def canonical_zone(name: Column) -> Column:
    """The IANA name in its own spelling, whatever the letter case; null where it is not known (so it never throws)."""
    import zoneinfo

    known = sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))
    known = [z for z in known if not z.startswith(("posix/", "right/", "Etc/GMT", "SystemV/"))]
    lower = F.lower(F.trim(name))
    if not known:
        return F.when(name.rlike("^[A-Za-z]+(/[A-Za-z_+-]+)+$|^UTC$"), name)
    return F.try_element_at(F.create_map(*[F.lit(x) for z in known for x in (z.lower(), z)]), lower)
