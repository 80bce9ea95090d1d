"""Scalar functions of the atlas as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain() -> tuple[str, str]:
    """Accented letters and the ASCII letter that their decomposition begins with."""
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    pairs = {a: b for a, b in pairs.items() if b != a and b.isascii()}
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _plain()


def unaccented(x: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), "[̀-ͯ]", "")


def fold_term(x: Column) -> Column:
    """Lower case, without accents, letters and digits only: the key under which spellings meet. Plain ASCII has no
    accents to look for."""
    plain = lambda text: F.regexp_replace(text, "[^a-z0-9]+", "")
    return F.when(F.length(x) == F.octet_length(x), plain(F.lower(x))).otherwise(plain(unaccented(x)))


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unaccented(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_case(x: Column) -> Column:
    """Each run of a-z and 0-9 with its first letter in upper case; other characters stay."""
    runs = F.regexp_extract_all(x, F.lit("([a-z0-9]+|[^a-z0-9]+)"), 1)
    upper = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(runs, lambda p: F.when(F.rlike(p, F.lit("^[a-z0-9]")), upper(p)).otherwise(p)), "")


def parse_tag_list(x: Column) -> Column:
    """Quoted phrases and words, unquoted, trimmed, in lower case, longer than one character."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r'"[^"]+"|\S+'), 0)
    plain = F.transform(found, lambda t: F.lower(F.trim(F.regexp_replace(t, '^"|"$', ""))))
    return F.filter(plain, lambda t: F.length(t) > 1)


def urn_to_id(urn: Column) -> Column:
    digits = F.regexp_extract(F.element_at(F.split(urn, ":"), -1), r"^\s*(\d+)", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0))


def format_duration(ms: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(
        F.concat(m.cast("string"), F.lit(":"), two(r))
    )


def rounded(x: Column, digits: int) -> Column:
    """Half up, towards positive infinity, by one formula that all engines share."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def format_count(n: Column) -> Column:
    """950, 2.3k, 1.2M; a trailing .0 is left out."""
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.1f", rounded(n / d, 1)), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1000, short(1000, "k")).otherwise(n.cast("string"))


def relative_time(then: Column, now: Column) -> Column:
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)
    many = lambda unit, n: F.concat(F.floor(days / n).cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(days < 1, "today").when(days < 2, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 14, "last week").when(days < 30, many("weeks", 7)).when(days < 60, "last month").when(days < 365, many("months", 30))
        .when(days < 730, "last year").otherwise(many("years", 365))
    )


def within_last_day(then: Column, now: Column) -> Column:
    """Whether less than 24 hours have gone by; null of what is no time."""
    return F.unix_timestamp(now) - F.unix_timestamp(then) < 86400


def activity_line(day: Column, week: Column) -> Column:
    return F.when(day > 0, "active now").when(week > 0, F.concat(week.cast("string"), F.lit(" this week")))


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise((longer - F.levenshtein(a, b)) / longer)


def running_sums(values: Column, chunk: int = 512) -> Column:
    """The sum of an array's integers before each of them, as longs. Arrays are summed up in chunks, as one that grows
    value by value costs the square of their number."""
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")), lambda i: F.slice(values, i * chunk + 1, F.lit(chunk)))
    inner = F.transform(chunks, lambda c: F.aggregate(c, start, step))
    moved = lambda told: F.flatten(
        F.zip_with(told, F.aggregate(F.transform(told, lambda x: x["at"]), start, step, lambda s: s["out"]), lambda x, by: F.transform(x["out"], lambda v: v + by))
    )
    return F.when(F.size(values) > 0, F.element_at(F.transform(F.array(inner), moved), 1)).otherwise(none)


def _compatible() -> tuple[str, str]:
    """Characters that compatibility composition turns into one ASCII character, and that one."""
    pairs = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200))}
    pairs = {a: b for a, b in pairs.items() if len(b) == 1 and b.isascii()}
    return "".join(pairs), "".join(pairs.values())


STYLED, UNSTYLED = _compatible()


def unstyled(x: Column) -> Column:
    """x with letters, digits and signs in styles (bold, double-struck, full width, circled, ...) as plain ASCII ones, and
    ligatures of f and s parted."""
    plain = F.translate(x, STYLED, UNSTYLED)
    parted = plain
    for c in range(0xFB00, 0xFB07):
        parted = F.replace(parted, F.lit(chr(c)), F.lit(unicodedata.normalize("NFKC", chr(c))))
    return F.when(F.rlike(plain, F.lit("[\uFB00-\uFB06]")), parted).otherwise(plain)
