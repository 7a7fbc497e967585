"""Column expressions for names, labels and texts shown to readers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions.geo import js_round

#: Spelt out in names before accents go.
LETTERS = (("þ", "th"), ("ð", "d"), ("æ", "ae"), ("ö", "o"), ("ø", "o"))


@lru_cache
def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter and marks, and those letters, by the rule of Unicode."""
    marked, plain = [], []
    for ch in map(chr, range(0xC0, 0x30000)):
        if (d := unicodedata.decomposition(ch)) and not d.startswith("<"):
            base = [c for c in unicodedata.normalize("NFD", ch) if not unicodedata.category(c).startswith("M")]
            if len(base) == 1:
                marked.append(ch)
                plain.append(base[0])
    return "".join(marked), "".join(plain)


def normalize(s: Column) -> Column:
    """Lower case without accents; every run of other than letters and digits is one blank.

    Accents go by canonical decomposition. Hangul syllables, which would fall into their letters, stay whole.
    """
    s = F.lower(s)
    for a, b in LETTERS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(s, *_accents()), r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " "))


def title_case(s: Column) -> Column:
    """Capitals only at starts of words (also after a hyphen), for names that are all capitals; others stay."""
    parts = F.transform(F.split(s, " "), lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "-"))
    return F.when((s == F.upper(s)) & (s != F.lower(s)), F.array_join(parts, " ")).otherwise(s)


def road_label(name: Column) -> Column:
    """How a road's name is said: numbers as roads, F-roads in one word, other names in title case; empty names are unknown."""
    name = F.when(name != "", F.trim(name))
    return F.when(name.rlike(r"^\d+$"), F.concat(F.lit("road "), name)).when(name.rlike(r"(?i)^f\s?\d+$"), F.upper(F.regexp_replace(name, r"\s", ""))).otherwise(title_case(name))


def one_decimal(x: Column) -> Column:
    """x, not below nought, with one decimal: the nearer one to its exact binary value, and the upper of two as near.

    The doubt is only where x is the double next to a half: twenty times that double, less its odd numerator, is exact in
    two steps, and its sign tells on which side of the half it lies.
    """
    k = js_round(x * 10)
    odd = (2 * k - 1).cast("double")
    half = odd / 20
    up = (x > half) | ((x == half) & ((half * 16 - odd) + half * 4 >= 0))
    n = F.when(up, k).otherwise(k - 1)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def search_distance(km: Column) -> Column:
    """Tens of metres below 1 km, one decimal below 10 km, then whole kilometres."""
    return (
        F.when(km < 1, F.concat(F.greatest(F.lit(10), js_round(km * 1000 / 10) * 10).cast("string"), F.lit(" m")))
        .when(km < 10, F.concat(one_decimal(km), F.lit(" km")))
        .otherwise(F.concat(js_round(km).cast("string"), F.lit(" km")))
    )


def stats_distance(metres: Column) -> Column:
    return (
        F.when(metres < 1000, F.concat(js_round(metres).cast("string"), F.lit(" m")))
        .when(metres < 10000, F.concat(one_decimal(metres / 1000), F.lit(" km")))
        .otherwise(F.concat(js_round(metres / 1000).cast("string"), F.lit(" km")))
    )


def stats_duration(ms: Column) -> Column:
    """Minutes, hours and minutes, one day and hours, or from two days on whole days, rounded."""
    minutes = js_round(ms / 60000)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min")))
        .when(minutes < 1440, F.concat(hours.cast("string"), F.lit(" h"), F.when(minutes % 60 > 0, F.concat(F.lit(" "), (minutes % 60).cast("string"), F.lit(" min"))).otherwise("")))
        .when(hours < 48, F.concat(F.lit("1 day"), F.when(hours > 24, F.concat(F.lit(" "), (hours - 24).cast("string"), F.lit(" h"))).otherwise("")))
        .otherwise(F.concat(js_round(hours / 24).cast("string"), F.lit(" days")))
    )


def clean_file_name(s: Column, default: str = "Route") -> Column:
    kept = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N} _-]+", " "), " +", " "))
    return F.when(kept == "", default).otherwise(kept)


def unescape(s: Column) -> Column:
    """The five named entities in any case and numeric ones, decimal or hexadecimal, each read once.

    Text is cut before each ampersand, and each part begins with an entity or doesn't. Numbers that name no character stay.
    """
    named = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"))

    def part(p: Column) -> Column:
        name, rest = F.lower(F.regexp_extract(p, r"^&([A-Za-z]{2,4});", 1)), F.regexp_extract(p, r"(?s)^&[^;]*;(.*)$", 1)
        digits, sixteen = F.regexp_extract(p, r"^&#([0-9]{1,7});", 1), F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.when(digits != "", digits.try_cast("long")).when(sixteen != "", F.conv(sixteen, 16, 10).try_cast("long"))
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        found = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for n, c in named:
            found = F.coalesce(found, F.when(name == n, c))
        return F.coalesce(F.concat(found, rest), p)

    return F.when(F.contains(s, F.lit("&")), F.array_join(F.transform(F.split(s, "(?=&)"), part), "")).otherwise(s)


def escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s
