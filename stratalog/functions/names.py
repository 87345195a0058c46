"""File name expressions: stems, suffixes, brackets, cleaning, derived names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that no file name may hold, and what stands for each; full-width brackets.
ILLEGAL, STAND_IN = '\\/:*?"<>|', "-" * 9
WIDE_BRACKETS, BRACKETS = "【】［］", "[][]"
ARCHIVE_EXTENSION = ".zipmod"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stem(name: Column | str) -> Column:
    """Before the last dot; a dot in front doesn't count."""
    n = _c(name)
    return F.when(n.rlike(r"(?s)^.+\.[^.]*$"), F.regexp_extract(n, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(n)


def suffix(name: Column | str) -> Column:
    """From the last dot on; null if there is none."""
    return F.nullif(F.regexp_extract(_c(name), r"(?s)^.+(\.[^.]*)$", 1), F.lit(""))


def normal_suffix(text: Column | str) -> Column:
    t = F.trim(_c(text))
    return F.when((t == "") | t.startswith("."), t).otherwise(F.concat(F.lit("."), t))


def bracketed(name: Column | str) -> Column:
    """Between the first [ and the next ]; null if empty or missing."""
    return F.nullif(F.regexp_extract(_c(name), r"(?s)^[^\[]*\[([^\]]*)\]", 1), F.lit(""))


def sanitized(name: Column | str) -> Column:
    return F.translate(_c(name), ILLEGAL, STAND_IN)


def narrow_brackets(name: Column | str) -> Column:
    return F.translate(_c(name), WIDE_BRACKETS[:2], BRACKETS[:2])


def without_number(name: Column | str) -> Column:
    """Without one ` (digits)` at the end."""
    return F.regexp_replace(_c(name), r" \([0-9]+\)$", "")


def family(name: Column | str) -> Column:
    """Without any ` (digits)` at the end, however many: names that can collide share it."""
    return F.regexp_replace(_c(name), r"( \([0-9]+\))+$", "")


def identity_name(guid: Column | str, author: Column | str, version: Column | str) -> Column:
    """[author] guid-version; a guid that starts with a bracket stands alone; the version isn't cleaned."""
    g, a, v = narrow_brackets(F.trim(_c(guid))), narrow_brackets(F.trim(_c(author))), F.trim(_c(version))
    g, a = F.coalesce(g, F.lit("")), F.coalesce(a, F.lit(""))
    named = F.concat(F.lit("["), F.when(a == "", F.lit("unknown")).otherwise(a), F.lit("] "), F.when(g == "", F.lit("unknown")).otherwise(g))
    base = sanitized(F.when(g.startswith("["), g).otherwise(named))
    return F.when(F.coalesce(v, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("-"), v))


def folder_name(tag: Column | str) -> Column:
    """A tag as a folder: cleaned, trimmed, then without dots at either end, and each run of white space a blank. A blank that stood
    beside a dot stays."""
    t = F.regexp_replace(sanitized(tag), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"^\.+|\.+$", "")
    return F.regexp_replace(t, r"(?U)\s+", " ")


def digit_id(name: Column | str, low: int = 8, high: int = 9) -> Column:
    """The first run of exactly low to high digits with none next to it; null if there is none."""
    return F.nullif(F.regexp_extract(_c(name), r"(?:^|\D)(\d{%d,%d})(?:\D|$)" % (low, high), 1), F.lit(""))


def without_game(xml: Column | str, keyword: Column | str) -> Column:
    """The text without <game>keyword</game>, case as given."""
    k = F.lit(keyword) if isinstance(keyword, str) else keyword
    return F.replace(_c(xml), F.concat(F.lit("<game>"), k, F.lit("</game>")), F.lit(""))


def is_archive(name: Column | str) -> Column:
    return F.lower(_c(name)).rlike(r"\.(zip|zipmod)$")


def preview_kind(name: Column | str) -> Column:
    e = F.lower(F.coalesce(suffix(name), F.lit("")))
    return F.when(e.isin(".txt", ".md", ".json", ".csv", ".log"), F.lit("text")).when(e.isin(".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"), F.lit("image")).when(e.isin(".zip", ".zipmod"), F.lit("archive")).otherwise(F.lit("unsupported"))
