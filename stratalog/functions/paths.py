"""Path expressions. Both separators are understood; results use `/`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def friendly(path: Column | str) -> Column:
    """Without the verbatim prefixes \\\\?\\ and \\\\?\\UNC\\."""
    p = F.regexp_replace(_c(path), r"^\\\\\?\\UNC\\", r"\\\\")
    return F.regexp_replace(p, r"^\\\\\?\\", "")


def extended(path: Column | str) -> Column:
    """With the verbatim prefix: drive paths get \\\\?\\, network paths \\\\?\\UNC\\; others stay."""
    p = _c(path)
    network = F.concat(F.lit("\\\\?\\UNC\\"), F.regexp_replace(p, r"^\\\\", ""))
    return F.when(p.rlike(r"^\\\\\?\\"), p).when(p.rlike(r"^\\\\"), network).when(p.rlike(r"^[A-Za-z]:\\"), F.concat(F.lit("\\\\?\\"), p)).otherwise(p)


def slashed(path: Column | str) -> Column:
    """Backslashes as slashes, without those at the end (a lone root stays)."""
    p = F.translate(_c(path), "\\", "/")
    return F.when(p.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(p, "/+$", ""))


def key(path: Column | str) -> Column:
    """What paths are compared by: slashed and lower case."""
    return F.lower(slashed(path))


def basename(path: Column | str) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def parent(path: Column | str) -> Column:
    return F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)


def extension(path: Column | str) -> Column:
    """Lower case without the dot; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)), F.lit(""))


def components(path: Column | str) -> Column:
    """The normal components: none of them empty, `.` or `..`."""
    return F.filter(F.split(slashed(path), "/"), lambda x: ~x.isin("", ".", ".."))


def depth(path: Column | str) -> Column:
    return F.size(components(path))


def ancestors(path: Column | str, with_self: bool = False) -> Column:
    """Every proper ancestor of a slashed path, shortest first; with_self adds the path."""
    parts = F.split(slashed(path), "/")
    last = F.size(parts) if with_self else F.size(parts) - 1
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda x: (x != "") & (F.lit(with_self) | (x != slashed(path))))


def same_or_below(path: Column | str, top: Column | str) -> Column:
    p, t = key(path), key(top)
    return (p == t) | p.startswith(F.concat(t, F.lit("/")))


def below(path: Column | str, top: Column | str) -> Column:
    return key(path).startswith(F.concat(key(top), F.lit("/")))


def relative_to(path: Column | str, top: Column | str) -> Column:
    """The folders between top and the file's name, compared part by part; null if it isn't below."""
    p, t = components(parent(path)), components(top)
    below_ = F.transform(F.slice(p, 1, F.size(t)), F.lower) == F.transform(t, F.lower)
    return F.when(below_ & (F.size(p) >= F.size(t)), F.array_join(F.slice(p, F.size(t) + 1, F.greatest(F.size(p) - F.size(t), F.lit(0))), "/"))


def join(*parts: Column | str) -> Column:
    """Parts joined by single slashes; null and empty parts are left out."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    first = F.regexp_replace(cols[0], "/+$", "")
    return F.concat_ws("/", *[F.nullif(c, F.lit("")) for c in (first, *cols[1:])])


def url(base: Column | str, id_: Column | str) -> Column:
    """base and id with exactly one slash between."""
    return F.concat(F.regexp_replace(_c(base), "/$", ""), F.lit("/"), _c(id_))


def longest_first(roots: Column) -> Column:
    return F.array_sort(roots, lambda a, b: F.length(b) - F.length(a))
