"""Bits, times, sizes, JSON payloads and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD = "error boolean, message string, body struct<tags: struct<tags: array<struct<tag: string, translation: struct<en: string>>>>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# bits and hashes


def content_hash(content: Column | str) -> Column:
    return F.sha2(_c(content), 256)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits that differ between arrays of 64-bit words of equal length; null if lengths differ."""
    x, y = _c(a), _c(b)
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v))


def hash_bits(side: Column | int) -> Column:
    s = F.greatest(F.lit(side) if isinstance(side, int) else side, F.lit(4))
    return s * s


def allowed_distance(bits: Column, threshold: Column) -> Column:
    """Bits that may differ at a similarity of `threshold` percent, kept between 0 and 100."""
    t = F.least(F.greatest(threshold, F.lit(0)), F.lit(100))
    return F.floor(bits * (F.lit(100) - t) / 100).cast("int")


def similarity(distance: Column, bits: Column) -> Column:
    s = F.round(F.lit(100.0) - distance * 100.0 / bits)
    return F.when(bits == 0, F.lit(100)).otherwise(F.least(F.greatest(s, F.lit(0)), F.lit(100)).cast("int"))


def sign_words(vector: Column | str) -> Column:
    """64-bit words with bit i of word k set where element 64 * k + i is above 0."""

    def words(v: Column) -> Column:
        bit = lambda i: F.when(F.get(v, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))).otherwise(F.lit(0).cast("long"))
        word = lambda k: F.aggregate(F.sequence(k * 64, k * 64 + 63), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(bit(i)))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 64).cast("int") - 1), word)

    return once(_c(vector), words)


# times


def file_seconds(ts: Column | str) -> Column:
    return F.coalesce(F.unix_seconds(_c(ts).cast("timestamp")), F.lit(0).cast("long"))


def created_or_changed(ctime: Column | str, mtime: Column | str) -> Column:
    c = _c(ctime)
    return F.when(c.isNull() | (c == 0), _c(mtime)).otherwise(c)


def record_name(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd_HH-mm-ss")


def time_text(seconds: Column | str) -> Column:
    s = _c(seconds)
    return F.when(s.isNull() | (s == 0), F.lit("-")).otherwise(F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm:ss"))


def dos_time(date: Column | str, time: Column | str) -> Column:
    """Text of an archive's date and time words; empty where they name no time."""
    d, t = _c(date).cast("int"), _c(time).cast("int")
    part = lambda x, shift, mask: F.shiftright(x, shift).bitwiseAND(F.lit(mask))
    ts = F.try_make_timestamp(part(d, 9, 127) + 1980, part(d, 5, 15), part(d, 0, 31), part(t, 11, 31), part(t, 5, 63), (part(t, 0, 31) * 2).cast("decimal(8,6)"))
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


# sizes and messages


def size_text(size: Column | str) -> Column:
    b = _c(size).cast("double")
    return (
        F.when(b < 1024, F.concat(b.cast("long").cast("string"), F.lit(" B")))
        .when(b < 1024**2, F.format_string("%.2f KB", b / 1024))
        .when(b < 1024**3, F.format_string("%.2f MB", b / 1024**2))
        .otherwise(F.format_string("%.2f GB", b / 1024**3))
    )


def http_text(code: Column | str) -> Column:
    c = _c(code)
    return F.when(c == 404, F.lit("not found")).when(c == 403, F.lit("access denied")).when(c == 429, F.lit("too many requests")).otherwise(F.concat(F.lit("HTTP "), c.cast("string")))


def error_text(chain: Column | str) -> Column:
    """A chain of causes in one line."""
    return F.array_join(F.filter(_c(chain), lambda x: x.isNotNull() & (x != "")), " -> ")


# payloads


def once(value: Column, use) -> Column:
    """use(value) where value is computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def last_of_each(pairs: Column) -> Column:
    """A map of array<struct<key, value>>: of entries with one key the last counts."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def payload(json: Column | str) -> Column:
    """struct<tags, translations, error> of a tag payload; text that is no JSON is an error."""

    def read(p: Column) -> Column:
        raw = p["body"]["tags"]["tags"]
        kept = F.filter(raw, lambda t: F.trim(F.coalesce(t["tag"], F.lit(""))) != "")
        told = F.filter(F.transform(kept, lambda t: F.struct(t["tag"].alias("key"), F.trim(t["translation"]["en"]).alias("value"))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
        error = F.when(F.coalesce(p["error"], F.lit(False)), F.coalesce(F.nullif(p["message"], F.lit("")), F.lit("request failed"))).when(raw.isNull(), F.lit("no tags"))
        ok = error.isNull()
        return F.struct(F.when(ok, F.transform(kept, lambda t: t["tag"])).alias("tags"), F.when(ok, last_of_each(told)).alias("translations"), error.alias("error"))

    return once(F.from_json(_c(json), PAYLOAD), read)


def text_list(json: Column | str) -> Column:
    return F.coalesce(F.from_json(_c(json), "array<string>"), F.array().cast("array<string>"))


def text_map(json: Column | str) -> Column:
    return F.coalesce(F.from_json(_c(json), "map<string,string>"), F.create_map().cast("map<string,string>"))


def imported_list(text: Column | str) -> Column:
    """A JSON array, an object with `tags`, or text split at ; , and line breaks (either width)."""
    t = _c(text)
    split = F.split(t, "[;,；，\r\n]+")
    found = F.coalesce(F.from_json(t, "array<string>"), F.when(t.rlike(r"^\s*\{"), F.from_json(t, "tags array<string>")["tags"]), split)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def imported_pairs(text: Column | str) -> Column:
    """A JSON object, one under `translations`, a JSON array of pairs or of objects (tag, original or key; translation,
    value or display), or lines `key=value` (or tab, or comma of either width); # starts a comment."""
    entry = lambda k, v: F.struct(F.trim(k).alias("key"), F.trim(v).alias("value"))
    first = lambda m, *names: F.coalesce(*[F.element_at(m, n) for n in names])

    def item(x: Column) -> Column:
        pair, fields = F.from_json(x, "array<string>"), F.from_json(x, "map<string,string>")
        named = entry(first(fields, "tag", "original", "key"), first(fields, "translation", "value", "display"))
        return F.when(x.startswith("["), entry(F.get(pair, 0), F.get(pair, 1))).when(x.startswith("{"), named)

    t = F.trim(_c(text))
    line = r"^(.+?)[\t=,，](.+)$"
    lines = F.filter(F.transform(F.split(t, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(line) & ~x.startswith("#"))
    of_lines = F.transform(lines, lambda x: entry(F.regexp_extract(x, line, 1), F.regexp_extract(x, line, 2)))
    of_map = lambda m: F.transform(F.map_entries(m), lambda e: entry(e["key"], e["value"]))
    whole, nested = F.from_json(t, "map<string,string>"), F.from_json(t, "translations map<string,string>")["translations"]
    items = F.from_json(t, "array<string>")
    found = F.when(t.startswith("{") & nested.isNotNull(), of_map(nested)).when(t.startswith("{") & whole.isNotNull(), of_map(whole)).when(t.startswith("[") & items.isNotNull(), F.transform(items, item)).otherwise(of_lines)
    full = F.filter(found, lambda e: (F.coalesce(e["key"], F.lit("")) != "") & (F.coalesce(e["value"], F.lit("")) != ""))
    return last_of_each(F.coalesce(full, F.array().cast("array<struct<key:string,value:string>>")))


def extension_list(text: Column | str) -> Column:
    parts = F.transform(F.split(_c(text), r"[,;，；\s]+"), lambda x: F.lower(F.regexp_replace(F.trim(x), r"^\.+", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


# tags


def shown(tag: Column, local: Column, remote: Column) -> Column:
    """The local translation, else the remote one, else the tag."""
    pick = lambda m: F.nullif(F.element_at(m, tag), F.lit(""))
    return F.coalesce(pick(local), pick(remote), tag)


def display_tags(tags: Column, local: Column, remote: Column, excluded: Column, translate: Column, locale: str | None = None) -> Column:
    """Sorted array<struct<display, tag>> without those whose tag or display is excluded; by bytes, or in the order of a locale
    (UNICODE, en, de, ... as Spark's collations have it)."""
    pairs = F.transform(tags, lambda t: F.struct(F.when(translate, shown(t, local, remote)).otherwise(t).alias("display"), t.alias("tag")))
    kept = F.filter(pairs, lambda p: ~F.array_contains(excluded, p["display"]) & ~F.array_contains(excluded, p["tag"]))
    if locale is None:
        return F.array_sort(kept)
    keyed = F.transform(kept, lambda p: F.struct(F.collate(p["display"], locale).alias("key"), p["display"].alias("display"), p["tag"].alias("tag")))
    return F.transform(F.array_sort(keyed), lambda p: F.struct(p["display"].alias("display"), p["tag"].alias("tag")))


def every(values: Column, test) -> Column:
    """All of at least one."""
    return (F.size(values) > 0) & F.forall(values, test)


# limits of parallel work


def clamped(value: Column, low: Column | int, high: Column | int) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, c(low)), c(high))


def thread_count(configured: Column, cpus: Column) -> Column:
    """What is configured, up to the processors; all of them where nothing is."""
    return F.when(F.coalesce(configured, F.lit(0)) > 0, F.greatest(F.least(configured, cpus), F.lit(1))).otherwise(F.greatest(cpus, F.lit(1)))


def io_permits(threads: Column, multiplier: Column) -> Column:
    """Threads times the multiplier: 1 to 16, 2 where it isn't set."""
    return threads * F.when(F.coalesce(multiplier, F.lit(0)) >= 1, F.least(multiplier, F.lit(16))).otherwise(F.lit(2))


def image_chunk(workers: Column) -> Column:
    return clamped(workers * 16, 256, 2048)
