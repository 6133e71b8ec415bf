"""Request headers that a catalog gives for an entry, as maps.

A layer is a map of header to value. Null lines and null layers count as empty; blank values are kept only if asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanework.functions import urls

#: Option names and the headers they set.
OPTIONS = {"http-cookie": "Cookie", "http-referrer": "Referer", "http-user-agent": "User-Agent", "http-origin": "Origin"}
#: Headers with one spelling, by their names in lower case with dashes.
SPELLINGS = {
    "cookie": "Cookie",
    "referer": "Referer",
    "referrer": "Referer",
    "origin": "Origin",
    "user-agent": "User-Agent",
    "useragent": "User-Agent",
    "authorization": "Authorization",
    "accept": "Accept",
}


def canonical_name(name: Column) -> Column:
    text = F.trim(name)
    known = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.replace(F.lower(text), F.lit("_"), F.lit("-"))), text)


def _last_wins(pairs: Column) -> Column:
    """A map of (key, value) pairs in which the last pair of a name, in any case, counts."""
    later = lambda names, i: F.slice(names, i + 2, F.size(names))
    kept = lambda x: F.filter(x["pairs"], lambda _, i: ~F.array_contains(later(x["names"], i), F.get(x["names"], i)))
    named = lambda p: F.struct(p.alias("pairs"), F.transform(p, lambda y: F.lower(y["key"])).alias("names"))
    return F.map_from_entries(urls.bound(urls.bound(pairs, named), kept))


def _pair(name: Column, value: Column) -> Column:
    return F.struct(canonical_name(name).alias("key"), F.trim(value).alias("value"))


def _usable(pairs: Column, keep_blank: bool) -> Column:
    return F.filter(pairs, lambda x: (x["key"] != "") & x["value"].isNotNull() & (F.lit(keep_blank) | (x["value"] != "")))


def option_headers(lines: Column, keep_blank: bool = False) -> Column:
    """Layer of the player options of an entry; directives in any case."""
    told = F.filter(F.transform(_under(lines, "#EXTVLCOPT:"), lambda x: _cut(x, "=")), lambda x: x["name"] != "")
    known = F.create_map(*(F.lit(x) for pair in OPTIONS.items() for x in pair))
    meant = lambda x: F.when(x["name"] == "http-extra-headers", _cut(x["value"], ":")).otherwise(F.struct(F.coalesce(F.try_element_at(known, x["name"]), F.lit("")).alias("name"), x["value"].alias("value")))
    low = F.transform(told, lambda x: F.struct(F.lower(x["name"]).alias("name"), x["value"].alias("value")))
    given = F.filter(F.transform(low, meant), lambda x: x["name"] != "")
    return _last_wins(_usable(F.transform(given, lambda x: _pair(x["name"], x["value"])), keep_blank))


def _under(lines: Column, directive: str) -> Column:
    """What stands behind a directive, in any case, in the lines that have it; only these cost a regular expression."""
    trimmed = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x))
    own = F.filter(trimmed, lambda x: F.lower(F.substring(x, 1, len(directive))) == directive.lower())
    return F.transform(own, lambda x: F.regexp_extract(x, rf"(?i)^{directive}(.*)$", 1))


def _cut(text: Column, at: str) -> Column:
    """struct(name, value): what stands before and behind the first ``at``; both blank without one."""
    name = F.substring_index(text, at, 1)
    there = F.contains(text, F.lit(at))
    return F.struct(F.when(there, name).otherwise("").alias("name"), F.when(there, F.substr(text, F.length(name) + 2)).otherwise("").alias("value"))


def json_headers(lines: Column, keep_blank: bool = False) -> Column:
    """Layer of the JSON header lines of an entry; text that is no JSON object is skipped, without a trial if it never ends."""
    closed = F.filter(_under(lines, "#EXTHTTP:"), lambda x: F.contains(x, F.lit("}")))
    found = F.filter(F.transform(closed, lambda x: F.from_json(x, "map<string,string>")), lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(found, lambda x: F.transform(F.map_entries(x), lambda y: _pair(y["key"], y["value"]))))
    return _last_wins(_usable(pairs, keep_blank))


def merge_header_layers(*layers: Column, keep_blank: bool = False) -> Column:
    """One map of layers in rising precedence; names agree in any case and a blank value never replaces a value."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    listed = lambda m: F.transform(F.map_entries(F.coalesce(m, empty)), lambda x: _pair(x["key"], x["value"]))
    pairs = _usable(reduce(F.concat, [listed(m) for m in layers]), keep_blank)
    if not keep_blank:
        return _last_wins(pairs)
    filled = lambda p, x: F.exists(p, lambda y: (F.lower(y["key"]) == F.lower(x["key"])) & (y["value"] != ""))
    return _last_wins(urls.bound(pairs, lambda p: F.filter(p, lambda x: (x["value"] != "") | ~filled(p, x))))


def effective_headers(provider: Column, given: Column, defaults: dict[str, dict[str, str]], user_agent: str) -> Column:
    """Headers of a request: the provider's defaults, the entry's own over them, and a user agent if neither names one.

    defaults: a small fixed table, provider (upper case) to headers; other and null providers have none.
    """
    if not user_agent.strip():
        raise ValueError("a user agent is needed")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    layer = lambda h: F.create_map(*(F.lit(x) for pair in h.items() for x in pair)) if h else empty
    own = empty
    for name, values in defaults.items():
        own = F.when(F.upper(F.trim(provider)) == name, layer(values)).otherwise(own)
    return merge_header_layers(layer({"User-Agent": user_agent}), own, given)


def split_url_metadata(url: Column, decode: bool = True) -> Column:
    """struct(url, headers) of an address with ``|name=value&...`` behind it.

    decode: percent escapes are undone (a plus stays, a bad escape leaves the text as it is) and blank values go; else the
    texts stay, blank values too, and a lone question mark at the end of the address goes. Null counts as empty.
    """
    raw = F.trim(F.coalesce(url, F.lit("")))
    clean, behind = F.trim(F.split_part(raw, F.lit("|"), F.lit(1))), F.regexp_extract(raw, r"(?s)^[^|]*\|(.*)$", 1)
    if not decode:
        clean = F.when(F.contains(raw, F.lit("|")), F.regexp_replace(clean, r"\?$", "")).otherwise(clean)
    plain = (lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)) if decode else (lambda x: x)
    items = F.filter(F.split(behind, "&"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(items, lambda x: _pair(plain(F.regexp_extract(x, r"(?s)^([^=]*)=", 1)), plain(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1))))
    return F.struct(clean.alias("url"), _last_wins(_usable(pairs, not decode)).alias("headers"))


#: Headers that make a playback what it is, sorted.
PLAYBACK = ("authorization", "cookie", "origin", "referer")


def playback_fingerprint(url: Column, headers: Column) -> Column:
    """SHA-256 of the final address and four headers as one line of JSON in ASCII; '' without an address."""
    listed = F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    value = lambda n: F.coalesce(F.trim(F.try_element_at(F.filter(listed, lambda x: F.lower(F.trim(x["key"])) == n), F.lit(1))["value"]), F.lit(""))
    text = F.to_json(F.struct(F.trim(url).alias("final_manifest_url"), F.struct(*(value(n).alias(n) for n in PLAYBACK)).alias("headers")))
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    far = lambda c: F.ascii(c) - 65536
    escaped = lambda c: F.when(F.ascii(c) < 127, c).when(F.ascii(c) < 65536, unit(F.ascii(c))).otherwise(F.concat(unit(F.shiftright(far(c), 10) + 55296), unit(far(c) % 1024 + 56320)))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(F.sha2(F.array_join(F.transform(F.split(text, ""), escaped), ""), 256))
