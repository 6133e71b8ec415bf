"""Parts of addresses that name a feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generic form of RFC 3986, appendix B.
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def without_suffix(url: Column) -> Column:
    """The address without what follows a bar."""
    return F.trim(F.substring_index(F.trim(F.coalesce(url, F.lit(""))), "|", 1))


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, URL, n)


#: A path's parts after scheme and host, trailing slashes apart; in the second form also a last part with a suffix.
PATH = r"^[^:/?#]+://[^/?#]+((?:/+[^/?#]+)*)"
PATH_BUT_LEAF = r"(?s)^[^:/?#]+://[^/?#]+((?:/+[^/?#]+)*?)(?:/+[^/?#]*\.[^./?#]+)?/*(?:[?#].*)?\z"


def path_or_null(url: Column, drop_leaf: bool) -> Column:
    """As canonical_path, but null instead of empty. Each value is used once, so a row costs two regular expressions, whatever the plan inlines."""
    parts = F.regexp_extract(without_suffix(url), PATH_BUT_LEAF if drop_leaf else PATH, 1)
    return F.nullif(F.regexp_replace(parts, "/{2,}", "/"), F.lit(""))


def canonical_path(url: Column, drop_leaf: bool) -> Column:
    """The path without doubled slashes and, if wanted, without a last part that has a suffix; empty without scheme and host."""
    return F.coalesce(path_or_null(url, drop_leaf), F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once; and kept out of the compiled code, which stays small enough to be compiled to the end. For what few rows need."""
    return F.transform(F.array(value), use)[0]


def opaque_key(url: Column) -> Column:
    """A strict key of an address without a usable path: its hash, or the text itself if it has no host."""

    def key(text: Column) -> Column:
        path = F.regexp_replace(part(text, 3), "/{2,}", "/")
        query = part(text, 4)
        plain = F.concat(F.lower(part(text, 1)), F.lit("://"), F.lower(part(text, 2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
        return F.when((part(text, 1) != "") & (part(text, 2) != ""), F.concat(F.lit("opaque-url:"), F.sha2(plain, 256))).otherwise(F.concat(F.lit("literal:"), text))

    return bound(without_suffix(url), key)


def stream_type(url: Column) -> Column:
    path = F.lower(part(without_suffix(url), 3))
    return F.when(path.contains(".mpd"), "DASH").when(path.contains(".m3u8"), "HLS").otherwise("")


def auth_expiry(*texts: Column) -> Column:
    """The earliest of all expiry stamps in the texts, null if there is none."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(?i)(?:^|[?&~=;])(?:exp|expires)=(\d+)"), F.lit(1)) for t in texts)))
    return F.array_min(F.transform(found, lambda x: x.try_cast("bigint")))


def manifest_type(text: Column) -> Column:
    """HLS, DASH or '' by what a manifest says."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")
    return F.when(body.startswith("#EXTM3U"), "HLS").when(body.rlike(r"(?i)<(?:[a-z_][\w.-]*:)?MPD\b"), "DASH").otherwise("")


def join(base: Column, uri: Column) -> Column:
    """The address that a reference in the document at ``base`` means (RFC 3986, section 5.2); the reference itself where base has no scheme.

    Both are taken apart once a row, and the parts bound before they are used.
    """
    parts = lambda url: F.array(*(part(url, n) for n in range(1, 6)))

    def resolved(x: Column) -> Column:
        (scheme, host, above, query, _), (own_scheme, own_host, path, own_query, fragment) = ([x[side][n] for n in range(5)] for side in ("base", "own"))
        put = lambda path: F.when(path.startswith("/"), path).when(path == "", above).otherwise(F.concat(F.regexp_extract(above, r"^(.*/)", 1), path))

        def cleaned(pieces: Column) -> Column:
            kept = F.aggregate(F.filter(pieces, lambda p: p != "."), F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(p))))
            return F.concat(F.array_join(kept, "/"), F.when(F.element_at(pieces, -1).isin(".", ".."), "/").otherwise(""))

        clean = bound(F.split(put(path), "/"), cleaned)
        rooted = bound(clean, lambda c: F.when(c.startswith("/") | ((c == "") & (path == "")), c).otherwise(F.concat(F.lit("/"), c)))
        rest = F.concat(F.when(own_query != "", F.concat(F.lit("?"), own_query)).when((path == "") & (query != ""), F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
        whole = F.concat(scheme, F.lit("://"), F.when(own_host != "", F.concat(own_host, path)).otherwise(F.concat(host, rooted)), rest)
        return F.when((own_scheme != "") | (scheme == ""), x["uri"]).otherwise(whole)

    given = F.struct(F.coalesce(base, F.lit("")).alias("base"), F.trim(F.coalesce(uri, F.lit(""))).alias("uri"))
    return bound(bound(given, lambda g: F.struct(parts(g["base"]).alias("base"), parts(g["uri"]).alias("own"), g["uri"].alias("uri"))), resolved)
