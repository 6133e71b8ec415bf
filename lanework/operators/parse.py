"""Catalog documents to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.functions import urls


def quoted(line: Column, name: str) -> Column:
    """Value of a quoted attribute, double quotes first; the name in any case."""
    double = F.regexp_extract(line, rf'(?i){name}="([^"]*)"', 1)
    single = F.regexp_extract(line, rf"(?i){name}='([^']*)'", 1)
    return F.when(double != "", double).otherwise(single)


def parse_extinf(line: Column) -> Column:
    """struct(tvg_name, group_title, entry_title): the title follows the first comma after the last quoted attribute."""
    rest = F.regexp_replace(line, r"""^.*=(?:"[^"]*"|'[^']*')""", "")
    title = F.trim(F.regexp_extract(rest, r"^[^,]*,(.*)$", 1))
    return F.struct(quoted(line, "tvg-name").alias("tvg_name"), quoted(line, "group-title").alias("group_title"), title.alias("entry_title"))


def explode_entries(documents: DataFrame) -> DataFrame:
    """(url, entry_index, tvg_name, group_title, entry_title, options, stream_url): one row per #EXTINF block of each text.

    Higher-order functions cut a text within its row, so documents are not shuffled; entries without an address stay.
    """
    blocks = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_replace("text", r"\r\n?", "\n")), r"\n[ \t]*(?=#EXTINF:)"), 2, 1 << 30)
    rows = documents.select("url", F.posexplode(blocks).alias("at", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("lines", lines)
    tail = F.slice("lines", 2, 1 << 30)
    links = F.filter(tail, lambda x: x.rlike("(?i)^https?://"))
    place = F.when(F.size(links) > 0, F.array_position(tail, F.element_at(links, 1))).otherwise(F.size(tail) + 1)
    found = rows.select("url", (F.col("at") + 1).alias("entry_index"), parse_extinf(F.element_at("lines", 1)).alias("x"), F.array_join(F.slice(tail, F.lit(1), place - 1), "\n").alias("options"), F.coalesce(F.try_element_at(links, F.lit(1)), F.lit("")).alias("stream_url"))
    return found.select("url", "entry_index", "x.*", "options", "stream_url")


def semantic_hash(text: Column) -> Column:
    """SHA-256 of the #EXTINF lines and of the addresses without query, fragment and suffix; of the whole text if it has none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: x.startswith("#EXTINF:") | x.rlike("(?i)^https?://"))
    plain = F.transform(kept, lambda x: F.when(x.startswith("#EXTINF:"), x).otherwise(F.regexp_replace(x, r"[?#|].*$", "")))
    return F.sha2(F.when(F.size(plain) > 0, F.array_join(plain, "\n")).otherwise(text), 256)


def page_identity(pages: DataFrame) -> DataFrame:
    """Key, label and kind of real addresses."""
    u = F.col("url")
    return pages.select("page_id", urls.canonical_path(u, True).alias("lane"), urls.canonical_path(u, False).alias("path"), F.lower(urls.part(u, 2)).alias("host"), urls.stream_type(u).alias("stream_type"), F.substring(urls.opaque_key(u), 1, 11).alias("key_kind"))
