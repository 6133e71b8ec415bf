"""JSON catalogs to entries.

A value that is itself an object or a list counts as missing; such a value is known by its first character and by being
valid JSON. A text that is null, no JSON, or holds no record list gives no entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the list of records, in order of preference.
LISTS = ("channels", "streams", "items", "entries", "data")
#: Names of a record's fields, in order of preference.
FIELDS = {
    "name": ("name", "channel_name", "channel", "title"),
    "stream_url": ("stream_url", "stream", "url", "link"),
    "id": ("id", "channel_id", "tvg_id", "tvg-id"),
    "group_title": ("group_title", "group", "category"),
}


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[- ]", "_")


def _value(record: Column, aliases: tuple[str, ...], first_wins: bool) -> Column:
    """Value of the first alias that the record has; of names that differ in spelling only, the first or the last."""
    at = F.lit(1 if first_wins else -1)
    named = lambda alias: F.filter(F.map_entries(record), lambda x: _plain(x["key"]) == alias.replace("-", "_"))
    return F.try_element_at(F.flatten(F.array(*(F.when(F.size(named(a)) > 0, F.array(F.try_element_at(named(a), at))).otherwise(F.array().cast("array<struct<key:string,value:string>>")) for a in aliases))), F.lit(1))["value"]


def _text(value: Column) -> Column:
    nested = value.rlike(r"^\s*[\[{]") & F.get_json_object(value, "$").isNotNull()
    return F.when(value.isNull() | nested, "").otherwise(F.trim(F.regexp_replace(value, r"[\r\n]", " ")))


def record_list(text: Column) -> Column:
    """JSON text of the record list: the root, or the first of the known names that holds a list; null if there is none."""
    root = F.from_json(text, "map<string,string>")
    under = lambda name: F.try_element_at(F.filter(F.map_entries(root), lambda x: _plain(x["key"]) == name), F.lit(-1))["value"]
    return F.when(text.rlike(r"^\s*\["), text).otherwise(F.coalesce(*(F.when(under(n).rlike(r"^\s*\["), under(n)) for n in LISTS)))


def explode_json_entries(documents: DataFrame, profile: str = "normalized") -> DataFrame:
    """(url, entry_index, name, stream_url, id, group_title): one row per record of each catalog.

    normalized keeps records without an address and lets the last of clashing names count; mature needs an address and
    lets the first count. Records that are no objects are left out; entry_index counts all records from 1.
    """
    if profile not in ("normalized", "mature"):
        raise ValueError(f"no such profile: {profile}")
    records = F.from_json(record_list(F.col("text")), "array<string>")
    rows = documents.select("url", F.posexplode(records).alias("at", "record"))
    rows = rows.select("url", (F.col("at") + 1).alias("entry_index"), F.from_json("record", "map<string,string>").alias("record")).where("record is not null")
    fields = {k: _text(_value(F.col("record"), v, profile == "mature")) for k, v in FIELDS.items()}
    found = rows.select("url", "entry_index", *(c.alias(k) for k, c in fields.items()))
    return found.where("stream_url <> ''") if profile == "mature" else found
