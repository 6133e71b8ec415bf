"""Requests and their probes: what is one request, a probe run once for each, its answer given to every row that asks for it.

Null addresses count as empty, null headers as none; headers of one name in different case are one, and the last of them in
order of name and value counts. Rows that are equal are ordinary rows. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.functions import urls
from lanework.operators import apply

#: Columns that a probe may answer with; a column that it leaves out is null.
ANSWER = "status string, width int, height int, fps double, bitrate long, answer_expiry double, problem string"


def request_key(url: Column, headers: Column, has_keys: Column) -> Column:
    """Hash of all that a request is made of: address, headers by lower-case name in order, and whether keys go with it; not where it was found."""
    pairs = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    kept = F.filter(pairs, lambda p, i: F.get(pairs, i + 1).isNull() | (F.get(pairs, i + 1)["name"] != p["name"]))
    # Lengths keep one text from passing for two.
    told = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    lines = F.transform(kept, lambda p: F.concat(told(p["name"]), told(p["value"])))
    key = F.sha2(F.concat(told(urls.without_suffix(url)), F.array_join(lines, ""), F.coalesce(has_keys, F.lit(False)).cast("string")), 256)
    return F.coalesce(key, F.lit(""))  # never null, and known to be: a join then makes no filter of all this


def probe_requests(entries: DataFrame, probe: Callable[[dict], dict], now: int, order: tuple[str, ...] = ("playlist_url", "entry_index")) -> DataFrame:
    """entries with probe_key, probe_status, quality and expiry as a probe of their request says, and members, the number of its rows.

    A request is probed once: by its first row (in the given order) that has not expired, or its first row if all have. The
    answer goes to every row of the request, which keeps its own place and its own expiry: a row whose own expiry has passed
    is expired whatever the answer, and the earlier of both expiries counts from then on. A probe that fails gives every row
    ``probe_failed`` and the reason.

    entries: (stream_url, headers map, has_keys, expiry, and the columns of order). probe gets the row as a dict.
    """
    late = F.coalesce(F.col("expiry") <= now, F.lit(False))
    keyed = entries.withColumns({"probe_key": request_key(F.col("stream_url"), F.col("headers"), F.col("has_keys")), "_late": late.cast("int")})
    asked = keyed.select("probe_key", "_late", *order, "stream_url", F.to_json("headers").alias("headers"), "expiry")
    failed = lambda row, e: {"status": "probe_failed", "problem": str(e) or type(e).__name__}
    answers = apply.representatives(asked, ["probe_key"], ["_late", *order], probe, ANSWER, failed, "members")
    both = keyed.join(answers, "probe_key")
    least = F.least("expiry", "answer_expiry")  # nulls are left out
    status = F.when(F.col("_late") == 1, "expired").when(F.coalesce(F.col("answer_expiry") <= now, F.lit(False)), "expired").otherwise(F.coalesce("status", F.lit("unsupported")))
    return both.select("probe_key", *(F.col(c) for c in entries.columns if c != "expiry"), least.alias("expiry"), status.alias("probe_status"), (status == "working").alias("launchable"), "width", "height", "fps", "bitrate", F.coalesce("problem", F.lit("")).alias("problem"), "members")
