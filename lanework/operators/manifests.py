"""Variants of stream manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.functions import quality, times, urls
from lanework.plans.ship import ship


def hls_variants(manifests: DataFrame) -> DataFrame:
    """(manifest_url, variant, width, height, fps, bitrate, codecs, uri, url, expiry): one row per #EXT-X-STREAM-INF with the address after it.

    url is the whole address that uri means in its manifest, expiry what url says of its end.
    """
    # What few manifests need (other line ends, lines between a variant and its address, fractions) costs the others nothing.
    text = F.when(F.col("text").contains("\r"), F.regexp_replace("text", r"\r\n?", "\n")).otherwise(F.col("text"))
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n\s*#EXT-X-STREAM-INF:"), 2, 1 << 30)
    rows = manifests.select("manifest_url", F.posexplode(parts).alias("at", "part"))
    line = F.split_part("part", F.lit("\n"), F.lit(1))
    # A cast of an empty text costs the JVM an exception, so an attribute that is not there is not cast.
    given = lambda x, kind: F.when(x != "", x.try_cast(kind))
    number = lambda p: F.coalesce(given(F.regexp_extract(line, p, 1), "bigint"), F.lit(0))
    average, peak = number(r"AVERAGE-BANDWIDTH=(\d+)"), number(r"(?:^|,)\s*BANDWIDTH=(\d+)")
    says = lambda x: (x != "") & ~x.startswith("#")
    uris = F.filter(F.slice(F.transform(F.split("part", "\n"), lambda x: F.trim(x)), 2, 1 << 30), says)
    second, rate = F.trim(F.split_part("part", F.lit("\n"), F.lit(2))), F.regexp_extract(line, r"FRAME-RATE=([\d./]+)", 1)
    found = rows.select(
        "manifest_url",
        (F.col("at") + 1).alias("variant"),
        number(r"RESOLUTION=(\d+)x").cast("int").alias("width"),
        number(r"RESOLUTION=\d+x(\d+)").cast("int").alias("height"),
        F.when(rate.contains("/"), times.frame_rate(rate)).otherwise(F.coalesce(given(rate, "double"), F.lit(0.0))).alias("fps"),
        F.when(average > 0, average).otherwise(peak).alias("bitrate"),
        F.regexp_extract(line, r'CODECS="([^"]*)"', 1).alias("codecs"),
        F.when(says(second), second).otherwise(F.coalesce(F.try_element_at(uris, F.lit(1)), F.lit(""))).alias("uri"),
    )
    return found.withColumn("url", urls.join(F.col("manifest_url"), F.col("uri"))).withColumn("expiry", urls.auth_expiry(F.col("url")))


def best_variant(variants: DataFrame) -> DataFrame:
    """The variant of highest quality of each manifest, the first of equal ones."""
    rank = quality.quality_rank(F.col("fps"), F.col("width"), F.col("height"), F.col("bitrate"), F.lit(""))
    best = F.max_by(F.struct("variant", "width", "height", "fps", "bitrate", "uri"), F.struct(rank.alias("rank"), (-F.col("variant")).alias("first")))
    return variants.groupBy("manifest_url").agg(best.alias("b")).select("manifest_url", "b.*")


def encryption_flags(manifests: DataFrame) -> DataFrame:
    """(manifest_url, protected, key_required): a key method other than NONE protects; AES-128 with an address brings its own key.

    A key line without a method protects nothing; a null text has no key lines.
    """
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    lines = F.filter(trimmed, lambda x: x.startswith("#EXT-X-KEY:") | x.startswith("#EXT-X-SESSION-KEY:"))
    given = lambda x, k: F.trim(F.regexp_extract(x, rf'(?i)[:,]\s*{k}="?([^",]*)', 1))
    method = lambda x: F.upper(given(x, "METHOD"))
    guarded = F.filter(lines, lambda x: ~method(x).isin("", "NONE"))
    own = lambda x: (method(x) == "AES-128") & (given(x, "URI") != "") & F.lower(given(x, "KEYFORMAT")).isin("", "identity")
    return manifests.select("manifest_url", (F.size(guarded) > 0).alias("protected"), F.exists(guarded, lambda x: ~own(x)).alias("key_required"))


def progress_bitrate(log: DataFrame) -> DataFrame:
    """(stream, bits_per_second) of key=value progress lines: most bytes by longest time, 0 if unknown."""
    value = lambda k: F.max(F.when(F.trim(F.split_part("line", F.lit("="), F.lit(1))) == k, F.trim(F.split_part("line", F.lit("="), F.lit(2))).try_cast("bigint")))
    rows = log.groupBy("stream").agg(value("total_size").alias("size"), value("out_time_us").alias("us"))
    return rows.select("stream", F.when((F.col("us") > 0) & (F.col("size") > 0), F.floor(F.col("size") * 8000000 / F.col("us"))).otherwise(0).cast("bigint").alias("bits_per_second"))


def stream_probe_rows(probes: DataFrame) -> DataFrame:
    """(manifest_url, stream, width, height, fps, bitrate, matched): the best stream of each probe's JSON answer.

    probes: (manifest_url, text, want_width, want_height, want_fps); null or 0 wishes ask for nothing. Streams of the
    wanted size and rate (within 0.05) come first; without one all count. A text that is no JSON, or one without streams,
    gives no row.
    """
    stream = "struct<index:int,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,bit_rate:string,field_order:string>"
    parsed = probes.withColumn("d", F.from_json("text", f"format struct<bit_rate:string>, streams array<{stream}>"))
    rows = parsed.select("manifest_url", "want_width", "want_height", "want_fps", F.coalesce(F.col("d.format.bit_rate").try_cast("bigint"), F.lit(0)).alias("whole"), F.posexplode("d.streams").alias("stream", "s"))
    average, own = times.frame_rate(F.coalesce("s.avg_frame_rate", F.lit(""))), F.coalesce(F.col("s.bit_rate").try_cast("bigint"), F.lit(0))
    rows = rows.select(
        "manifest_url",
        "stream",
        F.coalesce("s.width", F.lit(0)).alias("width"),
        F.coalesce("s.height", F.lit(0)).alias("height"),
        F.when(average > 0, average).otherwise(times.frame_rate(F.coalesce("s.r_frame_rate", F.lit("")))).alias("fps"),
        F.when(own > 0, own).otherwise(F.col("whole")).alias("bitrate"),
        F.coalesce("s.field_order", F.lit("")).alias("scan"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("want_width", "want_height", "want_fps")),
    )
    sized = (F.col("want_width") <= 0) | (F.col("want_height") <= 0) | ((F.col("width") == F.col("want_width")) & (F.col("height") == F.col("want_height")))
    timed = (F.col("want_fps") <= 0) | ((F.col("fps") > 0) & (F.abs(F.col("fps") - F.col("want_fps")) <= 0.05))
    rank = quality.quality_rank(F.col("fps"), F.col("width"), F.col("height"), F.col("bitrate"), F.col("scan"))
    rows = rows.withColumns({"fits": (sized & timed).cast("int"), "rank": rank})
    best = F.max_by(F.struct("stream", "width", "height", "fps", "bitrate"), F.struct("fits", "rank", (-F.col("stream")).alias("first")))
    return rows.groupBy("manifest_url").agg(best.alias("b"), F.sum("fits").cast("int").alias("matched")).select("manifest_url", "b.*", "matched")


def merge_probe_evidence(current: dict[str, Column], probe: dict[str, Column], default_bitrate_source: str = "") -> dict[str, Column]:
    """Columns of an entry with missing facts taken from a probe; known facts and their sources stay.

    Keys of both: fps, width, height, bitrate, scan; current also has a source for each of fps, resolution, bitrate and
    scan (``fps_source``, ...), probe has bitrate_source. Nulls count as missing.
    """
    number = lambda c: F.coalesce(c, F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(""))
    lacks = {k: (number(current[k]) <= 0) & (number(probe[k]) > 0) for k in ("fps", "width", "height", "bitrate")}
    out = {k: F.when(lacks[k], probe[k]).otherwise(current[k]) for k in lacks}
    kind = quality.scan_type(probe["scan"])
    scan_lacks = (quality.scan_type(current["scan"]) == "") & (kind != "")
    out["scan"] = F.when(scan_lacks, kind).otherwise(current["scan"])
    out["fps_source"] = F.when(lacks["fps"], "probe").otherwise(text(current["fps_source"]))
    filled = F.when(F.trim(text(current["resolution_source"])) == "manifest", "manifest+probe").otherwise("probe")
    out["resolution_source"] = F.when(lacks["width"] | lacks["height"], filled).otherwise(text(current["resolution_source"]))
    named = F.coalesce(F.nullif(text(probe["bitrate_source"]), F.lit("")), F.lit(default_bitrate_source))
    out["bitrate_source"] = F.when(lacks["bitrate"], named).otherwise(text(current["bitrate_source"]))
    out["scan_source"] = F.when(scan_lacks, "probe").otherwise(text(current["scan_source"]))
    known = (number(out["fps"]) > 0) | ((number(out["width"]) > 0) & (number(out["height"]) > 0)) | (number(out["bitrate"]) > 0)
    return out | {"known": known}


def dash_representations(manifests: DataFrame) -> DataFrame:
    """(manifest_url, id, width, height, fps, bitrate, codecs, scan, expiry, protected) of every video rendition of DASH texts.

    Attributes that a rendition lacks come from its set; expiry is the earliest stamp of the rendition, its set and what
    holds them. Texts that are null, broken or declare entities give no row.
    """
    ship(manifests.sparkSession)
    return manifests.select("manifest_url", "text").mapInArrow(_renditions, ", ".join(f"{n} {t}" for n, t in RENDITION.items()))


#: Columns of a rendition, as Spark and as Arrow name their types.
RENDITION = {"manifest_url": "string", "id": "string", "width": "int", "height": "int", "fps": "double", "bitrate": "long", "codecs": "string", "scan": "string", "expiry": "long", "protected": "boolean"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}


def _renditions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(url, *x) for url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text and "<!ENTITY" not in text for x in _video(text)]
        columns = zip(*rows, strict=True) if rows else [()] * len(RENDITION)
        yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t], from_pandas=True) for c, t in zip(columns, RENDITION.values(), strict=True)], names=list(RENDITION))


def _video(text: str) -> Iterator[tuple]:
    try:
        root = ElementTree.fromstring(text.strip().encode())
    except ElementTree.ParseError:
        return
    protected = "ContentProtection" in text and any(_local(e) == "ContentProtection" for e in root.iter())

    def walk(node, above: list[int]) -> Iterator[tuple]:
        a_set = _local(node) == "AdaptationSet"
        stamps = above + _stamps(node, ("Representation",) if a_set else ("Period", "AdaptationSet", "Representation"))
        for child in node:
            kind = _local(child)
            if a_set and kind == "Representation":
                yield from _rendition(node, child, stamps, protected)
            elif kind in ("Period", "AdaptationSet"):
                yield from walk(child, stamps)

    yield from walk(root, [])


def _rendition(parent, node, stamps: list[int], protected: bool) -> Iterator[tuple]:
    given = parent.attrib | {k: v for k, v in node.attrib.items() if v}
    width, height, fps = _whole(given.get("width")), _whole(given.get("height")), _rate(given.get("frameRate") or "")
    if (parent.get("contentType") or "").lower() == "video" or (width and height) or fps > 0 or "video" in f"{parent.get('mimeType') or ''} {node.get('mimeType') or ''}".lower():
        scan = (given.get("scanType") or "").strip().lower()
        every = stamps + _stamps(node, ())
        yield (node.get("id") or "").strip(), width, height, fps, _whole(node.get("bandwidth")), (given.get("codecs") or "").strip(), scan if scan in ("progressive", "interlaced") else "", min(every, default=None), protected


def _whole(text: str | None) -> int:
    return int(text) if text and text.strip().isdigit() else 0


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


#: A stamp in a text of its own, and within the marked-up text of an element: there, an escape of what stands before ends in ";".
_STAMP = re.compile(r"(?i)(?:^|[?&~=;])(?:exp|expires)=(\d+)")
_STAMP_IN_TEXT = re.compile(r"(?i)[?&~=;<>](?:exp|expires)=(\d+)")
_STAMP_IN_ATTRIBUTE = re.compile(r"(?i)[?&~=;<>\"\r\n\t](?:exp|expires)=(\d+)")


def _stamps(node, without: tuple[str, ...]) -> list[int]:
    """Stamps in a node's attributes and text, and in the marked-up text of its children but those named; only what holds "=" is searched."""
    found = [x for t in node.attrib.values() if "=" in t for x in _STAMP.findall(t)]
    if node.text and "=" in node.text:
        found += _STAMP.findall(node.text)
    for child in node:
        if without and _local(child) in without:
            continue
        for e in child.iter():
            for t in (e.text, e.tail):
                if t and "=" in t:
                    found += _STAMP_IN_TEXT.findall(t)
            for t in (e.tag, *e.attrib.keys(), *e.attrib.values()) if e.attrib else (e.tag,):
                if "=" in t:
                    found += _STAMP_IN_ATTRIBUTE.findall(t)
    return [int(x) for x in found]


def _rate(text: str) -> float:
    top, _, bottom = text.partition("/")
    try:
        return float(top) / float(bottom or 1)
    except (ValueError, ZeroDivisionError):
        return 0.0
