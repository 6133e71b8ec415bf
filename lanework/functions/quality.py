"""Quality of a source as comparable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanework.functions.policy import MOTION_CAP_FPS

RANK_FIELDS = ("known", "motion_class", "resolution_class", "motion", "scan_rank", "area", "height", "width", "bitrate")


def scan_type(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.isin("progressive", "p"), "progressive").when(text.isin("interlaced", "interlace", "i", "tt", "bb", "tb", "bt"), "interlaced").otherwise("")


def motion_fps(fps: Column, scan: Column, cap: float = MOTION_CAP_FPS) -> Column:
    """Frames a second of motion: interlaced video of up to half the cap shows twice its frame rate."""
    fps = F.coalesce(fps, F.lit(0.0))
    return F.when(fps <= 0, 0.0).when((scan_type(scan) == "interlaced") & (fps <= cap / 2 + 0.01), fps * 2).otherwise(fps)


def resolution_class(width: Column, height: Column) -> Column:
    out = F.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), 0)
    for lines in (2160, 1440, 1080, 720):
        out = out.when(height >= lines, lines)
    return out.otherwise(0)


def quality_rank(fps: Column, width: Column, height: Column, bitrate: Column, scan: Column, cap: float = MOTION_CAP_FPS) -> Column:
    """A null-free struct whose order is the order of quality."""
    fps, width, height, bitrate = (F.coalesce(x, F.lit(0)) for x in (fps, width, height, bitrate))
    motion = F.least(motion_fps(fps, scan, cap), F.lit(cap))
    known = ((fps > 0) | ((width > 0) & (height > 0)) | (bitrate > 0)).cast("int")
    kind = scan_type(scan)
    values = (
        known,
        F.when(motion >= cap, 2).when(motion > 0, 1).otherwise(0),
        resolution_class(width, height),
        motion,
        F.when(kind == "progressive", 2).when(kind == "interlaced", 1).otherwise(0),
        width.cast("long") * height.cast("long"),
        height,
        width,
        bitrate,
    )
    return F.struct(*(v.alias(n) for v, n in zip(values, RANK_FIELDS, strict=True)))


def quality_signature(fps: Column, width: Column, height: Column, bitrate: Column, scan: Column) -> Column:
    return F.concat_ws("/", F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)), F.format_string("%.3f", F.coalesce(fps, F.lit(0.0)).cast("double")), F.coalesce(bitrate, F.lit(0)), scan_type(scan))
