"""Joins of moments with the windows that hold them.

A window is cut into the few aligned pieces of doubling length that make it up (two for each length at most), a moment lies in one
piece of each length, so an equi-join of pieces finds the windows of every moment: no moment meets a window that is far from
it, and long, open and short windows cost alike. The plan has no product and broadcasts nothing by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the shortest piece, the moment from which pieces are counted, and how often their length doubles: 1900 to 2155.
PIECE_S, ORIGIN_S, LEVELS = 60, -2208988800, 27


def _pieces(low: Column, high: Column) -> Column:
    """array<struct<level, piece>> that make up [low, high), in units of the shortest piece."""

    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        a, b = F.ceil(low / width), F.floor(high / width)
        one = lambda p: F.struct(level.alias("level"), p.cast("bigint").alias("piece"))
        left = F.when((a < b) & (a % 2 == 1), one(a))
        right = F.when((a < b) & (b % 2 == 1), one(b - 1))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def _unit(time: Column) -> Column:
    return (F.unix_micros(time.cast("timestamp")) / F.lit(1_000_000) - ORIGIN_S) / PIECE_S


def active_at(moments: DataFrame, windows: DataFrame, at: str = "at", start: str = "active_from", end: str = "active_until") -> DataFrame:
    """(moments' columns, windows' columns) of every moment and every window [start, end) that holds it.

    A null start or end is open; an empty window holds nothing; a null moment lies in no window. Moments and ends are between
    1900 and 2155. Both sides may have rows that repeat. The two must not share a column's name.
    """
    low = F.coalesce(F.floor(_unit(F.col(start))), F.lit(0))
    high = F.coalesce(F.ceil(_unit(F.col(end))), F.lit(1 << LEVELS))
    held = windows.withColumn("_p", F.explode(_pieces(low.cast("bigint"), high.cast("bigint"))))
    held = held.select(*windows.columns, F.col("_p.level").alias("_level"), F.col("_p.piece").alias("_piece"))
    unit = F.floor(_unit(F.col(at))).cast("bigint")
    asked = moments.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    asked = asked.withColumn("_piece", F.call_function("shiftright", unit, F.col("_level")))
    # The shortest pieces reach over a window's ends: these decide.
    inside = (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return asked.join(held, ["_level", "_piece"]).where(inside).select(*moments.columns, *windows.columns)
