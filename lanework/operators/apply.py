"""User functions over groups: once per group on a representative, results fanned out to all members."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.plans.ship import ship


def representatives(rows: DataFrame, keys: list[str], order: list[str], function: Callable[[dict], dict], schema: str, on_error: Callable[[dict, Exception], dict], members: str | None = None) -> DataFrame:
    """(keys, the columns of schema) that function returns for the first member (by order) of each group; on_error's result where it fails.

    members: name of a further column, the number of a group's rows.
    """
    ship(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]
    others = [c for c in rows.columns if c not in keys]
    counted = [members] if members else []
    chosen = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"), *(F.count("*").alias(m) for m in counted)).select(*keys, "_r.*", *counted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                numbers = [row.pop(m) for m in counted]
                try:
                    got = function(row)
                except Exception as e:  # a failure is a result of its group
                    got = on_error(row, e)
                out.append({**{k: row[k] for k in keys}, **{n: got.get(n) for n in names}, **{m: number for m, number in zip(counted, numbers, strict=True)}})
            yield pd.DataFrame(out, columns=[*keys, *names, *counted])

    types = dict(rows.dtypes)
    return chosen.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema, *(f"`{m}` long" for m in counted)]))


def grouped_apply(rows: DataFrame, keys: list[str], order: list[str], function: Callable[[dict], dict], schema: str, on_error: Callable[[dict, Exception], dict]) -> DataFrame:
    """rows with the columns of schema that function returns for the first member (by order) of each group.

    A failing call gives on_error's result for its group. Only representatives go to Python; members are joined back.
    """
    return rows.join(representatives(rows, keys, order, function, schema, on_error), keys)
