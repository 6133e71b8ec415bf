from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Odd rows: nulls, empty and long texts, ties, repeated rows, a clashing extra column."""
    long = " ".join(f"w{i * 7919 % 1000} tail." for i in range(9000))
    rows = [(1, "alpha beta gamma", "x"), (1, "alpha beta gamma", "x"), (2, None, None), (3, "", "y"), (None, "no id here", "z"), (4, long, None), (5, long[: len(long) // 2], "q"), (6, " \t\n ", None), (7, "naïve ß 日本語  don't we'll\r\n\x1c odd<|endoftext|>x", "w"), (8, "a" * 30000, "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids string")
