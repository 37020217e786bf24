"""Share of two strings covered by common runs (longest common run, then left and right of it)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _longest_run(a: str, b: str) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the first longest common run."""
    best, at_a, at_b = 0, 0, 0
    below = [0] * (len(b) + 1)
    for i in range(len(a) - 1, -1, -1):
        row = [0] * (len(b) + 1)
        for j in range(len(b) - 1, -1, -1):
            if a[i] == b[j]:
                row[j] = below[j + 1] + 1
                if row[j] >= best:
                    best, at_a, at_b = row[j], i, j
        below = row
    return best, at_a, at_b


def covered(a: str, b: str) -> int:
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        n, i, j = _longest_run(x, y)
        if n:
            total += n
            todo += [(x[:i], y[:j]), (x[i + n:], y[j + n:])]
    return total


@F.pandas_udf(IntegerType())
def _covered(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([covered(x, y) for x, y in zip(a, b)], dtype="int32")


def similar(a: Column, b: Column, percent: int = 60) -> Column:
    """``2 * common / (len a + len b) >= percent %`` in integer arithmetic."""
    return _covered(a, b) * 200 >= (F.length(a) + F.length(b)) * percent
