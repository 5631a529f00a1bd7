"""Two small vectorised helpers that no built-in expression covers."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(T.DoubleType())
def chi2_1_p(statistic: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    value = statistic.to_numpy(float)
    return pd.Series(np.where(np.isnan(value), np.nan, _erfc(np.sqrt(np.maximum(np.nan_to_num(value), 0.0) / 2.0))))


def _osa(a: str, b: str) -> int:
    previous, current = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, previous, current = previous, current, [i]
        for j, y in enumerate(b, 1):
            best = min(previous[j] + 1, current[j - 1] + 1, previous[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            current.append(best)
    return current[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance with adjacent swaps (each substring edited once)."""
    return pd.Series([None if a is None or b is None else _osa(a, b) for a, b in zip(left, right)], dtype="Int32")


def _shifted(x: float) -> tuple[float, list[float]]:
    """``x`` raised to 12 or more, and the values passed on the way."""
    passed = []
    while x < 12:
        passed.append(x)
        x += 1.0
    return x, passed


def digamma(x: float) -> float:
    """Derivative of log gamma for x > 0: recurrence, then the asymptotic series."""
    x, passed = _shifted(x)
    y = 1.0 / (x * x)
    tail = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))
    return math.log(x) - 0.5 / x - tail - sum(1.0 / v for v in passed)


def trigamma(x: float) -> float:
    """Derivative of digamma for x > 0."""
    x, passed = _shifted(x)
    y = 1.0 / (x * x)
    tail = y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * (5 / 66 - y * 691 / 2730)))))
    return 1.0 / x + 0.5 * y + tail + sum(1.0 / (v * v) for v in passed)
