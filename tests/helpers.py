"""Small frames and comparisons."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

START = datetime(2024, 1, 1)
SCHEMA = "series string, ts timestamp_ntz, v double"


def hour(i: float) -> datetime:
    return START + timedelta(hours=i)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def random_series(seed: int, lengths: dict[str, int], gap: float = 0.2, unknown: float = 0.2):
    """Rows of hourly series with missing hours and NULL values."""
    rng = random.Random(seed)
    rows = []
    for name, n in lengths.items():
        for i in range(n):
            if rng.random() < gap:
                continue
            rows.append((name, hour(i), None if rng.random() < unknown else float(rng.randint(1, 1000))))
    rng.shuffle(rows)
    return rows


def pandas_of(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["series", "ts", "v"]).astype({"v": "float64"})
    return out.sort_values(["series", "ts"]).reset_index(drop=True)


def sorted_pandas(df, by=("series", "ts")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(left, right) -> bool:
    """Equal numbers, with NULL equal to NULL."""
    a = np.asarray(pd.Series(list(left), dtype="float64"))
    b = np.asarray(pd.Series(list(right), dtype="float64"))
    return len(a) == len(b) and bool(np.allclose(a, b, equal_nan=True, rtol=1e-9, atol=1e-9))


def rows_of(df, *columns):
    return sorted([tuple(r) for r in df.select(*(columns or df.columns)).collect()], key=repr)
