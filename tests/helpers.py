"""Small hand-made series for unit tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

BAR_SCHEMA = "symbol string, ts timestamp, bar_no long, open double, high double, low double, close double, volume double"


def random_bars(n: int, symbols=("A", "B"), seed: int = 1, freq: str = "1h", start: str = "2024-03-01") -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        open_ = np.r_[close[0], close[:-1]] * (1 + rng.normal(0, 0.002, n))
        high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.004, n)))
        low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.004, n)))
        out.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "ts": pd.date_range(start, periods=n, freq=freq),
                    "bar_no": range(n),
                    "open": open_,
                    "high": high,
                    "low": low,
                    "close": close,
                    "volume": rng.integers(0, 100, n).astype(float),
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=0), BAR_SCHEMA)


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def mk(spark, recs, schema):
    """Rows of plain tuples; pandas timestamps become datetimes (UTC)."""
    plain = [
        tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) and v is not pd.NaT else v for v in rec) for rec in recs
    ]
    return spark.createDataFrame(plain, schema)
