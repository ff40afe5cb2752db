"""Running offsets inside a row.

A fold that appends to an array copies it at every step; a running sum over the
sizes is linear. The sums of a whole Arrow batch are taken at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def running_starts(sizes: pd.Series) -> pd.Series:
    """For every array of sizes, where each element starts: the sum of the sizes before it."""
    some = sizes.map(lambda x: np.empty(0, np.int64) if x is None else np.asarray(x, np.int64))
    lengths = some.map(len).to_numpy()
    flat = np.concatenate([*some, np.empty(0, np.int64)])
    starts = np.cumsum(flat) - flat
    ends = np.cumsum(lengths)
    out = [starts[e - n:e] - starts[e - n] if n else starts[:0] for n, e in zip(lengths, ends, strict=True)]
    return pd.Series([None if x is None else (o.astype(np.int32)) for x, o in zip(sizes, out, strict=True)], dtype=object)
