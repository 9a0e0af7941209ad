"""Vector functions as Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column, floor: float = 1e-12) -> Column:
    """Unit length; a vector shorter than ``floor`` is divided by the floor."""
    length = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: (x.cast("double") / length).cast("float"))


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """The offline embedder: signed counts of hashed tokens, of unit length.

    Hashes come from the JVM, so every engine that has xxHash64 gets the same vector.
    """

    def dense(batch: pd.Series) -> pd.Series:
        out = []
        for hashes in batch:
            h = np.asarray([] if hashes is None else hashes, dtype=np.int64)
            v = np.bincount(h % size, np.where(h & (1 << 40), 1.0, -1.0), size)
            out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
        return pd.Series(out)

    return F.pandas_udf(dense, "array<float>")(F.transform(tokens, lambda t: F.xxhash64(t)))
