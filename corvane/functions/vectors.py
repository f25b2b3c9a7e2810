"""Column expressions over vectors (arrays of numbers), computed in doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(a: Column) -> Column:
    """To unit length; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def assert_dimension(a: Column, dim: int) -> Column:
    """``a`` itself; an error for a vector of another length."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(a).cast("string"))))


def embedder(encode, prefix: str = ""):
    """A function from a text column to unit vectors, by ``encode`` (list of texts -> rows of numbers).

    ``encode`` is an external model's; it is called once for each Arrow batch. Null
    texts have null vectors.
    """
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None]
        if known:
            rows = np.asarray(encode([prefix + texts.iloc[i] for i in known]), float)
            length = np.linalg.norm(rows, axis=1, keepdims=True)
            for i, v in zip(known, rows / np.where(length > 0, length, 1), strict=True):
                out[i] = v
        return pd.Series(out)

    return run
