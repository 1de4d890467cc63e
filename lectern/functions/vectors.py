"""Vector expressions in double precision, and an Arrow scorer for batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def literal(vector: Sequence[float]) -> Column:
    """A vector as one constant: a text that Catalyst folds to an array, not a node for each component."""
    return F.split(F.lit(",".join(repr(float(x)) for x in vector)), ",").cast("array<double>") if len(vector) else F.array().cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _beside(v: Column, value: Column) -> Column:
    """A value repeated for each component, so that it is worked out once for a row and not in every step."""
    return F.array_repeat(value, F.size(v))


def normalise(v: Column) -> Column:
    """At unit length; a zero vector stays."""
    return F.zip_with(v, _beside(v, norm(v)), lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def scale_of(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def quantise(v: Column) -> Column:
    """Whole numbers of -127 to 127 against the largest component, rounded half to even."""
    return F.zip_with(v, _beside(v, scale_of(v)), lambda x, s: F.when(s > 0, F.bround(x.cast("double") / s * 127, 0)).otherwise(F.lit(0.0)).cast("tinyint"))


def dequantise(data: Column, scale: Column) -> Column:
    return F.zip_with(data, _beside(data, scale), lambda x, s: x.cast("double") * s / 127)


@F.pandas_udf(T.StructType([T.StructField("data", T.BinaryType()), T.StructField("scale", T.DoubleType())]))
def packed(vectors: pd.Series) -> pd.DataFrame:
    """Vectors as eight-bit whole numbers in one run of bytes and a scale, the same numbers as by ``quantise``; null stays null."""
    rows = []
    for v in vectors:
        x = None if v is None else np.asarray(v, dtype=np.float64)
        scale = None if x is None else float(np.abs(x).max(initial=0.0))
        rows.append((None if x is None else np.rint(x / scale * 127 if scale else np.zeros(len(x))).astype(np.int8).tobytes(), scale))
    return pd.DataFrame(rows, columns=["data", "scale"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpacked(data: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else np.frombuffer(d, dtype=np.int8) * s / 127 for d, s in zip(data, scale, strict=True)], dtype=object)


def packed_scorer(query: Sequence[float]):  # noqa: ANN201
    """A column function (data, scale) that scores batches of packed vectors: one product of whole numbers with the query, then the scales."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def score(data: pd.Series, scale: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(data), dtype=np.int8).reshape(len(data), -1) if len(data) else np.zeros((0, len(q)), dtype=np.int8)
        return pd.Series((x.astype(np.float64) @ q) * scale.to_numpy(dtype=np.float64) / 127, dtype=float)

    return score


def truncate(v: Column, dim: int) -> Column:
    """The first ``dim`` components at unit length."""
    return normalise(F.slice(v, 1, dim))


def arrow_scorer(query: Sequence[float]):  # noqa: ANN201
    """A column function that scores whole Arrow batches with one matrix product."""
    q = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        return pd.Series(np.stack(vectors.tolist()).astype(np.float64) @ q if len(vectors) else [], dtype=float)

    return score
