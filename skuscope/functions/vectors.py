"""Vector functions: column expressions for single vectors, NumPy helpers for blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once a row: higher-order functions compute what stands in their lambda for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""

    def scaled(w: Column) -> Column:
        return _bound(norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))

    return _bound(v, scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def tta_average(v: Column, mirrored: Column) -> Column:
    """Mean of an image's and its mirror's vector, of unit length."""
    return l2_normalize(F.zip_with(v, mirrored, lambda x, y: (x.cast("double") + y.cast("double")) / 2))


def combine_backends(vectors: list[Column]) -> Column:
    """Unit vectors side by side, so that the dot product is the mean of the cosines."""
    scale = 1 / np.sqrt(len(vectors))
    return l2_normalize(F.concat(*[F.transform(l2_normalize(v), lambda x: x * float(scale)) for v in vectors]))


def format_vector(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=m.astype(np.float64), where=n > 0)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
