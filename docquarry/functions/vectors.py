"""Distances between array columns in double: in the JVM, or by Arrow batches against one query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType



def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine, clamped to [0, 2]; 1 if a norm is zero; null if the sizes differ."""
    na, nb = norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when(F.size(a) == F.size(b), F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - cosine))


def squared_l2(a: Column, b: Column) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d)


def is_vector(a: Column) -> Column:
    """Not empty and finite."""
    return (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


DISTANCES = {"cosine": cosine_distance, "l2sq": squared_l2}


def distances_to(query: list[float], metric: str = "cosine"):
    """A function of an array<double> column: the distance of each vector to ``query``, a batch at a time.

    A null vector has a null distance; one of another dimension than the query's is an error. Equal vectors have equal
    distances, whatever batch they are in.
    """
    if metric not in DISTANCES:
        raise ValueError(f"metric must be one of {sorted(DISTANCES)}")
    q = np.asarray(query, np.float64)

    @F.arrow_udf(DoubleType())
    def distance(v: pa.Array) -> pa.Array:
        known = v.drop_null()
        sizes = known.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes != len(q)).any():
            raise ValueError(f"vectors must have {len(q)} dimensions")
        x = known.flatten().to_numpy(zero_copy_only=False).reshape(len(known), len(q))
        if metric == "l2sq":
            d = ((x - q) ** 2).sum(1)
        else:
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
            d = 1 - np.clip(np.divide((x * q).sum(1), n, out=np.zeros(len(x)), where=n > 0), -1, 1)
        out = np.full(len(v), np.nan)
        out[~np.asarray(v.is_null())] = d
        return pa.array(out, pa.float64(), mask=np.asarray(v.is_null()))

    return distance
