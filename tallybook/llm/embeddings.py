"""What both embedding operators take as a vector, and how vectors travel to tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, *more: str) -> DataFrame:
    """(vec_id, v array<double>, more columns) of the rows with an id whose vector is neither null, empty nor zero and has only finite components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *more).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles; vectors of another width are cut or filled with zeros."""
    flat, lengths = np.asarray(column.flatten(), dtype=np.float64), np.diff(np.asarray(column.offsets))
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(lengths), width)), 0
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at: at + min(n, width)]
        at += n
    return out


def width(vectors: DataFrame) -> int:
    """The longest vector's length."""
    return vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
