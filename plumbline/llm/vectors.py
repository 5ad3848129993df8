"""What the vector operators share: which vectors take part, bounded samples, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that rotations, centroids and thresholds are fitted on, at most (the first by hash of their id).
FIT_ROWS = 20_000


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or zero and holds only finite numbers; only the dimension that most of them have."""
    real = F.col(vector).isNotNull() & (F.size(vector) > 0)
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(real).where(finite).where(F.exists(F.col(vector), lambda x: x != 0))
    most = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size(vector) == (most.d if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most `most` rows, the first by hash of the id."""
    got = rows.select(id_col, vector).orderBy(F.xxhash64(id_col), id_col).limit(most).toArrow()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return got[id_col].to_numpy(), matrix(pa.concat_arrays(got[vector].chunks))


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))
