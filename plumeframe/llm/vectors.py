"""What the two vector operators share: which vectors take part, and packs of bounded numbers of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for a vector without NULL, NaN or infinite components; false for NULL and empty vectors."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def matrix(lists: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(lists), -1)
