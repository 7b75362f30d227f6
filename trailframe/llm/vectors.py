"""Vectors as whole numbers, for the operators that compare them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component is smaller than this once it is scaled: squares and products of up to 128 of them fit a long.
LARGEST = 1 << 27


def whole(df: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", size: int | None = None) -> DataFrame:
    """vec_id long, v array<int>: each component x as floor(scale * x). Vectors that are null, hold a null or a number that isn't finite,
    or haven't `size` components, take no part. Nor do vectors with a component of LARGEST or more once it is scaled, as their results fit
    no long. Other columns are not read."""
    v = df[vector_col]
    fits = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < LARGEST - 1, F.lit(False)))
    kept = df.where(v.isNotNull() & fits & (F.size(v) == size if size is not None else F.lit(True)))
    return kept.select(df[id_col].cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of longs; missing components of shorter ones are 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


#: Numbers in a block of vectors at most, but for a single vector that has more: 8 MB as longs.
NUMBERS = 1 << 20


def blocks(batches, most: int, numbers: int = NUMBERS):
    """Ids (a pyarrow array) and vectors of `most` rows at most at a time, fewer if they are long, as matrices; shorter vectors are filled
    with zeros."""
    held: list[pa.RecordBatch] = []
    n = widest = 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return table.column("vec_id").chunk(0), matrix(table.column("v").chunk(0), widest)

    for batch in batches:
        lengths = np.diff(batch.column("v").offsets.to_numpy())
        at = 0
        while at < batch.num_rows:
            step = max(1, min(most, numbers // max(1, int(lengths[at : at + most].max()))))
            piece, wide = batch.slice(at, step), int(lengths[at : at + step].max())
            if n and (n + piece.num_rows > most or (n + piece.num_rows) * max(widest, wide) > numbers):
                yield joined()
                held, n, widest = [], 0, 0
            held.append(piece)
            n, widest, at = n + piece.num_rows, max(widest, wide), at + step
    if n:
        yield joined()
