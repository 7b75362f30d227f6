"""A model that is given from outside, applied to a table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from trailframe.functions import arrays


def classify(df: DataFrame, inputs: list[str], load: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], probs: str = "probs", logits: bool = True) -> DataFrame:
    """The table with `probs`, an array of the classes' probabilities. `load` is called once in each Python worker and returns the model: a
    function from a batch of `inputs` to a two-dimensional array, a row for each row of the batch. With `logits` a softmax follows, outside
    of Python. Rows in which one of `inputs` is null are left out, as a model can't judge them."""
    if probs in df.columns:
        raise ValueError(f"the table has a column {probs} already")
    schema = StructType([*df.schema.fields, StructField(probs, ArrayType(DoubleType()))])
    models: list = []

    def run(batches):
        if not models:
            models.append(load())
        for batch in batches:
            said = np.asarray(models[0](batch.select(inputs)), dtype=np.float64)
            if said.ndim != 2 or len(said) != batch.num_rows:
                raise ValueError(f"the model gave an array of shape {said.shape} for {batch.num_rows} rows")
            offsets = pa.array(np.arange(len(said) + 1, dtype=np.int32) * (said.shape[1] if said.size else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(said.ravel()))], [*batch.schema.names, probs])

    out = df.dropna(subset=inputs).mapInArrow(run, schema)
    return out.withColumn(probs, arrays.softmax(F.col(probs))) if logits else out
