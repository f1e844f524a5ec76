"""Decisions that depend on all rows before, made in one pass over sorted rows: only a state of fixed size is carried on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def carried(df: DataFrame, key: str, order: list[str | Column], inputs: list[str], step: Callable[..., tuple], out: str, kind: T.DataType) -> DataFrame:
    """df with the column out: step(state, *inputs) -> (state, value) over each key's rows in order; the state is None at the first.

    The rows of a key are streamed through one task in Arrow batches, so a key may have any number of them.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    arrow = pa.int64() if isinstance(kind, T.LongType) else pa.bool_()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            values = []
            for own, *given in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if not begun or own != last:
                    last, state, begun = own, None, True
                state, value = step(state, *given)
                values.append(value)
            yield pa.record_batch([*batch.columns, pa.array(values, arrow)], names=schema.names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
