"""Folds over the rows of each key in order, with a state that is carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, key: str, order: list[str], new: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """``step(state, rows)`` over the rows of each key in order, some at a time, with a state made by ``new`` for each key.

    Rows are sorted within the task by Spark, which spills, and read in batches: a key of any length needs the memory of one
    batch. A null key is a key. What depends on the row before cannot be split further, so a key is one task's work.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for frame in frames:
            change = frame[key].ne(frame[key].shift()) & ~(frame[key].isna() & frame[key].shift().isna())
            change.iloc[:1] = True
            for _, part in frame.groupby(change.cumsum(), sort=True):
                name = part[key].iloc[0]
                name = None if pd.isna(name) else name
                if name != now:
                    now, state = name, new()
                yield step(state, part)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def carried(df: DataFrame, key: str, order: list[str], new: Callable[[], Any], step: Callable[..., tuple], reads: list[str], adds: T.StructType) -> DataFrame:
    """``df`` with the columns ``adds``: of each row, in the order of its key's rows, the tuple that ``step(state, *values)`` gives for its
    values of ``reads``. A timestamp is given as seconds since 1970, UTC; a key's state is made by ``new``.

    As ``ordered_fold``, but a batch of many short keys is walked as it is instead of cut into frames. Columns of ``df`` that ``adds`` names are
    replaced."""
    kept = [c for c in df.columns if c not in adds.names]
    schema = T.StructType([*(df.schema[c] for c in kept), *adds.fields])

    def plain(column: pa.Array) -> list:
        if pa.types.is_timestamp(column.type):
            return [None if us is None else us / 1e6 for us in pc.cast(column.cast(pa.timestamp("us", column.type.tz)), pa.int64()).to_pylist()]
        return column.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        kinds = None
        for batch in batches:
            out = []
            for name, *values in zip(*(plain(batch.column(c)) for c in (key, *reads)), strict=True):
                if name != now:
                    now, state = name, new()
                out.append(step(state, *values))
            kinds = kinds or [_ARROW[f.dataType.typeName()] for f in adds.fields]
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *adds.names])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


_ARROW = {"boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
