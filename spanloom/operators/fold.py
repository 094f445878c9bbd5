"""Ordered state over the rows of each media, one row at a time."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .intervals import KEY


def folded(rows: DataFrame, order: list[str], step: Callable, schema: str) -> DataFrame:
    """What step(state, row) -> (state, records) makes of each media's rows in order; the state of
    a first row is None. schema: the records' columns after media_id.

    One shuffle by media and a sort that spills; rows then pass through, so time is linear in
    them and memory holds a batch, however many rows a media has.
    """
    out = T.StructType([rows.schema[KEY], *T.StructType.fromDDL(schema).fields])
    fields, at = to_arrow_schema(out), rows.columns.index(KEY)
    row_of = rows.columns

    def run(batches: Iterable[pa.RecordBatch]):
        row, key, state = namedtuple("row", row_of, rename=True), None, None
        for b in batches:
            made = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                if values[at] != key:
                    key, state = values[at], None
                state, records = step(state, row(*values))
                made += [(key, *r) for r in records]
            columns = zip(*made) if made else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return rows.repartition(KEY).sortWithinPartitions(KEY, *order).mapInArrow(run, out)


def greatest(*values):
    """The greatest of the values that are not null."""
    return max(v for v in values if v is not None)


def least(*values):
    """The least of the values that are not null."""
    return min(v for v in values if v is not None)
