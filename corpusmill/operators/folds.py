"""Ordered folds: state carried along the rows of a key in order, streamed, so that no group is ever held in memory.

Rows are shuffled by key and sorted inside the partitions; a Python generator then walks them as named tuples. Each key is one sequential stream,
since what a fold keeps depends on what it kept before; its memory is the fold's state, not the key's rows.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

Fold = Callable[[tuple, Iterator[tuple]], Iterable[tuple]]


def ordered(df: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str, batch: int = 2000) -> DataFrame:
    """``fold(key, rows)`` for each key's rows in order; it yields result rows as tuples in the order of ``schema``. A fold may stop early."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    layout = to_arrow_schema(StructType.fromDDL(schema))
    fields, places = tuple(df.columns), [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = namedtuple("Row", fields)._make  # type: ignore[misc]
        rows = chain.from_iterable(map(make, zip(*(c.to_pylist() for c in b.columns))) for b in batches)
        results = chain.from_iterable(fold(key, own) for key, own in groupby(rows, lambda r: tuple(r[i] for i in places)))
        for some in batched(results, batch):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), layout)], schema=layout)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
