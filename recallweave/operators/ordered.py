"""Groups of rows in order, one after the other in a task: for folds in Python over many small groups.

Rows are dealt by the keys into a number of partitions that follows the cores and is not put together again, and are sorted there; a task
reads them in batches and hands over one group at a time.  No frame is made for a group, which costs more than folding it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch of results, and partitions a core.
BATCH, A_CORE = 5_000, 4


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], fold: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows (tuples of schema) that fold makes of each group's rows (dicts), sorted by order.  A group is one list of rows."""
    kind = T.StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    names = df.columns
    key = itemgetter(*(names.index(k) for k in keys))

    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def made(found):
        cols = list(zip(*found, strict=True)) if found else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], fields.names)

    def run(batches):
        out = []
        for _, group in groupby(rows(batches), key):
            out.extend(fold([dict(zip(names, r, strict=True)) for r in group]))
            if len(out) >= BATCH:
                yield made(out)
                out = []
        yield made(out)

    n = df.sparkSession.sparkContext.defaultParallelism * A_CORE
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
