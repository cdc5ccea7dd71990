"""Groups of rows that stream through Arrow batches, many groups to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are Python objects at once, besides those of the group at hand.
ROWS_AT_ONCE = 256
#: Rows of an Arrow batch of results, about.
BATCH_ROWS = 2_000


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from batch.slice(start, ROWS_AT_ONCE).to_pylist()


def map_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Results of ``function`` for the rows of each group, in order, with nulls first.

    Rows are dealt and sorted by the keys, and a task reads its groups one after the other:
    a group costs no data frame of its own, and only one is in memory.  Columns that a
    result row leaves out are null.
    """
    batch_schema, of_group = to_arrow_schema(StructType.fromDDL(schema)), itemgetter(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _, rows in groupby(_rows(batches), of_group):
            out += function(list(rows))
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, batch_schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, batch_schema)

    # a number of its own: adaptive execution would merge partitions by bytes, and the work is not in the bytes
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
