"""Ordered folds over many groups, streamed: no group is ever held in memory.

Rows are hashed by group and sorted by group and order inside each partition;
the fold sees them one after the other and starts anew where the group changes.
A group costs no more than its rows, so millions of small groups are as cheap as
their rows, and a large one is limited by the fold's own state only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import ship

OUT_ROWS = 10_000


def fold_groups(rows: DataFrame, group: str, order: Sequence[str], columns: Sequence[str], start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Feeds ``columns`` of each row to the step made by ``start`` for its group; steps return result rows."""
    ship(rows.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(group, *columns).repartition(tasks, group).sortWithinPartitions(group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, out = object(), None, []
        for batch in batches:
            for key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, step = key, start()
                out.extend(step(*values))
            if len(out) >= OUT_ROWS:
                yield _batch(out, arrow)
                out = []
        yield _batch(out, arrow)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
