"""Order-dependent folds over many groups.

Groups are brought together by one shuffle and sorted inside their partition;
Python sees whole partitions as Arrow batches and walks from group to group. So
a hundred thousand small groups cost no more than their rows, where a grouped
pandas function pays for every group. Only the rows of one group are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = list[dict[str, Any]]


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[Rows], Iterable[tuple]], schema: str | StructType, flush: int = 20_000) -> DataFrame:
    """``fold`` applied to the rows (dicts, in ``order``) of every group of equal ``keys``.

    It returns tuples in the order of ``schema``. Null keys form groups of their own."""
    keys = list(keys)
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target, timestamp_utc=True)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows = []
        now: tuple | None = None
        out: list[tuple] = []
        for b in batches:
            for row in b.to_pylist():
                k = tuple(row[c] for c in keys)
                if held and k != now:
                    out.extend(fold(held))
                    held = []
                    if len(out) >= flush:
                        yield batch(out)
                        out = []
                now = k
                held.append(row)
        if held:
            out.extend(fold(held))
        yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, target)


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    """DDL of some columns."""
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
