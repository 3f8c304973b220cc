"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Whole texts travel to Python in batches of this many rows, so that a worker holds few long ones at once.
BATCH_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType,
    rows: int = BATCH_ROWS,
) -> DataFrame:
    """``mapInArrow`` with small batches. The setting holds for the session from here on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(function, schema)


def merged_spans(name: str, kind: str) -> Column:
    """The (first, after) spans of an array column as maximal runs in order; touching spans become one."""
    empty = f"cast(array() as array<struct<first: {kind}, after: {kind}>>)"
    closed = "concat(a.runs, array(named_struct('first', a.first, 'after', a.after)))"
    return F.expr(f"""
        aggregate(array_sort({name}),
          named_struct('runs', {empty}, 'first', cast(-1 as {kind}), 'after', cast(-1 as {kind})),
          (a, x) -> if(x.first <= a.after,
            named_struct('runs', a.runs, 'first', a.first, 'after', greatest(a.after, x.after)),
            named_struct('runs', if(a.after >= 0, {closed}, a.runs), 'first', x.first, 'after', x.after)),
          a -> if(a.after >= 0, {closed}, a.runs))""")
