"""Slices through Arrow, one at a time: what a worker holds is a batch bounded by bytes, and one slice's results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.operators.filters import Layout

ROWS, BYTES = 1 << 13, 8 << 20
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (f.strip().split(" ", 1) for f in schema.split(", "))])


def _weight(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, (bytes, str, list)))


def bounded(batches: Iterable[pa.RecordBatch], fn: Callable[[tuple], Iterable[tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of `fn` for each row of the batches, given out in batches of bounded size; rows are read one at a time."""
    kind = arrow_schema(schema)
    rows: list[tuple] = []
    weight = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    for batch in batches:
        for values in zip(*batch.columns):
            for row in fn(tuple(v.as_py() for v in values)):
                rows.append(row)
                weight += _weight(row)
                if len(rows) >= ROWS or weight >= BYTES:
                    yield made()
                    rows, weight = [], 0
    if rows:
        yield made()


def spread(s: DataFrame) -> DataFrame:
    """Rows dealt in turn over as many tasks as a shuffle has, four for each core at least. It is for work that costs far more for a byte than moving it: a scan has only as many busy tasks as the
    table has row groups, and long slices may lie together."""
    spark = s.sparkSession
    return s.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def rows_of(s: DataFrame, fn: Callable[[int, bytes, Layout], Iterable[tuple]], schema: str, heavy: bool = False) -> DataFrame:
    """Rows of `fn(id, bytes, layout)` for each slice (id, raw[, dtype, shape]); null bytes are empty. No shuffle, unless `fn` is said to be heavy: see `spread`."""
    typed = "dtype" in s.columns

    def one(row: tuple) -> Iterable[tuple]:
        return fn(row[0], row[1] or b"", Layout(row[2], tuple(row[3]) if row[3] else None) if typed else Layout())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bounded(batches, one, schema)

    rows = s.select("id", "raw", *(["dtype", "shape"] if typed else []))
    return (spread(rows) if heavy else rows).mapInArrow(run, schema)
