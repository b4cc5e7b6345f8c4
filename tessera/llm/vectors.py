"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised in double precision. 160 tables of 14 projections each, quantised at width 1.5, give bucket keys; a pair at cosine 0.95 (distance 0.316) meets in no
table with a probability of about 3e-6 (40 tables: 0.04), one at cosine 0 meets with one of under 2e-6 a table. There is no exact search for the rest. Rows of equal components are one
class. Buckets with one class are dropped before any vector moves. Those left are dealt into blocks of about BLOCK classes; every pair of blocks is one group, sorted rows of which stream
through a worker: cosines of a group are one matrix product, and only vectors that have a link have their keys taken again, to count the link in the first table whose keys
are equal. So links are counted, never emitted; for components a group gives one row for each member: the smallest id that it reaches in the group.

Random meetings in a bucket grow with the square of the number of vectors; `tables` and `projections` are arguments: two projections more divide them by about 7, and about 1.45 times the
tables keep the recall.

Cases: a vector that is null, empty, zero or holds null or non-finite components has no link; a null vec_id has no component and no link; vectors of different lengths don't link; equal
rows link; of rows that repeat a vec_id each counts as another vector; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_batch, discard, grouped, materialize, pick
from tessera.llm.graph import components

TABLES, PROJECTIONS, WIDTH = 160, 14, 1.5
LEAST = 0.95
BLOCK = 1024
#: Cosines of a matrix product differ from those summed row by row by less.
SLACK = 1e-9


def normalised(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@lru_cache(maxsize=4)
def _lines(size: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(size)
    return rng.standard_normal((size, tables * projections)) / WIDTH, rng.uniform(0, 1, tables * projections)


def keys(x: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS) -> np.ndarray:
    """One key for each row and table; the table and the vectors' length are part of the key."""
    lines, shift = _lines(x.shape[1], tables, projections)
    out = np.empty((len(x), tables), np.uint64)
    for at in range(0, len(x), 256):
        cells = np.floor(x[at : at + 256] @ lines + shift).astype(np.int64).view(np.uint64).reshape(-1, tables, projections)
        k = np.tile(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(x.shape[1] * 2 + 1), (len(cells), 1))
        for i in range(projections):
            k = (k ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(31)
        out[at : at + 256] = k
    return out.view(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as one matrix) for each length."""
    starts, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(starts)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[starts[rows][:, None] + np.arange(n)]


def _keyed(tables: int, projections: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("key", pa.int64())])
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in _by_length(batch.column(1)):
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    yield as_batch([np.repeat(ids[part], tables), keys(normalised(x[at : at + 512]), tables, projections).ravel()], schema)

    return run


def _near_pairs(x: np.ndarray, first: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b), a < b, of one group each, with a cosine of at least `least`; groups start at `first` and have `size` rows."""
    left, right = [], []
    for n in np.unique(size):
        starts = first[size == n]
        if n <= 32:
            a, b = np.triu_indices(n, 1)
            step = max(1, (1 << 16) // max(1, len(a)))
            for at in range(0, len(starts), step):
                s = starts[at : at + step, None]
                left.append((s + a).ravel())
                right.append((s + b).ravel())
                ok = (x[left[-1]] * x[right[-1]]).sum(axis=1) >= least
                left[-1], right[-1] = left[-1][ok], right[-1][ok]
            continue
        for s in starts:
            for at in range(s, s + n, 256):
                a, b = np.nonzero(x[at : min(at + 256, s + n)] @ x[s : s + n].T >= least - SLACK)
                a, b = a + at, b + s
                later = b > a
                a, b = a[later], b[later]
                for k in range(0, len(a), 1 << 15):
                    ok = (x[a[k : k + (1 << 15)]] * x[b[k : k + (1 << 15)]]).sum(axis=1) >= least
                    left.append(a[k : k + (1 << 15)][ok])
                    right.append(b[k : k + (1 << 15)][ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(ids: np.ndarray, a: np.ndarray, b: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links (a, b) of rows: the rows that have any, how many vectors each is linked with, and the smallest id that it reaches by them."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    links = np.bincount(a, copies[rows[b]], len(rows)) + np.bincount(b, copies[rows[a]], len(rows))
    root = ids[rows].copy()
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            return rows, links.astype(np.int64), root


def _checked(least: float, tables: int, projections: int):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            table = table.combine_chunks()
            key, i, j, all_ids, all_copies, all_parts = (table.column(c).to_numpy() for c in range(6))
            for rows, x in _by_length(table.column(6).combine_chunks()):
                x = normalised(x)
                k, ids, copies, part, apart = key[rows], all_ids[rows], all_copies[rows], all_parts[rows], (i != j)[rows]
                group = np.concatenate([[True], (k[1:] != k[:-1]) | (i[rows][1:] != i[rows][:-1]) | (j[rows][1:] != j[rows][:-1])])
                first = np.flatnonzero(group)
                a, b = _near_pairs(x, first, np.diff(np.append(first, len(rows))), least)
                # In a group of two blocks only pairs between them count; those of one block have a group of their own.
                ok = ~apart[a] | (part[a] != part[b])
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                # A class comes once for each of its buckets here; its keys are taken once.
                linked = np.unique(np.concatenate([a, b]))
                names, one, back = np.unique(ids[linked], return_index=True, return_inverse=True)
                taken = keys(x[linked[one]], tables, projections)
                at = np.zeros(len(rows), np.int64)
                at[linked] = back
                counts = np.zeros(len(a), bool)
                for s in range(0, len(a), 4096):
                    p, q = taken[at[a[s : s + 4096]]], taken[at[b[s : s + 4096]]]
                    place = np.argmax(p == q, axis=1)
                    counts[s : s + 4096] = p[np.arange(len(p)), place] == k[a[s : s + 4096]]
                a, b = a[counts], b[counts]
                if len(a):
                    rows_, links, root = _counted(ids, a, b, copies)
                    yield as_batch([ids[rows_], links, root], schema)

    return run


def near(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, projections: int = PROJECTIONS) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    d = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    if d.schema["v"].dataType.elementType.typeName() != "float":
        d = d.withColumn("v", F.col("v").cast("array<double>"))
    zero = F.lit(0).cast(d.schema["v"].dataType.elementType)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    d = d.withColumn("digest", F.when(good, F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + zero).cast("string"))), 256)))
    classes = d.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    # A class has a number of its own, as rows may repeat a vec_id with other vectors.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    found = materialize(classes.select("id", "v").mapInArrow(_keyed(tables, projections), "id long, key long"), "vector-keys")
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = found.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "part").alias("i"), F.greatest(o, "part").alias("j")))
    dealt = members.select("key", "id", "part", F.explode(pairs).alias("p")).select("key", "id", "part", "p.i", "p.j").join(classes.select("id", "copies", "v"), "id")
    order = ["key", "i", "j"]
    rows = dealt.select(*order, "id", "copies", "part", "v").repartition(*order).sortWithinPartitions(*order, "id")
    part = materialize(rows.mapInArrow(_checked(least, tables, projections), "id long, links long, least long"), "vector-links")
    discard(found)
    links = part.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(part.where("id != least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    placed = classes.select("id", "digest", "copies", "least").join(comp, "id", "left").withColumn("component", F.coalesce("component_id", "id"))
    first = placed.groupBy("component").agg(F.min("least").alias("first"))
    named = placed.join(first, "component").join(links, "id", "left").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first")
    out = d.select("vec_id", "digest").join(named, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
