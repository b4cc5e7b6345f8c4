"""Removal of repeated 100-byte strings by bucket-pointer refinement.

Offsets start in q-gram buckets (32 bytes); a bucket is refined by sorting its members on the bucket identifiers of later offsets. Identifiers are named by content, so they are global
without a global sort, and each update is used again: depth 64 is (identifier, identifier 32 bytes on), depth 100 is (depth 64, depth 64 36 bytes on).

Not every offset is shuffled. All strings whose least 32-gram (by identifier) is the same occurrence form one run, and equal strings have it at the same place, so a run's bucket stands for
all its offsets. (1) Buckets with one member are dropped before anything else moves. (2) Members of the rest are split by the identifier of their whole run, taken from the depth-100
identifiers of its two ends, which overlap: a run that occurs earlier is a repeat as a whole. (3) Only where a bucket still holds different runs, the first one of each is refined to its single
offsets: their depth-100 identifiers are streamed in order of occurrence, and those seen before in the bucket are repeats. Buckets with many different runs are refined by a grouping on bucket
and identifier in place of the stream, so no task holds a hot one. Groupings take minima and counts with map-side combination; a hot passage is one row for each map task. What a step has read is deleted after it.

Two strings count as equal if their 64-bit identifiers are, within a bucket of equal 64-bit identifiers of 32 bytes.

Cases: null text is empty; a text under 100 bytes is whole; documents are ordered by doc_id, a null one being after all others, and rows of one doc_id (or of none) by a digest of their text; rows of
one doc_id and the same text are one document, so they don't see each other and get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_batch, discard, free_shuffles, map_text, materialize, pick, small_batches

LENGTH = 100
GRAM = 32
LAST = (1 << 63) - 1
#: A bucket with more different runs is refined by a grouping on its offsets' identifiers, one with fewer in a worker.
PART = 4096
_rng = np.random.default_rng(20)
_FIRST = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BY = (_rng.integers(0, 1 << 63, 9, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
BLOCK = 1 << 16


def _refine(ids: np.ndarray, later: int, by: np.uint64) -> np.ndarray:
    """Identifiers of the string and of the one `later` bytes on, as one."""
    out = ids[:-later] * by
    out ^= out >> np.uint64(29)
    out += ids[later:]
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Identifiers at depth 32 of all offsets that have them."""
    ids, depth, step = _FIRST[data], 1, 0
    while depth < GRAM:
        ids = _refine(ids, depth, _BY[step])
        depth, step = depth * 2, step + 1
    return ids


def identifiers(ids: np.ndarray) -> np.ndarray:
    """Identifiers at depth 100, from those at depth 32."""
    return _refine(_refine(ids, GRAM, _BY[5]), LENGTH - 2 * GRAM, _BY[6])


def runs(data: np.ndarray, whole: bool = True) -> tuple[np.ndarray, ...]:
    """(bucket) or (bucket, identifier, start, count) of the runs of one text of at least LENGTH bytes, block by block."""
    found, total = [], len(data) - LENGTH + 1
    for at in range(0, total, BLOCK):
        n = min(BLOCK, total - at)
        ids = grams(data[at : at + n + LENGTH - 1])
        least = (ids >> np.uint64(20) << np.uint64(20)) | np.arange(len(ids), dtype=np.uint64)
        width = 1
        while width * 2 <= LENGTH - GRAM + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = LENGTH - GRAM + 1 - width
        least = np.minimum(least[:-rest], least[rest:]) if rest else least
        anchor = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        bucket = ids[anchor[start]].view(np.int64)
        if not whole:
            found.append((bucket,))
            continue
        count = np.diff(np.append(start, n))
        deep, end = identifiers(ids), start + count - 1
        mixed = deep[start] * _BY[7] + (deep[end] ^ (deep[end] >> np.uint64(31))) * _BY[8] + count.astype(np.uint64)
        found.append((bucket, mixed.view(np.int64), start + at, count))
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


_RUNS = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("bucket", pa.int64()), ("a", pa.int64()), ("start", pa.int32()), ("n", pa.int16())])
_OPEN = pa.schema([("bucket", pa.int64()), ("hot", pa.bool_()), ("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("ids", pa.list_(pa.int64()))])
_GONE = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _buckets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found = [runs(data, False)[0] for data in (_bytes(t.as_py()) for t in batch.column(2)) if len(data) >= LENGTH]
    if found:
        bucket, n = np.unique(np.concatenate(found), return_counts=True)
        yield as_batch([bucket, n], pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, parts = [], []
    for doc, sub, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        data = _bytes(text.as_py())
        if len(data) >= LENGTH:
            bucket, a, start, count = runs(data)
            ids.append((doc, sub))
            parts.append((bucket, a, start.astype(np.int32), count.astype(np.int16)))
    if parts:
        doc, sub = (np.repeat([i[k] for i in ids], [len(p[0]) for p in parts]) for k in range(2))
        yield as_batch([doc, sub, *(np.concatenate(x) for x in zip(*parts))], _RUNS)


def _open(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The identifiers of the single offsets of a document's runs; those of a hot bucket are rows of their own."""
    for doc, sub, text, reps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
        data, out = _bytes(text.as_py()), []
        for r in reps.as_py():
            s, n = r["start"], r["n"]
            ids = identifiers(grams(data[s : s + n + LENGTH - 1])).view(np.int64)
            if r["hot"]:
                out += [(r["bucket"], True, doc, sub, s + k, ids[k : k + 1]) for k in range(n)]
            else:
                out.append((r["bucket"], False, doc, sub, s, ids))
            if len(out) >= 8192:
                yield as_batch([*zip(*out)], _OPEN)
                out = []
        if out:
            yield as_batch([*zip(*out)], _OPEN)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and occurrence: the offsets whose identifier came before in the bucket, as stretches. What is held is one batch and the identifiers of one bucket."""
    at, known, last = None, set(), None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
        lists = batch.column(5)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        out = []
        for key, lo, hi in zip(keys, ends[:-1], ends[1:]):
            if key == last:
                continue
            last = key
            if key[0] != at:
                at, known = key[0], set()
            ids = values[lo:hi].tolist()
            again = [False, *(x in known for x in ids), False]
            known.update(ids)
            # A run's own offsets can be equal too.
            if len(set(ids)) < len(ids):
                mine: set[int] = set()
                for k, x in enumerate(ids, 1):
                    again[k] |= x in mine
                    mine.add(x)
            begun = 0
            for k in range(1, len(again)):
                if again[k] and not again[k - 1]:
                    begun = k
                elif again[k - 1] and not again[k]:
                    out.append((key[2], key[3], key[4] + begun - 1, k - begun))
        yield as_batch([*zip(*out)] if out else [[]] * 4, _GONE)


def kept(text: str | None, starts: list[int] | None, counts: list[int] | None) -> tuple[int, int, int, bytes]:
    """(bytes, removed, maximal removed runs, what is left); starts and counts are the offsets whose string is a repeat."""
    data = _bytes(text)
    edge = np.zeros(len(data) + 1, np.int32)
    if starts:
        s = np.asarray(starts, np.int64)
        np.add.at(edge, np.minimum(s, len(data)), 1)
        np.add.at(edge, np.minimum(s + np.asarray(counts, np.int64) + LENGTH - 1, len(data)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
    return len(data), int(gone.sum()), spans, data[~gone].tobytes()


def _clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = []
    for text, starts, counts in zip(*(batch.column(i) for i in (1, 2, 3))):
        n, removed, spans, left = kept(text.as_py(), starts.as_py(), counts.as_py())
        rows.append((n, removed, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    yield as_batch([batch.column(0), *(zip(*rows) if rows else [[]] * 5)], schema)


def dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text (broken characters replaced)."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("sub"), "text")
    long_ = d.select("doc", "sub", "text").where(F.octet_length("text") >= LENGTH)
    repeated = materialize(map_text(long_, "text", _buckets, "bucket long, n long", 1 << 20).groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket"), "repeat-buckets")
    free_shuffles(spark)
    found = map_text(long_, "text", _runs, "doc long, sub long, bucket long, a long, start int, n smallint", 1 << 20)
    found = materialize(found.join(repeated, "bucket", "left_semi"), "repeat-runs")
    discard(repeated)
    keys, where = ["bucket", "a"], F.struct("doc", "sub", "start")
    first = materialize(found.groupBy(*keys).agg(F.min(where).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c")), "repeat-first")
    free_shuffles(spark)
    whole = materialize(found.join(first.where("c > 1").select(*keys, "first"), keys).where(where > F.col("first")).select("doc", "sub", "start", F.col("n").cast("int").alias("n")), "repeat-whole")
    discard(found)
    mixed = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", (F.col("k") > PART).alias("hot"))
    reps = first.join(mixed, "bucket").select("first.doc", "first.sub", F.struct("first.start", F.col("n").cast("int").alias("n"), "bucket", "hot").alias("r"))
    reps = reps.groupBy("doc", "sub").agg(F.collect_list("r").alias("reps"))
    opened = map_text(long_.join(reps, ["doc", "sub"]), "text", _open, "bucket long, hot boolean, doc long, sub long, start int, ids array<long>", 1 << 20)
    opened = materialize(opened, "repeat-open")
    cold = opened.where("not hot").repartition("bucket").sortWithinPartitions("bucket", "doc", "sub", "start").mapInArrow(_seen, "doc long, sub long, start int, n int")
    with small_batches(spark):
        single = materialize(cold, "repeat-single")
    each = opened.where("hot").select("bucket", F.col("ids")[0].alias("id"), "doc", "sub", "start")
    least = each.groupBy("bucket", "id").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    hot = materialize(each.join(least, ["bucket", "id"]).where(where > F.col("first")).select("doc", "sub", "start", F.lit(1).alias("n")), "repeat-hot")
    discard(first, opened)
    gone = whole.union(single).union(hot).groupBy("doc", "sub").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    return map_text(
        d.join(gone, ["doc", "sub"], "left").select("doc_id", "text", "starts", "counts"), "text", _clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
