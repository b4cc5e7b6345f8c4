"""Slices as files: a pipeline's output with a header, metadata and the bytes that fill no item, and back.

The header has 64 bytes, little-endian: magic, version, selector's mode, header size, pipeline id, sizes of metadata and tail, of payload and original, and 28 zero bytes. The file has no
checksum; sizes are checked. Rows stay where they are, slice by slice."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters, registry
from tessera.operators.batches import bounded, rows_of
from tessera.operators.filters import Layout
from tessera.operators.sweep import CODECS

#: Fixed values of the format.
MAGIC, VERSION, FORMAT, HEAD = b"CPSS", 1, "<4sBBHIIIQQ28x", 64
MODES = {"exhaustive": 1, "model": 2, "hybrid": 3}


class Artifact(NamedTuple):
    pipeline: str
    payload: bytes
    tail: bytes
    metadata: dict

    @property
    def stored_size(self) -> int:
        """Payload, tail and metadata, without the header."""
        return len(self.payload) + len(self.tail) + len(encode_metadata(self.metadata))


def encode_metadata(metadata: dict) -> bytes:
    return json.dumps(metadata, ensure_ascii=False, separators=(",", ":")).encode("utf-8")


def decode_metadata(raw: bytes) -> dict:
    return json.loads(raw) if raw else {}


def compress(raw: bytes, pipeline: str, lay: Layout = Layout(), selector: dict | None = None, made: dict | None = None) -> Artifact:
    """X7. Pipelines that have no id, filters that don't apply and codecs that aren't there raise ValueError. `made` keeps filters' outputs for other pipelines of the same slice."""
    names, codec = registry.parse(pipeline)
    name = registry.join(names, codec)
    if name not in registry.IDS:
        raise ValueError(f"{name} can't be written to a file")
    end = len(raw) - len(raw) % lay.size
    middle, trace = raw[:end], []
    made = {} if made is None else made
    for k, f in enumerate(names, 1):
        if names[:k] not in made:
            made[names[:k]] = filters.ALL[f][0](middle, lay)
        middle, needed = made[names[:k]]
        trace.append({"name": f, "meta": needed})
    context = {"dtype_name": lay.dtype, "shape": list(lay.shape) if lay.shape else None, "typesize": lay.size, "endian": "little"}
    metadata = {"pipeline_name": name, "pipeline_id": registry.IDS[name], "context": context, "aligned_size": end, "tail_size": len(raw) - end, "filter_trace": trace, "selector": selector or {}}
    return Artifact(name, CODECS[codec][0](middle), raw[end:], metadata)


def _undone(payload: bytes, metadata: dict, tail: bytes, codec_size: int | None = None) -> bytes:
    names, codec = registry.parse(metadata["pipeline_name"])
    context, size = metadata.get("context") or {}, int(metadata.get("aligned_size", 0))
    lay = Layout(context.get("dtype_name"), tuple(context["shape"]) if context.get("shape") else None)
    middle = CODECS[codec][1](payload, codec_size)
    for stage in reversed(metadata.get("filter_trace", [])):
        middle = filters.ALL[registry.canonical(stage["name"])][1](middle, lay, stage.get("meta") or {})
    if size and len(middle) != size:
        raise ValueError(f"{len(middle)} bytes came back of {size}")
    return middle + tail


def decompress(payload: bytes, metadata: dict, tail: bytes = b"", pipeline_id: int | None = None) -> bytes:
    """The name in the metadata wins over the id."""
    if "pipeline_name" not in metadata:
        if pipeline_id not in registry.IDS.values():
            raise ValueError(f"unknown pipeline id: {pipeline_id}")
        metadata = metadata | {"pipeline_name": registry.DEPLOYABLE[pipeline_id - 1]}
    return _undone(payload, metadata, tail)


def to_file(artifact: Artifact, original: int, mode: str = "exhaustive") -> bytes:
    meta = encode_metadata(artifact.metadata)
    head = struct.pack(FORMAT, MAGIC, VERSION, MODES[mode], HEAD, registry.IDS[artifact.pipeline], len(meta), len(artifact.tail), len(artifact.payload), original)
    return b"".join([head, meta, artifact.tail, artifact.payload])


def read_header(raw: bytes) -> dict:
    """Raises ValueError for another magic, version or header size."""
    if len(raw) < HEAD:
        raise ValueError("the header is cut off")
    magic, version, mode, size, *rest = struct.unpack_from(FORMAT, raw)
    if (magic, version, size) != (MAGIC, VERSION, HEAD):
        raise ValueError("no file of this format")
    names = {v: k for k, v in MODES.items()}
    return {"version": version, "mode": names.get(mode, "unknown"), **dict(zip(("pipeline_id", "metadata_size", "tail_size", "payload_size", "original_size"), rest))}


def from_file(raw: bytes) -> bytes:
    h = read_header(raw)
    ends = [HEAD]
    for part in ("metadata_size", "tail_size", "payload_size"):
        ends.append(ends[-1] + h[part])
    if len(raw) < ends[-1]:
        raise ValueError("the file is cut off")
    meta, tail, payload = (raw[a:b] for a, b in zip(ends, ends[1:]))
    out = decompress(payload, decode_metadata(meta), tail, h["pipeline_id"])
    if len(out) != h["original_size"]:
        raise ValueError(f"{len(out)} bytes came back of {h['original_size']}")
    return out


def attempts(raw: bytes, lay: Layout, candidates: Sequence[str]) -> Iterator[tuple[str, Artifact | None, str | None]]:
    """Each candidate's artifact, one at a time, or the reason why it has none. Candidates share the outputs of their filters."""
    shared: dict = {}
    selector = {"mode": "exhaustive", "candidate_count": len(candidates)}
    for name in candidates:
        try:
            yield name, compress(raw, name, lay, selector, shared), None
        except Exception as e:  # a filter or codec may fail in any way; its row says how
            yield name, None, str(e)


def ranking(raw: bytes, lay: Layout, candidates: Sequence[str]) -> list[tuple[str, int | None, str | None, Artifact | None]]:
    """Each candidate's stored size, or the reason why it has none."""
    return [(name, made and made.stored_size, reason, made) for name, made, reason in attempts(raw, lay, candidates)]


def exhaustive(s: DataFrame, candidates: tuple[str, ...] = registry.DEPLOYABLE) -> DataFrame:
    """(id, rank, pipeline, stored_size, available, reason); the smallest first, the first candidate at ties, failures last in their order."""

    def rows(i, raw: bytes, lay: Layout) -> Iterator[tuple]:
        tried = [(size is None, size or 0, k, name, reason) for k, (name, size, reason, _) in enumerate(ranking(raw, lay, list(candidates)))]
        for rank, (failed, size, _, name, reason) in enumerate(sorted(tried), 1):
            yield i, rank, name, None if failed else size, not failed, reason

    return rows_of(s, rows, "id long, rank int, pipeline string, stored_size long, available boolean, reason string", heavy=True)


def pack(s: DataFrame, candidates: tuple[str, ...] = registry.DEPLOYABLE, mode: str = "exhaustive") -> DataFrame:
    """(id, pipeline, file) of each slice by its smallest candidate. A slice that none can hold fails the job."""

    def rows(i, raw: bytes, lay: Layout) -> Iterator[tuple]:
        made = [a for *_, a in ranking(raw, lay, list(candidates)) if a]
        if not made:
            raise ValueError(f"no pipeline can hold slice {i}")
        best = min(made, key=lambda a: a.stored_size)
        yield i, best.pipeline, to_file(best, len(raw), mode)

    return rows_of(s, rows, "id long, pipeline string, file binary", heavy=True)


def _mapped(files: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bounded(batches, fn, schema)

    return files.select("id", "file").mapInArrow(run, schema)


def unpack(files: DataFrame) -> DataFrame:
    """(id, raw) of (id, file)."""
    return _mapped(files, lambda row: [(row[0], from_file(row[1]))], "id long, raw binary")


def inspect(files: DataFrame) -> DataFrame:
    """The header's fields and the metadata as text."""

    def fn(row: tuple) -> list[tuple]:
        h = read_header(row[1])
        return [(row[0], *h.values(), row[1][HEAD : HEAD + h["metadata_size"]].decode("utf-8"))]

    return _mapped(files, fn, "id long, version int, mode string, pipeline_id int, metadata_size long, tail_size long, payload_size long, original_size long, metadata string")


def round_trips(s: DataFrame, candidates: tuple[str, ...] = registry.DEPLOYABLE) -> DataFrame:
    """(id, pipeline_id, pipeline, ok, reason): every candidate written to a file and read back."""

    def rows(i, raw: bytes, lay: Layout) -> Iterator[tuple]:
        for name, made, reason in attempts(raw, lay, candidates):
            yield i, registry.IDS.get(name), name, made is not None and from_file(to_file(made, len(raw))) == raw, reason

    return rows_of(s, rows, "id long, pipeline_id int, pipeline string, ok boolean, reason string", heavy=True)


def hybrid(ranked: DataFrame, measured: DataFrame, k: int) -> DataFrame:
    """Of a model's ranking (id, pipeline, score, available) the first max(1, k) available ones of each slice, and of these the smallest measured (id, pipeline, stored_size)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pipeline"))
    short = ranked.where("available").withColumn("place", place).where(F.col("place") <= max(1, k)).select("id", "pipeline", "place")
    both = short.join(measured.where("stored_size is not null").select("id", "pipeline", "stored_size"), ["id", "pipeline"])
    return both.groupBy("id").agg(F.min_by("pipeline", F.struct("stored_size", "place")).alias("pipeline"), F.min("stored_size").alias("stored_size"))
