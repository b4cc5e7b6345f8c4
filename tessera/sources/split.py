"""Files cut into pieces by their kind. A file is read by one worker, and its pieces are made one after the other; files stay where they are.

A piece is (path, kind, method, piece, payload, detail): `detail` says, as JSON, what part of the file it is. Text pieces break after the line or record that fills them to the target, the
middle of the least and the most bytes; numeric ones are cut along the first axis or thinned out by two along every axis."""

from __future__ import annotations

import io
import itertools
import json
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators.batches import bounded
from tessera.operators.filters import SIZES
from tessera.sources import scan

#: Bytes of a piece, and letters on a FASTA line.
LEAST, MOST, LINE = 10000 << 10, 50000 << 10, 80
SCHEMA = "path string, kind string, method string, piece int, payload binary, detail string"


class Size(NamedTuple):
    least: int = LEAST
    most: int = MOST
    pieces: int | None = None

    @property
    def target(self) -> int:
        return (self.least + self.most) // 2


Piece = tuple[str, bytes, dict]


def filled(parts: Iterable[bytes], target: int) -> Iterator[list[bytes]]:
    """Parts in order, as many together as reach the target."""
    held: list[bytes] = []
    size = 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= target:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_lines(raw: bytes, name: str, size: Size) -> Iterator[Piece]:
    """S21."""
    for lines in filled(io.BytesIO(raw), size.target):
        yield "line_chunk", b"".join(lines), {"line_count": len(lines)}


def fastq(raw: bytes, name: str, size: Size) -> Iterator[Piece]:
    """Reads of four lines; a read that is cut off raises ValueError."""
    lines = io.BytesIO(raw)

    def reads() -> Iterator[bytes]:
        while four := [*itertools.islice(lines, 4)]:
            if len(four) < 4:
                raise ValueError(f"a read of {name} is cut off")
            yield b"".join(four)

    start = 0
    for some in filled(reads(), size.target):
        yield "read_chunk", b"".join(some), {"read_start": start, "read_stop": start + len(some), "read_count": len(some)}
        start += len(some)


def wrapped(sequence: str, width: int = LINE) -> str:
    """S14."""
    return "\n".join(sequence[i : i + width] for i in range(0, len(sequence), width))


def fasta(raw: bytes, name: str, size: Size) -> Iterator[Piece]:
    """Windows of each record, whose header tells chunk and bases (from 1)."""
    target = max(1, int(size.target * LINE / (LINE + 1)))
    lines = [x for x in (line.strip() for line in io.StringIO(raw.decode("utf-8", "replace"))) if x]
    if lines and not lines[0].startswith(">"):
        raise ValueError(f"{name} has a sequence before any header")
    heads = [i for i, x in enumerate(lines) if x.startswith(">")]
    for number, (at, end) in enumerate(zip(heads, [*heads[1:], len(lines)]), 1):
        start = 1
        for chunk, some in enumerate(filled((x.encode() for x in lines[at + 1 : end]), target)):
            bases = b"".join(some).decode()
            stop = start + len(bases) - 1
            payload = f"{lines[at]} | chunk={chunk} bases={start}-{stop}\n{wrapped(bases)}\n"
            detail = {"record_header": lines[at][1:], "record_position": number, "chunk_index_in_record": chunk, "base_start": start, "base_stop": stop, "base_count": len(bases)}
            yield "sequence_window", payload.encode(), detail
            start = stop + 1


def loop_name(tags: list[str], other: str = "loop") -> str:
    """S18."""
    return next((t.strip().lstrip("_").replace(".", "_") for t in tags if t.strip().startswith("_")), other)


def mmcif(raw: bytes, name: str, size: Size) -> Iterator[Piece]:
    """Loops whose rows reach the target are cut, each piece with the loop's header; what lies between is cut after a `#` line that reaches it. Small files are pieces as they are."""
    if len(raw) <= size.most:
        yield "copy_small_file", raw, {}
        return
    lines = io.StringIO(raw.decode("utf-8", "replace")).readlines()
    title = f"data_{name.rsplit('/', 1)[-1].rsplit('.', 1)[0]}"
    if lines and lines[0].startswith("data_"):
        title = lines.pop(0).strip()
    weight = lambda some: sum(len(x.encode()) for x in some)

    def piece(some: list[str]) -> bytes:
        text = f"{title}\n#\n" + "".join(some)
        return (text if text.endswith("\n") else text + "\n").encode()

    between: list[str] = []
    at = 0
    while at < len(lines):
        if not lines[at].startswith("loop_"):
            between.append(lines[at])
            at += 1
            if between[-1].strip() == "#" and weight(between) >= size.target:
                yield "mmcif_section_chunk", piece(between), {}
                between = []
            continue
        end = at + 1
        while end < len(lines) and lines[end].startswith("_"):
            end += 1
        head, stop = lines[at:end], end
        while stop < len(lines) and lines[stop].strip() != "#":
            stop += 1
        rows, cut, at = lines[end:stop], False, stop + 1
        for some in filled((x.encode() for x in rows), size.target - weight(head)):
            part = [x.decode() for x in some]
            if weight(head) + weight(part) >= size.target or cut:
                if not cut and between:
                    yield "mmcif_section_chunk", piece(between), {}
                    between = []
                cut = True
                yield "mmcif_loop_chunk", piece([*head, *part, "#\n"]), {"loop_name": loop_name(head[1:]), "row_count": len(part)}
            else:
                between += [*head, *part, "#\n"]
                if weight(between) >= size.target:
                    yield "mmcif_section_chunk", piece(between), {}
                    between = []
    if between:
        yield "mmcif_section_chunk", piece(between), {}


def best_3d(n: int) -> tuple[tuple[int, int, int], float] | None:
    """the factors nearest to a cube, and the largest over the least."""
    found = None
    for a in range(round(n ** (1 / 3)), 0, -1):
        if n % a:
            continue
        side = next(s for s in range(int((n // a) ** 0.5), 0, -1) if n // a % s == 0)
        shape = tuple(sorted((a, side, n // a // side)))
        score = shape[2] / shape[0]
        if found is None or score < found[1]:
            found = shape, score
    return found


def numeric_layout(name: str, length: int, dtype: str | None, candidates: list[list[int]], known: list[list[int]]) -> dict:
    """Type, shape and where each comes from. Without a type, the first of four whose number of items a shape has; without any, ValueError."""
    shapes = [(tuple(s), "dataset_table") for s in known] + [(tuple(s), "path_or_name") for s in candidates]
    fit = lambda count: next(((s, w) for s, w in shapes if int(np.prod(s, dtype=object)) == count), None)
    if dtype is None:
        for guess in ("float32", "float64", "int32", "int64"):
            if length % SIZES[guess] == 0 and (found := fit(length // SIZES[guess])):
                return {"dtype": guess, "dtype_from": "heuristic", "shape": found[0], "shape_from": found[1], "used": length}
        raise ValueError(f"no type can be told for {name}")
    count = length // SIZES[dtype]
    found = fit(count)
    if not found and count <= 0:
        raise ValueError(f"{name} holds no whole item")
    if not found and count >= 64 and (cube := best_3d(count)) and cube[1] <= 16:
        found = cube[0], "heuristic_3d"
    if not found and count >= 16:
        side = next(s for s in range(int(count**0.5), 0, -1) if count % s == 0)
        found = ((side, count // side), "heuristic_2d") if count / side / side <= 64 else None
    shape, source = found or ((count,), "1d_fallback")
    return {"dtype": dtype, "dtype_from": "filename", "shape": shape, "shape_from": source, "used": count * SIZES[dtype]}


def rounds(total: int, ndim: int, size: Size) -> int:
    """How often to halve every axis: nearest to the middle of the bounds, among those within them if there are any; the fewest at ties."""
    left = [total / 2 ** (ndim * r) for r in range(12)]
    within = [r for r, b in enumerate(left) if size.least <= b <= size.most]
    return min(within or range(12), key=lambda r: (abs(left[r] - (size.least + size.most) / 2), r))


def thinned(x: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, list[list[int]]]]:
    """Every second item along each axis, from each start, over and over; with the starts taken."""
    for path in itertools.product(itertools.product((0, 1), repeat=x.ndim), repeat=times):
        part = x
        for starts in path:
            part = part[tuple(slice(s, None, 2) for s in starts)]
        yield part, [list(s) for s in path]


def slabs(x: np.ndarray, size: Size) -> Iterator[tuple[np.ndarray, dict]]:
    """As many items, or layers of the first axis, as the target holds."""
    layer = x.itemsize * int(np.prod(x.shape[1:], dtype=np.int64))
    step = max(1, size.target // max(1, layer))
    first, last = ("element_start", "element_stop") if x.ndim == 1 else ("axis0_start", "axis0_stop")
    for at in range(0, len(x), step):
        yield x[at : at + step], {first: at, last: min(at + step, len(x))}


def array_pieces(x: np.ndarray, length: int, size: Size, save: Callable[[np.ndarray], bytes], raw: bytes) -> Iterator[Piece]:
    """S11."""
    if length <= size.most:
        yield "copy_small_file", raw, {"source_shape": x.shape, "sample_shape": x.shape}
    elif x.ndim in (2, 3) and x.dtype.kind in "iuf":
        times = rounds(x.nbytes, x.ndim, size)
        for part, path in thinned(x, times):
            yield "stride_2_sampling", save(np.ascontiguousarray(part)), {"sampling_rounds": times, "sampling_path": path, "source_shape": x.shape, "sample_shape": part.shape}
    else:
        for part, detail in slabs(x, size):
            yield "contiguous_slice" if x.ndim == 1 else "axis0_slice", save(np.ascontiguousarray(part)), detail | {"source_shape": x.shape, "sample_shape": part.shape}


def numeric(raw: bytes, name: str, size: Size, dtype: str | None, candidates: list, known: list) -> Iterator[Piece]:
    """S6."""
    lay = numeric_layout(name, len(raw), dtype, candidates, known)
    x = np.frombuffer(raw[: lay["used"]], np.dtype(lay["dtype"]).newbyteorder("<")).reshape(lay["shape"])
    about = {k: lay[k] for k in ("dtype", "dtype_from", "shape_from")} | {"tail_dropped_bytes": len(raw) - lay["used"]}
    for method, payload, detail in array_pieces(x, len(raw), size, np.ndarray.tobytes, raw):
        yield method, payload, about | detail


def npy(raw: bytes, name: str, size: Size) -> Iterator[Piece]:
    """Arrays of one to three axes; pieces are .npy files."""
    x = np.load(io.BytesIO(raw), allow_pickle=False)

    def save(part: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, part)
        return out.getvalue()

    if not 1 <= x.ndim <= 3:
        raise ValueError(f"{name} has {x.ndim} axes")
    for method, payload, detail in array_pieces(x, len(raw), size, save, raw):
        yield method, payload, {"dtype": x.dtype.name} | detail


#: How a file of each kind is cut; a kind whose library isn't there is copied whole.
KINDS: dict[str, Callable[[bytes, str, Size], Iterator[Piece]]] = {
    "text_lines": text_lines,
    "fastq": fastq,
    "fasta": fasta,
    "mmcif": mmcif,
    "npy": npy,
    "tiff": lambda raw, name, size: iter([("copy_no_tifffile", raw, {})]),
    "netcdf": lambda raw, name, size: iter([("copy_netcdf_hdf5", raw, {})]),
}


def split(listing: DataFrame, size: Size = Size()) -> DataFrame:
    """Pieces of (path, content) by kind, at most `size.pieces` of a file (S22). Files that are skipped give none; one that can't be cut gives a piece of method `failed`, with the reason and no
    bytes."""
    path = F.col("path")
    known = scalars._shapes(scalars.dataset_key(path), scalars.SPLIT_SHAPES)
    rows = listing.select("path", scan.outcome(path)["kind"].alias("kind"), scalars.split_dtype(F.substring_index(path, "/", -1)).alias("dtype"), scalars.dimension_candidates(path).alias("dims"), known.alias("known"), "content")

    def cut(row: tuple) -> Iterator[tuple]:
        name, kind, dtype, dims, shapes, raw = row
        try:
            found = numeric(raw, name, size, dtype, dims, shapes) if kind == "raw_numeric" else KINDS[kind](raw, name, size)
            for k, (method, payload, detail) in enumerate(itertools.islice(found, size.pieces)):
                yield name, kind, method, k, payload, json.dumps(detail)
        except ValueError as e:
            yield name, kind, "failed", -1, b"", json.dumps({"reason": str(e)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bounded(batches, cut, SCHEMA)

    return rows.where("kind is not null").mapInArrow(run, SCHEMA)


def suffix(path: Column) -> Column:
    from tessera.operators import names

    return names.suffix(path)


def finished(pieces: DataFrame) -> DataFrame:
    """The records of pieces: `id` over all and `slice_file` numbered in each dataset, in order of path and piece. Datasets are numbered apart; their sizes are one row each."""
    rows = pieces.where("piece >= 0").withColumn("dataset", F.split_part("path", F.lit("/"), F.lit(1))).withColumn("slice_size_bytes", F.octet_length("payload"))
    counts = rows.groupBy("dataset", "path").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each file is ordered here, not one for each piece.
    starts = counts.withColumn("local", before(Window.partitionBy("dataset").orderBy("path")))
    sets = counts.groupBy("dataset").agg(F.sum("n").alias("n"))
    sets = sets.withColumn("all", before(Window.orderBy("dataset"))).select("dataset", "all")
    placed = rows.join(starts.select("dataset", "path", "local"), ["dataset", "path"]).join(F.broadcast(sets), "dataset")
    number = F.col("local") + F.col("piece") + 1
    name = F.concat("dataset", F.lit("/"), F.lpad(number.cast("string"), 6, "0"), suffix(F.col("path")))
    out = placed.withColumn("id", (F.col("all") + number).cast("long")).withColumn("slice_file", name).withColumnRenamed("path", "source_file")
    return out.select("id", "dataset", "source_file", "kind", "method", "piece", "slice_size_bytes", "slice_file", "detail", "payload")
