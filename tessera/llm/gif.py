"""GIF: LZW code streams, palettes, disposal and transparency, timed frames with colour-histogram columns.

`decode` plays any GIF87a/89a: it resolves local and global palettes, interlacing, transparency and disposal onto the canvas. `store` writes a payload of whole 576-byte rows as frames of at most
64 rows with a grey palette, so that samples are palette indices and are read back without loss. Cases: null text is empty (its payload is 576 bytes of 255); equal texts give equal
bytes; a null doc_id and repeated rows are returned as they are; a damaged stream raises ValueError; an empty table gives no rows; memory is that of one text and its frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_batch, map_text, pick

UNIT = 576
FRAME_ROWS = 64
DELAY = 4
BINS = 16


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """Words are nodes of a trie: a node maps the next byte to the code and node of the longer word."""
    clear = 1 << depth
    tries: list[dict] = [{} for _ in range(clear)]
    free, width = clear + 2, depth + 1
    out, held, bits = bytearray(), clear, width
    if data:
        now = data[0]
        node = tries[now]
        for b in data[1:]:
            found = node.get(b)
            if found is not None:
                now, node = found
                continue
            held |= now << bits
            bits += width
            if bits >= 512:
                out += (held & ((1 << 512) - 1)).to_bytes(64, "little")
                held >>= 512
                bits -= 512
            if free < 4096:
                node[b] = (free, {})
                if free == 1 << width:
                    width += 1
                free += 1
            else:
                held |= clear << bits
                bits += width
                tries = [{} for _ in range(clear)]
                free, width = clear + 2, depth + 1
            now, node = b, tries[b]
        held |= now << bits
        bits += width
        # The decoder has one entry more by now, and may be a bit wider.
        if free == 1 << width and width < 12:
            width += 1
    held |= (clear + 1) << bits
    bits += width
    return bytes(out) + held.to_bytes((bits + 7) // 8, "little")


@lru_cache(maxsize=16)
def _widths(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each code since a clear code, and where it begins: the table has an entry more with each code but the first, until it is full."""
    entries = (1 << depth) + 2 + np.maximum(np.arange(4096) - 1, 0)
    width = np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, depth + 1, 12)
    return width, np.cumsum(width) - width


def _codes(data: np.ndarray, at: int, depth: int, full: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes from bit `at` on, as many as there may be before the table is full (or 4,096 of twelve bits, if it is), and where each ends."""
    width, start = (np.full(4096, 12), np.arange(4096) * 12) if full else _widths(depth)
    ends = at + start + width
    n = int(np.searchsorted(ends, (len(data) - 3) * 8, "right"))
    place = at + start[:n]
    byte = place >> 3
    window = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
    return window >> (place & 7) & ((1 << width[:n]) - 1), ends[:n]


def lzw_decode(data: bytes, depth: int, size: int) -> bytes:
    clear = 1 << depth
    end = clear + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    bits = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    out: list[bytes] = []
    total, at, table, last, full = 0, 0, list(base), None, False
    while total < size:
        codes, ends = _codes(bits, at, depth, full)
        if not len(codes):
            raise ValueError("code stream ends early")
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        for code in codes[:n].tolist():
            if last is None:
                if code >= clear:
                    raise ValueError("bad first code")
                word = table[code]
            elif code < len(table):
                word = table[code]
                if len(table) < 4096:
                    table.append(last + word[:1])
            elif code == len(table) < 4096:
                word = last + last[:1]
                table.append(word)
            else:
                raise ValueError("bad code")
            out.append(word)
            last = word
            total += len(word)
            if total >= size:
                break
        if total >= size or n < len(codes) and codes[n] == end:
            break
        if n < len(codes):
            at, table, last, full = int(ends[n]), list(base), None, False
        else:
            at, full = int(ends[-1]), True
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def store(payload: bytes) -> bytes:
    """Grey frames UNIT wide and at most FRAME_ROWS high, each shown DELAY hundredths of a second and kept."""
    rows = len(payload) // UNIT
    out = [b"GIF89a", struct.pack("<HHBBB", UNIT, min(rows, FRAME_ROWS), 0xF7, 0, 0), bytes(v for i in range(256) for v in (i, i, i))]
    for at in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - at)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 0x04, DELAY, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, UNIT, n, 0) + b"\x08" + _blocks(lzw_encode(payload[at * UNIT : (at + n) * UNIT])))
    return b"".join(out) + b"\x3b"


def frames(data: bytes) -> Iterator[dict]:
    """Frames as stored: delay, disposal, transparent, place, palette and the index of each sample, rows in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    control = (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                f, delay, clear = struct.unpack_from("<BHB", data, at + 3)
                control = (delay, f >> 2 & 7, clear if f & 1 else None)
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if f & 0x80:
            n = 3 << ((f & 7) + 1)
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        if palette is None:
            raise ValueError("no palette")
        depth, at, parts = data[at], at + 1, []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        index = np.frombuffer(lzw_decode(b"".join(parts), depth, w * h), np.uint8)
        if len(index) < w * h:
            raise ValueError("frame ends early")
        index = index.reshape(h, w)
        if f & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            index = index[np.argsort(order)]
        yield {"canvas": (width, height), "back": back, "delay": control[0], "disposal": control[1], "transparent": control[2], "place": (left, top, w, h), "palette": palette, "index": index}
        control = (0, 0, None)


def decode(data: bytes) -> Iterator[tuple[int, int, tuple[int, int, int, int], np.ndarray]]:
    """(start and length in hundredths of a second, place drawn on, RGBA canvas) of each frame as it is shown; the canvas is good until the next frame."""
    canvas, start = None, 0
    for f in frames(data):
        w, h = f["canvas"]
        if canvas is None:
            canvas = np.zeros((h, w, 4), np.uint8)
        left, top, fw, fh = f["place"]
        before = canvas.copy() if f["disposal"] == 3 else None
        area = canvas[top : top + fh, left : left + fw]
        index = f["index"][: area.shape[0], : area.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f["palette"]), :3], colours[:, 3] = f["palette"], 255
        if f["transparent"] is None:
            area[:] = colours[index]
        else:
            seen = index != f["transparent"]
            area[seen] = colours[index[seen]]
        yield start, f["delay"], f["place"], canvas
        start += f["delay"]
        if f["disposal"] == 2:
            area[:] = 0
        elif f["disposal"] == 3:
            canvas = before


def histogram(pixels: np.ndarray) -> list[int]:
    """Of RGBA pixels that are shown: BINS counts each of red, green and blue."""
    shown = pixels[pixels[..., 3] > 0]
    return [int(n) for c in range(3) for n in np.bincount(shown[:, c] // (256 // BINS), minlength=BINS)]


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def measure(text: str | None) -> tuple:
    n, data = payload(text)
    media = store(data)
    parts, counts, time = [], np.zeros(BINS, np.int64), 0
    for start, delay, (left, top, w, h), canvas in decode(media):
        grey = canvas[top : top + h, left : left + w, 0].ravel()
        counts += np.bincount(grey // (256 // BINS), minlength=BINS)
        parts.append(grey.tobytes())
        time = start + delay
    back = b"".join(parts)
    feature = f"frames={len(parts)};time={time};histogram=" + ",".join(map(str, counts))
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, gif (its payload as a GIF)."""
    d = pick(docs, "doc_id", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [store(payload(t.as_py())[1]) for t in batch.column(1)]
        yield as_batch([batch.column(0), made], pa.schema([("doc_id", batch.schema.field(0).type), ("gif", pa.binary())]))

    return map_text(d, "text", run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, gif binary")


def timed_frames(gifs: DataFrame) -> DataFrame:
    """(doc_id, gif) to one row for each frame as it is shown: doc_id, frame (from 0), start and delay in hundredths of a second, histogram (16 counts each of red, green, blue over the whole canvas).
    A null GIF has no rows."""
    d = pick(gifs, "doc_id", "gif").where("gif is not null")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", batch.schema.field(0).type), ("frame", pa.int32()), ("start", pa.int64()), ("delay", pa.int64()), ("histogram", pa.list_(pa.int64()))])
        for doc, gif in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = [(doc, k, start, delay, histogram(canvas)) for k, (start, delay, _, canvas) in enumerate(decode(gif.as_py()))]
            yield as_batch([*zip(*rows)] if rows else [[]] * 5, schema)

    return map_text(d, "gif", run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, frame int, start long, delay long, histogram array<long>")


def _measured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = [measure(t.as_py()) for t in batch.column(1)]
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    yield as_batch([batch.column(0), *(zip(*rows) if rows else [[]] * 7)], pa.schema([("doc_id", batch.schema.field(0).type), *kinds]))


def store_all(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    d = pick(docs, "doc_id", "text")
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_text(d, "text", _measured, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {schema}")
