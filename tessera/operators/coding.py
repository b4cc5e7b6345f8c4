"""Integer codes in columns: LEB128, zigzag and bit packing, lowest bit first."""

from __future__ import annotations

import numpy as np

_SEVEN = np.uint64(7)


def uleb(values: np.ndarray, after: np.ndarray | None = None) -> bytes:
    """LEB128 of unsigned values, one after the other, each followed by its byte of `after`, if that is given."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    places = np.arange(10, dtype=np.uint64) * _SEVEN
    parts = v[:, None] >> places
    used = parts > 0
    used[:, 0] = True
    more = np.concatenate([used[:, 1:], np.zeros((len(v), 1), bool)], axis=1)
    out = (parts & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
    if after is not None:
        out, used = np.column_stack([out, after]), np.column_stack([used, np.ones(len(v), bool)])
    return out[used].tobytes()


def unuleb1(raw: bytes, at: int) -> tuple[int, int]:
    """One value from `at`, and where it ends."""
    n = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("a value is cut off or longer than ten bytes")
        c = raw[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def uleb1(n: int) -> bytes:
    """LEB128 of one value."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def unuleb(raw: bytes, count: int | None = None, at: int = 0) -> tuple[np.ndarray, int]:
    """`count` values (all that there are, if None) from `at`, and where they end. Raises ValueError on a cut or overlong value."""
    b = np.frombuffer(raw, np.uint8)[at : None if count is None else at + 10 * count]
    ends = np.flatnonzero(b < 128)[:count]
    if (count is not None and len(ends) < count) or (count is None and len(b) and b[-1] > 127):
        raise ValueError("a value is cut off")
    if not len(ends):
        return np.zeros(0, np.uint64), at
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (ends - starts).max() > 9:
        raise ValueError("a value is longer than ten bytes")
    stop = int(ends[-1]) + 1
    place = np.arange(stop) - np.repeat(starts, ends - starts + 1)
    parts = (b[:stop] & 127).astype(np.uint64) << (place.astype(np.uint64) * _SEVEN)
    return np.bitwise_or.reduceat(parts, starts), at + stop


def zigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.uint64)
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def pack(values: np.ndarray, width: int) -> bytes:
    v = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(v[:, : (width + 7) // 8], axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, count: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(count, np.uint64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: count * width].reshape(count, width).astype(np.uint64)
    return np.bitwise_or.reduce(bits << np.arange(width, dtype=np.uint64), axis=1)


def width(values: np.ndarray) -> int:
    return int(values.max()).bit_length() if len(values) else 0
