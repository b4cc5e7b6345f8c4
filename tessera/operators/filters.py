"""Reversible filters on the bytes of a slice, with their inverses.

A slice has a layout: the type of its items (None: single bytes of no type) and its shape. A filter that needs items of two bytes, integers, whole items or a shape, and doesn't have
them, raises ValueError with the reason. `ALL` has, by name, a forward step (bytes, layout) to (bytes, what the inverse needs) and the inverse (bytes, layout, that) to bytes."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from tessera.operators import coding


def _split(raw: bytes, size: int) -> tuple[np.ndarray, bytes]:
    n = len(raw) // size * size
    return np.frombuffer(raw[:n], f"<u{size}"), raw[n:]


def shuffle(raw: bytes, size: int = 4) -> bytes:
    x, rest = _split(raw, size)
    return x.view(np.uint8).reshape(-1, size).T.tobytes() + rest


def unshuffle(raw: bytes, size: int = 4) -> bytes:
    x, rest = _split(raw, size)
    return x.view(np.uint8).reshape(size, -1).T.tobytes() + rest


def delta(raw: bytes, size: int = 1) -> bytes:
    x, rest = _split(raw, size)
    return np.diff(x, prepend=x.dtype.type(0)).tobytes() + rest


def undelta(raw: bytes, size: int = 1) -> bytes:
    x, rest = _split(raw, size)
    return np.cumsum(x, dtype=x.dtype).tobytes() + rest


def xor(raw: bytes, size: int = 1) -> bytes:
    x, rest = _split(raw, size)
    out = x.copy()
    out[1:] ^= x[:-1]
    return out.tobytes() + rest


def unxor(raw: bytes, size: int = 1) -> bytes:
    x, rest = _split(raw, size)
    return np.bitwise_xor.accumulate(x).tobytes() + rest if len(x) else rest


def rle(raw: bytes) -> bytes:
    x = np.frombuffer(raw, np.uint8)
    if not len(x):
        return b""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    n = np.diff(np.append(at, len(x)))
    return np.column_stack([n.astype(np.uint8), x[at]]).tobytes() if n.max() < 128 else coding.uleb(n, x[at])


def unrle(raw: bytes) -> bytes:
    x = np.frombuffer(raw, np.uint8)
    if len(x) % 2 == 0 and (x[::2] < 128).all():
        return np.repeat(x[1::2], x[::2]).tobytes()
    out, at = [], 0
    while at < len(raw):
        n, at = coding.unuleb1(raw, at)
        out.append(raw[at : at + 1] * n)
        at += 1
    return b"".join(out)


def bitshuffle(raw: bytes, size: int = 4) -> bytes:
    x, rest = _split(raw, size)
    bits = np.unpackbits(x.view(np.uint8), bitorder="little").reshape(-1, 8 * size)
    return np.packbits(bits.T.ravel(), bitorder="little").tobytes() + rest


def unbitshuffle(raw: bytes, size: int = 4) -> bytes:
    x, rest = _split(raw, size)
    bits = np.unpackbits(x.view(np.uint8), bitorder="little").reshape(8 * size, -1)
    return np.packbits(bits.T.ravel(), bitorder="little").tobytes() + rest


def tdt(raw: bytes, size: int = 4) -> bytes:
    """Byte planes, the highest byte's first."""
    x, rest = _split(raw, size)
    return x.view(np.uint8).reshape(-1, size)[:, ::-1].T.tobytes() + rest


def untdt(raw: bytes, size: int = 4) -> bytes:
    x, rest = _split(raw, size)
    return x.view(np.uint8).reshape(size, -1)[::-1].T.tobytes() + rest


def delta2(raw: bytes, size: int = 1) -> bytes:
    return delta(delta(raw, size), size)


def undelta2(raw: bytes, size: int = 1) -> bytes:
    return undelta(undelta(raw, size), size)


def _whole(raw: bytes, size: int) -> np.ndarray:
    x, rest = _split(raw, size)
    if rest:
        raise ValueError(f"{len(raw)} bytes aren't items of {size}")
    return x


def varint(raw: bytes, size: int = 4, signed: bool = True) -> bytes:
    """LEB128 of each item, of its zigzag code if signed."""
    x = _whole(raw, size)
    return coding.uleb(coding.zigzag(x.view(f"<i{size}")) if signed else x)


def unvarint(raw: bytes, size: int = 4, signed: bool = True) -> bytes:
    v, _ = coding.unuleb(raw)
    return (coding.unzigzag(v) if signed else v).astype(f"<u{size}").tobytes()


def bit_packing(raw: bytes, size: int = 4, signed: bool = True) -> bytes:
    """Count and bit width as LEB128, then all items (zigzag codes if signed) at that width."""
    x = _whole(raw, size)
    v = coding.zigzag(x.view(f"<i{size}")) if signed else x.astype(np.uint64)
    bits = max(1, coding.width(v))
    return coding.uleb([len(v), bits]) + coding.pack(v, bits)


def unbit_packing(raw: bytes, size: int = 4, signed: bool = True) -> bytes:
    (n, bits), at = coding.unuleb(raw, 2)
    v = coding.unpack(raw[at:], int(n), int(bits))
    return (coding.unzigzag(v) if signed else v).astype(f"<u{size}").tobytes()


def _bytes_dictionary(raw: bytes) -> bytes:
    """The same for tokens of one byte, by a table of 256 places."""
    x = np.frombuffer(raw, np.uint8)
    names = np.array(sorted(set(raw), key=raw.index), np.uint8)
    rank = np.zeros(256, np.uint64)
    rank[names] = np.arange(len(names), dtype=np.uint64)
    bits = max(1, max(0, len(names) - 1).bit_length())
    return coding.uleb([1, len(x), len(names), bits]) + names.tobytes() + coding.pack(rank[x], bits)


def dictionary(raw: bytes, size: int = 1) -> bytes:
    """Token size, tokens, entries and bit width as LEB128, the entries as first seen, and each token's entry at that width; tokens of one byte where the size doesn't divide."""
    size = size if len(raw) % size == 0 else 1
    if size == 1:
        return _bytes_dictionary(raw)
    tokens = np.frombuffer(raw, f"V{size}") if size not in (1, 2, 4, 8) else np.frombuffer(raw, f"<u{size}")
    names, first, of = np.unique(tokens, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    bits = max(1, max(0, len(names) - 1).bit_length())
    return coding.uleb([size, len(tokens), len(names), bits]) + names[order].tobytes() + coding.pack(rank[of.ravel()], bits)


def undictionary(raw: bytes) -> bytes:
    (size, n, entries, bits), at = coding.unuleb(raw, 4)
    end = at + int(size * entries)
    names = np.frombuffer(raw[at:end], f"V{int(size)}")
    return names[coding.unpack(raw[end:], int(n), int(bits)).astype(np.int64)].tobytes()


def records(raw: bytes, size: int = 1) -> list[bytes]:
    """Lines with their ends where there are two line feeds or more; else pieces of `size`."""
    return raw.splitlines(keepends=True) if raw.count(b"\n") >= 2 else [raw[i : i + size] for i in range(0, len(raw), size)]


def delta_length(raw: bytes, size: int = 1) -> bytes:
    """Number of records, bytes of the next stream, zigzag differences of the records' lengths, all as LEB128, and the bytes."""
    if raw.count(b"\n") >= 2:
        lengths = np.array([len(r) for r in records(raw, size)], np.int64)
    else:
        lengths = np.minimum(size, len(raw) - np.arange(0, len(raw), size))
    stream = coding.uleb(coding.zigzag(np.diff(lengths, prepend=0)))
    return coding.uleb([len(lengths), len(stream)]) + stream + raw


def undelta_length(raw: bytes) -> bytes:
    (_, size), at = coding.unuleb(raw, 2)
    return raw[at + int(size) :]


def front_coding(raw: bytes, size: int = 1) -> bytes:
    """Number of records; of each one how many bytes it shares with the one before, how many follow, and these."""
    if size == 1 and raw.count(b"\n") < 2:
        x = np.frombuffer(raw, np.uint8)
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        used = np.column_stack([np.ones((len(x), 2), bool), new])
        return coding.uleb1(len(x)) + np.column_stack([~new, new, x]).astype(np.uint8)[used].tobytes()
    out, before = [], b""
    pieces = records(raw, size)
    for r in pieces:
        shared = len(os.path.commonprefix([before, r]))
        out += [coding.uleb1(shared), coding.uleb1(len(r) - shared), r[shared:]]
        before = r
    return coding.uleb1(len(pieces)) + b"".join(out)


def unfront_coding(raw: bytes) -> bytes:
    (n,), at = coding.unuleb(raw, 1)
    out, before = [], b""
    for _ in range(int(n)):
        shared, at = coding.unuleb1(raw, at)
        more, at = coding.unuleb1(raw, at)
        before = before[:shared] + raw[at : at + more]
        at += more
        out.append(before)
    return b"".join(out)


def packbits(raw: bytes) -> bytes:
    """PackBits: 1 to 128 bytes as they are after n - 1, or a byte n times (2 to 128) after 257 - n. Runs of two are left among bytes as they are."""
    x = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(np.diff(x, prepend=x[:1] ^ 255) != 0) if len(x) else np.zeros(0, int)
    size = np.diff(np.append(at, len(x)))
    out, plain = bytearray(), 0

    def literals(end: int) -> None:
        for i in range(plain, end, 128):
            piece = raw[i : min(i + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for start, n in zip(at[size >= 3].tolist(), size[size >= 3].tolist()):
        literals(start)
        while n >= 3:
            take = min(n, 128)
            out += bytes([257 - take, raw[start]])
            start, n = start + take, n - take
        plain = start
    literals(len(raw))
    return bytes(out)


def unpackbits(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        n = raw[at]
        out.append(raw[at + 1 : at + 2 + n] if n < 128 else raw[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
        at += 2 + n if n < 128 else 2 if n > 128 else 1
    return b"".join(out)


RUN, LITERALS = 4, 128


def hybrid(values: np.ndarray) -> tuple[bytes, int]:
    """Runs of four and more as (1, length, value), what lies between as blocks (0, count, values at one bit width) of at most 128; and that width."""
    v = np.asarray(values, np.uint64)
    bits = max(1, coding.width(v))
    if not len(v):
        return b"", bits
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.append(at, len(v)))
    out, plain = [], 0

    def literals(end: int) -> None:
        packed, step = coding.pack(v[plain:end], bits), LITERALS * bits // 8
        for k, i in enumerate(range(plain, end, LITERALS)):
            out.append(b"\0" + coding.uleb1(min(LITERALS, end - i)) + packed[k * step : (k + 1) * step])

    for start, n in zip(at[size >= RUN].tolist(), size[size >= RUN].tolist()):
        literals(start)
        out.append(b"\1" + coding.uleb1(n) + coding.uleb1(int(v[start])))
        plain = start + n
    literals(len(v))
    return b"".join(out), bits


def unhybrid(raw: bytes, bits: int) -> np.ndarray:
    out, at = [], 0
    while at < len(raw):
        kind, at = raw[at], at + 1
        n, at = coding.unuleb1(raw, at)
        if kind:
            value, at = coding.unuleb1(raw, at)
            out.append(np.full(n, value, np.uint64))
        else:
            end = at + (n * bits + 7) // 8
            out.append(coding.unpack(raw[at:end], n, bits))
            at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Context:
    """What a value's context says comes next: a table under a hash of the values (fcm) or strides (dfcm) before it."""

    def __init__(self, bits: int, strides: bool, hash_bits: int = 16) -> None:
        self.mask, self.table, self.top = (1 << bits) - 1, [0] * (1 << hash_bits), (1 << hash_bits) - 1
        self.strides, self.at, self.last = strides, 0, 0
        # How far the hash moves for each value, and how many leading bits of one it takes.
        self.move, self.cut = (2, max(0, bits - 24)) if strides else (5, max(0, bits - 16))

    def guess(self) -> int:
        return (self.last + self.table[self.at]) & self.mask if self.strides else self.table[self.at]

    def learn(self, value: int) -> None:
        seen = (value - self.last) & self.mask if self.strides else value
        self.table[self.at] = seen
        self.at = (self.at << self.move ^ seen >> self.cut) & self.top
        self.last = value


def residual(raw: bytes, size: int, strides: bool, back: bool = False) -> bytes:
    """Each item XOR what its context says; the same with `back` undoes it."""
    x, context, out = np.frombuffer(raw, f"<u{size}"), Context(8 * size, strides), []
    for item in x.tolist():
        other = item ^ context.guess()
        out.append(other)
        context.learn(other if back else item)
    return np.array(out, x.dtype).tobytes()


def lorenzo(raw: bytes, size: int, shape: tuple[int, ...]) -> bytes:
    """Differences along every axis, modulo the items' range: each item less what its lower neighbours say by inclusion and exclusion."""
    x = np.frombuffer(raw, f"<u{size}").reshape(shape)
    for axis in range(len(shape)):
        x = np.diff(x, axis=axis, prepend=x.dtype.type(0))
    return x.tobytes()


def unlorenzo(raw: bytes, size: int, shape: tuple[int, ...]) -> bytes:
    x = np.frombuffer(raw, f"<u{size}").reshape(shape)
    for axis in range(len(shape)):
        x = np.cumsum(x, axis=axis, dtype=x.dtype)
    return x.tobytes()


CELL = 4


def cells(shape: tuple[int, ...]) -> np.ndarray:
    """Places of the items in cell order: cells of at most four along each axis, one after the other, each by rows."""
    places = np.indices(shape).reshape(len(shape), -1)
    side = [min(CELL, n) or 1 for n in shape]
    outer, inner = ([f(p, n) for p, n in zip(places, side)] for f in (np.floor_divide, np.mod))
    return np.lexsort([*inner[::-1], *outer[::-1]])


#: Bytes of an item by type.
SIZES = {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "float32": 4, "float64": 8}


class Layout(NamedTuple):
    dtype: str | None = None
    shape: tuple[int, ...] | None = None

    @property
    def size(self) -> int:
        return SIZES.get(self.dtype, 1)

    @property
    def signed(self) -> bool:
        return self.dtype is not None and self.dtype.startswith("int")

    def shaped(self, raw: bytes) -> tuple[int, ...] | None:
        """The shape, if it fits the slice."""
        return self.shape if self.shape and int(np.prod(self.shape)) * self.size == len(raw) else None


def _items(raw: bytes, lay: Layout, least: int = 2, integers: bool = False) -> None:
    if len(raw) % lay.size:
        raise ValueError(f"{len(raw)} bytes aren't items of {lay.size}")
    if lay.size < least:
        raise ValueError(f"items must have {least} bytes at least")
    if integers and lay.dtype in ("float32", "float64"):
        raise ValueError("items must be integers")


def _sized(forward: Callable, back: Callable, least: int = 2) -> tuple[Callable, Callable]:
    def there(raw: bytes, lay: Layout) -> tuple[bytes, dict]:
        _items(raw, lay, least)
        return forward(raw, lay.size), {}

    return there, lambda raw, lay, _: back(raw, lay.size)


def _integers(forward: Callable, back: Callable) -> tuple[Callable, Callable]:
    def there(raw: bytes, lay: Layout) -> tuple[bytes, dict]:
        _items(raw, lay, 2, True)
        return forward(raw, lay.size, lay.signed), {}

    return there, lambda raw, lay, _: back(raw, lay.size, lay.signed)


def _loose(forward: Callable, back: Callable) -> tuple[Callable, Callable]:
    return (lambda raw, lay: (forward(raw), {})), (lambda raw, lay, _: back(raw))


def _recorded(forward: Callable, back: Callable) -> tuple[Callable, Callable]:
    return (lambda raw, lay: (forward(raw, lay.size), {})), (lambda raw, lay, _: back(raw))


def _hybrid(raw: bytes, lay: Layout) -> tuple[bytes, dict]:
    _items(raw, lay, 1)
    v = coding.zigzag(np.frombuffer(raw, f"<i{lay.size}")) if lay.signed else np.frombuffer(raw, f"<u{lay.size}").astype(np.uint64)
    out, bits = hybrid(v)
    return out, {"bit_width": bits}


def _unhybrid(raw: bytes, lay: Layout, meta: dict) -> bytes:
    v = unhybrid(raw, meta["bit_width"])
    return (coding.unzigzag(v) if lay.signed else v).astype(f"<u{lay.size}").tobytes()


def _by_shape(forward: Callable, axes: int | None = None) -> Callable:
    def there(raw: bytes, lay: Layout) -> tuple[bytes, dict]:
        _items(raw, lay)
        if not lay.shaped(raw):
            raise ValueError("a shape that fits the slice is needed")
        if axes and len(lay.shape) > axes:
            raise ValueError(f"at most {axes} axes are known")
        return forward(raw, lay), {}

    return there


def _uncelled(raw: bytes, lay: Layout, _: dict) -> bytes:
    x = np.frombuffer(raw, f"<u{lay.size}")
    out = np.empty_like(x)
    out[cells(lay.shape)] = x
    return out.tobytes()


def _higher(raw: bytes, lay: Layout) -> tuple[bytes, dict]:
    _items(raw, lay, 1)
    return delta2(raw, lay.size), {"order": 2}


#: Forward step and inverse of every filter by name.
ALL: dict[str, tuple[Callable, Callable]] = {
    "identity": _loose(bytes, bytes),
    "shuffle": _sized(shuffle, unshuffle),
    "bitshuffle": _sized(bitshuffle, unbitshuffle),
    "delta": _sized(delta, undelta, 1),
    "higher_order_delta": (_higher, lambda raw, lay, _: undelta2(raw, lay.size)),
    "zigzag_uleb128_varint": _integers(varint, unvarint),
    "bit_packing": _integers(bit_packing, unbit_packing),
    "rle": _loose(rle, unrle),
    "rle_bitpack_hybrid": (_hybrid, _unhybrid),
    "dictionary_categorize": _recorded(dictionary, undictionary),
    "byte_stream_split": _sized(shuffle, unshuffle),
    "nbit": _integers(bit_packing, unbit_packing),
    "packbits": _loose(packbits, unpackbits),
    "delta_length_byte_array": _recorded(delta_length, undelta_length),
    "delta_byte_array": _recorded(front_coding, unfront_coding),
    "ndcell": (_by_shape(lambda raw, lay: np.frombuffer(raw, f"<u{lay.size}")[cells(lay.shape)].tobytes()), _uncelled),
    "tdt": _sized(tdt, untdt),
    "fcm_residual": _sized(lambda raw, n: residual(raw, n, False), lambda raw, n: residual(raw, n, False, True)),
    "dfcm_residual": _sized(lambda raw, n: residual(raw, n, True), lambda raw, n: residual(raw, n, True, True)),
    "xor_residual": _sized(xor, unxor),
    "lorenzo_residual": (_by_shape(lambda raw, lay: lorenzo(raw, lay.size, lay.shape), 3), lambda raw, lay, _: unlorenzo(raw, lay.size, lay.shape)),
}
#: Those that apply to slices of no type.
UNTYPED = ("identity", "delta", "higher_order_delta", "rle", "rle_bitpack_hybrid", "dictionary_categorize", "packbits", "delta_length_byte_array", "delta_byte_array")
