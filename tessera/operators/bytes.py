"""Byte statistics of slices (id, raw): each slice is counted in one pass where it lies, and gives one row (or one for each byte value); nothing is exploded into bytes or shuffled. A slice is held
whole by one worker, and its working arrays are a small multiple of it; blocks bound those of adjacent bytes. Slices without bytes give no row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.batches import rows_of

#: Bytes that are looked at in one go.
BLOCK = 1 << 22
#: Windows of a slice, and bytes of one; slices of up to FULL bytes are sampled whole.
WINDOWS, WINDOW, FULL = 5, 128 << 10, 8 << 20


def slices(docs: DataFrame) -> DataFrame:
    """Texts as slices; null is empty."""
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def rounded(x: float) -> float:
    """To six places as SQL does: the product is rounded, halves away from zero. Python's round takes halves of the value itself to even."""
    y = abs(float(x)) * 1e6
    whole = math.floor(y)
    return math.copysign((whole + (y - whole >= 0.5)) / 1e6, x)


def counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256)


def entropy_of(n: np.ndarray) -> float:
    """Bits of entropy of counts; 0 if there are none."""
    p = n[n > 0] / max(1, n.sum())
    return float(-(p * np.log2(p)).sum()) + 0.0


def moments(n: np.ndarray, values: np.ndarray | None = None) -> tuple[float, float]:
    """Mean and population deviation of values by their counts."""
    v = np.arange(len(n)) if values is None else values
    mean = float((n * v).sum() / n.sum())
    return mean, float(np.sqrt(max(0.0, float((n * v * v).sum() / n.sum()) - mean * mean)))


def adjacent_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the distances and of the XORs of neighbours, block by block."""
    x = np.frombuffer(raw, np.uint8)
    far, xor = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for at in range(0, len(x) - 1, BLOCK):
        a, b = x[at : at + BLOCK], x[at + 1 : at + BLOCK + 1]
        a = a[: len(b)]
        far += np.bincount(np.maximum(a, b) - np.minimum(a, b), minlength=256)
        xor += np.bincount(a ^ b, minlength=256)
    return far, xor


def window_entropies(raw: bytes, width: int = WINDOW) -> list[float]:
    """Of the whole slice, or of WINDOWS evenly placed windows where it is longer than one."""
    if len(raw) <= width:
        return [entropy_of(counts(raw))]
    return [entropy_of(counts(raw[at : at + width])) for at in window_starts(len(raw), WINDOWS, width)]


def window_starts(size: int, n: int = WINDOWS, width: int = WINDOW) -> list[int]:
    """Whole parts of evenly spaced places, the first at 0 and the last where the window ends with the slice."""
    return [int(i * (size - width) / (n - 1)) for i in range(n - 1)] + [size - width]


def sampled(raw: bytes) -> bytes:
    """The windows joined, for slices over FULL bytes."""
    return raw if len(raw) <= FULL else b"".join(raw[at : at + WINDOW] for at in window_starts(len(raw)))


def bit_shares(n: np.ndarray) -> list[float]:
    """Mean of each bit, highest first."""
    v = np.arange(256)
    return [float((n * (v >> (7 - k) & 1)).sum() / n.sum()) for k in range(8)]


def histogram(s: DataFrame, zeros: bool = False) -> DataFrame:
    """A1: (id, byte, n, p); with `zeros` also the values that don't occur."""

    def rows(i, raw: bytes, _) -> Iterator[tuple]:
        n = counts(raw)
        for v in range(256) if zeros and raw else np.flatnonzero(n).tolist():
            yield i, v, int(n[v]), n[v] / len(raw)

    return rows_of(s, rows, "id long, byte int, n long, p double")


def entropy(s: DataFrame) -> DataFrame:
    """Entropy, shares of zero and 255, of the largest and the four largest bins, share of byte values, mean / 255 and population deviation / 128."""

    def rows(i, raw: bytes, _) -> Iterator[tuple]:
        if raw:
            n = counts(raw)
            p, (mean, std) = n / len(raw), moments(n)
            top = np.sort(p)[::-1]
            yield i, *(rounded(x) for x in (entropy_of(n), p[0], p[255], top[0], top[:4].sum(), (n > 0).mean(), mean / 255, std / 128))

    return rows_of(s, rows, "id long, entropy double, zero_frac double, ff_frac double, top1_frac double, top4_frac double, unique_byte_ratio double, mean_byte double, std_byte double")


def bit_density(s: DataFrame) -> DataFrame:
    """Mean of each bit, highest first."""
    return rows_of(s, lambda i, raw, _: [(i, *(rounded(x) for x in bit_shares(counts(raw))))] if raw else [], "id long, " + ", ".join(f"bit{k} double" for k in range(8)))


def adjacent(s: DataFrame) -> DataFrame:
    """Share of equal neighbours, mean / 255, deviation / 128 and entropy of their distance, entropy of their XOR. Slices of one byte give no row."""

    def rows(i, raw: bytes, _) -> Iterator[tuple]:
        if len(raw) > 1:
            far, xor = adjacent_counts(raw)
            mean, std = moments(far)
            yield i, *(rounded(x) for x in (float(far[0] / far.sum()), mean / 255, std / 128, entropy_of(far), entropy_of(xor)))

    return rows_of(s, rows, "id long, same_adjacent double, mean_delta double, std_delta double, delta_entropy double, xor_entropy double")


def window_stats(s: DataFrame, width: int = WINDOW) -> DataFrame:
    """Windows, and mean, population deviation, least and most of their entropies / 8."""

    def rows(i, raw: bytes, _) -> Iterator[tuple]:
        if raw:
            e = np.array(window_entropies(raw, width)) / 8
            yield i, len(e), *(rounded(x) for x in (e.mean(), e.std(), e.min(), e.max()))

    return rows_of(s, rows, "id long, windows int, mean double, std double, least double, most double")


def run_lengths(s: DataFrame) -> DataFrame:
    """Runs of equal bytes, the longest, and the size of their run-length coding, a varint and a byte each."""

    def rows(i, raw: bytes, _) -> Iterator[tuple]:
        if raw:
            x = np.frombuffer(raw, np.uint8)
            n = np.diff(np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]))
            yield i, len(n), int(n.max()), int(sum((n >> 7 * k > 0).sum() for k in range(9)) + len(n))

    return rows_of(s, rows, "id long, runs long, longest long, rle_size long")
