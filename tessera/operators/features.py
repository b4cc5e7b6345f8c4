"""The 322 features of a slice, in order: byte statistics, windows, type, typed items, byte shares, bit shares, pilot compressions, shape."""

from __future__ import annotations

import bz2
import gzip
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import bytes as b
from tessera.operators.batches import rows_of

#: Items looked at, items needed, bytes compressed on trial, and the bounds of items.
ITEMS, LEAST_ITEMS, PILOT, BOUND, TINY = 16384, 64, 128 << 10, 1e6, 1e-12
#: Names in their order.
BASE = (
    "log_file_size sample_ratio mean_byte std_byte entropy zero_frac ff_frac top1_frac top4_frac unique_byte_ratio same_adjacent_ratio mean_abs_delta std_abs_delta delta_entropy xor_entropy "
    "window_entropy_mean window_entropy_std window_entropy_min window_entropy_max is_f32 is_f64 is_unknown_dtype"
).split()
TYPED = (
    "finite_ratio offset log_count zero_frac near_zero_frac sign_frac log_range std_ratio mean_abs_diff1 mean_abs_diff2 diff_std_ratio repeat_frac sign_change_frac lag1 lag2 exp_entropy exp_top1 "
    "mantissa_low_zero"
).split()
SOURCES = ("dataset_table", "filename_numbers", "1d_fallback", "byte_fallback")
META = ["ndim", "log_count", *(f"log_dim{i}" for i in range(4)), *(f"source_{s}" for s in SOURCES), "source_unknown", "is_f32", "is_f64", "is_unknown_dtype"]
NAMES = [*BASE, *(f"typed_{n}" for n in TYPED), *(f"byte_hist_{i}" for i in range(256)), *(f"bit_density_{i}" for i in range(8)), "pilot_gzip_raw", "pilot_bz2_raw", "pilot_gzip_delta", "pilot_gzip_xor", *(f"meta_{n}" for n in META)]
#: Where exponent and mantissa lie.
FLOATS = {"float32": (4, 23, 8), "float64": (8, 52, 11)}


def float_type(hint: str | None, suffix: str | None = "") -> str | None:
    """F3 C: from the named type, then from the suffix."""
    for text, short in ((str(hint or "").lower(), True), (str(suffix or "").lower(), False)):
        if "float32" in text or (text == "f32" if short else "f32" in text):
            return "float32"
        if "float64" in text or "double" in text or (text in ("f64", "d64") if short else "f64" in text or "d64" in text):
            return "float64"
    return None


def lag_corr(x: np.ndarray, lag: int) -> float:
    """Correlation of a series with itself `lag` items on, both ends centred by themselves; 0 where it isn't defined."""
    if len(x) <= lag:
        return 0.0
    x = np.clip(np.asarray(x, np.float64), -BOUND, BOUND)
    head, tail = x[:-lag] - x[:-lag].mean(), x[lag:] - x[lag:].mean()
    spread = float((head * head).mean()), float((tail * tail).mean())
    if not all(math.isfinite(v) and v > 0 for v in spread):
        return 0.0
    return float(np.clip((head * tail).mean() / (math.sqrt(spread[0] * spread[1]) + TINY), -1, 1))


def typed_view(raw: bytes, dtype: str | None) -> tuple[np.ndarray, np.ndarray, int, float] | None:
    """(finite values, their bits, byte offset, share of finite ones) at the offset that looks most like a series; the lowest one at ties."""
    if dtype not in FLOATS:
        return None
    size, best, top = FLOATS[dtype][0], None, -math.inf
    for offset in range(size):
        n = (len(raw) - offset) // size
        if n < LEAST_ITEMS:
            continue
        values = np.frombuffer(raw, f"<f{size}", min(n, ITEMS), offset)
        finite = np.isfinite(values)
        good = values[finite]
        if len(good) < LEAST_ITEMS:
            continue
        wide = good.astype(np.float64)
        score = float(finite.mean()) + 0.20 * abs(lag_corr(wide, 1)) + 0.05 * float((wide == 0).mean())
        if score > top:
            top, best = score, (wide, good.view(f"<u{size}"), offset, float(finite.mean()))
    return best


def typed(raw: bytes, dtype: str | None) -> list[float]:
    """The 18 features of typed items; zeros where there is no type or no view."""
    seen = typed_view(raw, dtype)
    if seen is None:
        return [0.0] * len(TYPED)
    size, shift, width = FLOATS[dtype]
    values, bits, offset, finite = seen
    x = np.clip(values, -BOUND, BOUND)
    far, std = np.abs(x), float(x.std())
    mean, some = float(far.mean()), far[far > 0]
    step, second = np.diff(x), np.diff(x, 2)
    turns = np.sign(step[1:]) != np.sign(step[:-1])
    exponent = np.bincount((bits >> bits.dtype.type(shift)).astype(np.int64) & ((1 << width) - 1), minlength=1 << width)
    mantissa = bits & bits.dtype.type((1 << shift) - 1)
    low = sum(float((mantissa & bits.dtype.type(m) == 0).mean()) for m in (0xFF, 0xFFFF))
    out = [
        finite, offset / max(1, size - 1), math.log1p(len(x)), float((x == 0).mean()), float((far <= max(TINY, 1e-6 * (mean + TINY))).mean()), float((bits >> bits.dtype.type(8 * size - 1)).mean()),
        min(float(np.log10(some.max() + TINY) - np.log10(some.min() + TINY)) / 20, 1.0) if len(some) else 0.0, min(std / (mean + TINY), 10.0) / 10,
        float(np.abs(step).mean()) / (std + TINY), float(np.abs(second).mean()) / (std + TINY), float(step.std()) / (std + TINY), float((x[1:] == x[:-1]).mean()), float(turns.mean()),
        lag_corr(x, 1), lag_corr(x, 2), b.entropy_of(exponent) / width, float(exponent.max() / exponent.sum()), low,
    ]
    return np.nan_to_num(out, nan=0.0, posinf=BOUND, neginf=-BOUND).tolist()


def pilot(raw: bytes, bzip2: int | None = None) -> list[float]:
    """How many times the first bytes shrink by gzip and bzip2, and their differences and XORs by gzip; `bzip2` is the length of bzip2's stream of these bytes, if that is known."""
    probe = raw[:PILOT]
    if not probe:
        return [0.0] * 4
    x = np.frombuffer(probe, np.uint8)
    zipped = lambda data: len(data) / max(1, len(gzip.compress(data, 1, mtime=0)))
    return [zipped(probe), len(probe) / max(1, bzip2 or len(bz2.compress(probe, 1))), zipped(np.diff(x).tobytes()), zipped((x[1:] ^ x[:-1]).tobytes())]


def shape_meta(shape: list[int] | None, count: int | None, source: str | None, dtype: str | None) -> list[float]:
    """X22."""
    dims = [max(0, int(d)) for d in shape or []]
    if count is None:
        count = int(np.prod(dims)) if dims else 0
    first = [math.log1p(d) / 20 for d in (dims + [0] * 4)[:4]]
    return [min(len(dims), 6) / 6, math.log1p(count) / 30, *first, *(float(source == s) for s in SOURCES), float(source not in SOURCES), float(dtype == "float32"), float(dtype == "float64"), float(dtype is None)]


def base(raw: bytes, dtype: str | None) -> list[float]:
    """What comes before the typed items, for a sample of the slice; an empty one counts as a single zero."""
    sample = b.sampled(raw) or b"\0"
    n, size = b.counts(sample), len(raw)
    p, (mean, std) = n / len(sample), b.moments(n)
    top = np.sort(p)[::-1]
    same, far_mean, far_std, far_entropy, xor_entropy = 1.0, 0.0, 0.0, 0.0, 0.0
    if len(sample) > 1:
        far, xor = b.adjacent_counts(sample)
        (far_mean, far_std), same = b.moments(far), float(far[0] / far.sum())
        far_entropy, xor_entropy = b.entropy_of(far), b.entropy_of(xor)
    windows = np.array(b.window_entropies(sample)) / 8
    return [
        math.log1p(size), min(1.0, len(sample if raw else b"") / max(1, size)), mean / 255, std / 128, b.entropy_of(n) / 8, p[0], p[255], top[0], top[:4].sum(), float((n > 0).mean()),
        same, far_mean / 255, far_std / 128, far_entropy / 8, xor_entropy / 8, windows.mean(), windows.std(), windows.min(), windows.max(),
        float(dtype == "float32"), float(dtype == "float64"), float(dtype is None),
    ]


def vector(raw: bytes, dtype: str | None = None, shape: list[int] | None = None, source: str | None = None, count: int | None = None, bzip2: int | None = None) -> list[float]:
    """All 322 features. `bzip2`: see `pilot`."""
    kind, sample = float_type(dtype), b.sampled(raw)
    n = b.counts(sample or b"\0")
    out = [*base(raw, kind), *typed(sample, kind), *(n / n.sum()).tolist(), *b.bit_shares(n), *pilot(sample, bzip2), *shape_meta(shape, count, source, kind)]
    return [float(x) for x in out]


def of_slice(raw: bytes, lay, bzip2: int | None = None) -> list[float]:
    shape = list(lay.shape) if lay.shape else None
    return vector(raw, lay.dtype, shape, "filename_numbers" if shape else "unknown", bzip2=bzip2)


def extract(s: DataFrame) -> DataFrame:
    """(id, features) of slices (id, raw[, dtype, shape]); the shape's source is `filename_numbers` where there is a shape, `unknown` otherwise."""

    def rows(i, raw: bytes, lay) -> Iterator[tuple]:
        yield i, of_slice(raw, lay)

    return rows_of(s, rows, "id long, features array<double>", heavy=True)


def padded(x: Column, width: int) -> Column:
    """F16: cut or filled with zeros to a width."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), width)), 1, width)


def finite(x: Column) -> Column:
    """no NaN (0) and no infinity (a million)."""
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), BOUND).when(x == float("-inf"), -BOUND).otherwise(x)
