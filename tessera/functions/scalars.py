"""Scalar functions as Column expressions: types and shapes from names, factorings, sizes and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.filters import SIZES

#: Types in the order in which a file's name is searched for them, with what tells each.
LABEL_TYPES = ("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64")
FLOAT_WORDS = (("float64", ("double", "d64", "f64", "float64")), ("float32", ("f32", "float32", "single")))
SPLIT_TYPES = (
    ("float64", ("float64", "double", "d64", "f64")), ("float32", ("float32", "single", "f32")), ("int64", ("int64", "i64")), ("uint64", ("u64",)), ("int32", ("int32", "i32")),
    ("uint32", ("u32",)), ("int16", ("int16", "i16")), ("uint16", ("u16",)), ("int8", ("int8", "i8")), ("uint8", ("u8",)),
)
#: Shapes of known datasets, for labelling and for splitting.
LABEL_SHAPES = {"cesm-atm": [[1800, 3600], [26, 1800, 3600]], "hurricane-isabel": [[100, 500, 500]], "hurricane": [[100, 500, 500]], "miranda": [[256, 384, 384], [3072, 3072, 3072]]}
SPLIT_SHAPES = {
    "cesm-atm": [[1800, 3600], [26, 1800, 3600]], "hurricane-isabel": [[100, 500, 500]], "miranda": [[256, 384, 384]], "nyx": [[512, 512, 512]], "s3d": [[500, 500, 5500]],
    "exafel": [[130, 1480, 1552], [130, 2048]],
}
UNSTRUCTURED = ("xgc",)


def _first(name: Column, kinds) -> Column:
    out = F.lit(None).cast("string")
    for kind, words in reversed([*kinds]):
        out = F.when(F.greatest(*[F.instr(name, w) for w in (*words, words[0])]) > 0, kind).otherwise(out)
    return out


def label_dtype(name: Column) -> Column:
    """F3 A: the first integer type that the name holds, then a float type."""
    return _first(F.lower(name), [*((t, (t,)) for t in LABEL_TYPES), *FLOAT_WORDS])


def split_dtype(name: Column) -> Column:
    """F3 B: floats first; a name with `uint64` holds `int64`, so unsigned types are only told by their short words."""
    return _first(F.lower(name), SPLIT_TYPES)


def element_size(dtype: Column) -> Column:
    """F7; null for no type."""
    out = F.lit(None).cast("int")
    for name, size in SIZES.items():
        out = F.when(dtype == name, size).otherwise(out)
    return out


def product(shape: Column) -> Column:
    """product of an array of numbers; 1 for an empty one."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def _shapes(key: Column, table: dict) -> Column:
    out = F.array().cast("array<array<bigint>>")
    for name, shapes in table.items():
        out = F.when(key == name, F.array(*[F.array(*[F.lit(n).cast("long") for n in s]) for s in shapes])).otherwise(out)
    return out


def _last(values: Column, n: int) -> Column:
    """The last n numbers without leading ones, or null if there are fewer."""
    last = F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)
    cut = F.aggregate(last, F.array().cast("array<bigint>"), lambda a, x: F.when((F.size(a) == 0) & (x == 1), a).otherwise(F.concat(a, F.array(x))))
    return F.when(F.size(values) >= n, F.when(F.size(cut) == 0, F.array(F.lit(1).cast("long"))).otherwise(cut))


def label_shape(path: Column, dtype: Column, dataset: Column, used: Column) -> Column:
    """struct (shape, source): a known dataset's shape, else the last 4, 3, 2 or 1 numbers of the name, if the product is the number of items; else one axis."""
    size = element_size(dtype)
    count = F.floor(used / size).cast("long")
    key = F.translate(F.lower(dataset), "_ ", "--")
    name = F.substring_index(path, "/", -1)
    stem = F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    known = F.filter(_shapes(key, LABEL_SHAPES), lambda s: product(s) == count)
    named = F.filter(F.array(*[_last(numbers(stem), n) for n in (4, 3, 2, 1)]), lambda s: s.isNotNull() & (product(s) == count))
    made = lambda shape, source: F.struct(shape.alias("shape"), F.lit(source).alias("source"))
    none = F.lit(None).cast("array<bigint>")
    return (
        F.when(size.isNull() | (used == 0), made(none, "unknown"))
        .when(key.isin(*UNSTRUCTURED), made(none, "unstructured_dataset"))
        .when(F.size(known) > 0, made(F.get(known, F.lit(0)), "dataset_table"))
        .when(F.size(named) > 0, made(F.get(named, F.lit(0)), "filename_numbers"))
        .otherwise(made(F.array(count), "1d_fallback"))
    )


def dimension_candidates(text: Column) -> Column:
    """distinct shapes that a path names, `AxBxC` first, then the last three, two and one numbers set off by underscores. One look-ahead pattern each, matches don't overlap."""
    low = F.lower(text)
    by_x = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:x\d+){1,3})"), 1), lambda m: F.transform(F.split(m, "x"), lambda x: x.cast("long")))
    parts = [F.transform(F.regexp_extract_all(low, F.lit("(" + r"_\d+" * n + r")(?=$|[._])"), 1), numbers) for n in (3, 2, 1)]
    return F.array_distinct(F.concat(by_x, *parts))


def best_2d(n: Column) -> Column:
    """struct (shape, score): the factors nearest to a square and their ratio; null for nothing. The candidates are the numbers up to the root."""
    sides = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n)).cast("long")), lambda a: n % a == 0)
    side = F.array_max(sides)
    return F.when(n > 0, F.struct(F.array(side, (n / side).cast("long")).alias("shape"), ((n / side) / side).alias("score")))


def split_path(path: Column) -> Column:
    """Forward slashes, no leading one."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def dataset_key(path: Column) -> Column:
    """The first part of a path, lower case."""
    return F.lower(F.split_part(path, F.lit("/"), F.lit(1)))


def safe_ratio(raw: Column, packed: Column) -> Column:
    """F11."""
    return raw / F.greatest(F.lit(1), packed)


def speed(size: Column, seconds: Column) -> Column:
    """MiB a second, null for no time."""
    return F.when(seconds > 0, size / 1048576 / seconds)


def parse_shape(text: Column) -> Column:
    """numbers between commas; null for none."""
    parts = F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    return F.when(F.size(parts) > 0, parts)


def packed_name(path: Column) -> Column:
    """F18."""
    return F.concat(path, F.lit(".cpss"))


def restored_name(path: Column) -> Column:
    """without the ending, or with another one."""
    return F.when(F.endswith(path, F.lit(".cpss")), F.regexp_replace(path, r"\.cpss$", "")).otherwise(F.concat(path, F.lit(".restored")))
