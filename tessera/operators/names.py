"""Scalar functions on names and integers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_name(x: Column) -> Column:
    """F2: lower case; underscores and spaces are hyphens."""
    return F.translate(F.lower(x), "_ ", "--")


def top_folder(x: Column) -> Column:
    """What is before the first slash, `(flat)` without one."""
    return F.when(F.instr(x, "/") == 0, F.lit("(flat)")).otherwise(F.substring_index(x, "/", 1))


def suffix(x: Column) -> Column:
    """P10: the last path part from its first dot on, empty without one."""
    part = F.substring_index(x, "/", -1)
    return F.when(F.instr(part, ".") == 0, F.lit("")).otherwise(F.substring(part, F.instr(part, "."), F.length(part)))


def zigzag(x: Column) -> Column:
    """F9 for values under 2^62 in size."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def uleb_size(x: Column) -> Column:
    """F8: bytes of the LEB128 code of a value from 0 on."""
    return F.ceil(F.length(F.bin(x)) / 7).cast("int")
