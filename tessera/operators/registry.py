"""Names of pipelines: spelling, presets, and the pipelines that can be written to files, by id. Tables of names are small dimensions made from constants; combinations are joins."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Filters and compressors in their order, which breaks ties.
FILTERS = (
    "shuffle", "bitshuffle", "delta", "higher_order_delta", "zigzag_uleb128_varint", "bit_packing", "rle", "rle_bitpack_hybrid", "dictionary_categorize", "byte_stream_split",
    "nbit", "packbits", "delta_length_byte_array", "delta_byte_array", "ndcell", "tdt", "fcm_residual", "dfcm_residual", "xor_residual", "lorenzo_residual",
)
COMPRESSORS = (
    "zlib", "zlib_ng", "libdeflate", "zstd", "lz4", "lz4hc", "lzo", "snappy", "brotli", "bzip2", "xz_lzma2", "lzf", "szip_libaec", "ucl_nrv", "blosclz", "fastlz", "lzfse", "libbsc", "huff0",
    "fse",
)
#: What the presets take or leave out.
RECOMMENDED_FILTERS = ("shuffle", "bitshuffle", "delta", "higher_order_delta", "byte_stream_split", "dictionary_categorize", "ndcell", "tdt")
RECOMMENDED_COMPRESSORS = ("zstd", "libdeflate", "zlib_ng", "lz4", "lz4hc", "brotli", "lzfse", "fse")
RARE_COMPRESSORS = ("zlib_ng", "lzo", "ucl_nrv", "fastlz", "libbsc", "huff0", "fse")
INTEGER_FILTERS = ("zigzag_uleb128_varint", "bit_packing", "nbit")
CURATED = (
    "shuffle->zstd", "delta->zstd", "byte_stream_split->zstd", "higher_order_delta->zstd", "bitshuffle->zstd", "shuffle->libdeflate", "delta->libdeflate", "byte_stream_split->libdeflate",
    "shuffle->lz4hc", "delta->lz4hc", "shuffle->brotli", "delta->brotli", "shuffle->xz_lzma2", "delta->xz_lzma2", "shuffle->bzip2", "ndcell->zstd", "dictionary_categorize->zstd", "tdt->zstd",
    "xor_residual->zstd", "fcm_residual->zstd", "shuffle->zlib", "delta->zlib", "shuffle->lz4", "shuffle->lzfse", "delta->lzfse", "shuffle->snappy", "shuffle->lzf", "shuffle->szip_libaec",
    "shuffle->blosclz", "lorenzo_residual->zstd",
)
#: Pipelines that files may hold; ids count from 1.
DEPLOYABLE = (
    "brotli", "bzip2", "delta->brotli", "delta->bzip2", "delta->libdeflate", "delta->xz_lzma2", "delta->zlib", "delta_byte_array->xz_lzma2", "delta_length_byte_array->xz_lzma2",
    "dictionary_categorize->bzip2", "higher_order_delta->xz_lzma2", "libdeflate", "lorenzo_residual->xz_lzma2", "packbits->bzip2", "rle->brotli", "rle->xz_lzma2", "rle_bitpack_hybrid->snappy",
    "rle_bitpack_hybrid->xz_lzma2", "shuffle->bzip2", "shuffle->xz_lzma2", "snappy", "tdt->brotli", "tdt->bzip2", "tdt->xz_lzma2", "xz_lzma2", "zlib", "zstd",
)
IDS = {name: i for i, name in enumerate(DEPLOYABLE, 1)}
#: Names of presets, the first one of each being its own.
PRESETS = {
    "compressors_only": ("compressors_only", "all_compressors", "compressors"),
    "recommended": ("recommended", "recommended_8x8"),
    "single_filter": ("single_filter", "single_filter_x_compressor", "all_single_filter_combos"),
    "all_registered": ("all_registered", "compressors_plus_single_filter_x_compressor"),
    "curated_30": ("curated_30", "benchmark_curated", "curated_benchmark"),
}


def canonical(name: str) -> str:
    """Lower case; plus, slash, hyphen and blank are underscores; two underscores in a row become one, once."""
    out = name.strip().lower()
    for c in "+/- ":
        out = out.replace(c, "_")
    return out.replace("__", "_")


def canonical_column(name: Column) -> Column:
    return F.replace(F.translate(F.lower(F.trim(name)), "+/- ", "____"), F.lit("__"), F.lit("_"))


def join(filters: Sequence[str], compressor: str) -> str:
    return "->".join([*filters, compressor])


def parse(name: str) -> tuple[tuple[str, ...], str]:
    """(filters, compressor) of a pipeline's name; an empty name or an unknown member raises ValueError."""
    parts = [canonical(p) for p in name.split("->") if p.strip()]
    if not parts:
        raise ValueError("a pipeline has a compressor at least")
    *filters, compressor = parts
    unknown = [f for f in filters if f not in FILTERS and f != "identity"] + ([] if compressor in COMPRESSORS else [compressor])
    if unknown:
        raise ValueError(f"unknown in {name!r}: {', '.join(unknown)}")
    return tuple(f for f in filters if f != "identity"), compressor


def _dimension(spark: SparkSession, names: Sequence[str], column: str) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} string, {column}_place int")


def preset(spark: SparkSession, name: str = "compressors_only") -> DataFrame:
    """(pipeline, ordinal) of a preset; filters by compressors less the excluded ones. Dimensions have twenty rows each."""
    kind = next((k for k, names in PRESETS.items() if canonical(name) in names), None)
    if kind is None:
        raise ValueError(f"unknown preset: {name}")
    if kind == "curated_30":
        return _dimension(spark, CURATED, "pipeline").select("pipeline", F.col("pipeline_place").alias("ordinal"))
    compressors, filters = _dimension(spark, COMPRESSORS, "compressor"), _dimension(spark, FILTERS, "filter")
    bare = compressors.select(F.col("compressor").alias("pipeline"), F.col("compressor_place").alias("ordinal"))
    if kind == "compressors_only":
        return bare
    if kind == "recommended":
        compressors, filters = _dimension(spark, RECOMMENDED_COMPRESSORS, "compressor"), _dimension(spark, RECOMMENDED_FILTERS, "filter")
    if kind == "single_filter":
        compressors = compressors.join(_dimension(spark, RARE_COMPRESSORS, "compressor"), "compressor", "left_anti")
        filters = filters.join(_dimension(spark, INTEGER_FILTERS, "filter"), "filter", "left_anti")
    both = F.broadcast(filters).crossJoin(compressors)
    pairs = both.select(F.concat_ws("->", "filter", "compressor").alias("pipeline"), (F.col("filter_place") * len(COMPRESSORS) + F.col("compressor_place")).alias("ordinal"))
    return bare.union(pairs.withColumn("ordinal", F.col("ordinal") + len(COMPRESSORS))) if kind == "all_registered" else pairs


def from_settings(spark: SparkSession, settings: Mapping[str, str] | None = None) -> list[str]:
    """Pipelines named in PIPELINES (comma-separated, as they are), or else those of PIPELINE_PRESET."""
    settings = os.environ if settings is None else settings
    listed = [p.strip() for p in settings.get("PIPELINES", "").split(",") if p.strip()]
    return listed or [r.pipeline for r in preset(spark, settings.get("PIPELINE_PRESET") or "compressors_only").orderBy("ordinal").collect()]


def deployable(spark: SparkSession) -> DataFrame:
    """(pipeline_id, pipeline)."""
    return spark.createDataFrame([(i, n) for n, i in IDS.items()], "pipeline_id int, pipeline string")


def parts(pipelines: DataFrame) -> DataFrame:
    """The distinct (kind, name) of (pipeline): filters before the last arrow, compressors after it."""
    split = F.split("pipeline", "->")
    members = F.transform(split, lambda x, i: F.struct(F.when(i == F.size(split) - 1, "compressor").otherwise("filter").alias("kind"), x.alias("name")))
    return pipelines.select(F.explode(members).alias("m")).select("m.*").distinct()
