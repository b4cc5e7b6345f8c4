"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import gif, html, language, licenses, minhash, mixing, packing, secrets, suffix, vectors
from tessera.llm.common import read


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_suffix_dedup": lambda s, d: suffix.dedup(read(s, d, "documents")).drop("kept_text"),
        "op2_language_id": lambda s, d: language.held_out(read(s, d, "documents")),
        "op3_html_extract": lambda s, d: html.extract(read(s, d, "pages")),
        "op4_minhash_dedup": lambda s, d: minhash.near(read(s, d, "documents"), 3, 85),
        "op5_secret_scan": lambda s, d: secrets.find(read(s, d, "documents")),
        "op6_source_mixing": lambda s, d: mixing.mix(read(s, d, "documents")),
        "op7_gif_media": lambda s, d: gif.store_all(read(s, d, "documents")),
        "op8_best_fit_packing": lambda s, d: packing.pack(read(s, d, "documents")),
        "op9_embedding_dedup": lambda s, d: vectors.near(read(s, d, "embeddings")),
        "op10_license_scan": lambda s, d: licenses.scan(read(s, d, "documents")),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mixing": mixing.ORACLE, "op10_license_scan": licenses.ORACLE}
