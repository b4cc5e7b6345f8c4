"""A training corpus from `documents`: language, near duplicates, secrets, source weights, packed sequences.

Every stage decides row by row: null and repeated doc_id, repeated rows, null and empty texts and empty tables are inputs like others, and extra columns are dropped. The module needs the
subpackage `tessera.llm` and fails to import without it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, minhash, mixing, packing, secrets
from tessera.llm.common import map_text, materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tells the rows of a table apart, whatever their doc_id: from the first stage to the mix, where rows multiply.
ROW = "row"


def _numbered(docs: DataFrame) -> DataFrame:
    """With a row number; a table that has none yet is written first, as numbers would change when it is read twice."""
    return docs if ROW in docs.columns else materialize(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; `lang` becomes the predicted one where it was null. Each row is decided by itself, also one with a null or repeated doc_id."""
    found = language.identify(docs, language.learn(docs), keep=("text", "lang", "source", "n_chars")).where("lang_pred != 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id, a null one being the last. Rows are told apart by number: those that share a doc_id, or have none, go only
    if another row has nearly the same text."""
    docs = _numbered(docs)
    groups = minhash.near(docs.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    kept = groups.join(docs.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first.alias("f")).select(F.col(f"f.{ROW}").alias(ROW))
    return docs.join(kept, ROW, "left_semi").select(*COLUMNS, ROW)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found are masked in place; no document goes, a null text stays null."""
    import pyarrow as pa

    rest = [c for c in ("lang", "source", ROW) if c in docs.columns]

    def run(batch: pa.RecordBatch):
        texts = [None if t is None else secrets.masked(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], names=["doc_id", "text", *rest])

    schema = ", ".join(["doc_id long, text string", *(f"{c} {'long' if c == ROW else 'string'}" for c in rest)])
    out = map_text(docs.select("doc_id", "text", *rest), "text", run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, *rest[2:])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, by its number; the one row of a source that the mix takes in part comes whole once more or not, whichever is nearer to the target."""
    docs = _numbered(docs)
    plan = mixing.mix(docs, keep=(ROW,)).select(ROW, "size", "reps", "part")
    again = ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("int")
    rows = F.array_repeat(F.col("text"), F.col("reps").cast("int") + again)
    out = docs.join(plan, ROW).select("doc_id", F.explode(rows).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null text is the closing id alone; rows that repeat a doc_id are documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("minhash_dedup", near_duplicates),
    ("secret_scan", hide_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
