"""Files as rows: listing, kinds of files, checks of lists, counts of what became of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars

#: Kinds of files by the ending of their names, in the order in which they are tried.
ENDINGS = (
    ("npy", (".npy",)), ("fastq", (".fastq", ".fq")), ("fasta", (".fna", ".fasta", ".fa")), ("mmcif", (".cif",)), ("tiff", (".tif", ".tiff")), ("netcdf", (".nc",)),
    ("raw_numeric", (".bin", ".f32", ".f64", ".d64", ".i64", ".dat", ".raw")),
)
SKIPPED_NAMES, TEXT_SUFFIXES = ("readme.md", "md5sum.txt"), (".txt", ".csv", ".tsv")


def _like(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole path."""
    out, at = "", 0
    while at < len(pattern):
        c, at = pattern[at], at + 1
        if c == "[" and (end := pattern.find("]", at + 1)) > 0:
            inner, at = pattern[at:end], end + 1
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
        else:
            out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, "\\" + c if not c.isalnum() and c not in "_/ " else c)
    return f"^{out}$"


def matches(path: Column, patterns: Sequence[str]) -> Column:
    """Any of the shell patterns; all paths, if there are none."""
    out = F.lit(not patterns)
    for p in patterns:
        out = out | path.rlike(_like(p))
    return out


def files(spark: SparkSession, root: str, patterns: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(path relative to root, length, content) of all files under root; with `most`, the first ones by path. Contents aren't read unless they are used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    named = found.withColumn("path", F.substring("path", len(base) + 1, 1 << 20)).select("path", "length", "content").where(matches(F.col("path"), patterns))
    if most is None:
        return named
    return named.join(F.broadcast(named.select("path").orderBy("path").limit(most)), "path", "left_semi")


def file_kind(path: Column) -> Column:
    """Struct (kind, reason): the kind of a file by its name, or why it is skipped."""
    name = F.lower(F.substring_index(path, "/", -1))
    archive = F.array_contains(F.split(F.lower(path), "/"), "_archives")
    suffix = F.regexp_extract(name, r"^.[^.]*(\..*)?$", 1)
    made = lambda kind, reason=None: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(reason).cast("string").alias("reason"))
    out = F.when(name.isin(*SKIPPED_NAMES), made(None, "metadata_file")).when(archive, made("archive")).when(name.rlike(r"\.jsonl?$"), made(None, "json_metadata"))
    for kind, ends in ENDINGS:
        out = out.when(F.greatest(*[F.endswith(name, F.lit(e)).cast("int") for e in (*ends, ends[0])]) == 1, made(kind))
    out = out.when(scalars.split_dtype(name).isNotNull(), made("raw_numeric"))
    return out.when(suffix.isin(*TEXT_SUFFIXES), made("text_lines")).otherwise(made(None, "unknown_or_unsupported"))


def outcome(path: Column, include_archives: bool = False) -> Column:
    """Struct (status, reason, kind): what is split, and why others aren't."""
    k = file_kind(path)
    kept = "archive_not_split" if include_archives else "archive_skipped"
    reason = F.when(k["kind"] == "archive", kept).otherwise(k["reason"])
    return F.struct(F.when(reason.isNull(), "ok").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(reason.isNull(), k["kind"]).alias("kind"))


def outcomes(rows: DataFrame) -> DataFrame:
    """How many of (status, reason, kind) there are."""
    return rows.groupBy("status", "reason", "kind").agg(F.count(F.lit(1)).alias("n"))


def folders(rows: DataFrame, most: int) -> DataFrame:
    """(folder, available, picked) of (path)."""
    from tessera.operators import names

    return rows.groupBy(names.top_folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("available"), F.least(F.count(F.lit(1)), F.lit(most)).alias("picked"))


def payload_bytes(rows: DataFrame) -> DataFrame:
    """Bytes of (path, length) without archives."""
    return rows.where(~F.array_contains(F.split(F.lower("path"), "/"), "_archives")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def missing(records: DataFrame, listing: DataFrame, column: str = "slice_file") -> DataFrame:
    """Records whose file isn't listed."""
    return records.join(listing.select(F.col("path").alias(column)), column, "left_anti")


def repeated(records: DataFrame, column: str) -> DataFrame:
    """(target, n) of targets that more than one record has."""
    return records.groupBy(F.col(column).alias("target")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def records(rows: DataFrame) -> DataFrame:
    """Records of slices: no `_meta`, and with a file."""
    return rows.where((F.col("id") != "_meta") & F.col("slice_file").isNotNull())


def labels(rows: DataFrame) -> DataFrame:
    """Rows with a label, the first of label, best_pipeline and best_algorithm that isn't empty."""
    some = [F.when(F.col(c) != "", F.col(c)) for c in ("label", "best_pipeline", "best_algorithm") if c in rows.columns]
    return rows.withColumn("label", F.coalesce(*some)).where("label is not null")


def derived(rows: DataFrame) -> DataFrame:
    """Of (path, dataset, length): dtype, used and dropped bytes, number of items, shape and its source."""
    typed = rows.withColumn("dtype_guess", scalars.label_dtype(F.substring_index("path", "/", -1)))
    size = scalars.element_size(F.col("dtype_guess"))
    typed = typed.withColumn("used_size_bytes", F.col("length") - F.coalesce(F.col("length") % size, F.lit(0)))
    typed = typed.withColumn("tail_dropped_bytes", F.col("length") - F.col("used_size_bytes")).withColumn("element_count", F.floor(F.col("used_size_bytes") / size).cast("long"))
    found = scalars.label_shape(F.col("path"), F.col("dtype_guess"), F.col("dataset"), F.col("used_size_bytes"))
    return typed.withColumn("s", found).withColumn("shape", F.col("s.shape")).withColumn("shape_source", F.col("s.source")).drop("s")


def flat(results: DataFrame, pipelines: Sequence[str]) -> DataFrame:
    """One row for each slice, with ratio, rate, size and reason of every pipeline of a given list as columns named by its spelling."""
    from tessera.operators import registry

    names = [registry.canonical(p) for p in pipelines]
    wide = results.where(F.col("pipeline").isin(*pipelines)).groupBy("id").pivot("pipeline", list(pipelines))
    out = wide.agg(F.first("out_size").alias("s"), F.first("ratio").alias("r"), F.first("rate").alias("t"), F.first("reason").alias("w"))
    columns = [F.col(f"`{p}_{k}`").alias(f"{n}_{name}") for p, n in zip(pipelines, names) for k, name in (("s", "compressed_size_bytes"), ("r", "ratio"), ("t", "rate"), ("w", "reason"))]
    return out.select("id", *columns)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of records by id as rows (id, record as text)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "record"))
