"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import bytes as b
from tessera.operators import container, features, filters, learning, names, registry, sampling, sweep
from tessera.operators.batches import bounded, rows_of
from tessera.sources import scan, split


def _read(table: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet")


_docs, _items, _orders, _pages, _parts = map(_read, ("documents", "lineitem", "orders", "pages", "part"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.slices(_docs(spark, sf_dir))


def typed_slices(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Slices of float64 items, a column's values in order by key: (id, raw, dtype, shape). A key's values are one slice, as a file would be."""
    lists = rows.groupBy(F.col(key).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("x")))).alias("a")).select("id", F.col("a.x").alias("x"))

    def run(batches: Iterator) -> Iterator:
        def one(row: tuple) -> list[tuple]:
            return [(row[0], np.array(row[1], "<f8").tobytes(), "float64", [len(row[1])])]

        yield from bounded(batches, one, "id long, raw binary, dtype string, shape array<long>")

    return lists.mapInArrow(run, "id long, raw binary, dtype string, shape array<long>")


#: Order keys of a slice of prices: slices get more with the table, not longer.
PRICES = 2048


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumn("k", F.floor(F.col("o_orderkey") / PRICES))
    return typed_slices(rows, "k", ["o_orderkey"], "o_totalprice")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SIZES = ("p_size", "p_retailprice")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select(F.col("l_returnflag").alias("y"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("p"))


#: Stand-ins for a sweep's results: suppliers as slices, flags as pipelines; some fail and some have no ratio.
_RESULTS = """SELECT l_suppkey AS id, l_returnflag AS pipeline, l_suppkey % 7 <> 3 OR l_returnflag <> 'N' AS ok, CASE WHEN l_suppkey % 11 = 5 THEN NULL ELSE round(avg(l_quantity), 6) END AS ratio,
count(*) AS out_size, round(avg(l_discount), 6) AS rate, CASE WHEN l_suppkey % 7 = 3 AND l_returnflag = 'N' THEN 'refused' END AS reason FROM lineitem GROUP BY l_suppkey, l_returnflag"""
_TRUTH = "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'X' END AS y FROM supplier"
_LABELS = ("A", "N", "R")


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in ("lineitem", "supplier"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"catalog_{t}")
    return spark.sql(sql.replace("FROM lineitem", "FROM catalog_lineitem").replace("FROM supplier", "FROM catalog_supplier"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _RESULTS)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _TRUTH)


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, i) for i, x in enumerate(_LABELS)], "label string, place int")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.valid(_results(spark, sf_dir)).select("id", F.col("pipeline").alias("label"), F.col("ratio").alias("score"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).groupBy((F.col("l_linenumber") % 3).alias("member"), F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("label")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))


def _alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = learning.valid(_results(spark, sf_dir)).join(F.broadcast(_labels(spark)), F.col("pipeline") == F.col("label"))
    scored = good.select("id", "label", "place", F.col("ratio").alias("cls"), (F.col("rate") * 100).alias("util"))
    return _rounded(_rounded(learning.best_alpha(scored, _truth(spark, sf_dir), _results(spark, sf_dir), (0.0, 0.5, 1.0, 4.0)), "accuracy"), "relative_ratio")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), F.octet_length("html").cast("long").alias("length"))


def _page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("path")
    rows = _paths(spark, sf_dir).withColumn("path", F.concat(u, F.lit(".v1.F32")))
    return rows.select("page_id", names.dataset_name(u).alias("dataset"), names.top_folder(u).alias("folder"), names.suffix(u).alias("suffix"), scalars.dataset_key(u).alias("key"), scalars.packed_name(u).alias("packed"), scalars.restored_name(u).alias("restored"))


def _varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = names.zigzag(F.col("o_orderkey") - F.col("o_custkey"))
    return _orders(spark, sf_dir).select("o_orderkey", z.alias("zigzag"), names.uleb_size(z).alias("bytes"))


#: Files by name and size, for what is told from names.
_FILES = (
    ("NYX/density_512_512_512.f32", 536870912), ("cesm-atm/CLDHGH_1_1800_3600.f32", 25920000), ("cesm-atm/odd.dat", 25920000), ("Miranda/velocity.d64", 301989888), ("x/readme.md", 10),
    ("x/_Archives/a.tar.gz", 10), ("x/a.json", 10), ("x/b.jsonl", 10), ("x/c.npy", 10), ("bio/r.fq", 10), ("bio/g.FNA", 10), ("bio/p.cif", 10), ("img/t.tiff", 10), ("sea/w.nc", 10),
    ("txt/notes.txt", 10), ("txt/table.csv", 10), ("txt/a.b.csv", 10), ("x/uint64_counts", 803), ("x/plain", 10), ("xgc/i.f64", 80), ("x/3x5_grid.f32", 60), ("flat.i32", 0), ("x/u16_3_4", 24),
)


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FILES, "path string, length long")


def _file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark).select("path", F.inline(F.array(scan.outcome(F.col("path")))))


def _file_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.derived(_files(spark).withColumn("dataset", F.split_part("path", F.lit("/"), F.lit(1))))
    return rows.select("path", "dtype_guess", scalars.split_dtype(F.substring_index("path", "/", -1)).alias("split_dtype"), "used_size_bytes", "tail_dropped_bytes", "element_count", F.array_join("shape", "x").alias("shape"), "shape_source")


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalars.best_2d(F.col("o_orderkey"))
    return _orders(spark, sf_dir).select("o_orderkey", s["shape"][0].alias("a"), s["shape"][1].alias("b"), F.round(s["score"], 6).alias("score"))


def _dictionary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(_slices(spark, sf_dir), lambda i, raw, lay: [(i, len(filters.ALL["dictionary_categorize"][0](raw, lay)[0]))], "id long, size long")


def _residual_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the bytes after a filter: it depends on each of them."""

    def rows(i, raw: bytes, lay) -> Iterator[tuple]:
        x = np.frombuffer(filters.ALL["delta"][0](raw, lay)[0], np.uint8)
        yield i, int(x.sum(dtype=np.int64)), int(np.frombuffer(filters.ALL["higher_order_delta"][0](raw, lay)[0], np.uint8).sum(dtype=np.int64))

    return rows_of(_slices(spark, sf_dir), rows, "id long, delta long, delta2 long")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = container.pack(_slices(spark, sf_dir), ("zlib",))
    return container.inspect(packed).select("id", "version", "mode", "pipeline_id", "tail_size", "original_size", F.get_json_object("metadata", "$.pipeline_name").alias("pipeline"), F.get_json_object("metadata", "$.aligned_size").cast("long").alias("aligned"))


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = ("snappy", "delta->libdeflate", "rle->brotli", "zstd", "delta_length_byte_array->xz_lzma2")
    return container.unpack(container.pack(_slices(spark, sf_dir), candidates)).select("id", F.sha2("raw", 256).alias("sha256"), F.octet_length("raw").cast("long").alias("size"))


def _trips(s: DataFrame) -> DataFrame:
    return container.round_trips(s).groupBy("pipeline_id", "pipeline").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ok"), 1)).alias("ok"))


def _line_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _docs(spark, sf_dir).select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    pieces = split.split(listing, split.Size(500, 1500))
    whole = pieces.groupBy("path").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.octet_length("payload")).alias("bytes"), F.sum(F.get_json_object("detail", "$.line_count").cast("long")).alias("lines"))
    return whole


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return learning.binned(rows, _SIZES).select("id", F.posexplode("x").alias("place", "x")).withColumn("x", F.round("x", 6))


def _trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranker that is trained on slices' features and best pipelines and ranks them: (id, label, score, rank)."""
    both = sweep.examples(_slices(spark, sf_dir), ("identity", "rle", "delta"), ("zlib", "zstd", "bzip2")).persist(StorageLevel.DISK_ONLY)
    space = [r.label for r in learning.label_space(both.withColumnRenamed("best_pipeline", "label"), "label").orderBy("y").collect()]
    place = F.array_position(F.array(*map(F.lit, space)), F.col("best_pipeline")) - 1
    model = learning.train(both.where("best_pipeline is not null").select("x", place.cast("double").alias("y")), [len(features.NAMES), 16, max(2, len(space))], epochs=10)
    scores = learning.scores_of(model, both.select("id", "x"), space).persist(StorageLevel.DISK_ONLY)
    scores.count()
    both.unpersist()
    return learning.ranked(scores).withColumn("score", F.round("score", 6))


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in registry.PRESETS:
        one = registry.preset(spark, name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pipeline").alias("names"), F.count_distinct("ordinal").alias("places")).withColumn("preset", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def queries() -> dict:
    return {
        "byte_histogram": lambda s, d: b.histogram(_slices(s, d)).select("id", "byte", "n", F.round("p", 9).alias("p")),
        "byte_entropy": lambda s, d: b.entropy(_slices(s, d)),
        "bit_density": lambda s, d: b.bit_density(_slices(s, d)),
        "adjacent_bytes": lambda s, d: b.adjacent(_slices(s, d)),
        "window_entropy_stats": lambda s, d: b.window_stats(_slices(s, d), 1024),
        "run_lengths": lambda s, d: b.run_lengths(_slices(s, d)),
        "dictionary_sizes": _dictionary_sizes,
        "delta_bytes": _residual_sizes,
        "stratified_sample": lambda s, d: sampling.stratified(_rows(s, d), "source", 20),
        "seeded_numbers": lambda s, d: sampling.numbered(_rows(s, d)),
        "train_test_split": lambda s, d: sampling.split(_rows(s, d), "source"),
        "label_space": lambda s, d: learning.label_space(_items(s, d), "l_returnflag"),
        "class_weights": lambda s, d: _rounded(learning.class_weights(_items(s, d), "l_returnflag"), "weight"),
        "column_stats": lambda s, d: _rounded(_rounded(learning.column_stats(_items(s, d), _MEASURES), "mean"), "std"),
        "quantile_thresholds": lambda s, d: _rounded(learning.thresholds(_items(s, d), _MEASURES), "threshold"),
        "quantile_bins": _binned,
        "accuracy": lambda s, d: _rounded(learning.accuracy(_predicted(s, d), "y", "p"), "accuracy"),
        "macro_f1": lambda s, d: _rounded(learning.macro_f1(_predicted(s, d), "y", "p", s.createDataFrame([("A",), ("N",), ("R",), ("X",)], "label string")), "macro_f1"),
        "label_ranking": lambda s, d: learning.ranked(_scores(s, d)),
        "top_two_accuracy": lambda s, d: _rounded(_rounded(learning.top_k_accuracy(_scores(s, d), _truth(s, d)), "accuracy"), "top"),
        "utility": lambda s, d: _rounded(learning.utility(_results(s, d)), "utility").select("id", "pipeline", "ratio", "utility"),
        "relative_ratio": lambda s, d: _rounded(learning.relative_ratio(_results(s, d), _truth(s, d).withColumnRenamed("y", "label")), "relative_ratio"),
        "label_targets": lambda s, d: learning.targets(_truth(s, d).withColumnRenamed("y", "label"), _results(s, d), _labels(s)),
        "masked_scores": lambda s, d: learning.masked_scores(learning.targets(_truth(s, d).withColumnRenamed("y", "label"), _results(s, d), _labels(s)).withColumnRenamed("ratio", "score")),
        "unseen_labels": lambda s, d: learning.unseen(_results(s, d).select(F.col("pipeline").alias("y")), _truth(s, d), "y"),
        "ensemble_mean": lambda s, d: _rounded(learning.ensemble(_members(s, d)), "score"),
        "alpha_grid": _alphas,
        "best_of_results": lambda s, d: sweep.best(learning.valid(_results(s, d)).where("ok").join(F.broadcast(_labels(s).select(F.col("label").alias("pipeline"), F.col("place").alias("ordinal"))), "pipeline")),
        "results_pivot": lambda s, d: scan.flat(_results(s, d), _LABELS),
        "page_names": _page_names,
        "folder_summary": lambda s, d: scan.folders(_paths(s, d), 5),
        "payload_bytes": lambda s, d: scan.payload_bytes(_paths(s, d)),
        "repeated_targets": lambda s, d: scan.repeated(_paths(s, d).withColumn("target", F.substring_index("path", "/", -1)), "target"),
        "missing_files": lambda s, d: scan.missing(_paths(s, d).select("page_id", F.col("path").alias("slice_file")), _paths(s, d).where("page_id % 3 <> 0")),
        "file_kinds": _file_kinds,
        "file_outcomes": lambda s, d: scan.outcomes(_file_kinds(s, d)),
        "file_layouts": _file_layouts,
        "square_shapes": _squares,
        "varint_sizes": _varints,
        "line_pieces": _line_pieces,
        "pipeline_presets": _presets,
        "pipeline_parts": lambda s, d: registry.parts(registry.preset(s, "all_registered")),
        "deployable_pipelines": lambda s, d: registry.deployable(s),
        "container_headers": _headers,
        "container_restored": _restored,
        "text_round_trips": lambda s, d: _trips(_slices(s, d)),
        "typed_round_trips": lambda s, d: _trips(_prices(s, d)),
        "exhaustive_ranking": lambda s, d: container.exhaustive(_prices(s, d)),
        "slice_features": lambda s, d: features.extract(_prices(s, d)).select("id", F.transform("features", lambda x: F.round(x, 6)).alias("features")),
        "trained_ranking": _trained,
        "best_pipeline": lambda s, d: sweep.best_swept(_slices(s, d), sweep.REFERENCE_FILTERS, sweep.REFERENCE_CODECS),
    }


_BYTES = """WITH d AS (SELECT doc_id AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT id, p AS pos, ('0x' || substr(h, 2 * p + 1, 2))::INT AS byte FROM (SELECT id, h, unnest(range(length(h) // 2)) AS p FROM d)),
c AS (SELECT id, byte, count(*) AS n FROM e GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY n DESC, byte) AS place FROM c)
"""
_ENTROPY = "round(abs(-sum(p * log2(p))), 6)"
_VARINT = "CASE WHEN {0} = 0 THEN 1 ELSE ceil(length(bin({0})) / 7) END"
_VALID = "v AS (SELECT * FROM r WHERE coalesce(ok, true) AND ratio IS NOT NULL)"
_TARGETS = f"""WITH r AS ({_RESULTS}), {_VALID}, t AS ({_TRUTH}), l(label) AS (VALUES ('A'), ('N'), ('R')),
j AS (SELECT t.id, t.y AS own, l.label, v.ratio, count(v.ratio) OVER (PARTITION BY t.id) AS valid FROM t JOIN l k ON t.y = k.label CROSS JOIN l LEFT JOIN v ON v.id = t.id AND v.pipeline = l.label),
g AS (SELECT id, own, label, CASE WHEN valid = 0 AND label = own THEN 1.0 ELSE coalesce(ratio, 0.0) END::DOUBLE AS ratio, (ratio IS NOT NULL OR (valid = 0 AND label = own))::INT AS mask FROM j)
"""
_PATHS = "SELECT page_id, regexp_replace(url, '^https?://', '') AS path, strlen(html) AS length FROM pages"


def _values(rows) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


#: What is to be told from the names of _FILES, by hand: (path, status, reason, kind).
_KINDS = (
    ("NYX/density_512_512_512.f32", "ok", None, "raw_numeric"), ("cesm-atm/CLDHGH_1_1800_3600.f32", "ok", None, "raw_numeric"), ("cesm-atm/odd.dat", "ok", None, "raw_numeric"),
    ("Miranda/velocity.d64", "ok", None, "raw_numeric"), ("x/readme.md", "skipped", "metadata_file", None), ("x/_Archives/a.tar.gz", "skipped", "archive_skipped", None),
    ("x/a.json", "skipped", "json_metadata", None), ("x/b.jsonl", "skipped", "json_metadata", None), ("x/c.npy", "ok", None, "npy"), ("bio/r.fq", "ok", None, "fastq"),
    ("bio/g.FNA", "ok", None, "fasta"), ("bio/p.cif", "ok", None, "mmcif"), ("img/t.tiff", "ok", None, "tiff"), ("sea/w.nc", "ok", None, "netcdf"), ("txt/notes.txt", "ok", None, "text_lines"),
    ("txt/table.csv", "ok", None, "text_lines"), ("txt/a.b.csv", "skipped", "unknown_or_unsupported", None), ("x/uint64_counts", "ok", None, "raw_numeric"),
    ("x/plain", "skipped", "unknown_or_unsupported", None), ("xgc/i.f64", "ok", None, "raw_numeric"), ("x/3x5_grid.f32", "ok", None, "raw_numeric"), ("flat.i32", "ok", None, "raw_numeric"),
    ("x/u16_3_4", "ok", None, "raw_numeric"),
)
#: (path, dtype, splitter's dtype, used, dropped, items, shape, source).
_LAYOUTS = (
    ("NYX/density_512_512_512.f32", "float32", "float32", 536870912, 0, 134217728, "512x512x512", "filename_numbers"),
    ("cesm-atm/CLDHGH_1_1800_3600.f32", "float32", "float32", 25920000, 0, 6480000, "1800x3600", "dataset_table"), ("cesm-atm/odd.dat", None, None, 25920000, 0, None, None, "unknown"),
    ("Miranda/velocity.d64", "float64", "float64", 301989888, 0, 37748736, "256x384x384", "dataset_table"), ("x/uint64_counts", "uint64", "int64", 800, 3, 100, "100", "1d_fallback"),
    ("xgc/i.f64", "float64", "float64", 80, 0, 10, None, "unstructured_dataset"), ("x/3x5_grid.f32", "float32", "float32", 60, 0, 15, "3x5", "filename_numbers"),
    ("flat.i32", None, "int32", 0, 0, None, None, "unknown"), ("x/u16_3_4", None, "uint16", 24, 0, None, None, "unknown"),
)
_NAMED = {r[0] for r in _LAYOUTS}


def oracle_sql() -> dict[str, str]:
    bits = ", ".join(f"round(avg((byte >> {7 - k}) & 1), 6) AS bit{k}" for k in range(8))
    stats = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) < 1e-6 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM lineitem" for c in _MEASURES)
    cut = lambda c, i, table: f"quantile_cont({c}, {0.05 + 0.9 * i / 14!r})"
    cuts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i}::INT AS place, round({cut(c, i, 'lineitem')}, 6) AS threshold FROM lineitem" for c in _MEASURES for i in range(15))
    marks = " UNION ALL ".join(
        [f"SELECT p_partkey AS id, {k}::INT AS place, round(({c} - (SELECT avg({c}) FROM part)) / (SELECT stddev_pop({c}) FROM part), 6) AS x FROM part" for k, c in enumerate(_SIZES)]
        + [f"SELECT p_partkey AS id, {2 + 15 * k + i}::INT AS place, ({c} > (SELECT {cut(c, i, 'part')} FROM part))::INT::DOUBLE AS x FROM part" for k, c in enumerate(_SIZES) for i in range(15)]
    )
    predicted = "WITH r AS (SELECT l_returnflag AS y, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS p FROM lineitem) "
    results = f"WITH r AS ({_RESULTS}), {_VALID}, t AS ({_TRUTH}) "
    untyped = ", ".join(f"'{n}'" for n in registry.DEPLOYABLE if n.split("->")[0] in (*filters.UNTYPED, *registry.COMPRESSORS))
    ids = _values([(i, n) for n, i in registry.IDS.items()])
    rest = [(p, None, None, n, 0, None, None, "unknown") for p, n in _FILES if p not in _NAMED]
    return {
        "byte_histogram": _BYTES + "SELECT id, byte, n, round(p, 9) AS p FROM q",
        "byte_entropy": _BYTES + f"""SELECT id, {_ENTROPY} AS entropy, round(sum(CASE WHEN byte = 0 THEN p ELSE 0.0 END), 6)::DOUBLE AS zero_frac,
round(sum(CASE WHEN byte = 255 THEN p ELSE 0.0 END), 6)::DOUBLE AS ff_frac, round(max(p), 6) AS top1_frac, round(sum(CASE WHEN place <= 4 THEN p ELSE 0.0 END), 6) AS top4_frac,
round(count(*) / 256, 6) AS unique_byte_ratio, round(sum(p * byte) / 255, 6) AS mean_byte,
round(sqrt(greatest(0.0, sum(p * byte * byte) - sum(p * byte) * sum(p * byte))) / 128, 6) AS std_byte FROM q GROUP BY id""",
        "bit_density": _BYTES + f"SELECT id, {bits} FROM e GROUP BY id",
        "adjacent_bytes": _BYTES + f""", n AS (SELECT id, byte, lag(byte) OVER (PARTITION BY id ORDER BY pos) AS b FROM e), a AS (SELECT id, abs(byte - b) AS d, xor(byte, b) AS x FROM n WHERE b IS NOT NULL),
f AS (SELECT id, {_ENTROPY} AS delta_entropy FROM (SELECT id, d, count(*) / sum(count(*)) OVER (PARTITION BY id) AS p FROM a GROUP BY id, d) GROUP BY id),
g AS (SELECT id, {_ENTROPY} AS xor_entropy FROM (SELECT id, x, count(*) / sum(count(*)) OVER (PARTITION BY id) AS p FROM a GROUP BY id, x) GROUP BY id)
SELECT id, round(avg((d = 0)::INT), 6) AS same_adjacent, round(avg(d) / 255, 6) AS mean_delta, round(stddev_pop(d) / 128, 6) AS std_delta, any_value(delta_entropy) AS delta_entropy,
any_value(xor_entropy) AS xor_entropy FROM a JOIN f USING (id) JOIN g USING (id) GROUP BY id""",
        "window_entropy_stats": _BYTES + """, z AS (SELECT id, count(*) AS size FROM e GROUP BY id),
w AS (SELECT id, i, CASE WHEN size <= 1024 THEN 0 WHEN i = 4 THEN size - 1024 ELSE floor(i * (size - 1024) / 4) END AS start FROM z, range(5) t(i) WHERE size > 1024 OR i = 0),
k AS (SELECT w.id, i, byte, count(*) AS n FROM w JOIN e ON e.id = w.id AND pos >= start AND pos < start + 1024 GROUP BY ALL),
h AS (SELECT id, i, abs(-sum(p * log2(p))) / 8 AS h FROM (SELECT id, i, n / sum(n) OVER (PARTITION BY id, i) AS p FROM k) GROUP BY id, i)
SELECT id, count(*)::INT AS windows, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std, round(min(h), 6) AS least, round(max(h), 6) AS most FROM h GROUP BY id""",
        "run_lengths": _BYTES + f""", s AS (SELECT id, pos, byte, lag(byte) OVER (PARTITION BY id ORDER BY pos) IS DISTINCT FROM byte AS first FROM e),
g AS (SELECT id, sum(first::INT) OVER (PARTITION BY id ORDER BY pos) AS run FROM s), l AS (SELECT id, run, count(*) AS n FROM g GROUP BY id, run)
SELECT id, count(*) AS runs, max(n) AS longest, sum({_VARINT.format('n')} + 1)::BIGINT AS rle_size FROM l GROUP BY id""",
        "dictionary_sizes": f"""WITH d AS (SELECT doc_id AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT id, length(h) // 2 AS n, len(list_distinct(list_transform(range(length(h) // 2), lambda p: substr(h, 2 * p + 1, 2)))) AS k FROM d),
w AS (SELECT *, CASE WHEN k <= 2 THEN 1 ELSE length(bin(k - 1)) END AS bits FROM c)
SELECT id, (2 + {_VARINT.format('n')} + {_VARINT.format('k')} + k + ceil(n * bits / 8))::BIGINT AS size FROM w""",
        "delta_bytes": _BYTES + """, n AS (SELECT id, pos, (byte - lag(byte, 1, 0) OVER (PARTITION BY id ORDER BY pos) + 256) % 256 AS d FROM e),
m AS (SELECT id, d, (d - lag(d, 1, 0) OVER (PARTITION BY id ORDER BY pos) + 256) % 256 AS d2 FROM n)
SELECT id, coalesce(sum(d), 0)::BIGINT AS delta, coalesce(sum(d2), 0)::BIGINT AS delta2 FROM (SELECT id FROM d) LEFT JOIN m USING (id) GROUP BY id""",
        "stratified_sample": """SELECT id, source, place FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY lower(source) ORDER BY md5('42:' || doc_id), doc_id)::INT AS place FROM documents)
WHERE place <= 20""",
        "seeded_numbers": "SELECT doc_id AS id, source, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS number FROM documents",
        "train_test_split": """WITH l AS (SELECT doc_id AS id, source FROM documents WHERE source <> ''), n AS (SELECT count(*) AS n FROM l)
SELECT id, source, row_number() OVER (ORDER BY md5('42:' || id), id) <= CASE WHEN n <= 1 THEN 0 ELSE least(n - 1, greatest(1, n // 5)) END AS test FROM l, n
UNION ALL SELECT doc_id, source, NULL FROM documents WHERE source IS NULL OR source = ''""",
        "label_space": "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS y FROM (SELECT DISTINCT l_returnflag AS label FROM lineitem WHERE l_returnflag IS NOT NULL)",
        "class_weights": """WITH c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1),
w AS (SELECT label, n, pow((SELECT avg(n) FROM c) / n, 0.15) AS w FROM c) SELECT label, n, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""",
        "column_stats": stats,
        "quantile_thresholds": cuts,
        "quantile_bins": marks,
        "accuracy": predicted + "SELECT count(*) AS n, round(avg((y = p)::INT), 6) AS accuracy FROM r",
        "macro_f1": predicted + """, l(k) AS (VALUES ('A'), ('N'), ('R'), ('X'))
SELECT round(avg(coalesce(f, 0)), 6) AS macro_f1 FROM (SELECT k, 2 * (SELECT count(*) FROM r WHERE y = k AND p = k) / nullif((SELECT count(*) FROM r WHERE y = k) + (SELECT count(*) FROM r WHERE p = k), 0) AS f FROM l)""",
        "label_ranking": results + "SELECT id, pipeline AS label, ratio AS score, row_number() OVER (PARTITION BY id ORDER BY ratio DESC, pipeline)::INT AS rank FROM v",
        "top_two_accuracy": results + """, k AS (SELECT id, pipeline, row_number() OVER (PARTITION BY id ORDER BY ratio DESC, pipeline) AS rank FROM v),
p AS (SELECT id, min(CASE WHEN pipeline = y THEN rank END) AS place FROM k JOIN t USING (id) GROUP BY id)
SELECT count(*) AS n, round(avg(coalesce(place <= 1, false)::INT), 6) AS accuracy, round(avg(coalesce(place <= 2, false)::INT), 6) AS top FROM p""",
        "utility": results + "SELECT id, pipeline, ratio, round(ratio / greatest(max(ratio) OVER (PARTITION BY id), 1e-12), 6) AS utility FROM v",
        "relative_ratio": results + """, m AS (SELECT id, max(ratio) AS best FROM v GROUP BY id)
SELECT round(avg(coalesce(v.ratio, 0) / greatest(best, 1e-12)), 6) AS relative_ratio FROM t JOIN m USING (id) LEFT JOIN v ON v.id = t.id AND v.pipeline = t.y""",
        "label_targets": _TARGETS + "SELECT * FROM g",
        "masked_scores": _TARGETS + "SELECT id, own, label, CASE WHEN mask = 0 THEN -1e9 ELSE ratio END AS score, mask FROM g",
        "unseen_labels": f"WITH r AS ({_RESULTS}), t AS ({_TRUTH}) SELECT y FROM t EXCEPT SELECT pipeline FROM r",
        "ensemble_mean": """SELECT id, label, round(avg(score), 6) AS score FROM (SELECT l_linenumber % 3 AS member, l_suppkey AS id, l_returnflag AS label, round(avg(l_quantity), 6) AS score FROM lineitem
GROUP BY 1, 2, 3) GROUP BY id, label""",
        "alpha_grid": results + """, a(alpha) AS (VALUES (0.0), (0.5), (1.0), (4.0)), m AS (SELECT id, max(ratio) AS best FROM v GROUP BY id),
s AS (SELECT alpha, id, pipeline, row_number() OVER (PARTITION BY alpha, id ORDER BY ratio + alpha::DOUBLE * (rate * 100) DESC, pipeline) AS k FROM v, a)
SELECT alpha::DOUBLE AS alpha, round(avg((s.pipeline = y)::INT), 6) AS accuracy, round(avg(coalesce(v.ratio / greatest(best, 1e-12), 0)), 6) AS relative_ratio
FROM s JOIN t USING (id) JOIN m USING (id) LEFT JOIN v ON v.id = s.id AND v.pipeline = s.pipeline WHERE k = 1 GROUP BY alpha""",
        "best_of_results": results + """SELECT id, pipeline AS best_pipeline, ratio AS best_ratio FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ratio DESC, pipeline) AS k FROM v) WHERE k = 1""",
        "results_pivot": f"WITH r AS ({_RESULTS}) SELECT id, " + ", ".join(f"max(CASE WHEN pipeline = '{p}' THEN {c} END) AS {p.lower()}_{n}" for p in _LABELS for c, n in (("out_size", "compressed_size_bytes"), ("ratio", "ratio"), ("rate", "rate"), ("reason", "reason"))) + " FROM r GROUP BY id",
        "page_names": f"""WITH p AS (SELECT page_id, path || '.v1.F32' AS path FROM ({_PATHS}))
SELECT page_id, replace(replace(lower(path), '_', '-'), ' ', '-') AS dataset, CASE WHEN instr(path, '/') = 0 THEN '(flat)' ELSE split_part(path, '/', 1) END AS folder,
regexp_extract(split_part(path, '/', -1), '^[^.]*(\\..*)?$', 1) AS suffix, lower(split_part(path, '/', 1)) AS key, path || '.cpss' AS packed, path || '.restored' AS restored FROM p""",
        "folder_summary": f"SELECT CASE WHEN instr(path, '/') = 0 THEN '(flat)' ELSE split_part(path, '/', 1) END AS folder, count(*) AS available, least(count(*), 5) AS picked FROM ({_PATHS}) GROUP BY 1",
        "payload_bytes": f"SELECT coalesce(sum(length), 0)::BIGINT AS bytes FROM ({_PATHS}) WHERE NOT list_contains(string_split(lower(path), '/'), '_archives')",
        "repeated_targets": f"SELECT split_part(path, '/', -1) AS target, count(*) AS n FROM ({_PATHS}) GROUP BY 1 HAVING count(*) > 1",
        "missing_files": f"WITH p AS ({_PATHS}) SELECT path AS slice_file, page_id FROM p WHERE path NOT IN (SELECT path FROM p WHERE page_id % 3 <> 0)",
        "file_kinds": f"SELECT * FROM ({_values(_KINDS)}) v(path, status, reason, kind)",
        "file_outcomes": f"SELECT status, reason, kind, count(*) AS n FROM ({_values(_KINDS)}) v(path, status, reason, kind) GROUP BY ALL",
        "file_layouts": f"SELECT path, dtype_guess, split_dtype, used::BIGINT AS used_size_bytes, dropped::BIGINT AS tail_dropped_bytes, items::BIGINT AS element_count, shape, source AS shape_source FROM ({_values([*_LAYOUTS, *rest])}) v(path, dtype_guess, split_dtype, used, dropped, items, shape, source)",
        "square_shapes": """WITH f AS (SELECT o_orderkey, max(a) AS a FROM (SELECT o_orderkey, unnest(range(1, floor(sqrt(o_orderkey))::BIGINT + 1)) AS a FROM orders) WHERE o_orderkey % a = 0 GROUP BY o_orderkey)
SELECT o_orderkey, a, o_orderkey // a AS b, round((o_orderkey / a) / a, 6) AS score FROM orders LEFT JOIN f USING (o_orderkey)""",
        "varint_sizes": """SELECT o_orderkey, z AS zigzag, CASE WHEN z = 0 THEN 1 ELSE ceil(length(bin(z)) / 7)::INT END AS bytes
FROM (SELECT o_orderkey, CASE WHEN o_orderkey < o_custkey THEN -2 * (o_orderkey - o_custkey) - 1 ELSE 2 * (o_orderkey - o_custkey) END AS z FROM orders)""",
        "line_pieces": """WITH RECURSIVE t AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text <> ''),
l AS (SELECT doc_id, i, strlen(parts[i]) + (i < len(parts))::INT AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM t)),
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, n FROM l WHERE n > 0),
w AS (SELECT doc_id, i, n, n AS held, 1 AS piece FROM x WHERE i = 1
UNION ALL SELECT x.doc_id, x.i, x.n, CASE WHEN held >= 1000 THEN x.n ELSE held + x.n END, CASE WHEN held >= 1000 THEN piece + 1 ELSE piece END FROM w JOIN x ON x.doc_id = w.doc_id AND x.i = w.i + 1)
SELECT 'docs/' || doc_id || '.txt' AS path, max(piece)::BIGINT AS pieces, sum(n)::BIGINT AS bytes, count(*) AS lines FROM w GROUP BY doc_id""",
        "pipeline_presets": "SELECT preset, n::BIGINT AS n, n::BIGINT AS names, n::BIGINT AS places FROM (VALUES ('compressors_only', 20), ('recommended', 64), ('single_filter', 221), ('all_registered', 420), ('curated_30', 30)) v(preset, n)",
        "pipeline_parts": f"SELECT 'filter' AS kind, name FROM ({_values((f,) for f in registry.FILTERS)}) v(name) UNION ALL SELECT 'compressor', name FROM ({_values((c,) for c in registry.COMPRESSORS)}) v(name)",
        "deployable_pipelines": f"SELECT pipeline_id::INT AS pipeline_id, pipeline FROM ({ids}) v(pipeline_id, pipeline)",
        "container_headers": "SELECT doc_id AS id, 1 AS version, 'exhaustive' AS mode, 26 AS pipeline_id, 0::BIGINT AS tail_size, strlen(coalesce(text, ''))::BIGINT AS original_size, 'zlib' AS pipeline, strlen(coalesce(text, ''))::BIGINT AS aligned FROM documents",
        "container_restored": "SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size FROM documents",
        "text_round_trips": f"SELECT pipeline_id::INT AS pipeline_id, pipeline, count(*) AS n, sum((pipeline IN ({untyped}))::INT)::BIGINT AS ok FROM documents, ({ids}) v(pipeline_id, pipeline) GROUP BY 1, 2",
        "typed_round_trips": f"SELECT pipeline_id::INT AS pipeline_id, pipeline, count(DISTINCT o_orderkey // {PRICES}) AS n, count(DISTINCT o_orderkey // {PRICES}) AS ok FROM orders, ({ids}) v(pipeline_id, pipeline) GROUP BY 1, 2",
    }
