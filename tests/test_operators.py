import bz2
import gzip
import io
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import bytes as b
from tessera.operators import catalog, coding, container, features, filters, learning, registry, sampling, sweep
from tessera.operators.batches import spread
from tessera.operators.filters import ALL, UNTYPED, Context, Layout, cells, front_coding, hybrid, lorenzo, packbits
from tessera.sources import scan, split

RAW = [b"", b"a", b"aaabbb", bytes(range(256)) * 3 + b"xy", b"\0" * 1000, b"one\none two\n\r\none twofold", bytes(range(250, 256)) * 30]
LAYOUTS = [Layout(), Layout("uint8"), Layout("int16"), Layout("uint16", (6, 10)), Layout("int32", (3, 5, 4)), Layout("uint64", (30,)), Layout("float32", (12, 5)), Layout("float64", (60,)), Layout("int8", (2, 3, 2, 5))]


@pytest.mark.parametrize("name", ALL)
@pytest.mark.parametrize("lay", LAYOUTS)
def test_filters_are_reversible_or_say_why_not(name, lay):
    r = np.random.default_rng(1)
    typed = [r.integers(0, 256, 60 * lay.size, dtype=np.uint8).tobytes(), np.repeat(r.integers(0, 99, 12), 5).astype(f"<u{lay.size}").tobytes(), b"\xff" * 60 * lay.size]
    for raw in typed + RAW:
        forward, back = ALL[name]
        try:
            out, needed = forward(raw, lay)
        except ValueError as e:
            needs = {"zigzag_uleb128_varint": lay.size < 2 or "float" in lay.dtype, "bit_packing": lay.size < 2 or "float" in lay.dtype, "nbit": lay.size < 2 or "float" in lay.dtype}
            shaped = name in ("ndcell", "lorenzo_residual") and (not lay.shaped(raw) or len(lay.shape) > 3)
            assert str(e) and (needs.get(name) or shaped or len(raw) % lay.size or (lay.size < 2 and name not in UNTYPED))
        else:
            assert back(out, lay, json.loads(json.dumps(needed))) == raw


def test_formats_are_as_defined():
    assert coding.uleb([0, 127, 128, 300, 2**64 - 1]) == b"\0\x7f\x80\x01\xac\x02" + b"\xff" * 9 + b"\x01"
    assert coding.zigzag([0, -1, 1, -(2**63)]).tolist() == [0, 1, 2, 2**64 - 1] and coding.pack([1, 2, 3], 2) == bytes([0b111001])
    assert packbits(b"aaab") == b"\xfea\0b" and front_coding(b"ab\nabc\n") == b"\x02\x00\x03ab\n\x02\x02c\n"
    v = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64) >> np.arange(500, dtype=np.uint64) % np.uint64(63)
    assert (coding.unuleb(coding.uleb(v))[0] == v).all() and (coding.unpack(coding.pack(v, 63), 500, 63) == v).all()
    with pytest.raises(ValueError):
        coding.unuleb(b"\x80")
    two = np.array([0, 0], "<u2").tobytes()
    assert ALL["bit_packing"][0](two, Layout("uint16"))[0] == b"\x02\x01\0"
    assert ALL["dictionary_categorize"][0](b"aa", Layout())[0] == b"\x01\x02\x01\x01a\0"
    assert ALL["delta_length_byte_array"][0](b"ab\nc\nd", Layout())[0] == b"\x03\x03\x06\x01\x01ab\nc\nd"
    assert ALL["delta_length_byte_array"][0](b"abc", Layout("uint16"))[0] == b"\x02\x02\x04\x01abc"
    assert hybrid(np.array([5, 5, 5, 5, 1, 2])) == (b"\x01\x04\x05\0\x02" + coding.pack([1, 2], 3), 3)
    assert [len(hybrid(np.arange(n) % 2)[0]) for n in (128, 129)] == [3 + 16, 3 + 16 + 2 + 1]
    assert np.frombuffer(lorenzo(np.array([[1, 2], [3, 7]], "<u2").tobytes(), 2, (2, 2)), "<u2").tolist() == [1, 1, 2, 3]
    assert cells((2, 5)).tolist() == [0, 1, 2, 3, 5, 6, 7, 8, 4, 9]
    # After four sevens the hash of the last ones has been seen: 7, 7<<5^7, ... differ until the oldest has moved out of sixteen bits.
    found = np.frombuffer(ALL["fcm_residual"][0](np.full(9, 7, "<u2").tobytes(), Layout("uint16"))[0], "<u2").tolist()
    assert found[0] == 7 and found[-1] == 0
    c = Context(16, True)
    c.learn(10)
    assert (c.last, c.table[0], c.guess()) == (10, 10, 10 + c.table[c.at])


def test_whole_sweep_is_lossless_and_gives_reasons(spark):
    s = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(RAW)] + [(99, None)], "id long, raw binary")
    codecs = [*sweep.CODECS, "lzf"]
    rows = sweep.sweep(s, list(ALL), codecs).collect()
    assert len(rows) == (len(RAW) + 1) * len(ALL) * len(codecs)
    for r in rows:
        filter_ = r.pipeline.split("->")[0] if "->" in r.pipeline else "identity"
        assert r.ok == (filter_ in UNTYPED and not r.pipeline.endswith("lzf")) and (r.reason is None) == r.ok
    with pytest.raises(KeyError):
        sweep.sweep(s, ["rle"], ["nonesuch"])


def test_typed_sweep(spark):
    raw = np.arange(300, dtype="<i4").tobytes()
    s = spark.createDataFrame([(1, bytearray(raw + b"xyz"), "int32", [300]), (2, bytearray(raw), "float32", [300]), (3, bytearray(raw), "int32", [10, 30])], "id long, raw binary, dtype string, shape array<long>")
    rows = sweep.sweep(s, list(ALL), ["zlib"]).collect()
    assert {r.pipeline for r in rows if not r.ok and r.id == 2} == {f"{n}->zlib" for n in registry.INTEGER_FILTERS} and all(r.ok for r in rows if r.id != 2) and all(r.in_size == 1200 for r in rows)


def test_empty_slices_give_no_row(spark):
    s = spark.createDataFrame([(1, bytearray(b"aaab")), (2, bytearray(b"")), (3, None), (4, bytearray(b"x"))], "id long, raw binary")
    assert [tuple(r) for r in b.run_lengths(s).collect()] == [(1, 2, 3, 4), (4, 1, 1, 2)]
    assert [r.id for r in b.entropy(s).collect()] == [1, 4] and [r.id for r in b.adjacent(s).collect()] == [1]
    assert b.histogram(s, zeros=True).count() == 512


def test_shares_are_rounded_as_by_sql(spark):
    s = spark.createDataFrame([(1, bytearray(range(26))), (2, bytearray(b"@" * 473 + bytes(167)))], "id long, raw binary")
    assert [r.unique_byte_ratio for r in b.entropy(s).orderBy("id").collect()] == [0.101563, 0.007813]
    assert b.bit_density(s).where("id = 2").first().bit1 == 0.739063
    assert (b.rounded(0.0), b.rounded(-0.0000005), b.rounded(2.5e-7), b.rounded(7.9999999)) == (0.0, -0.000001, 0.0, 8.0)


def test_heavy_work_is_dealt_over_all_tasks(spark):
    s = spark.createDataFrame([(i, bytearray(b"ab" * i)) for i in range(64)], "id long, raw binary").coalesce(1)
    where = s.transform(spread).select("id", F.spark_partition_id().alias("at"))
    assert where.count() == 64 and where.agg(F.count_distinct("at")).first()[0] == 16
    assert sorted(r.id for r in container.unpack(container.pack(s, ("zlib",))).collect() if bytes(r.raw) == b"ab" * r.id) == [*range(64)]


def test_sweep_is_lossless_and_best_is_its_maximum(spark):
    s = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(RAW)], "id long, raw binary")
    rows = sweep.sweep(s).collect()
    assert all(r.ok for r in rows) and len(rows) == len(RAW) * len(UNTYPED) * len(sweep.DEFAULT)
    for r in sweep.best(sweep.sweep(s)).collect():
        assert r.best_ratio == max(x.ratio for x in rows if x.id == r.id)


def test_best_needs_one_round_trip_unless_it_fails(monkeypatch):
    trips = []
    wrong = {"xz_lzma2", "brotli"}

    def counted(name, unpack, lossy):
        return lambda x, n: trips.append(name) or (b"" if lossy and name in wrong else unpack(x, n))

    for lossy in (False, True):
        with monkeypatch.context() as patch:
            for name, (pack, unpack) in sweep.CODECS.items():
                patch.setitem(sweep.CODECS, name, (pack, counted(name, unpack, lossy)))
            for raw in RAW:
                trips.clear()
                found, sizes = sweep._tried(raw, Layout(), sweep.REFERENCE_FILTERS, sweep.REFERENCE_CODECS)
                assert len(trips) == 1 or lossy
                rows = list(sweep._rows(raw, Layout(), sweep.REFERENCE_FILTERS, sweep.REFERENCE_CODECS))
                ratio, at = max((r[4], -k) for k, r in enumerate(rows) if r[0])
                assert found == (-at, ratio) and all(rows[k][3] == n for k, n in sizes.items() if rows[k][0])


def test_filters_give_the_bytes_of_their_plain_forms():
    r = random.Random(3)
    runs = [b"".join(bytes([r.randrange(4)]) * r.choice((1, 2, 3, 127, 128, 129, 131, 257, 400)) for _ in range(r.randrange(30))) for _ in range(60)]
    for raw in [*RAW, *runs]:
        plain = coding.uleb1(len(raw)) + b"".join(bytes([1, 0]) if i and raw[i] == raw[i - 1] else bytes([0, 1, raw[i]]) for i in range(len(raw)))
        assert raw.count(b"\n") >= 2 or filters.front_coding(raw) == plain
        groups = [(k, len(list(g))) for k, g in itertools.groupby(raw)]
        assert filters.rle(raw) == b"".join(coding.uleb1(n) + bytes([k]) for k, n in groups)
        names = list(dict.fromkeys(raw))
        bits = max(1, (len(names) - 1).bit_length() if names else 0)
        text = "".join(f"{names.index(c):0{bits}b}"[::-1] for c in raw)
        packed = bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))
        assert filters.dictionary(raw) == b"".join(map(coding.uleb1, (1, len(raw), len(names), bits))) + bytes(names) + packed


def test_candidates_share_outputs_of_filters(monkeypatch):
    calls = []
    forward, back = ALL["delta"]
    monkeypatch.setitem(ALL, "delta", (lambda raw, lay: calls.append(1) or forward(raw, lay), back))
    made = container.ranking(b"one two three " * 9, Layout(), registry.DEPLOYABLE)
    assert len(calls) == 1 and all(container.from_file(container.to_file(a, 126)) == b"one two three " * 9 for *_, a in made if a)


def test_examples_are_features_beside_best_pipelines(spark):
    s = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate([*RAW, b"long and longer " * 9000])], "id long, raw binary")
    chosen, codecs = ("identity", "rle", "delta"), ("zlib", "zstd", "bzip2")
    got = {r.id: r for r in sweep.examples(s, chosen, codecs).collect()}
    best = {r.id: r.best_pipeline for r in sweep.best(sweep.sweep(s, chosen, codecs)).collect()}
    assert {i: r.best_pipeline for i, r in got.items()} == best
    assert {i: r.x for i, r in got.items()} == {r.id: r.features for r in features.extract(s).collect()}


def test_split_is_over_all_labelled_rows(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(20)] + [(99, None), (98, "")], "id long, label string")
    out = sampling.split(rows, "label").collect()
    assert sum(bool(r.test) for r in out) == 4 and {r.id for r in out if r.test is None} == {98, 99}
    assert [r.test for r in sampling.split(rows.limit(1)).collect()] == [False]


def test_best_pipeline_sweeps_all_pipelines(spark, tmp_path):
    listed = sweep.names(sweep.REFERENCE_FILTERS, sweep.REFERENCE_CODECS)
    assert len(set(listed)) == 420 and listed[0] == "zlib" and listed[20] == "shuffle->zlib" and set(ALL) == set(sweep.REFERENCE_FILTERS) and {*sweep.CODECS, *sweep.MISSING} == set(sweep.REFERENCE_CODECS)
    texts = ["", "abcd" * 2, "one two three " * 9, "aaaabbbb" * 40, "".join(chr(48 + i * i % 77) for i in range(401)), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sweep.sweep(b.slices(docs), sweep.REFERENCE_FILTERS, sweep.REFERENCE_CODECS).collect()
    assert len(rows) == 420 * len(texts) and all((r.reason is None) == r.ok for r in rows)
    got = {r.id: r for r in catalog.queries()["best_pipeline"](spark, str(tmp_path)).collect()}
    for i in range(len(texts)):
        want = max((r for r in rows if r.ok and r.id == i), key=lambda r: (r.ratio, -r.ordinal))
        assert (got[i].best_pipeline, got[i].best_ratio) == (want.pipeline, want.ratio)


def test_names_of_pipelines():
    assert registry.canonical(" Byte Stream-Split ") == "byte_stream_split" and registry.canonical("zigzag + uleb128 / varint") == "zigzag__uleb128__varint"
    assert registry.parse("Shuffle->ZSTD") == (("shuffle",), "zstd") and registry.parse("zlib") == ((), "zlib")
    for bad in ("", "->", "nonesuch->zlib", "shuffle->nonesuch"):
        with pytest.raises(ValueError):
            registry.parse(bad)


def test_pipelines_from_settings(spark):
    assert registry.from_settings(spark, {"PIPELINES": "a, b"}) == ["a", "b"] and len(registry.from_settings(spark, {"PIPELINE_PRESET": "curated_30"})) == 30
    with pytest.raises(ValueError):
        registry.preset(spark, "nonesuch")


@pytest.mark.parametrize("lay", [Layout(), Layout("float32", (256,)), Layout("float64", (16, 8)), Layout("int16", (8, 8, 8))])
def test_files_are_restored(lay):
    raw = np.linspace(0, 1, 256).astype("<f4").tobytes()
    done = 0
    for name, size, reason, made in container.ranking(raw + b"x" * (lay.size - 1), lay, list(registry.DEPLOYABLE)):
        assert (made is None) == (reason is not None)
        if made:
            done += 1
            file = container.to_file(made, len(raw) + lay.size - 1)
            assert len(file) == 64 + size and file[:8] == b"CPSS\x01\x01\x40\0" and container.from_file(file) == raw + b"x" * (lay.size - 1)
            head = container.read_header(file)
            assert registry.DEPLOYABLE[head["pipeline_id"] - 1] == name and head["tail_size"] == lay.size - 1
            for bad in (b"XPSS" + file[4:], file[:4] + b"\x02" + file[5:], file[:50], file[:-1]):
                with pytest.raises(ValueError):
                    container.from_file(bad)
    assert done == (21 if lay == Layout() else 27)
    with pytest.raises(ValueError):
        container.compress(raw, "shuffle->zstd")
    with pytest.raises(ValueError):
        container.decompress(b"", {}, b"", 99)


def test_files_of_slices(spark):
    s = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(RAW)], "id long, raw binary")
    packed = container.pack(s)
    assert {r.id: bytes(r.raw) for r in container.unpack(packed).collect()} == dict(enumerate(RAW))
    ranked = container.exhaustive(s).collect()
    first = {r.id: r.pipeline for r in ranked if r["rank"] == 1}
    assert {r.id: r.pipeline for r in packed.collect()} == first and all(r.available == (r.reason is None) for r in ranked)
    scores = spark.createDataFrame([(0, "zlib", 0.5, True), (0, "bzip2", 0.9, True), (0, "brotli", 1.0, False), (0, "zstd", 0.1, True)], "id long, pipeline string, score double, available boolean")
    sizes = spark.createDataFrame([(0, "zlib", 10), (0, "bzip2", 12), (0, "brotli", 1), (0, "zstd", 2)], "id long, pipeline string, stored_size long")
    assert [tuple(r) for r in container.hybrid(scores, sizes, 2).collect()] == [(0, "zlib", 10)]
    assert [tuple(r) for r in container.hybrid(scores, sizes, 0).collect()] == [(0, "bzip2", 12)]


def test_features_against_plain_formulas():
    r = np.random.default_rng(2)
    x = np.cumsum(r.standard_normal(500)).astype("<f4")
    raw = x.tobytes()
    got = dict(zip(features.NAMES, features.vector(raw, "float32", [20, 25], "filename_numbers")))
    u = np.frombuffer(raw, np.uint8)
    far = np.abs(np.diff(u.astype(int)))
    assert len(features.NAMES) == len(set(features.NAMES)) == len(got) == 322
    assert math.isclose(got["mean_byte"], u.mean() / 255) and math.isclose(got["std_byte"], u.std() / 128) and math.isclose(got["std_abs_delta"], far.std() / 128, rel_tol=1e-9)
    assert math.isclose(got["pilot_gzip_delta"], (len(raw) - 1) / len(gzip.compress(np.diff(u).tobytes(), 1, mtime=0))) and math.isclose(got["pilot_bz2_raw"], len(raw) / len(bz2.compress(raw, 1)))
    assert [got[f"bit_density_{k}"] for k in range(8)] == pytest.approx(np.unpackbits(u).reshape(-1, 8).mean(axis=0))
    wide = x.astype(float)
    assert got["typed_offset"] == 0 and got["typed_finite_ratio"] == 1 and math.isclose(got["typed_lag1"], np.corrcoef(wide[:-1], wide[1:])[0, 1], rel_tol=1e-6)
    assert math.isclose(got["typed_mean_abs_diff1"], np.abs(np.diff(wide)).mean() / wide.std(), rel_tol=1e-9) and math.isclose(got["meta_log_dim1"], math.log1p(25) / 20)
    assert (got["is_f32"], got["meta_is_f32"], got["meta_source_filename_numbers"], got["meta_source_unknown"]) == (1, 1, 1, 0)
    empty = dict(zip(features.NAMES, features.vector(b"")))
    assert empty["zero_frac"] == 1 and empty["pilot_gzip_raw"] == 0 and empty["meta_source_unknown"] == 1 and empty["same_adjacent_ratio"] == 1
    assert features.typed(raw[:200], "float32") == [0.0] * 18 and features.lag_corr(np.ones(9), 1) == 0
    assert b.window_starts(1 << 20) == [int(v) for v in np.linspace(0, (1 << 20) - (128 << 10), 5).astype(np.int64)] and len(b.sampled(b"x" * (9 << 20))) == 5 * (128 << 10)


def test_model_ranks_labels(spark, tmp_path):
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], float(i % 2)) for i in range(40)], "id long, x array<double>, y double")
    model = learning.train(rows, [2, 4, 2])
    model.write().overwrite().save(str(tmp_path / "m"))
    model = MultilayerPerceptronClassificationModel.load(str(tmp_path / "m"))
    got = learning.ranked(learning.scores_of(model, rows, ["even", "odd"])).where("rank = 1").collect()
    assert all(r.label == ("odd" if r.id % 2 else "even") for r in got) and len(got) == 40


FILES = {
    "bio/r.fq": b"".join(b"@r%d\nACGTACGT\n+\nIIIIIIII\n" % i for i in range(20)),
    "bio/g.fa": b">one x\n" + b"ACGTA\n" * 30 + b"\n>two\nGG\n",
    "bio/p.cif": b"data_P\n_a 1\n#\nloop_\n_t.x\n_t.y\n" + b"1 2\n" * 60 + b"#\nloop_\n_u.x\n1\n#\n_z 3\n#\n",
    "txt/a.txt": b"".join(b"line %d\r\n" % i for i in range(40)) + b"end",
    "grid/d_16_16.f32": np.arange(256, dtype="<f4").tobytes(),
    "grid/e.npy": b"",
    "grid/f_7.i64": np.arange(7, dtype="<i8").tobytes() + b"abc",
    "grid/long_101.f32": np.arange(101, dtype="<f4").tobytes(),
    "img/t.tif": b"II*\0",
    "x/unknown": b"?",
    "bio/cut.fastq": b"@r\nAC\n+\n",
}
out = io.BytesIO()
np.save(out, np.arange(200, dtype="<i4").reshape(20, 10))
FILES["grid/e.npy"] = out.getvalue()


def test_files_are_listed_and_split(spark, tmp_path):
    for name, raw in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    listing = scan.files(spark, str(tmp_path))
    assert {r.path: bytes(r.content) for r in listing.collect()} == FILES
    assert {r.path for r in scan.files(spark, str(tmp_path), ["bio/*.f*", "x/?nknown"]).select("path").collect()} == {"bio/r.fq", "bio/g.fa", "bio/cut.fastq", "x/unknown"}
    assert [r.path for r in scan.files(spark, str(tmp_path), most=2).select("path").orderBy("path").collect()] == sorted(FILES)[:2]
    pieces = split.split(listing, split.Size(60, 200))
    by = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.path, r.piece)):
        by.setdefault(r.path, []).append((r.method, bytes(r.payload), json.loads(r.detail)))
    assert set(by) == set(FILES) - {"x/unknown"}
    join = lambda p: b"".join(x[1] for x in by[p])
    assert join("txt/a.txt") == FILES["txt/a.txt"] and join("bio/r.fq") == FILES["bio/r.fq"] and by["bio/r.fq"][-1][2]["read_stop"] == 20
    assert all(len(x[1]) >= 130 for x in by["txt/a.txt"][:-1]) and by["bio/cut.fastq"][0][0] == "failed"
    fasta = by["bio/g.fa"]
    assert [x[2]["base_start"] for x in fasta] == [1, 131, 1] and fasta[0][1].startswith(b">one x | chunk=0 bases=1-130\nACGTA") and all(len(line) <= 80 for x in fasta for line in x[1].split(b"\n"))
    loops = [x for x in by["bio/p.cif"] if x[0] == "mmcif_loop_chunk"]
    assert sum(x[2]["row_count"] for x in loops) == 60 and all(x[2]["loop_name"] == "t_x" for x in loops) and by["bio/p.cif"][0][0] == "mmcif_section_chunk"
    grid = by["grid/d_16_16.f32"]
    values = np.concatenate([np.frombuffer(x[1], "<f4") for x in grid])
    assert sorted(values.tolist()) == list(range(256)) and grid[0][0] == "stride_2_sampling" and grid[0][2]["source_shape"] == [16, 16]
    first = np.frombuffer(grid[0][1], "<f4").reshape(grid[0][2]["sample_shape"])
    step = 2 ** grid[0][2]["sampling_rounds"]
    assert (first == np.arange(256).reshape(16, 16)[::step, ::step]).all()
    assert sum(np.load(io.BytesIO(x[1])).size for x in by["grid/e.npy"]) == 200
    assert by["grid/f_7.i64"][0][0] == "copy_small_file" and by["grid/f_7.i64"][0][2]["tail_dropped_bytes"] == 3
    assert [x[2].get("element_start") for x in by["grid/long_101.f32"]] == [0, 32, 64, 96]
    assert by["img/t.tif"] == [("copy_no_tifffile", b"II*\0", {})]
    done = sorted(split.finished(pieces).collect(), key=lambda r: r.id)
    assert [r.id for r in done] == list(range(1, len(done) + 1)) and done[0].slice_file == "bio/000001.fa"
    assert [r.slice_file for r in done if r.dataset == "grid"][:2] == ["grid/000001.f32", "grid/000002.f32"]
    assert split.split(listing, split.Size(60, 200, 1)).where("piece > 0").count() == 0
    (tmp_path / "data.json").write_text(json.dumps({"_meta": {"a": 1}, "1": {"slice_file": "x"}}))
    assert sorted(r.id for r in scan.read_records(spark, str(tmp_path / "data.json")).collect()) == ["1", "_meta"]


def test_numeric_layouts():
    lay = lambda *a: (lambda x: (x["dtype"], tuple(x["shape"]), x["shape_from"], x["used"]))(split.numeric_layout("n", *a))
    assert lay(800, None, [[10, 10]], []) == ("float64", (10, 10), "path_or_name", 800) and lay(400, None, [[10, 10]], [[100]]) == ("float32", (100,), "dataset_table", 400)
    assert lay(4 * 64, "float32", [], []) == ("float32", (4, 4, 4), "heuristic_3d", 256) and lay(4 * 101, "float32", [], [])[1:3] == ((101,), "1d_fallback")
    assert lay(4 * 34, "float32", [], [])[1:3] == ((2, 17), "heuristic_2d") and lay(9, "int32", [], []) == ("int32", (2,), "1d_fallback", 8)
    for bad in ((400, None, [], []), (3, "float32", [], [])):
        with pytest.raises(ValueError):
            split.numeric_layout("n", *bad)
    assert split.best_3d(27) == ((3, 3, 3), 1) and split.rounds(4096, 2, split.Size(10, 100)) == 3 and split.rounds(50, 2, split.Size(10, 100)) == 0


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first().c
    assert get(scalars.dimension_candidates(F.lit("a_1_2_3.x/4x5_6"))) == [[4, 5], [1, 2, 3], [1, 2], [1], [2], [3], [6]]
    assert get(scalars.parse_shape(F.lit("3, 4,"))) == [3, 4] and get(scalars.parse_shape(F.lit(" "))) is None
    assert get(scalars.restored_name(F.lit("a.cpss"))) == "a" and get(scalars.restored_name(F.lit("a"))) == "a.restored" and get(scalars.split_path(F.lit("/a\\b"))) == "a/b"
    assert get(scalars.safe_ratio(F.lit(4), F.lit(0))) == 4 and get(scalars.speed(F.lit(1 << 21), F.lit(2.0))) == 1 and get(scalars.product(F.array().cast("array<long>"))) == 1
    assert get(features.padded(F.array(F.lit(1.0)), 3)) == [1, 0, 0] and get(features.finite(F.lit(float("nan")))) == 0 and get(features.finite(F.lit(float("-inf")))) == -1e6
    assert get(registry.canonical_column(F.lit(" Rle / Bit-Pack"))) == registry.canonical(" Rle / Bit-Pack")
