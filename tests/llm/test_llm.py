import hashlib
import random
import re
import struct
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import gif, html, language, licenses, minhash, mixing, packing, secrets, suffix, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0, "x") for i, t in enumerate(texts)], SCHEMA)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(n))


def _plain_repeats(rows):
    """(doc_id, bytes, removed, spans, digest) by looking at every 100-byte string in order of occurrence; a row's place among those of its doc_id is that of the digest of its text."""
    seen, want = set(), []
    distinct = {}
    for i, t, sub in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        data = (t or "").encode()
        if (i, t) not in distinct:
            gone = np.zeros(len(data) + 1, bool)
            for k in range(len(data) - 99):
                piece = data[k : k + 100]
                if piece in seen:
                    gone[k : k + 100] = True
                seen.add(piece)
            left = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
            spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
            distinct[i, t] = (i, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
        want.append(distinct[i, t])
    return Counter(want)


@pytest.mark.parametrize("part", [1, 4096])
def test_repeats_against_brute_force(spark, monkeypatch, part):
    """Boundaries, overlaps, periods, near copies, block borders, repeated and null ids."""
    monkeypatch.setattr(suffix, "PART", part)
    monkeypatch.setattr(suffix, "BLOCK", 700)
    shared, r = prose(60, 1), random.Random(6)
    texts = [None, "", "é" * 400, prose(300, 2), prose(40, 3) + shared + prose(50, 4), shared, shared, prose(9, 5) + shared + "ab" * 300, "é" * 400, "x" * 99, "x" * 100, "x" * 101]
    for k in range(60):
        words = shared.split()
        words[r.randint(0, 59)] = "w%d" % k
        texts.append(prose(r.randint(0, 40), 50 + k) + " ".join(words[: r.randint(20, 60)]) + prose(r.randint(0, 40), 200 + k))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q" * 7), (None, texts[30]), (None, shared), (None, shared), (3, texts[40]), (3, texts[41]), (3, texts[3]), (70, texts[3])]
    d = spark.createDataFrame([(i, t, "s", "S") for i, t in rows], "doc_id long, text string, note string, NOTE string")
    subs = [x.s for x in d.select(F.xxhash64("text").alias("s")).collect()]
    got = suffix.dedup(d).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == _plain_repeats([(i, t, x) for (i, t), x in zip(rows, subs)])


def test_repeats_of_an_empty_table(spark):
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates(spark):
    base = prose(200, 7)
    got = {r.doc_id: r for r in minhash.near(frame(spark, [base, base, base + " end", prose(200, 8), None, ""]), 3, 85).collect()}
    assert [got[i].component_id for i in range(6)] == [0, 0, 0, 3, 4, 5]
    assert got[4].n_shingles == 0 and got[4].kept


def test_near_duplicates_around_the_threshold(spark):
    r = random.Random(9)
    bases = [prose(n, n).split() for n in (4, 30, 90, 91)]
    texts = [" ".join(r.choice(["x%d" % r.randint(0, 999), w]) if r.random() < p else w for w in base) for base in bases for p in (0.02, 0.05, 0.08, 0.12) for _ in range(25)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if k == b else k for k in want]
    got = sorted(minhash.near(frame(spark, texts), 3, 85).collect(), key=lambda r: r.doc_id)
    assert [r.component_id for r in got] == want and [r.n_shingles for r in got] == [len(s) for s in sets]


@pytest.mark.parametrize("block", [1, 400])
def test_exact_search_of_unclear_classes(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(3)
    sets = [sorted({r.choice([r.randint(0, 10**6), b]) if r.random() < p else b for b in range(k, k + 60)}) for k in (0, 40) for p in (0.05, 0.15, 0.3) for _ in range(12)]
    d = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "id long, k long, set array<long>")
    got = {frozenset(x) for x in minhash._meet(d, 85).collect()}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 85 * len({*sets[i]} | {*sets[j]})}

    assert want and want <= got and len(got) < len(sets) ** 2 / 8


@pytest.mark.parametrize("text", ["", "password = 'abcdef'", "token=abc", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xé" + "0a" * 12 + "Z", "secret: 12 api_key==abcdefg", "PassWord=password=longer1"])
def test_base_rules_against_regular_expressions(text):
    rules = {"assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    want = []
    for name, rule in rules.items():
        for m in re.finditer(rule, text):
            if len(m[2]) >= 6 if name == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[name]:
                want.append((m.start(), name, m.end()))
    order = list(rules)
    want.sort(key=lambda x: (x[0], order.index(x[1])))
    assert [x for x in secrets.scanner().spans(text) if x[1] in rules] == want


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 40000, bytes(range(256)) * 400, random.Random(1).randbytes(70000)])
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_gif_payload_is_read_back():
    for text in (None, "", "é" * 999, "x" * 576 * 200):
        n, size, digest, *_ = gif.measure(text)
        data = gif.payload(text)[1]
        assert (size, digest) == (len(data), hashlib.sha256(data).hexdigest()) and size % 576 == 0


def test_best_fit_plan_is_gapless():
    r = random.Random(2)
    counts = {r.randint(1, 2048): r.randint(1, 50) for _ in range(300)}
    places, ranks = {}, {}
    for size, rank, n, seq, offset in packing.plan(counts):
        for i in range(n):
            places.setdefault(seq + i, []).append((offset, size))
            ranks.setdefault(size, set()).add(rank + i)
    assert all(ranks[k] == set(range(c)) for k, c in counts.items())
    for p in places.values():
        at = 0
        for offset, size in sorted(p):
            assert offset == at
            at += size
        assert at <= 2048
    total = sum(k * c for k, c in counts.items())
    assert len(places) <= 1.05 * -(-total // 2048) + 1


def test_mixing_meets_targets(spark):
    d = frame(spark, ["a b c"] * 50).union(frame(spark, ["d e"] * 5 + [None], None))
    rows = mixing.mix(d).collect()
    for s in ("s", None):
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and all(r.taken <= 2 * r.size for r in mine)


def test_vectors_links(spark):
    x = np.random.default_rng(1).standard_normal((40, 16))
    x[1], x[2] = x[0] * 2, x[0] + 0.01
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(40, None), (41, []), (42, [0.0] * 16), (43, [float("nan")] * 16)]
    got = {r.vec_id: r for r in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 44 and [got[i].component_id for i in range(3)] == [0, 0, 0] and [got[i].n_links for i in range(3)] == [2, 2, 2]
    assert all(got[i].n_links == 0 and got[i].kept for i in range(40, 44))


def test_language(spark):
    d = spark.createDataFrame([(i, t, l, "s", 0, "") for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et les chiens", "fr")] * 9 + [(None, "en"), ("12 !", "fr")])], SCHEMA)
    model = language.learn(d)
    got = [r.lang_pred for r in sorted(language.identify(d, model).collect(), key=lambda r: r.doc_id)]
    assert got == ["en", "fr"] * 9 + ["und", "und"]


def test_html():
    chain = html.model()
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>On a&amp;b</h1><p>Some  text, long enough to read.</article><footer>&copy; all rights reserved</footer>"
    assert html.main_text(page, chain) == "On a&b\n\nSome text, long enough to read."
    assert html.main_text(None, chain) == ""


def test_licenses(spark):
    texts = ["Copyright (c) 2020 X\n" + licenses.KNOWN[0][1].upper(), "RELEASED under the MIT licence", "other", None]
    assert [r.license_id for r in sorted(licenses.scan(frame(spark, texts)).collect(), key=lambda r: r.doc_id)] == ["MIT", "notice-MIT", None, None]


def test_licenses_as_usually_wrapped(spark):
    known = dict(licenses.KNOWN)
    wrap = lambda name, width: textwrap.fill(known[name], width)
    isc = "ISC License\n\nCopyright (c) 2004-2010 by Internet Systems Consortium, Inc. (\"ISC\")\n\n" + wrap("ISC", 70).replace(" copyright notice", "\ncopyright notice")
    assert "\ncopyright notice" in isc
    mit = "The MIT License (MIT)\n\nCopyright © 2020 X\nCopyright 2019 Y <y@z.org>\n" + wrap("MIT", 78)
    marked = lambda mark: "".join(f"{mark} {line}\n" for line in mit.split("\n"))
    texts = [
        isc, mit, marked("#"), marked("//"), "/*\n" + marked(" *") + " */\n", mit.replace("\n", "\r\n"),
        "MIT License\n\nCopyright (c) [year] [fullname]\nAll rights reserved.\n\n" + wrap("MIT", 60), "BSD Zero Clause License\n\n(C) 2021 Z\n\n" + wrap("0BSD", 72), "# zlib License\n\n(C) Copyright 1995 A\n  B\n",
        *(wrap(name, width) for name in known for width in (40, 55, 72, 79)),
    ]
    got = [r.license_id for r in sorted(licenses.scan(frame(spark, texts)).collect(), key=lambda r: r.doc_id)]
    assert got == ["ISC", *["MIT"] * 6, "0BSD", None, *(name for name in known for _ in range(4))]


def test_normal_form_drops_no_line_of_the_body(spark):
    texts = ["a\nCopyright notice stays", "a\n(c) You must retain", "a\nAll rights reserved.\nb", "MIT License", "x\nMIT License\ny", "a\n# Copyright (c) 2020 X. All rights reserved.\nb", "a\nCopyright 2020 X\n\nAll rights reserved.\nb"]
    got = [r.c for r in spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").orderBy("doc_id").select(licenses.canonical(F.col("text")).alias("c")).collect()]
    assert got == ["a copyright notice stays", "a c you must retain", "a all rights reserved b", "mit license", "x mit license y", "a b", "a b"]


def test_whole_license_files_are_known(spark):
    files = {p.stem: p.read_text("utf-8") for p in licenses.TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(files)
    texts = [(n, t) for n, t in [*licenses.KNOWN, *files.items()]]
    texts += [("Apache-2.0", files["Apache-2.0"].split("   APPENDIX")[0].replace("\n", "\r\n")), ("GPL-3.0", files["GPL-3.0"].replace("https:", "http:")), ("Unlicense", "The Unlicense\n\n" + files["Unlicense"])]
    bsd = "BSD 2-Clause License\n\nCopyright 2020 X\nAll rights reserved.\n\n" + files["BSD-2-Clause"].split("reserved.")[1]
    texts += [("BSD-2-Clause", bsd), ("BSD-2-Clause", bsd.replace("1.", " * ").replace("2. R", " * R")), (None, files["GPL-3.0"][:9000]), (None, files["MPL-2.0"] + " and more")]
    rows = sorted(licenses.scan(frame(spark, [t for _, t in texts])).collect(), key=lambda r: r.doc_id)
    assert [r.license_id for r in rows] == [n for n, _ in texts]
    assert [r.digest for r in rows] == [hashlib.sha256(licenses.normal(t).encode()).hexdigest() for _, t in texts]


def test_vectors_lose_no_planted_link(spark):
    r = np.random.default_rng(7)
    x, w = vectors.normalised(r.standard_normal((2000, 64))), r.standard_normal((2000, 64))
    w = vectors.normalised(w - (w * x).sum(axis=1, keepdims=True) * x)
    c = np.concatenate([np.full(1000, 0.95 + 1e-8), r.uniform(0.95, 0.97, 1000)])[:, None]
    y = c * x + np.sqrt(1 - c * c) * w
    assert all((vectors.keys(x[i : i + 250]) == vectors.keys(y[i : i + 250])).any(axis=1).all() for i in range(0, 2000, 250))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x[:60], y[:60]]))]
    got = {g.vec_id: g for g in vectors.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links == 1 and got[i].component_id == i % 60 for i in range(120))


def _brute_links(rows, least=0.95):
    good = [(k, np.asarray(v, np.float64)) for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v) and rows[k][0] is not None]
    n, comp = [0] * len(rows), [r[0] for r in rows]
    near = [[] for _ in rows]
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n[i] += 1
                n[j] += 1
                near[i].append(j)
                near[j].append(i)
    todo = True
    while todo:
        todo = False
        for i, of in enumerate(near):
            low = min([comp[i], *(comp[j] for j in of)]) if of else comp[i]
            todo |= low != comp[i]
            comp[i] = low
    return Counter((r[0], a, b) for r, a, b in zip(rows, n, comp))


@pytest.mark.parametrize("block", [7, 1024])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    """A hot bucket over several blocks, chains, copies, two lengths, repeated and null ids, broken vectors."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(5)
    centre = r.standard_normal((6, 24))
    x = [centre[k % 6] + r.normal(0, s, 24) for s in (0.02, 0.15, 0.25) for k in range(60)]
    x += [centre[0]] * 5 + list(r.standard_normal((50, 24))) + list(r.standard_normal((5, 8))) + [np.ones(8) + r.normal(0, 0.05, 8) for _ in range(5)]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(r.permutation(len(x)), x)]
    rows += [(3, rows[0][1]), (3, rows[40][1]), (None, rows[1][1]), (900, None), (901, []), (902, [0.0] * 24), (903, [None] * 24), (904, [float("inf")] * 24)]
    d = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<double>, label string, LABEL string")
    got = vectors.near(d).collect()
    want = _brute_links(rows)
    assert Counter((g.vec_id, g.n_links, g.component_id) for g in got) == want and sum(n for _, n, _ in want) > 1000
    assert all(g.kept == (g.vec_id == g.component_id or g.vec_id is None) for g in got)


def test_vectors_of_an_empty_table(spark):
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def _plain_pieces(texts, length):
    """(number of the text, piece, start, length, crc) by the tokenizer alone."""
    coder, out = packing.coder(packing.default_path()).tokenizer, []
    for i, t in enumerate(texts):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % length or min(length, len(ids))
        ends = [first, *range(first + length, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_against_the_tokenizer(spark, length):
    r = random.Random(11)
    alphabet = [*map(chr, range(32, 0x250)), *" \n\t'  \x0b\x0c\x85\xa0　 ᲀ\U0001f600中"] + list("abcde 12") * 40
    texts = [None, "", " ", "a <|endoftext|> b", "x" * 5000, prose(3000, 12), "\x1c a\x1d"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(150)]
    texts += texts[:20]
    got = packing.pack(frame(spark, texts), length=length).collect()
    want = _plain_pieces(texts, length)
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == Counter(want)
    places = {}
    for g in got:
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for p in places.values():
        assert [a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= length
    total = sum(w[3] for w in want)
    assert len(places) <= 1.03 * -(-total // length) + 1


def test_packing_of_null_and_repeated_ids_and_an_empty_table(spark):
    rows = [(i, t, "en", "s", 0, "x") for i, t in [(None, "a b"), (None, "a b"), (7, "c"), (7, "d e f"), (7, "c")]]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(g.doc_id for g in got) == Counter([None, None, 7, 7, 7]) and len({(g.sequence_id, g.offset) for g in got}) == 5
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b = prose(80, 1), prose(80, 2)
    rows = [(5, a), (5, b), (5, a + " end"), (3, b), (None, a), (None, a), (9, a), (9, a), (1, "two words"), (2, "TWO\twords"), (4, "one"), (None, None), (6, " \n")]
    got = minhash.near(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, note string, NOTE string"), 3, 85).collect()
    want = [(5, 78, 5), (5, 78, 3), (5, 79, 5), (3, 78, 3), (None, 78, None), (None, 78, None), (9, 78, 5), (9, 78, 5), (1, 1, 1), (2, 1, 1), (4, 1, 4), (None, 0, None), (6, 0, 6)]
    assert Counter((g.doc_id, g.n_shingles, g.component_id) for g in got) == Counter(want)
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)
    assert minhash.near(spark.createDataFrame([], "doc_id long, text string"), 3, 85).count() == 0


@pytest.mark.parametrize("star", [8])
def test_near_duplicates_of_one_hot_centre(spark, monkeypatch, star):
    """A third of the rows are near copies of one text; each changes other words."""
    monkeypatch.setattr(minhash, "STAR", star)
    r = random.Random(4)
    base = prose(120, 3).split()
    texts = [" ".join("y%d" % r.randint(0, 9999) if k in at else w for k, w in enumerate(base)) for at in ({r.randint(0, 119) for _ in range(2)} for _ in range(120))]
    texts += [prose(60, 100 + i) for i in range(200)]
    got = minhash.near(frame(spark, texts), 3, 85).collect()
    assert {g.component_id for g in got if g.doc_id < 120} == {0} and all(g.kept for g in got if g.doc_id >= 120)


def test_secrets_against_regular_expressions_on_whole_texts(spark):
    r = random.Random(8)
    pieces = ["password", "passwd", "SECRET", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdef", "AKIA", "A1B2C3D4E5F6G7H8J9", "deadbeef" * 3, "0a", "é", "中", "\n", "xy", "ghp_" + "a" * 40]
    texts = [None, "", "token=password: " + "z" * 50000] + ["".join(r.choice(pieces) for _ in range(r.choice([5, 40, 400]))) for _ in range(120)]
    rules = {"assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    want = []
    for t in texts:
        spans = [(m.start(), k, m.end()) for k, (name, rule) in enumerate(rules.items()) for m in re.finditer(rule, t or "") if (len(m[2]) >= 6 if name == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[name])]
        code = ",".join(f"{list(rules)[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((*(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(code.encode()).hexdigest()))
    got = sorted(secrets.find(frame(spark, texts)).collect(), key=lambda g: g.doc_id)
    assert [(g.n_assign, g.n_access, g.n_hex, g.base_sha256) for g in got] == want
    assert any("github:" in g.spans for g in got)
    assert secrets.find(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["token=password: " + "a" * 300000, "token=password: " * 20000, "password: é" * 30000, "eyJ" * 100000])
def test_secrets_take_time_in_proportion(text):
    start = time.process_time()
    secrets.scanner().spans(text)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("mark", ['<a "', '<a ">"', "<!", "<a '\">", "<", "<script", "<div>a", "</p>"])
def test_broken_pages_take_time_in_proportion(mark):
    start = time.process_time()
    html.main_text(mark * (300000 // len(mark)), html.model())
    assert time.process_time() - start < 20


def test_html_cases(spark):
    long = "Some text that is long enough to be read as prose, with an end."
    pages = [
        f"<form action=x><h1>A title</h1><p>{long}</p></form>",
        f"<head><title>t</title><h1>A title</h1><p>{long}</p>",
        f"<body><article><h1>A title</h1><p>Some text that is long <button>Buy</button>enough to be read as prose, with an end.</p></article></body>",
        f"<body><article><h1>A title</h1><p>{long}</p><form><label>Name</label><p>x</p></form></article>",
        None, "", "<p", "<html></html>",
    ]
    rows = [(i, "u", p, "x", "y") for i, p in enumerate(pages)] + [(None, None, pages[0], "x", "y")]
    got = sorted(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, note string, NOTE string")).collect(), key=lambda g: (g.page_id is None, g.page_id))
    assert [g.text for g in got] == [f"A title\n\n{long}"] * 4 + [""] * 2 + [got[6].text, ""] + [f"A title\n\n{long}"]
    assert all(g.n_chars == len(g.text) for g in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_of_labelled_pages_held_out():
    """Pages of another seed than the model's."""
    chain = html.model()
    made = html.labelled_pages(80, 77)
    right = sum(html.main_text(p, chain) == "\n\n".join(main) for p, main in made)
    assert right >= 72


def _gif(frames, size=(4, 4), palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9)), interlaced=False, local=None):
    """A GIF of frames (place, samples, disposal, transparent, delay), written by the format's description."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x91, 0, 0), bytes(c for p in palette for c in p)]
    for (left, top, w, h), samples, disposal, clear, delay in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0")
        if interlaced:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            samples = [v for y in order for v in samples[y * w : y * w + w]]
        flags = (0x40 if interlaced else 0) | (0x81 if local else 0)
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (bytes(c for p in local for c in p) if local else b"") + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2)))
    return b"".join(out) + b"\x3b"


def test_gif_playback_and_frame_rows(spark):
    whole, spot = (0, 0, 4, 4), (1, 1, 2, 2)
    data = _gif([(whole, [0] * 16, 1, None, 5), (spot, [1, 2, 1, 2], 2, 2, 7), (spot, [1] * 4, 3, None, 1), (spot, [3] * 4, 1, None, 2)])
    shown = [(start, delay, canvas.copy()) for start, delay, _, canvas in gif.decode(data)]
    assert [x[:2] for x in shown] == [(0, 5), (5, 7), (12, 1), (13, 2)]
    assert (shown[0][2] == [255, 0, 0, 255]).all()
    assert shown[1][2][1, 1].tolist() == [0, 255, 0, 255] and shown[1][2][1, 2].tolist() == [255, 0, 0, 255]  # transparent: what was there
    assert shown[2][2][1, 2].tolist() == [0, 255, 0, 255] and shown[2][2][0, 0].tolist() == [255, 0, 0, 255]
    assert shown[3][2][1, 1].tolist() == [9, 9, 9, 255]
    cleared = _gif([(whole, [0] * 16, 1, None, 5), (spot, [1] * 4, 2, None, 7), ((0, 0, 1, 1), [2], 3, None, 1), ((3, 3, 1, 1), [2], 1, None, 1)])
    last = [c.copy() for *_, c in gif.decode(cleared)]
    assert last[2][1, 1].tolist() == [0, 0, 0, 0] and last[3][0, 0].tolist() == [255, 0, 0, 255] and last[3][3, 3].tolist() == [0, 0, 255, 255]
    rows_ = [y % 4 for y in range(16) for _ in range(4)]
    assert next(gif.frames(_gif([((0, 0, 4, 16), rows_, 1, None, 1)], (4, 16), interlaced=True)))["index"].ravel().tolist() == rows_
    assert next(gif.decode(_gif([(whole, [1] * 16, 1, None, 1)], local=((1, 2, 3), (4, 5, 6), (0, 0, 0), (0, 0, 0)))))[3][0, 0].tolist() == [4, 5, 6, 255]
    table = gif.timed_frames(spark.createDataFrame([(1, data), (None, None)], "doc_id long, gif binary")).orderBy("frame").collect()
    assert [(g.doc_id, g.frame, g.start, g.delay) for g in table] == [(1, 0, 0, 5), (1, 1, 5, 7), (1, 2, 12, 1), (1, 3, 13, 2)]
    assert table[0].histogram[15] == 16 and table[0].histogram[16] == 16 and sum(table[0].histogram) == 48
    for bad in (b"", b"GIF89a", data[:60], data.replace(b"\x2c", b"\x2e", 1)):
        with pytest.raises((ValueError, struct.error, IndexError)):
            list(gif.decode(bad))


def test_gif_query_against_recomputed_values(spark):
    texts = [None, "", "é" * 999, "x" * 576 * 70, prose(500, 3), prose(500, 3)]
    got = sorted(gif.store_all(frame(spark, texts)).collect(), key=lambda g: g.doc_id)
    stored = {g.doc_id: g.gif for g in gif.media(frame(spark, texts)).collect()}
    for g, t in zip(got, texts):
        raw = (t or "").encode()
        data = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (g.media_bytes, g.media_sha256) == (len(stored[g.doc_id]), hashlib.sha256(stored[g.doc_id]).hexdigest())
    assert got[4][1:] == got[5][1:] and gif.store_all(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_against_a_plain_version(spark):
    """Held-out rows, null ids, no label, ties, a text of several pieces, an empty table."""
    r = random.Random(3)
    words = {"en": "the of and to in is that it was for".split(), "fr": "le la les et un une que dans est pour".split(), "de": "der die und das ist nicht ein zu den mit".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 60))), lang) for i, lang in enumerate(list(words) * 25)]
    rows += [(None, "le chat", None), (900, "the dog, 7 " * 30000, None), (901, None, "en"), (902, " 12 !", "fr"), (903, "", "de"), (904, "the", "en"), (904, "the", "en")]
    d = spark.createDataFrame([(i, t, g, "s", 0, "") for i, t, g in rows], SCHEMA)

    def grams(text):
        out = Counter()
        letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        for n in (1, 2, 3):
            for k in range(len(letters) - n + 1):
                g = letters[k : k + n]
                if g.strip() and not (n == 3 and g[1] == " ") and not (n == 2 and g == "  "):
                    out[g] += 1
        return out

    rank = lambda c: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], sum(ord(a) << 21 * (len(x[0]) - 1 - j) for j, a in enumerate(x[0]))))[: language.TOP])}
    learnt = {}
    for i, t, g in {(i, t, g) for i, t, g in rows if t is not None and g and zlib.crc32(str(i).encode()) % 5}:
        learnt.setdefault(g, Counter()).update(grams(t))
    profiles = {g: rank(c) for g, c in sorted(learnt.items())}
    want = []
    for i, t, _ in rows:
        mine = rank(grams(t or ""))
        if not any(len(g) == 1 for g in mine):
            want.append((i, "und"))
            continue
        far = {g: sum(abs(p[x] - k) if x in p else language.TOP for x, k in mine.items()) for g, p in profiles.items()}
        want.append((i, min(far, key=far.get)))
    got = language.held_out(d).collect()
    assert Counter((g.doc_id, g.lang_pred) for g in got) == Counter(want) and all(0 <= g.score <= 1 for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id if g.doc_id is not None else "").encode()) % 5 == 0) for g in got)
    assert {g.lang_pred for g in language.held_out(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.held_out(d.limit(0)).count() == 0
