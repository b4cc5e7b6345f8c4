"""Stages of the corpus pipeline on rows with null and repeated doc_id."""

import random
from collections import Counter

import pytest

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghilmnorst") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Distinct texts by (doc_id, number): three rows without an id, three that share id 7, one of its own."""
    return [(i, prose(60 + k, k)) for k, i in enumerate([None, None, None, 7, 7, 7, 3])]


def table(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in rows], SCHEMA)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_language_id_keeps_every_row(spark, texts):
    assert pairs(p.identify(spark, table(spark, [*texts, (7, "12 !"), (None, "")]), "")) == Counter(texts)


def test_near_duplicates_decide_by_row(spark, texts):
    more = [*texts, texts[0], (9, texts[3][1]), (1, texts[6][1]), (None, texts[4][1])]
    assert pairs(p.near_duplicates(spark, table(spark, more), "")) == Counter([*texts[:6], (1, texts[6][1])])


def test_secrets_keep_every_row(spark, texts):
    assert pairs(p.hide_secrets(spark, p.identify(spark, table(spark, texts), ""), "")) == Counter(texts)


def test_mix_takes_each_row_by_itself(spark, texts):
    """Alone, a source is taken one and a half times; no row more than twice."""
    got = pairs(p.mix_sources(spark, table(spark, texts), ""))
    words = sum(len(t.split()) * n for (_, t), n in got.items())
    assert set(texts) <= set(got) and max(got.values()) <= 2 and abs(words - 1.5 * sum(len(t.split()) for _, t in texts)) <= 40


def test_all_stages_in_turn(spark, texts, tmp_path):
    docs = table(spark, [*texts, texts[1]])
    for name, stage in p.STAGES[:3]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert pairs(docs) == Counter(texts)
    assert set(pairs(p.mix_sources(spark, docs, ""))) >= set(texts)


def test_mix_gives_whole_texts(spark, texts):
    """The border row of each source is whole or left, whichever is nearer to the target."""
    rows = [(i, t.replace(" ", "\n  ", 20)) for i, (_, t) in enumerate(texts * 3)]
    docs = table(spark, rows, "a").union(table(spark, [(100 + i, t) for i, t in rows[:5]], "b")).union(table(spark, [(200, rows[0][1])], "c"))
    want = Counter()
    for r in p.mixing.mix(docs).collect():
        want[r.doc_id] = r.reps + (0 < r.size <= 2 * r.part)
    plan = [r for r in p.mixing.mix(docs).collect() if 0 < r.part < r.size]
    assert plan
    known = dict(rows) | {100 + i: t for i, t in rows[:5]} | {200: rows[0][1]}
    got = pairs(p.mix_sources(spark, docs, ""))
    assert all(known[i] == t for i, t in got) and {i: n for (i, _), n in got.items()} == {i: n for i, n in want.items() if n}
