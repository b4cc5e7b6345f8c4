"""Language identification by rank-order profiles: the out-of-place distance between a text's most frequent n-grams and each language's.

n-grams are runs of one to three letters of a lower-cased text, a space standing for whatever is between words. Profiles are learnt from at most `sample` labelled rows, those with the
least digest of their id (a documented bound; all texts in it are counted whole); prediction counts the whole of every text.

Cases: null text, empty text or text without a letter is `und` with score 0, as is every text when nothing could be learnt; of equal distances the language first by
code point wins; equal texts get equal results; an empty table gives no rows. A null doc_id counts as an empty id; rows equal in id, label and text are learnt from once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_batch, map_text, pick

TOP = 400
SAMPLE = 4000
PIECE = 1 << 17


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and how often each occurs, counted piece by piece with the last two letters carried on."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.array([32], np.int64)
    pending = 0
    for at in range(0, len(text), PIECE):
        raw = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(_letters()[raw], raw, 32)
        codes = np.concatenate([before, codes] if at + PIECE < len(text) else [before, codes, [32]])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        x, y, z = codes[:-2], codes[1:-1], codes[2:]
        one = codes[pending:]
        two = (codes[:-1] << 21 | codes[1:])[max(pending - 1, 0) :]
        grams = np.concatenate([one[one != 32], two, (x << 42 | y << 21 | z)[y != 32]])
        k, n = np.unique(grams, return_counts=True)
        keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([sums, n]), len(keys)).astype(np.int64)
        before = codes[-2:]
        pending = len(before)
    return keys, sums


def ranked(keys: np.ndarray, sums: np.ndarray, top: int = TOP) -> np.ndarray:
    return keys[np.lexsort((keys, -sums))[:top]]


def learn(labelled: DataFrame, sample: int = SAMPLE, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles from (doc_id, text, lang). What is collected is the top n-grams of the few languages of a bounded sample."""
    names = ["order", "lang", "digest"]
    rows = pick(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null")
    rows = rows.select("text", "lang", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"), F.xxhash64("text").alias("digest"))
    # Digests alone are ranked, at most `sample` rows of some 100 bytes; texts follow by a join with them.
    chosen = rows.select(*names).orderBy(*names).limit(sample).distinct()
    rows = rows.join(F.broadcast(chosen), names, "left_semi").dropDuplicates(names)

    def grams(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text, lang in zip(batch.column(1), batch.column(2).to_pylist()):
            k, n = counts(text.as_py())
            yield as_batch([[lang] * len(k), k, n], pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    sums = map_text(rows.select("order", "text", "lang"), "text", grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best: dict[str, list[int]] = {}
    for r in sums.withColumn("place", place).where(F.col("place") <= top).orderBy("lang", "place").collect():
        best.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(grams, np.int64) for lang, grams in best.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP) -> None:
        self.names, self.top = sorted(profiles), top
        self.grams = [np.sort(profiles[n]) for n in self.names]
        self.ranks = [np.argsort(profiles[n], kind="stable") for n in self.names]

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*counts(text), self.top) if text else np.zeros(0, np.int64)
        if not self.names or not (mine >> 21 == 0).any():
            return "und", 0.0
        place = np.arange(len(mine))
        best, found = None, ""
        for name, grams, ranks in zip(self.names, self.grams, self.ranks):
            at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
            d = int(np.where(grams[at] == mine, np.abs(ranks[at] - place), self.top).sum())
            if best is None or d < best:
                best, found = d, name
        return found, 1.0 - best / (self.top * len(mine))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text) to doc_id, lang_pred, score, and the columns to keep, row by row."""
    model = Profiles(profiles, top)
    d = pick(docs, "doc_id", "text", *(n for n in keep if n != "text"))
    at = [d.columns.index(n) for n in keep]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [model.predict(t.as_py()) for t in batch.column(1)]
        kept = [(n, batch.schema.field(i).type) for n, i in zip(keep, at)]
        schema = pa.schema([("doc_id", batch.schema.field(0).type), ("lang_pred", pa.string()), ("score", pa.float64()), *kept])
        yield as_batch([batch.column(0), [f[0] for f in found], [f[1] for f in found], *(batch.column(i) for i in at)], schema)

    kinds = [f"{n} {d.schema[n].dataType.simpleString()}" for n in keep]
    return map_text(d, "text", run, ", ".join([f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", *kinds]))


def remainder(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def held_out(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose id's remainder is not 0 and predicts all: doc_id, held_out, lang_pred, score."""
    d = pick(docs, "doc_id", "text", "lang")
    return identify(d, learn(d.where(remainder(d) != 0))).withColumn("held_out", remainder(d) == 0).select("doc_id", "held_out", "lang_pred", "score")
