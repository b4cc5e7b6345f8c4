"""Best-fit packing of tokenised documents into sequences, bulk-synchronous over length classes.

Documents are dealt into ranges by length and sequences by gap; as lengths are whole numbers up to the sequence length, a range is one length and one gap. A sweep takes the
classes from the longest down: the class looks up its successor among the gaps (the least one that holds it), is matched with as many gaps of that size as there are, by
rank, so that no two documents claim one gap; what is left sweeps on to the next gap and in the end opens new sequences; gaps are updated and the next class follows. A match is a row
(length, first rank, how many, first sequence, offset): the plan is over classes and is bounded by the square of the sequence length whatever the number of documents.
Ranks in a class are dealt over 1,024 salted ranges, whose counts are summed before.

Cases: null text is empty and has the one closing id; a longer document is cut into full pieces, its first piece being the shorter one; null doc_id, ties and repeated rows are
documents in their own right, told apart by a row key; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_batch, map_text, materialize, pick

LENGTH = 2048
TOKENIZER = "byte_bpe_50k.json"
SALTS = 1024
#: Fixed value: how a byte-level BPE of this kind splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a longer word are left to the tokenizer.
LONGEST = 1 << 12
_loaded: dict = {}


@lru_cache(maxsize=1)
def _unsettled() -> re.Pattern:
    """Characters that Unicode's versions class differently (letter, number, space or none), and all beyond the first plane: splitters may differ in them."""

    def kind(data, c: str) -> str:
        return k if (k := data.category(c)[0]) in "LNZ" else "-"

    odd = (c for c in map(chr, range(0x10000)) if kind(unicodedata, c) != kind(unicodedata.ucd_3_2_0, c) or unicodedata.category(c) == "Cn")
    return re.compile(f"[{''.join(map(re.escape, odd))}\U00010000-\U0010FFFF]")


class Coder:
    """Texts to their ids. Where the tokenizer is a plain byte-level BPE whose merges are in the order of their ids, the same vocabulary as ranks gives the same ids in a fifth of the time; any
    other tokenizer, and texts with unsettled characters, an added token's text or an overlong word, are coded by the tokenizer itself."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in kind["added_tokens"]]
        self.ranked = self._ranked(kind)

    @staticmethod
    def _ranked(kind: dict):
        import tiktoken

        pre, model = kind["pre_tokenizer"] or {}, kind["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or kind["normalizer"] or kind["post_processor"]:
            return None
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = model["vocab"]
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if len(vocab) != 256 + len(merged) or merged != list(range(256, len(vocab))) or not all(c in byte for w in vocab for c in w):
            return None
        ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if len(ranks) == len(vocab) else None

    def _plain(self, text: str) -> bool:
        return not (any(t in text for t in self.added) or _unsettled().search(text) or any(len(w) > LONGEST for w in (text.split() if len(text) > LONGEST else ())))

    def ids(self, text: str) -> np.ndarray:
        if self.ranked and self._plain(text):
            return np.array(self.ranked(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def coder(path: str) -> Coder:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = Coder(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    path = path or default_path()
    d = pick(docs, "doc_id", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coded, rows = coder(path).ids, []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = coded(text.as_py() or "").tobytes() + bytes(4)
            rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, length))]
        schema = pa.schema([("doc_id", batch.schema.field(0).type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        yield as_batch([*zip(*rows)] if rows else [[]] * 5, schema)

    return map_text(d, "text", run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long", 1 << 18)


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(length class, first rank, how many, first sequence, offset) of the matches; counts are documents by length."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    matches, opened = [], 0
    for size in sorted((k for k, c in counts.items() if c), reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(sizes, size)
            if at < len(sizes):
                gap = sizes[at]
                seq, n = heapq.heappop(gaps[gap])
                if n > left:
                    heapq.heappush(gaps[gap], (seq + left, n - left))
                    n = left
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, seq = length, opened
                n = -(-left // (length // size))
                opened += n
                if n > left:
                    n = left
            take = min(n, left)
            matches.append((size, rank, take, seq, length - gap))
            rank, left = rank + take, left - take
            rest = gap - size
            if rest:
                if rest not in gaps:
                    gaps[rest] = []
                    insort(sizes, rest)
                heapq.heappush(gaps[rest], (seq, take))
    return matches


def place(cut_up: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which must be stable when read twice."""
    rows = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    ranges = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # At most `length` rows, one for each length there can be.
    counts = {r["length"]: r["n"] for r in ranges.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    matches = np.array(plan(counts, length), np.int64).reshape(-1, 5)
    key = matches[:, 0] * (1 << 44) + matches[:, 1]
    order = np.argsort(key, kind="stable")
    key, matches = key[order], matches[order]
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = rows.withColumn("own", F.row_number().over(own) - 1).join(base, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
                m = matches[np.searchsorted(key, size * (1 << 44) + rank, "right") - 1]
                columns = [*(batch.column(i) for i in range(5)), pa.array(m[:, 3] + rank - m[:, 1]), pa.array(m[:, 4])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut_up.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialize(pieces(docs, path, length), "pieces"), length)
