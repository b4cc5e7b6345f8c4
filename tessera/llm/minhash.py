"""Near-duplicate documents: universal-hash minima, banding, signature verification, exact confirmation and connected components.

A text's set is its distinct word shingles. Texts of one set are one class (copies cost nothing further). A class has 128 minima of universal hashes (a*x + b mod 2^64) >> 32; 32 bands of
4 make buckets, which a pair at the threshold of 0.85 shares with a probability over 1 - 1e-10. In a bucket each class is first tried against one centre (another one for each
band); pairs whose signatures (the last byte of each minimum) agree by at least the threshold less five standard errors are confirmed on the full sets, the best one of each class first.
A centre's classes are dealt into parts that stream behind one copy of the centre. Links found are joined to components; what is in one component needs no more tries. Sets are never
stored for this: they are taken again from the texts of the pairs to confirm.

Classes of buckets whose components still differ go on to an exact search, so that no link is lost. Their shingles are ordered by how many of these classes have them; two sets at the
threshold share a shingle among the first few of both, so a class whose first ones are all its own has no link and drops out. Classes meet under such a shingle and a range of set
sizes; a meeting of one component is dropped, a large one is dealt over pairs of salted blocks. A block bounds the overlap of two sets in columns, by their first shingles alone, and
returns a pair only under the first shingle it shares, and only if the bound reaches the threshold; those are confirmed on the full sets. What stays quadratic is computing that bound
for unlinked classes that share a rare shingle.

Cases: null, empty or blank text has an empty set and is its own component; ties go to the smaller id; rows that repeat a doc_id are documents of their own that share a name: each is linked by
its own text and has the smallest doc_id that it reaches; a row without doc_id has a null component, is linked with nothing and kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_batch, discard, free_shuffles, grouped, map_text, materialize, pick, small_batches
from tessera.llm.graph import components

BANDS, ROWS = 32, 4
#: Shingles that a block's rows hold, about: bounds what one meeting holds in a task.
BLOCK = 1 << 17
#: Leaves that are tried against one copy of their hub, about.
STAR = 256
_rng = np.random.default_rng(4)
#: h(x) = (a*x + b mod 2^64) >> 32 with random 64-bit a, b is strongly universal on 32-bit x.
_A = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_B = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * _PLACE[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit values of the text's shingles. Bytes lower and split exactly A-Z and the six ASCII white spaces; words are hashed once each, shingles in columns."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _PLACE[0] + word[i : len(words) - n + 1 + i])
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    """Minima of 128 universal hashes, 32 bits each, block by block."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    x = values >> np.uint64(32)
    for at in range(0, len(x), 512):
        h = _A[:, None] * x[None, at : at + 512]
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signed(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Per row: number of shingles, digest of the set, the last byte of each minimum, and the bands' keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    rows = []
    for text in batch.column(1):
        s = shingles(text.as_py(), size)
        if not len(s):
            rows.append((0, None, None, None))
            continue
        sig = signature(s)
        bands = [int.from_bytes(hashlib.blake2b(bytes([i]) + sig[ROWS * i : ROWS * i + ROWS].tobytes(), digest_size=8).digest(), "little", signed=True) for i in range(BANDS)]
        rows.append((len(s), _digest(s), (sig & np.uint32(255)).astype(np.uint8).tobytes(), bands))
    yield as_batch([batch.column(0), *(zip(*rows) if rows else [[]] * 4)], schema)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _set_of(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """(id, k, digest, text) to (id, k, set); rows whose set has another digest are of other rows that repeat the id."""
    rows = []
    for id_, k, digest, text in zip(*batch.columns):
        s = shingles(text.as_py(), size)
        if _digest(s) == digest.as_py():
            rows.append((id_.as_py(), k.as_py(), s.view(np.int64)))
    yield as_batch([*zip(*rows)] if rows else [[]] * 3, pa.schema([("id", pa.int64()), ("k", pa.int64()), ("set", pa.list_(pa.int64()))]))


def _starred(rows: DataFrame, value, test, schema: str) -> DataFrame:
    """Rows (hub, part, leaf, id, ...) of groups (hub, part): first that of the hub, whose leaf is null, then its leaves. `value` reads a row; `test` compares the hub's with a leaf's and gives
    None or what is to be returned of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = []
            hubs, parts, leaves = (batch.column(i).to_pylist() for i in range(3))
            columns = batch.columns[3:]
            for i, (hub, part, leaf) in enumerate(zip(hubs, parts, leaves)):
                mine = value(*(c[i] for c in columns))
                if mine is None:
                    continue
                if leaf is None:
                    at, held = (hub, part), mine
                elif at == (hub, part) and (found := test(held, mine)) is not None:
                    out.append((hub, leaf, *found))
            names = [f.strip().split(" ") for f in schema.split(",")]
            kinds = pa.schema([(n, pa.int64() if k == "long" else pa.float64()) for n, k in names])
            yield as_batch([*zip(*out)] if out else [[]] * len(names), kinds)

    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("leaf").isNotNull()).mapInArrow(run, schema)


def _stars(pairs: DataFrame) -> DataFrame:
    """Pairs (hub, leaf) as rows (hub, part, leaf, id): a hub's leaves are dealt into parts of about STAR, and each part has one row of the hub's own."""
    count = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    hubs = count.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("leaf"), F.col("hub").alias("id"))
    leaves = pairs.join(count, "hub").select("hub", F.pmod(F.xxhash64("leaf"), "parts").cast("int").alias("part"), "leaf", F.col("leaf").alias("id"))
    return hubs.union(leaves)


def _possible(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of each group that may reach the threshold; rows are (key, range, a, b, id, component, set size, shingles of its own, is probe, first shared ones), groups are whole."""
    table = table.combine_chunks()
    key, *rest, ids, comps, sizes, alone, probe = (table.column(i).to_numpy() for i in range(9))
    firsts = table.column(9).combine_chunks()
    ends, values = firsts.offsets.to_numpy(), firsts.values.to_numpy(zero_copy_only=False)
    new = np.zeros(len(key), bool)
    for c in (key, *rest):
        new[1:] |= c[1:] != c[:-1]
    starts = np.concatenate([[0], np.flatnonzero(new), [len(key)]]) if len(key) else np.zeros(1, np.int64)
    out = []
    for lo, hi in zip(starts[:-1], starts[1:]):
        of, looks = lo + np.flatnonzero(~probe[lo:hi]), lo + np.flatnonzero(probe[lo:hi])
        if not len(of) or not len(looks):
            continue
        names, dense = np.unique(values[ends[lo] : ends[hi]], return_inverse=True)
        pieces = [dense[ends[i] - ends[lo] : ends[i + 1] - ends[lo]] for i in range(lo, hi)]
        held = np.concatenate([pieces[i - lo] for i in of])
        start = np.cumsum([0, *(len(pieces[i - lo]) for i in of)])[:-1]
        last = np.array([pieces[i - lo][-1] for i in of])
        sooner = held < np.searchsorted(names, key[lo])
        has = np.zeros(len(names), np.int32)
        for i in looks:
            mine = pieces[i - lo]
            has[mine] = 1
            common = has[held]
            has[mine] = 0
            both, known = np.add.reduceat(common, start), np.minimum(last, mine[-1])
            seen = alone[of] + np.add.reduceat((held <= mine[-1]).astype(np.int32), start)
            most = both + np.minimum(sizes[of] - seen, sizes[i] - alone[i] - np.searchsorted(mine, known, "right"))
            ok = ((100 + percent) * most >= percent * (sizes[i] + sizes[of])) & (comps[of] != comps[i]) & (np.add.reduceat(common * sooner, start) == 0)
            ok &= (sizes[of] < sizes[i]) | ((sizes[of] == sizes[i]) & (ids[of] < ids[i]))
            out += [(ids[i], j) for j in ids[of[ok]]]
    yield as_batch([*zip(*out)] if out else [[], []], pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def _meet(unclear: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components of (id, k, set) that may be links, with all that are; see above. k is the component. With sizes |y| <= |x|, x looks under its first
    |x| - percent*|x| + 1 shingles and y waits under its first |y| - 2*percent/(100+percent)*|y| + 1; a range of sizes spans a little more than the threshold, so y is in x's range or
    the one before. A shingle's key is its count and 40 of its bits, so keys sort as the shingles do; two under one key can only add a pair to confirm."""
    own = unclear.select("id", F.explode("set").alias("q"))
    shares = own.groupBy("q").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    keyed = own.join(shares, "q").select("id", F.shiftleft(F.least("c", F.lit((1 << 22) - 1)), 40).bitwiseOR(F.col("q").bitwiseAND(F.lit((1 << 40) - 1))).alias("key"))
    ordered = keyed.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    n, alone = F.col("n"), F.col("n") - F.size("keys")
    looks = n - F.ceil(n * percent / 100) + 1
    sets = materialize(
        ordered.join(unclear.select("id", "k", F.size("set").alias("n")), "id")
        .select("id", "k", "n", alone.alias("alone"), F.slice("keys", 1, F.greatest(F.lit(0), 2 * looks - alone).cast("int")).alias("firsts"), (looks - alone).alias("looks"))
        .withColumn("waits", n - F.ceil(n * (2 * percent) / (100 + percent)) + 1 - F.col("alone"))
        .withColumn("range", F.floor(F.log(n) / float(-np.log(percent / 100 * 0.99))))
        .where("looks > 0"),
        "unclear-sets",
    )

    def under(places: str, probe: bool, ranges) -> DataFrame:
        at = F.slice("firsts", 1, F.greatest(F.col(places), F.lit(0)).cast("int"))
        rows = sets.select("id", "k", F.size("firsts").alias("held"), F.explode(at).alias("key"), ranges.alias("ranges"))
        return rows.select("key", F.explode("ranges").alias("range"), "id", "k", "held", F.lit(probe).alias("probe"))

    range_ = F.col("range")
    rows = under("looks", True, F.array(range_, range_ - 1)).union(under("waits", False, F.array(range_)))
    worth = rows.groupBy("key", "range").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("probe").alias("p"), F.min("probe").alias("w"), F.sum("held").alias("held"))
    worth = worth.where("lo < hi and p and not w").select("key", "range", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.join(worth, ["key", "range"]).select("key", "range", "id", "probe", mine.alias("mine"), other.alias("other"))
    dealt = dealt.select("key", "range", F.when(F.col("probe"), F.col("mine")).otherwise(F.col("other")).alias("a"), F.when(F.col("probe"), F.col("other")).otherwise(F.col("mine")).alias("b"), "id", "probe")
    order = ["key", "range", "a", "b"]
    full = dealt.join(sets.select("id", "k", "n", "alone", "firsts"), "id").select(*order, "id", "k", "n", "alone", "probe", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 4):
            yield from _possible(table, percent)

    found = full.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(run, "u long, v long")
    with small_batches(unclear.sparkSession):
        out = materialize(found.distinct(), "possible")
    discard(sets)
    return out


def near(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. Links have 100 * intersection >= percent * union of shingles of `size` words."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bound = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5
    signed = materialize(map_text(d, "text", lambda b: _signed(b, size), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>", 1 << 20), "signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # A class has a number of its own, as rows may repeat a doc_id with other texts.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "set-classes")
    keys = classes.select("id", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "band"), "id")).alias("c")).where("n > 1").select("band", F.col("c.id").alias("centre"))
    members = materialize(keys.join(shared, "band"), "band-members")
    free_shuffles(spark)

    def agree(hub: np.ndarray, leaf: np.ndarray):
        alike = float((hub == leaf).mean())
        return (alike,) if alike >= bound else None

    def read_set(digest: pa.Scalar, text: pa.Scalar):
        s = shingles(text.as_py(), size)
        return s if _digest(s) == digest.as_py() else None

    def confirm(hub: np.ndarray, leaf: np.ndarray):
        both = len(np.intersect1d(hub, leaf, assume_unique=True))
        return () if 100 * both >= percent * (len(hub) + len(leaf) - both) else None

    def with_texts(rows: DataFrame, *columns: str) -> DataFrame:
        named = rows.join(classes.select("id", "least", "digest"), "id")
        return named.join(d.withColumnRenamed("doc_id", "least"), "least").select(*columns, "digest", "text")

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs whose components differ."""
        a, b = comp.toDF("hub", "cu"), comp.toDF("leaf", "cv")
        return pairs.join(a, "hub", "left").join(b, "leaf", "left").where(F.coalesce("cu", "hub") != F.coalesce("cv", "leaf")).drop("cu", "cv")

    def links(pairs: DataFrame) -> DataFrame:
        rows = with_texts(_stars(pairs.select("hub", "leaf")), "hub", "part", "leaf")
        with small_batches(spark):
            return materialize(_starred(rows, read_set, confirm, "u long, v long"), "confirmed")

    stars = _stars(members.where("id != centre").select(F.col("centre").alias("hub"), F.col("id").alias("leaf")).distinct())
    signatures = stars.join(classes.select("id", "sig"), "id").select("hub", "part", "leaf", "sig")
    likely = materialize(_starred(signatures, lambda x: np.frombuffer(x.as_py(), np.uint8), agree, "hub long, leaf long, alike double"), "likely")
    free_shuffles(spark)
    # Of each class the best pair first: a class with its likeliest hub.
    best = likely.groupBy("leaf").agg(F.max(F.struct("alike", "hub")).alias("b")).select(F.col("b.hub").alias("hub"), "leaf")
    found = [links(best)]
    comp = components(found[0])
    found.append(links(apart(likely, comp)))
    discard(likely)
    comp = components(found[0].union(found[1]))
    placed = members.select("band", "id").join(comp.toDF("id", "k"), "id", "left").select("band", "id", F.coalesce("k", "id").alias("k"))
    several = placed.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("band")
    open_ = materialize(placed.join(several, "band").select("id", "k").distinct(), "open")
    discard(members)
    unclear = materialize(map_text(with_texts(open_, "id", "k"), "text", lambda b: _set_of(b, size), "id long, k long, set array<long>", 1 << 20).dropDuplicates(["id"]), "unclear")
    possible = _meet(unclear, percent)
    discard(unclear, open_)
    found.append(links(possible.toDF("hub", "leaf")))
    comp = components(found[0].union(found[1]).union(found[2]))
    discard(*found)
    # The smallest document of a component is the smallest of its classes' smallest.
    joined = classes.select("digest", "least", "id").join(comp, "id", "left").withColumn("component", F.coalesce("component_id", "id"))
    first = joined.groupBy("component").agg(F.min("least").alias("first"))
    named = joined.join(first, "component").select("digest", "first")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
        .withColumn("component_id", component)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
