"""Links between texts whose sets of word shingles have a given Jaccard similarity: operator 4 beyond two bits.

SimHash retrieves: each text has FINGERPRINTS fingerprints of 64 bits from
different hashes of its shingles, and texts that share a Golay key of one of
them (simhash.join_keys) are candidates. At similarity 0.8 two fingerprints
lie about ten of 64 bits apart, so a key of one is shared by a tenth of such
pairs only, and several are taken. The exact similarity of the shingle sets
decides. What those keys do not join is the rest that bands of MinHash values
go through: BANDS of ROWS values each miss a pair with probability
(1 - s ** ROWS) ** BANDS, at most MISS; no other step leaves a pair out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, bounded_batches, key_filter, with_row_key, written
from .components import components
from .decontaminate import hashes

#: Fingerprints of a text, and shingles whose bits are added at a time (as bytes).
FINGERPRINTS, ADDED = 12, 255
#: Golay keys of a fingerprint, about; what spreads them over 64 bits (odd, so that no two become one).
GOLAY_KEYS, SPREAD = 16, np.uint64(0x9E3779B97F4A7C15)
#: Keys of a bucket that a task sorts at a time, about, and keys that a worker holds before it sends them to buckets.
BUCKET_KEYS, HELD_KEYS = 1 << 18, 1 << 20
ROWS, MISS = 4, 1e-6
#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 512
#: Members and hashes of a block of a key's group at most, about: two blocks are compared in one task, some 100 MB. Columns
#: of the comparison at a time.
BLOCK, BLOCK_HASHES, COLUMNS = 1000, 500_000, 4096
#: Members of a centre that one task compares with it, where there are no more than HOT_CENTRES such centres; else more.
STAR_ROWS, HOT_CENTRES = 1000, 100_000


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


class Family:
    """The hash functions of `bands` bands, from a fixed seed."""

    def __init__(self, bands: int):
        rng = np.random.default_rng(42)
        self.bands = bands
        self.xor = rng.integers(0, 1 << 64, ROWS * bands, dtype=np.uint64)
        self.odd = rng.integers(0, 1 << 64, ROWS * bands, dtype=np.uint64) | np.uint64(1)
        self.mix = rng.integers(0, 1 << 64, ROWS, dtype=np.uint64) | np.uint64(1)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A key for each band, its number included; sets without shingles have none."""
        if not len(shingles):
            return np.empty(0, dtype=np.int64)
        least = np.full(ROWS * self.bands, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), CHUNK):
            np.minimum(least, ((shingles[at : at + CHUNK, None] ^ self.xor) * self.odd).min(axis=0), out=least)
        least = least.reshape(self.bands, ROWS)
        keys = ((least ^ (least >> np.uint64(31))) * self.mix).sum(axis=1, dtype=np.uint64)
        keys ^= keys >> np.uint64(29)
        return (keys * np.uint64(self.bands) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


class Fingerprints:
    """SimHash fingerprints of a shingle set: a bit is set if it is in over half of the hashes, as in simhash.fingerprint."""

    def __init__(self, count: int):
        rng = np.random.default_rng(43)
        self.xor = rng.integers(0, 1 << 64, count, dtype=np.uint64)
        self.odd = rng.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        sums = np.zeros(64 * len(self.odd), dtype=np.int64)
        for at in range(0, len(shingles), ADDED):
            h = (shingles[at : at + ADDED, None] ^ self.xor) * self.odd
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            sums += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
        return np.packbits(sums * 2 > len(shingles), bitorder="little").view(np.int64)


def golay_keyer():
    """What gives row numbers of a batch and the Golay keys of their fps, the fingerprint's number included."""
    from .simhash import golay_tables, join_keys

    tables = golay_tables()

    def of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        fps = b.column("fps").flatten().to_numpy().view(np.uint64)
        rows, keys = join_keys(fps, tables)
        each = max(1, len(fps) // max(1, len(b)))
        keys |= (rows % each).astype(np.int64) << 42
        return rows // each, (keys.view(np.uint64) * SPREAD).view(np.int64)

    return of


def band_keyer():
    """What gives row numbers of a batch and their MinHash keys."""
    return lambda b: (np.repeat(np.arange(len(b)), b.column("keys").value_lengths().to_numpy()), b.column("keys").flatten().to_numpy())


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z are lower-cased, white space is that of ASCII.

    Fewer words than a shingle's are one shingle, none is no shingle.
    """
    return np.unique(hashes((text or b"").lower().split(), shingle))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _texts(documents: DataFrame) -> DataFrame:
    return with_row_key(documents.select("doc_id", "text")).select(*KEY, F.col("doc_id").cast("bigint").alias("doc_id"), F.encode("text", "UTF-8").alias("t"))


def sketches(documents: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """KEY, doc_id, d (digest of the shingle set), n (its size), fps (fingerprints), keys (of MinHash bands) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, prints = Family(bands_for(similarity)), Fingerprints(FINGERPRINTS)
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(map(digest, sets), pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(map(prints.of, sets), pa.list_(pa.int64())), pa.array(map(family.keys, sets), pa.list_(pa.int64()))], names=[*KEY, "doc_id", "d", "n", "fps", "keys"])

    return _texts(documents).transform(bounded_batches).mapInArrow(run, ", ".join(f"{c} bigint" for c in (*KEY, "doc_id")) + ", d binary, n int, fps array<bigint>, keys array<bigint>")


def sets_of(documents: DataFrame, wanted: DataFrame, *, shingle: int = 5) -> DataFrame:
    """d and the shingles' hashes of the rows whose KEY is in wanted, and of few others that its filter lets through."""

    known = key_filter(wanted.select(F.xxhash64(*KEY).alias("k")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).filter(pa.array(known.holds(b.column(0).to_numpy())))
            sets = [shingle_set(t, shingle) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["d", "hashes"])

    texts = _texts(documents).select(F.xxhash64(*KEY).alias("k"), "t")
    return texts.transform(bounded_batches).mapInArrow(run, "d binary, hashes array<bigint>").dropDuplicates(["d"])


def _alike(both: Column, n: Column, m: Column, similarity: float) -> Column:
    return both >= similarity * (n + m - both) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose sets are alike. pairs: written.

    A centre b of more than STAR_ROWS members is dealt over tasks: each gets
    a share of its members and the centre's set once.
    """
    most = max(STAR_ROWS, pairs.count() // HOT_CENTRES)
    deals = F.ceil(F.count(F.lit(1)) / most).cast("int").alias("deals")
    hot = F.broadcast(written(pairs.groupBy("b").agg(deals).where("deals > 1"), "near-hot"))  # HOT_CENTRES rows at most
    n = F.coalesce("deals", F.lit(1))
    x = sets.select(F.col("d").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("d").alias("b"), F.col("hashes").alias("y")).join(hot, "b", "left").select("b", "y", F.explode(F.sequence(F.lit(0), n - 1)).alias("deal"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), n).cast("int").alias("deal"))
    return dealt.join(x, "a").join(y, ["b", "deal"]).where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), similarity)).select("a", "b")


def _forest(sets: list[np.ndarray], groups: list[int], similarity: float) -> list[tuple[int, int]]:
    """Pairs of members of different groups that are alike, as few as join all groups that any such pair joins."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    owner, column = owner[shared], place[column[shared]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int((count > 1).sum()), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        holds = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        holds[owner[here], column[here] - at] = 1
        both += holds @ holds.T
    alike = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    g = np.array(groups)
    root = {x: x for x in groups}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(alike & (g[:, None] != g[None, :])))):
        x, y = find(groups[i]), find(groups[j])
        if x != y:
            root[x] = y
            out.append((int(i), int(j)))
    return out


def joined(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join all components that a pair of members of one key joins. members: key, d, n, component (written).

    A key's members are dealt into blocks by the memory of a task, and each
    two blocks meet in one with their sets, where all pairs are counted as a
    matrix product. Nothing is emitted for a pair but the few edges of a
    forest; a member is sent as often as its key has blocks.
    """
    counts = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")
    placed_ = members.join(counts, "key").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = placed_.select("key", "d", "component", "own", other).select("key", "d", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def unit(table: pa.Table) -> pa.Table:
        ds, comps = table.column("d").to_pylist(), table.column("component").to_pylist()
        number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        hashed = [np.asarray(x.values) for x in table.column("hashes")]
        pairs = _forest(hashed, [number[c] for c in comps], similarity) if len(number) > 1 else []
        return pa.Table.from_pylist([{"a": ds[i], "b": ds[j]} for i, j in pairs], schema=schema)

    return units.join(sets, "d").groupBy("key", "i", "j").applyInArrow(unit, "a binary, b binary").distinct()


def several_keys(reps: DataFrame, keyer, each: int) -> DataFrame:
    """key: those that several rows have, once each. reps: written; each: keys of a row, about.

    Most keys are of one row, so to count them by partial aggregates would
    fill a table in memory with all of a task's keys. A worker sorts HELD_KEYS
    at a time, keeps at most two of one key, and sends them to buckets by
    their first bits as packed numbers; a bucket is sorted again in its task.
    """
    bits = max(1, (reps.count() * each // BUCKET_KEYS).bit_length())
    shift = np.uint64(64 - bits)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held).view(np.uint64))
        new = np.ones(len(h), dtype=bool)
        new[2:] = h[2:] != h[:-2]
        h = h[new]
        at = np.searchsorted(h >> shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(at))
        ends = (np.append(at[full], len(h)) * 8).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(h)])
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), parts], names=["bucket", "part"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, held, n = keyer(), [], 0
        for b in batches:
            held.append(keys_of(b)[1])
            n += len(held[-1])
            if n >= HELD_KEYS:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    def meet(bucket: pa.Table) -> pa.Table:
        h = np.sort(np.frombuffer(b"".join(bucket.column("part").to_pylist()), dtype=np.int64))
        return pa.table({"key": np.unique(h[1:][h[1:] == h[:-1]])})

    return reps.transform(bounded_batches).mapInArrow(deal, "bucket int, part binary").groupBy("bucket").applyInArrow(meet, "key bigint")


def shared_keys(reps: DataFrame, keyer, each: int) -> DataFrame:
    """The rows (d, n, key) of keys that several have; keys of the same members count once. reps: written."""
    # Only keys are shuffled to find those that several have, and only their members leave the workers.
    several = written(several_keys(reps, keyer, each), "near-several")
    known = key_filter(several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = keyer()
        for b in batches:
            rows, keys = keys_of(b)
            hit = known.holds(keys)
            out = b.select(["d", "n"]).take(pa.array(rows[hit]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(keys[hit])], names=["d", "n", "key"])

    keyed = reps.transform(bounded_batches).mapInArrow(run, "d binary, n int, key bigint")
    met = written(keyed.join(several, "key").select("d", "n", "key"), "near-met")
    marks = met.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("d"))).alias("y"))
    once = written(marks.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "near-once")
    return written(met.join(once, "key").select("d", "n", "key"), "near-keys")


def stars(shared: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): members of a key and the one of them that is in most keys, where their sizes allow the similarity."""
    fits = _alike(F.least("n", "m"), F.col("n"), F.col("m"), similarity)  # the smaller set is the most they can share
    often = shared.groupBy("d").agg(F.count(F.lit(1)).alias("often"))
    centres = shared.join(often, "d").groupBy("key").agg(F.max(F.struct("often", "d", "n")).alias("first"))
    out = shared.join(centres, "key").select(F.col("d").alias("a"), "n", F.col("first.d").alias("b"), F.col("first.n").alias("m"))
    return out.where("a <> b").where(fits).select("a", "b").distinct()


def links(documents: DataFrame, rows: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) of digests: enough of the links between texts alike that components are exact.

    rows: the written sketches. Members of a key are compared with the one
    that is in most keys: of a text and its copies mostly the text, so
    clusters cost a comparison a member. Golay keys of the fingerprints come
    first. MinHash keys are for the rest: candidates that SimHash has joined
    are not compared again, and in keys that hold more than one component
    still, all members meet in blocks. What that costs a member grows with the
    members that are nearly but not alike, as such pairs cannot be told
    without looking at them; no pair is emitted for it.
    """
    reps = written(rows.groupBy("d").agg(F.min(F.struct(*KEY)).alias("k"), F.first("n").alias("n"), F.first("fps").alias("fps"), F.first("keys").alias("keys")), "near-reps")
    golay = shared_keys(reps.where("n > 0").select("d", "n", "fps"), golay_keyer, FINGERPRINTS * GOLAY_KEYS)
    shared = shared_keys(reps.select("d", "n", "keys"), band_keyer, bands_for(similarity))
    wanted = reps.select("d", "k.*").join(golay.select("d").union(shared.select("d")).distinct(), "d").select(*KEY)
    sets = written(sets_of(documents, wanted, shingle=shingle), "near-sets")
    edges = written(verified(written(stars(golay, similarity), "near-pairs"), sets, similarity), "simhash-edges")
    of = written(components(edges).select(F.col("node").alias("d"), "component"), "simhash-components")
    rest = stars(shared, similarity)
    for x in "ab":
        rest = rest.join(of.select(F.col("d").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    rest = written(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "near-rest")
    edges = edges.unionByName(written(verified(rest, sets, similarity), "near-edges"))
    now = shared.join(components(edges).withColumnRenamed("node", "d"), "d", "left").select("key", "d", "n", F.coalesce("component", "d").alias("component"))
    now = written(now, "near-placed")
    mixed = written(now.join(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "key"), "near-mixed")
    return edges.unionByName(written(joined(mixed, sets, similarity), "near-more-edges"))


def classes(documents: DataFrame, *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """KEY, doc_id, class, component_id (smallest doc_id reachable) of each row.

    Rows with equal shingle sets are one node, however many. Null and empty
    texts have equal (empty) sets. Repeated and null ids as in
    simhash.near_dedup. Extra columns are not read. An empty table gives an
    empty result.
    """
    from .simhash import placed

    rows = written(sketches(documents, shingle=shingle, similarity=similarity), "near-sketches")
    return placed(rows.select(*KEY, "doc_id", "d"), lambda _: links(documents, rows, shingle=shingle, similarity=similarity), "d")
