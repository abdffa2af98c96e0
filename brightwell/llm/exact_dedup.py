"""Exact deduplication by a log-structured merge index of digests.

Each task fills a memtable, digest to (identifier that stays, count), and
flushes it as a sorted run: a file of its own with a Bloom filter and a
sparse index of its digests. Compaction merges runs level by level: FAN runs
become one, cut by digest range into files of bounded size, so tasks and
their memory are alike at every level. Point look-ups ask the filters first.
Digests with more than one document are hits; a filter of them picks the rows
whose bytes are compared, and a digest shared by different texts is split by
text, so results never rest on the digest alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import KEY, batches_of, bounded_batches, dealt_join, gone_or_repeated, keep_rows, key_filter, open_bytes, put_bytes, scratch, temporary, with_row_key, written

#: Entries of a memtable; at about 200 bytes each this bounds a worker's memory.
MEMTABLE = 100_000
#: Runs that become one in a merge, and entries that a merge's file has at about; both bound a task.
FAN, FILE_ENTRIES = 32, 12_500
#: Bytes of texts that a task holds for the comparison of hits before it hands them on.
HELD_BYTES = 32 << 20
RUN_MAGIC, INDEX_STEP, FILTER_BITS = b"DIGRUN01", 128, 10

#: level, run: which run a file belongs to; lo, hi: its share of the digests' first 32 bits.
FILES = "level int, run bigint, lo bigint, hi bigint, path string, entries bigint"


def normalise(text: bytes | None) -> bytes:
    """Null counts as empty; A-Z become a-z. bytes.lower() touches ASCII only."""
    return (text or b"").lower()


ENTRY = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class Run:
    """A sorted file of (digest, keep_id or None, count).

    Magic, entries of fixed width, filter, the digest of every INDEX_STEP-th
    entry, and a footer with checksums of filter and index.
    """

    FOOTER = "<QIIII"

    @staticmethod
    def parts(entries: Iterator[tuple[bytes, int | None, int]], width: int) -> tuple[list[bytes], int]:
        body, keys, n = [RUN_MAGIC], [], 0
        for digest, keep, count in entries:
            if n % INDEX_STEP == 0:
                keys.append(digest)
            body.append(digest + struct.pack("<?qq", keep is None, keep or 0, count))
            n += 1
        bits = bytearray(n * FILTER_BITS // 8 + 1)
        for entry in body[1:]:
            for at in Run.places(entry[:width], len(bits) * 8):
                bits[at >> 3] |= 1 << (at & 7)
        index = b"".join(keys)
        return [*body, bytes(bits), index, struct.pack(Run.FOOTER, n, width, len(bits), zlib.crc32(bits), zlib.crc32(index))], n

    @staticmethod
    def places(digest: bytes, bits: int) -> list[int]:
        """Digests are hashes already; short ones (in tests) are stretched."""
        a, b = struct.unpack("<QQ", digest[:16].ljust(16, digest[:1]))
        return [(a + k * (b | 1)) % bits for k in range(4)]

    def __init__(self, path: str):
        self.path, self.file, self._bits = path, open_bytes(path), None
        if self.file.read(8) != RUN_MAGIC:
            raise ValueError(f"{path}: not a run")
        footer = struct.calcsize(self.FOOTER)
        self.file.seek(-footer, 2)
        self.n, self.width, self.size, self.filter_crc, crc = struct.unpack(self.FOOTER, self.file.read(footer))
        self.step = self.width + 17
        self.file.seek(8 + self.n * self.step + self.size)
        keys = self.file.read(-(-self.n // INDEX_STEP) * self.width)
        if zlib.crc32(keys) != crc:
            raise ValueError(f"{path}: damaged index")
        self.keys = [keys[k : k + self.width] for k in range(0, len(keys), self.width)]

    @property
    def bits(self) -> bytes:
        """The filter, read when first asked: merges do not need it."""
        if self._bits is None:
            self.file.seek(8 + self.n * self.step)
            self._bits = self.file.read(self.size)
            if zlib.crc32(self._bits) != self.filter_crc:
                raise ValueError(f"{self.path}: damaged filter")
        return self._bits

    def close(self) -> None:
        self.file.close()

    def may_hold(self, digest: bytes) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self.places(digest, len(self.bits) * 8))

    def entries(self, lo: bytes = b"", hi: bytes | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Entries with lo <= digest < hi, a step of the index in memory at a time."""
        at = max(0, bisect_right(self.keys, lo) - 1) * INDEX_STEP
        while at < self.n:
            self.file.seek(8 + at * self.step)
            count = min(INDEX_STEP, self.n - at)
            block = self.file.read(count * self.step)
            for k in range(0, len(block), self.step):
                digest = block[k : k + self.width]
                if hi is not None and digest >= hi:
                    return
                if digest >= lo:
                    null, keep, n = struct.unpack_from("<?qq", block, k + self.width)
                    yield digest, None if null else keep, n
            at += count

    def get(self, digest: bytes) -> tuple[int | None, int] | None:
        """(keep_id, count) of a digest; the filter answers for most that are not here."""
        if self.may_hold(digest):
            for found, keep, n in self.entries(digest):
                return (keep, n) if found == digest else None
        return None


def better(a: int | None, b: int | None, keep: str) -> int | None:
    """The identifier that stays; any goes before null."""
    if a is None or b is None:
        return b if a is None else a
    return min(a, b) if keep == "min" else max(a, b)


def flush_runs(documents: DataFrame, *, keep: str = "min", digest_bytes: int = 32, memtable: int = MEMTABLE) -> tuple[DataFrame, DataFrame]:
    """(members, files): doc_id, digest and KEY of each row, and the sorted runs of level 0.

    Files are named by task attempt, and only those of attempts that ended
    well are listed, so a retried task leaves at most a file nothing names.
    """
    spark = documents.sparkSession
    folder = scratch(spark, "exact-runs")
    schema = pa.schema([*((c, pa.int64()) for c in KEY), ("doc_id", pa.int64()), ("digest", pa.binary()), ("path", pa.string()), ("entries", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/0-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        held: dict[bytes, tuple[int | None, int]] = {}
        flushed: list[tuple[str, int]] = []

        def flush() -> None:
            path = f"{name}-{len(flushed)}.run"
            parts, n = Run.parts(((d, *held[d]) for d in sorted(held)), digest_bytes)
            put_bytes(path, parts)
            flushed.append((path, n))
            held.clear()

        for b in batches:
            digests = [hashlib.sha256(normalise(t)).digest()[:digest_bytes] for t in b.column(4).to_pylist()]
            for i, d in zip(b.column(3).to_pylist(), digests):
                old = held.get(d)
                held[d] = (i, 1) if old is None else (better(old[0], i, keep), old[1] + 1)
                if len(held) >= memtable:
                    flush()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(digests, pa.binary()), pa.nulls(len(digests), pa.string()), pa.nulls(len(digests), pa.int64())], schema=schema)
        if held:
            flush()
        yield pa.RecordBatch.from_pylist([{"path": p, "entries": n} for p, n in flushed], schema=schema)

    rows = with_row_key(documents.select("doc_id", "text")).select(*KEY, F.col("doc_id").cast("bigint"), F.encode("text", "UTF-8").alias("t"))
    both = written(rows.transform(bounded_batches).mapInArrow(run, ", ".join(f"{c} bigint" for c in KEY) + ", doc_id bigint, digest binary, path string, entries bigint"), "exact-members")
    # One row for each memtable: the number of a run is its place among them.
    number = F.row_number().over(W.orderBy("path")) - 1
    files = both.where("path is not null").select(F.lit(0).alias("level"), number.cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("lo"), F.lit(1 << 32).alias("hi"), "path", "entries")
    return both.where("path is null").select("doc_id", "digest", *KEY), files


def _bound(at: int, digest_bytes: int) -> bytes | None:
    """The digest at which a share of the first 32 bits begins; None behind the last."""
    return None if at >= 1 << 32 else struct.pack(">I", at)[:digest_bytes]


def _merged(runs: list[Run], lo: bytes, hi: bytes | None, keep: str) -> Iterator[tuple[bytes, int | None, int]]:
    """One sorted stream of entries, each digest once."""
    for digest, same in groupby(merge(*(r.entries(lo, hi) for r in runs), key=lambda e: e[0]), key=lambda e: e[0]):
        _, best, n = next(same)
        for _, other, m in same:
            best, n = better(best, other, keep), n + m
        yield digest, best, n


def compact(files: DataFrame, *, keep: str = "min", digest_bytes: int = 32, fan: int = FAN, file_entries: int = FILE_ENTRIES) -> DataFrame:
    """The files of one run into which all runs are merged, level by level; `keep` says which identifier stays.

    A task merges the files of `fan` runs that cover its share of the digests,
    entry by entry, into one file: a digest of a third of all rows is one
    entry of each run. Levels grow with the logarithm of the rows.
    """
    if fan < 2:
        raise ValueError(f"a merge of {fan} runs")
    spark = files.sparkSession
    folder = scratch(spark, "exact-levels")
    files = written(files, "exact-level")
    level, shares, most = 0, 1, 1 << (8 * min(digest_bytes, 4))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("level", pa.int32()), ("run", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("path", pa.string()), ("entries", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for b in batches:
            for row in b.to_pylist():
                runs = [Run(p) for p in sorted(row["paths"])]
                parts, n = Run.parts(_merged(runs, _bound(row["lo"], digest_bytes), _bound(row["hi"], digest_bytes), keep), digest_bytes)
                for r in runs:
                    r.close()
                path = f"{folder}/{row['level']}-{row['run']}-{row['lo']}-{TaskContext.get().taskAttemptId()}.run"
                put_bytes(path, parts)
                yield pa.RecordBatch.from_pylist([{"level": row["level"], "run": row["run"], "lo": row["lo"], "hi": row["hi"], "path": path, "entries": n}], schema=schema)

    while True:
        runs, total = files.agg(F.countDistinct("run"), F.sum("entries")).first()
        if runs <= 1:
            return files
        level += 1
        wider = shares
        while wider < most and total > -(-runs // fan) * wider * file_entries:
            wider *= 2
        size = (1 << 32) // wider
        # A file goes to each share of the new run that lies in its own; a share has one file of each run.
        share = F.explode(F.transform(F.sequence(F.lit(0), F.lit(wider // shares - 1)), lambda k: F.col("lo") + k * F.lit(size).cast("bigint"))).alias("lo")
        jobs = files.select(F.floor(F.col("run") / fan).cast("bigint").alias("run"), "path", share).groupBy("run", "lo").agg(F.collect_list("path").alias("paths"))
        jobs = jobs.select(F.lit(level).alias("level"), "run", "lo", (F.col("lo") + F.lit(size).cast("bigint")).alias("hi"), "paths")
        files = written(jobs.repartition(tasks, "run", "lo").transform(bounded_batches).mapInArrow(work, FILES), "exact-level")
        shares = wider


def entries(files: DataFrame, *, least: int = 1) -> DataFrame:
    """digest, keep_id, group_size: what the listed files hold, of digests with `least` documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                r = Run(path)
                yield from batches_of((e for e in r.entries() if e[2] >= least), ENTRY)
                r.close()

    tasks = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(tasks, "path").transform(bounded_batches).mapInArrow(run, "digest binary, keep_id bigint, group_size bigint")


def lookup(files: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of the digests that runs of one level hold; the files' filters are asked first.

    digests: one column. Each goes to the files whose share it falls in, and
    is read from those whose filter knows it. Several runs give a row each.
    """
    size = files.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 1 << 32
    at = F.conv(F.rpad(F.substring(F.hex(digests.columns[0]), 1, 8), 8, "0"), 16, 10).cast("bigint")
    tasks = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = digests.select(F.col(digests.columns[0]).alias("digest"), (at - at % F.lit(size).cast("bigint")).alias("lo")).join(files.select("lo", "path"), "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            out = []
            for digest, path in zip(*(b.column(k).to_pylist() for k in (0, 1))):
                if r is None or r.path != path:
                    if r is not None:
                        r.close()
                    r = Run(path)
                if got := r.get(digest):
                    out.append({"digest": digest, "keep_id": got[0], "group_size": got[1]})
            yield pa.RecordBatch.from_pylist(out, schema=ENTRY)

    ordered = pairs.select("digest", "path").repartition(tasks, "path").sortWithinPartitions("path")
    return ordered.transform(bounded_batches).mapInArrow(run, "digest binary, keep_id bigint, group_size bigint")


def _grouped(documents: DataFrame, keep: str, digest_bytes: int, memtable: int, fan: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members, hits, split): rows with digests, digests of several rows, and rows of digests that stand for different texts, by text."""
    members, runs = flush_runs(documents, keep=keep, digest_bytes=digest_bytes, memtable=memtable)
    hits = written(entries(compact(runs, keep=keep, digest_bytes=digest_bytes, fan=fan), least=2), "exact-hits")
    return members, hits, _collisions(documents, hits, keep, digest_bytes)


def dedup(documents: DataFrame, *, keep: str = "min", digest_bytes: int = 32, memtable: int = MEMTABLE, fan: int = FAN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (binary).

    Texts are equal when identical after A-Z are lower-cased; null counts as
    empty. keep ("min" or "max") says which id of equal texts stays. A repeated
    doc_id with equal text counts in group_size and its rows are all marked
    kept or not alike; with different texts its rows are in different groups.
    A null doc_id stays only where its group has no other. Extra columns are
    not read. An empty table gives an empty result.

    Texts are moved only for hits, once a task and digest.
    """
    members, hits, split = _grouped(documents, keep, digest_bytes, memtable, fan)
    out = dealt_join(members, hits, "digest", "group_size", "left").select(
        "doc_id", "digest",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
    )
    if split is not None:
        out = out.join(split.select("digest").distinct(), "digest", "left_anti").unionByName(split.select("doc_id", "digest", "keep_id", "group_size"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _collisions(documents: DataFrame, hits: DataFrame, keep: str, digest_bytes: int) -> DataFrame | None:
    """Byte verification of all hits: None if the texts of each digest are equal.

    Else doc_id, digest, t (normalised), keep_id, group_size for the rows of
    the digests that stand for several texts. A filter of the hits' digests
    picks the rows to compare; a task compares what it has and hands on one
    text of each digest (and any other that differs), so of a group of copies
    as many texts move as there are tasks.
    """
    known = key_filter(hits.select(F.xxhash64("digest").alias("k")))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode("text", "UTF-8").alias("t"))
    schema = pa.schema([("digest", pa.binary()), ("t", pa.binary())])

    def suspects(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes, bytes]]:
        ts = list(map(normalise, batch.column(1).to_pylist()))
        ds = [hashlib.sha256(t).digest()[:digest_bytes] for t in ts]
        # As Spark's xxhash64 of a binary.
        keys = np.fromiter((xxhash.xxh64_intdigest(d, 42) for d in ds), dtype=np.uint64, count=len(ds)).view(np.int64)
        for k in np.nonzero(known.holds(keys))[0]:
            yield batch.column(0)[k].as_py(), ds[k], ts[k]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set[bytes]] = {}
        size = 0
        out = lambda: pa.RecordBatch.from_pylist([{"digest": d, "t": t} for d, ts in held.items() for t in sorted(ts)], schema=schema)
        for b in batches:
            for _, d, t in suspects(b):
                own = held.setdefault(d, set())
                if t not in own:  # compares bytes
                    own.add(t)
                    size += len(t)
            if size >= HELD_BYTES:
                yield out()
                held.clear()
                size = 0
        yield out()

    seen = texts.transform(bounded_batches).mapInArrow(distinct, "digest binary, t binary")
    unequal = written(seen.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("digest"), "exact-unequal")
    if unequal.isEmpty():
        return None

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "digest", "t"), row)) for row in suspects(b)], schema=pa.schema([("doc_id", pa.int64()), *schema]))

    keyed = texts.transform(bounded_batches).mapInArrow(every, "doc_id bigint, digest binary, t binary")
    rows = written(keyed.join(unequal, "digest"), "exact-unequal-texts")
    best = F.min("doc_id") if keep == "min" else F.max("doc_id")
    groups = rows.groupBy("digest", "t").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return written(rows.join(groups, ["digest", "t"]), "exact-split")


def unique(documents: DataFrame, *, keep: str = "min") -> DataFrame:
    """The documents of which each text stays exactly once, with all columns.

    Decided by id and text: other texts of an id that goes are not touched. Of
    rows with the text and the id that stays one is taken, and of rows without
    an id one where no other row has the text. Null and empty texts are one
    text. An empty table gives an empty one.
    """
    with temporary(documents.sparkSession):
        members, hits, split = _grouped(documents, keep, 32, MEMTABLE, FAN)
        if split is not None:
            raise ValueError("different texts with one SHA-256")
        met = written(dealt_join(members, hits.select("digest", "group_size"), "digest", "group_size").drop("group_size"), "exact-met")
        id_, none = F.col("doc_id"), F.col("doc_id").isNull()
        first = F.min(F.struct(none, id_, *KEY)) if keep == "min" else F.max(F.struct(~none, id_, *KEY))
        winners = written(met.groupBy("digest").agg(first.alias("w"), F.count(F.lit(1)).alias("n")), "exact-winners")
        stays = (F.col("k0__") == F.col("w.k0__")) & (F.col("k1__") == F.col("w.k1__")) & (F.col("k2__") == F.col("w.k2__"))
        known = written(gone_or_repeated(dealt_join(met, winners, "digest", "n"), stays), "exact-known", keep=True)
    return keep_rows(documents, known)
