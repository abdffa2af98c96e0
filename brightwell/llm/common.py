"""What the corpus operators share: files, filters of keys, text inputs."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_path, qualified, scratch, shared_root, temporary, written

__all__ = ["drop_path", "qualified", "scratch", "shared_root", "temporary", "written"]

#: White space of the contracts: space and the five ASCII controls.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def local_path(path: str) -> str | None:
    """The path for open(), if the URI (`qualified`) names a mounted file system."""
    parts = urlsplit(path)
    if not parts.scheme:
        raise ValueError(f"a path without a scheme is no place that all executors share: {path!r}")
    return parts.path if parts.scheme == "file" else None


def put_bytes(path: str, parts) -> int:
    """Write an object whole or not at all; from executors, on a mounted or object store."""
    own = local_path(path)
    if own is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_output_stream(inner) as out:
            return sum(out.write(p) for p in parts)
    os.makedirs(os.path.dirname(own), exist_ok=True)
    with open(f"{own}.part", "wb") as out:
        n = sum(out.write(p) for p in parts)
    os.replace(f"{own}.part", own)
    return n


def open_bytes(path: str):
    """A readable binary file with seek(), from executors."""
    own = local_path(path)
    if own is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(own, "rb")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Letters beyond ASCII that lower() changes are of these kinds; Cn are those newer than the regex's Unicode.
OTHER_CAPITALS = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}&&[^A-Z]]"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, JVM-side.

    lower() does it where there are no other capitals; else each letter is
    replaced by itself, which is faster than translate() by character.
    """
    slow = text
    for a, b in zip(UPPER, LOWER):
        slow = F.replace(slow, F.lit(a), F.lit(b))
    plain = (F.octet_length(text) == F.char_length(text)) | ~F.rlike(text, F.lit(OTHER_CAPITALS))
    return F.when(plain, F.lower(text)).otherwise(slow)


#: Bytes of a key filter at most, its hash functions, and bits a key: sixteen let through one stranger in 400.
FILTER_BYTES, FILTER_HASHES, FILTER_BITS = 16 << 20, 4, 16


class KeyFilter:
    """A Bloom filter of bigint keys that are hashes, for use in column expressions and in workers."""

    def __init__(self, bits, words: int):
        self.bits, self.words = bits, words

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that is in, and for few others."""
        table = np.frombuffer(self.bits.value, dtype=np.int64)
        low, high = keys & 0xFFFFFFFF, ((keys >> 32) & 0xFFFFFFFF) | 1
        out = np.ones(len(keys), dtype=bool)
        for k in range(FILTER_HASHES):
            at = (low + k * high) % (self.words * 64)
            out &= ((table[at >> 6] >> (at & 63)) & 1).astype(bool)
        return out

    def __call__(self, key: Column) -> Column:
        @F.arrow_udf("boolean")
        def may_be_in(keys: pa.Array) -> pa.Array:
            return pa.array(self.holds(keys.to_numpy(zero_copy_only=False)))

        return may_be_in(key)


def key_filter(keys: DataFrame, *, max_bytes: int = FILTER_BYTES) -> KeyFilter:
    """A filter of at most max_bytes of the keys (one bigint column of hashes without nulls), however many there are.

    Set bits are grouped into words on the executors, and the words, as many
    as fit max_bytes, are all that reaches the driver and goes out again. With
    more keys than it is made for it only lets more strangers through, so it
    may stand before a shuffle but never in place of a join.
    """
    spark, name = keys.sparkSession, keys.columns[0]
    n = keys.count()
    words = 1 << 6
    while words * 64 < n * FILTER_BITS and words * 8 < max_bytes:
        words *= 2
    low, high = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", F.col(name), F.lit(32)).bitwiseOR(F.lit(1))
    bit = F.explode(F.array(*((low + F.lit(k) * high) % F.lit(words * 64) for k in range(FILTER_HASHES)))).alias("b")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("b") % 64).cast("int"))
    rows = keys.select(bit).groupBy(F.call_function("shiftright", "b", F.lit(6)).alias("w")).agg(F.bit_or(mask).alias("m")).toArrow()
    bits = np.zeros(words, dtype=np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return KeyFilter(spark.sparkContext.broadcast(bits.tobytes()), words)


#: Rows of a key that one task joins, where there are no more than HOT_KEYS such keys; else more.
DEAL_ROWS, HOT_KEYS = 1000, 100_000


def dealt_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """left.join(right, key, how), where right (written) has a row for each key and in `rows` how many of left have it.

    The rows of a key that has many are dealt over tasks, and right's row is
    sent to each. Of such keys there are at most HOT_KEYS, so they may be
    broadcast.
    """
    most = max(DEAL_ROWS, (right.agg(F.sum(rows)).first()[0] or 0) // HOT_KEYS)
    deals = F.ceil(F.col(rows) / F.lit(most)).cast("int")
    hot = F.broadcast(right.where(F.col(rows) > most).select(key, deals.alias("deals__")))
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("deals__", F.lit(1))).cast("int")
    dealt = left.join(hot, key, "left").withColumn("deal__", own).drop("deals__")
    return dealt.join(right.withColumn("deal__", F.explode(F.sequence(F.lit(0), deals - 1))), [key, "deal__"], how).drop("deal__")


#: Columns that tell documents apart: rows that agree in id and text (null unlike empty) are one document given twice.
KEY = ["k0__", "k1__", "k2__"]


def with_row_key(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows with KEY: the id or 0, and 128 bits of hash of text and id. None is null."""
    return documents.withColumns({"k0__": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "k1__": F.xxhash64(text), "k2__": F.xxhash64(F.lit(1), F.col("doc_id").cast("bigint"), F.col(text))})


def keep_rows(documents: DataFrame, known: DataFrame) -> DataFrame:
    """The documents without those marked in known (KEY, stays boolean; a written table, each key once), each document once.

    known holds every key that goes, and those that stay but are given more
    than once; other rows are not in it and stay as they are. Only rows whose
    key may be in known, by the key filter, are shuffled, and the join decides
    exactly; all others pass. Of rows with one key the one whose columns hash
    lowest is taken, by partial aggregates before the join.
    """
    names = documents.columns
    test = key_filter(known.select(F.xxhash64(*KEY).alias("k")))
    keyed = with_row_key(documents).withColumn("hit__", test(F.xxhash64(*KEY)))
    row = F.struct(*(F.col(c) for c in names))
    # What is given twice is in known, so no stranger that the filter lets through is merged here.
    once = keyed.where("hit__").groupBy(*KEY).agg(F.min_by(row, F.xxhash64(*(F.col(c) for c in names))).alias("row__"))
    stay = once.join(known.select(*KEY, "stays"), KEY, "left").where(F.coalesce("stays", F.lit(True))).select("row__.*")
    return keyed.where(~F.col("hit__")).select(*names).unionByName(stay)


def gone_or_repeated(rows: DataFrame, stays: Column) -> DataFrame:
    """What keep_rows takes, from a row for each document with KEY and, alike for rows of one key, whether it stays."""
    marks = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.bool_or(stays).alias("stays"))
    return marks.where((F.col("n") > 1) | ~F.col("stays")).select(*KEY, "stays")


@contextmanager
def paused_gc():
    """No cyclic garbage collection inside: it would walk a large memo again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def worker_held(key, make):
    """What make() gave for the key first in this Python worker; it lives as long as the worker, across its tasks.

    This package travels with each task and is made anew for it, so its own
    globals do not last; a module of its name in sys.modules does.
    """
    import sys
    import types

    store = sys.modules.setdefault("brightwell_worker_state", types.ModuleType("brightwell_worker_state")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


#: Rows and bytes of a batch that goes to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same frame in a session of its own, whose batches to Python have at most BATCH_ROWS and BATCH_BYTES.

    This bounds a worker's memory; the caller's session keeps its settings.
    """
    spark = df.sparkSession
    session = spark._jsparkSession.cloneSession()
    session.conf().set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    session.conf().set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, df._jdf.queryExecution().logical()), spark)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most `size`."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
            held.clear()
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
