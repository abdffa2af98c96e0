"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and texts are sets of shingles of five words. Items are partitioned by
size; in a partition of items of at most u shingles each item is sketched by
its k = u - ceil(0.8 u) + 1 smallest hash values (bottom-k MinHash). A text
that holds 0.8 of an item lacks fewer than k of its shingles, so it holds one
of any k: probing all hashes of a text, however long, against the sketches
retrieves every such item. Exact containment of the shingles then decides.

An item of one to four words is one shingle of all its words, as is such a
text: it is found in texts that are just these words, not inside longer ones.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, open_bytes, put_bytes, scratch, worker_held

SHINGLE, CONTAINMENT = 5, 0.8
#: Characters of items that go out with a task at once; a larger benchmark is searched in blocks of items.
BLOCK_CHARS = 16_000_000
#: Items whose shingles a worker keeps at a time.
KEPT_SETS = 4096


def words(text: str | None) -> list[bytes]:
    """Lower case, split at white space of ASCII."""
    return (text or "").lower().encode().split()


def shingles(ws: list[bytes]) -> set[bytes]:
    """Five words each; fewer words are one shingle, none is no shingle."""
    if len(ws) <= SHINGLE:
        return {b" ".join(ws)} if ws else set()
    return set(map(b" ".join, zip(*(ws[k : len(ws) - SHINGLE + 1 + k] for k in range(SHINGLE)))))


def hashes(ws: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each shingle, combined from the words' hashes."""
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    n = max(1, len(h) - shingle + 1)
    out = np.zeros(n, dtype=np.uint64)
    odd = 0x9E3779B97F4A7C15
    for k in range(min(shingle, len(h))):
        out += h[k : k + n] * np.uint64(pow(odd, 2 * k + 1, 1 << 64))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(32))


def sketch_size(upper: int) -> int:
    """Hash values kept of each item in a partition of items of at most `upper` shingles."""
    return upper - math.ceil(CONTAINMENT * upper) + 1


class Index:
    """A block of items: sorted hash values of their sketches with the items they are of, and the items' words."""

    def __init__(self, ids: list, items: list[bytes], values: np.ndarray, owners: np.ndarray):
        self.ids, self.items, self.values, self.owners = ids, items, values, owners
        self.coarse = np.zeros(1 << 20, dtype=bool)
        self.coarse[(values >> np.uint64(44)).astype(np.int64)] = True
        self._sets: dict[int, set[bytes]] = {}

    @staticmethod
    def build(items: list[tuple[object, str | None]]) -> tuple[list, list[bytes], np.ndarray, np.ndarray]:
        """The arguments of an Index."""
        ids, texts, values, owners = [], [], [], []
        partitions: dict[int, list[tuple[object, list[bytes], np.ndarray]]] = {}
        for i, text in items:
            ws = words(text)
            if ws:
                h = np.unique(hashes(ws))
                partitions.setdefault(len(h).bit_length(), []).append((i, ws, h))
        for _, part in sorted(partitions.items()):
            k = sketch_size(max(len(h) for _, _, h in part))
            for i, ws, h in part:
                values.append(h[:k])
                owners.append(np.full(len(values[-1]), len(ids)))
                ids.append(i)
                texts.append(b" ".join(ws))
        v = np.concatenate(values) if values else np.empty(0, dtype=np.uint64)
        o = np.concatenate(owners) if owners else np.empty(0, dtype=np.int64)
        order = np.argsort(v, kind="stable")
        return ids, texts, v[order], o[order]

    def shingles_of(self, k: int) -> set[bytes]:
        if (got := self._sets.get(k)) is None:
            if len(self._sets) >= KEPT_SETS:
                self._sets.clear()
            got = self._sets[k] = shingles(self.items[k].split())
        return got

    def matches(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item, shingles found, shingles of the item) for each item of which the text holds CONTAINMENT."""
        ws = words(text)
        h = hashes(ws)
        h = h[self.coarse[(h >> np.uint64(44)).astype(np.int64)]]
        if not len(h):
            return []
        h = np.unique(h)
        lo, hi = np.searchsorted(self.values, h, "left"), np.searchsorted(self.values, h, "right")
        near = sorted({int(self.owners[x]) for a, b in zip(lo, hi) for x in range(a, b)})
        if not near:
            return []
        have, out = shingles(ws), []
        for k in near:
            item = self.shingles_of(k)
            found = len(item & have)
            if found >= CONTAINMENT * len(item) - 1e-9:
                out.append((self.ids[k], found, len(item)))
        return out


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[str]:
    """Paths of the indexes of the benchmark's items, in blocks that fit a task; each block is one pass over the texts.

    The driver holds one block at a time: each is written to the shared folder
    before the next is read.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    folder, out = scratch(spark, "benchmark-index"), []
    for k in range(n):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]
        out.append(f"{folder}/block-{k}")
        put_bytes(out[-1], [pickle.dumps(Index.build(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))))])
    return out


def _index(path: str) -> Index:
    """The block's index; a worker keeps the last one it read."""
    held = worker_held("benchmark index", dict)
    if path not in held:
        held.clear()
        with open_bytes(path) as f:
            held[path] = Index(*pickle.loads(f.read()))
    return held[path]


def search(documents: DataFrame, benchmark: DataFrame, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, matched, item_shingles, containment for each item found in a document.

    Null and empty texts or items match nothing; a repeated row of documents
    is searched and reported by itself; equal rows of the benchmark count
    once. Extra columns are not read. No shuffle of texts.
    """
    schema = "doc_id bigint, item_id bigint, matched bigint, item_shingles bigint"
    out = None
    for path in blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            index = _index(path)
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in index.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "matched", "item_shingles"])

        part = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(bounded_batches).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("matched") / F.col("item_shingles"))


def clean(documents: DataFrame, benchmark: DataFrame, *, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, with all columns, that hold no item of the benchmark. One pass for each block, no shuffle.

    Null and empty texts stay, as do all if the benchmark is empty. Each row
    is judged by its own text, whatever its id; an empty table gives an empty
    one.
    """
    schema = documents.schema
    for path in blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            index = _index(path)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], type=pa.bool_()))

        documents = documents.transform(bounded_batches).mapInArrow(run, schema)
    return documents
