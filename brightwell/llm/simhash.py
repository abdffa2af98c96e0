"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. A segment
with its parity bit is a word of the extended binary Golay code [24, 12, 8];
it lies within four bits of one codeword or of six, whose indices are its
keys. Words of even weight two bits apart share at least one of them, so
segments with up to two errors share a key. By pigeonhole, of three segments
with at most two errors together one is free of errors: the join key is that
segment exactly and a Golay index of the next one. Pairs that share a key are
verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, bounded_batches, gone_or_repeated, keep_rows, temporary, with_row_key, written
from .components import components

SEED = 42
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2
#: Members of a key that are compared pair by pair; larger groups are linked through shared one-bit neighbours.
PAIR_CAP = 24
#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 1 << 16


def _bit_sums(hashes: list[int]) -> np.ndarray:
    h = np.fromiter(hashes, dtype=np.uint64, count=len(hashes))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64; repeats count, no words give 0."""
    words = text.lower().split()  # bytes: A-Z only, and white space of ASCII
    n = len(words) - shingle + 1
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < 2:
        return digest(b" ".join(words), SEED)
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        joined = map(b" ".join, zip(*(part[k : len(part) - shingle + 1 + k] for k in range(shingle))))
        sums += _bit_sums(list(map(digest, joined, repeat(SEED))))
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, *, shingle: int = 3) -> DataFrame:
    """KEY, doc_id and fp (bigint, the bits as a signed number) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(4).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(fps.view(np.int64))], names=[*KEY, "doc_id", "fp"])

    rows = with_row_key(documents.select("doc_id", "text")).select(*KEY, F.col("doc_id").cast("bigint").alias("doc_id"), F.encode("text", "UTF-8").alias("t"))
    return rows.transform(bounded_batches).mapInArrow(run, ", ".join(f"{c} bigint" for c in (*KEY, "doc_id", "fp")))


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of 12 bits the error patterns of weight 4 at most (-1 fills), and the syndromes of the 24 bits.

    Built from the code's cyclic generator x^11+x^10+x^6+x^5+x^4+x^2+1 over 23
    bits and an overall parity bit.
    """
    gen = 0b110001110101

    def rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= gen << (k - 11)
        return word

    # Syndrome of bit k of 23: remainder, and one for parity; bit 23 is the parity bit.
    unit = np.array([rest(1 << k) << 1 | 1 for k in range(23)] + [1], dtype=np.int64)
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(24), weight):
            s = 0
            for k in bits:
                s ^= int(unit[k])
            old = found.setdefault(s, [])
            if not old or weight == 4 and old[0].bit_count() == 4:
                old.append(sum(1 << k for k in bits))
    errors = np.full((4096, 6), -1, dtype=np.int64)
    for s, patterns in found.items():
        errors[s, : len(patterns)] = patterns
    return errors, unit


def golay_keys(segment: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indices (12 bits, -1 fills) of the codewords within four bits of each 23-bit word with its parity bit."""
    errors, unit = tables
    word = segment.astype(np.int64)
    word |= (np.bitwise_count(word).astype(np.int64) & 1) << 23
    syndrome = np.zeros(len(word), dtype=np.int64)
    for k in range(24):
        syndrome ^= np.where(word >> k & 1, unit[k], 0)
    near = errors[syndrome]
    # The code is systematic in bits 11 to 22: they are a codeword's index.
    return np.where(near < 0, -1, ((word[:, None] ^ near) >> 11) & 4095)


def join_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: 2 bits of segment number, the exact segment, and a Golay index of the next segment."""
    cut = [(fps >> np.uint64(at)) & np.uint64((1 << bits) - 1) for at, bits in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        near = golay_keys(cut[(k + 1) % 3], tables)
        r, c = np.nonzero(near >= 0)
        rows.append(r)
        keys.append((np.int64(k) << 40) | (cut[k].astype(np.int64)[r] << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def links(nodes: DataFrame, *, pair_cap: int = PAIR_CAP) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp bigint, each once) that connect what lies MAX_BITS or fewer apart.

    Every pair in reach is linked, directly or through fingerprints that are
    also linked, so components are exact. Groups of a key over pair_cap are
    not paired: their members meet in shared neighbours one bit off, 65 rows
    each, as two fingerprints two bits apart have such a neighbour and any two
    that share one are at most two apart. That way takes over where keys
    (33 to 34 bits) hold more than pair_cap by chance, above some 8e10
    fingerprints; its cost a fingerprint does not grow.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for b in batches:
            rows, keys = join_keys(b.column(0).to_numpy().view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(keys)], names=["fp", "key"])

    keyed = nodes.select("fp").transform(bounded_batches).mapInArrow(expand, "fp bigint, key bigint")
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "golay-sizes")
    shared = written(keyed.join(sizes, "key"), "golay-keys")
    few = shared.where(F.col("n") <= pair_cap)
    x, y = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = x.join(y, "key").where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    many = shared.where(F.col("n") > pair_cap).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    around = written(many.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("x")), "golay-neighbours")
    stars = around.join(around.groupBy("x").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1"), "x").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def placed(rows: DataFrame, edges, node: str) -> DataFrame:
    """The rows (with doc_id and a node column) and their class and component_id, its smallest doc_id.

    Rows of one node are one however many; edges(nodes) links the distinct
    nodes. A class is a component's smallest node, so rows without an id take
    part like others, and an id that is given to several nodes joins none.
    """
    nodes = written(rows.groupBy(node).agg(F.min("doc_id").alias("first")), "near-nodes")
    comps = written(components(edges(nodes.select(node))), "near-components")
    of = nodes.join(comps.withColumnRenamed("node", node), node, "left").select(node, F.coalesce("component", node).alias("class"), "first")
    firsts = of.groupBy("class").agg(F.min("first").alias("component_id"))
    of = written(of.join(firsts, "class").select(node, "class", "component_id"), "near-classes", keep=True)
    return rows.join(of, node)


def near_dedup(documents: DataFrame, *, shingle: int = 3, pair_cap: int = PAIR_CAP) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable).

    Rows with equal fingerprints are one node, however many; only nodes are
    linked. Null texts count as empty (fingerprint 0, linked like any other).
    Each row of a repeated doc_id has the component of its own text: the id
    links no texts. Rows with a null doc_id are nodes and links like others,
    and where a component has no other id its component_id is null. Extra
    columns are not read. An empty table gives an empty result.
    """
    with temporary(documents.sparkSession):
        rows = written(fingerprints(documents, shingle=shingle), "simhash", keep=True)
        out = placed(rows, lambda nodes: links(nodes, pair_cap=pair_cap), "fp")
    return out.select("doc_id", "fp", "component_id")


def unique(documents: DataFrame, *, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """The documents of which exactly one stays for each component, with all columns: that with the smallest doc_id.

    Without a similarity, components are those of near_dedup. With one, texts
    are linked whose sets of shingles have that Jaccard similarity or more:
    Golay keys of several fingerprints a text retrieve them, the exact
    similarity decides, and MinHash bands go through the rest that no such key
    joins (similar.py). Decided by id and text: other texts of an id that goes are
    not touched. Rows without an id go where their component has another, and
    rows that repeat id and text are one document. An empty table gives an
    empty one.
    """
    from . import similar

    with temporary(documents.sparkSession):
        if similarity is None:
            rows = placed(written(fingerprints(documents, shingle=shingle), "simhash"), links, "fp")
        else:
            rows = similar.classes(documents, shingle=shingle, similarity=similarity)
        first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *KEY)).alias("w")
        groups = rows.groupBy("class").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
        stays = (F.col("k0__") == F.col("w.k0__")) & (F.col("k1__") == F.col("w.k1__")) & (F.col("k2__") == F.col("w.k2__"))
        known = written(gone_or_repeated(rows.join(groups, "class"), stays), "near-known", keep=True)
    return keep_rows(documents, known)
