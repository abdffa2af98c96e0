"""Graph operators over edge tables: adjacency, pair features, sketches, diffusion, search, splits.

Edges are rows (src, dst[, w]); an adjacency holds each edge in both
directions once. Joins are by node, so Spark shuffles on node ids and its
skew join splits hubs; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ranges import running
from ..shared import temporary, written

#: Modulus of the hash family h(x) = (a * x + b) mod P.
P = 2147483647
#: Stands for "no neighbour" in a sketch.
NO_HASH = 4294967295
#: Sketches that a task holds while their nodes' neighbours send theirs, in bytes; links gathered and sketches passed on at a time.
BLOCK_BYTES, GATHERED, SENT = 1 << 26, 1 << 15, 4096


def affine(x: Column, a: int, b: int) -> Column:
    """(a * (x mod P) + b) mod P, for a and b below P and any id."""
    p = F.lit(P).cast("bigint")
    return (F.lit(a).cast("bigint") * F.pmod(x.cast("bigint"), p) + F.lit(b).cast("bigint")) % p


def hash_family(k: int, seed: int = 1) -> list[tuple[int, int]]:
    """k pairs (a, b) with a in [1, P-2], b in [0, P-2], from a linear congruence on the seed."""
    out, x = [], seed
    for _ in range(k):
        x = (48271 * x + 11) % P
        a = 1 + x % (P - 2)
        x = (48271 * x + 11) % P
        out.append((a, x % (P - 1)))
    return out


#: Items of a group that co_occurrence takes; as it links each pair, twice as many make four times the edges.
MAX_GROUP = 10_000


def _groups(rows: DataFrame, group: str, item: str, max_group: int) -> DataFrame:
    """(items): the sorted different items of each group."""
    sets = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.collect_set(item).alias("items"))
    message = F.format_string(f"a group of %d items, more than {max_group}", F.size("items"))
    return sets.select(F.when(F.size("items") > max_group, F.raise_error(message)).otherwise(F.array_sort("items")).alias("items"))


def co_occurrence(rows: DataFrame, group: str, item: str, *, max_group: int = MAX_GROUP) -> DataFrame:
    """Undirected edges (src < dst, w): items that share a group, w groups in common.

    Every pair of a group is an edge by definition, so a group of more than
    max_group different items is an error, not a plan that never ends. One
    shuffle by group gathers its items, pairs are streamed from the array.
    """
    sets = _groups(rows, group, item, max_group)
    firsts = sets.select("items", F.posexplode("items").alias("at", "src")).select("src", F.slice("items", F.col("at") + 2, F.size("items")).alias("rest"))
    pairs = firsts.select("src", F.explode("rest").alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def co_occurrence_links(rows: DataFrame, group: str, item: str, *, max_group: int = MAX_GROUP) -> DataFrame:
    """The edges of co_occurrence in both directions (src, dst), repeated for each group and not shuffled: for minima, which repeats leave as they are."""
    ends = _groups(rows, group, item, max_group).select("items", F.explode("items").alias("src"))
    return ends.select("src", F.explode("items").alias("dst")).where("src <> dst")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges (src < dst) without self-loops."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def edges_since(edges: DataFrame, year: int = 2010, column: str = "year") -> DataFrame:
    return edges.where(F.col(column) >= year)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, duplicates kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): one row for each direction, weights of duplicates added (a self-loop counts twice)."""
    w = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    return symmetrize(w.select("src", "dst", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def degrees(adj: DataFrame) -> DataFrame:
    """(id, deg): distinct neighbours."""
    return adj.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))


def structural_features(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ten features of each pair (u, v): cn, aa, ra, log_pa, jaccard, wcn, cn_deg_sum, cn_deg_min, deg_i, deg_j.

    aa weighs a common neighbour by 1/ln(max(deg, 2)), ra by 1/max(deg, 1).
    Pairs without common neighbours keep their degrees; unknown nodes have 0.
    A pair is expanded from its endpoint of lower degree, so a hub's rows are
    only probed. The adjacency and the degrees are read several times and are
    written.
    """
    adj = written(adj.select("src", "dst", "w"), "adjacency")
    deg = written(degrees(adj), "degrees")
    both = (
        pairs.select("u", "v").join(deg.select(F.col("id").alias("u"), F.col("deg").cast("double").alias("deg_i")), "u", "left")
        .join(deg.select(F.col("id").alias("v"), F.col("deg").cast("double").alias("deg_j")), "v", "left").na.fill(0.0, ["deg_i", "deg_j"])
    )
    first = F.col("deg_i") <= F.col("deg_j")
    ends = both.select("u", "v", F.when(first, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("t")).distinct()
    near = adj.select(F.col("src").alias("s"), F.col("dst").alias("k"), F.col("w").alias("ws"))
    far = adj.select(F.col("src").alias("t"), F.col("dst").alias("k"), F.col("w").alias("wt"))
    by = deg.select(F.col("id").alias("k"), F.col("deg").cast("double").alias("dk"))
    common = (
        ends.join(near, "s").join(far, ["t", "k"]).join(by, "k")
        .groupBy("u", "v").agg(
            F.count(F.lit(1)).cast("double").alias("cn"), F.sum(1 / F.log(F.greatest("dk", F.lit(2.0)))).alias("aa"),
            F.sum(1 / F.greatest("dk", F.lit(1.0))).alias("ra"), F.sum(F.col("ws") * F.col("wt")).alias("wcn"),
            F.sum("dk").alias("cn_deg_sum"), F.min("dk").alias("cn_deg_min"),
        )
    )
    out = both.join(common, ["u", "v"], "left").na.fill(0.0, ["cn", "aa", "ra", "wcn", "cn_deg_sum", "cn_deg_min"])
    union = F.col("deg_i") + F.col("deg_j") - F.col("cn")
    out = out.withColumn("log_pa", F.log1p(F.col("deg_i") * F.col("deg_j"))).withColumn("jaccard", F.when(union > 0, F.col("cn") / union).otherwise(0.0))
    return out.select("u", "v", "cn", "aa", "ra", "log_pa", "jaccard", "wcn", "cn_deg_sum", "cn_deg_min", "deg_i", "deg_j")


def _packed(sketches: np.ndarray) -> pa.Array:
    """Rows of unsigned 32-bit numbers as binary values."""
    n, width = sketches.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(4 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sketches, dtype="<u4"))])


def _unpacked(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, k)


def _own_hashes(ids: np.ndarray, family: Sequence[tuple[int, int]]) -> np.ndarray:
    """affine of each id (int64) for each function: a sketch of hop 0."""
    rest, out = ids % P, np.empty((len(ids), len(family)), dtype=np.uint32)
    for j, (a, b) in enumerate(family):
        out[:, j] = (a * rest + b) % P
    return out


class _Least:
    """Minimum of the sketches that each id was sent, in memory; ids in `own` are nodes."""

    def __init__(self, k: int):
        self.ids, self.at = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)  # sorted, and their rows
        self.rows, self.own = np.empty((0, k), dtype=np.uint32), np.empty(0, dtype=bool)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct ids; new ones get a row."""
        where = np.searchsorted(self.ids, ids)
        known = np.zeros(len(ids), dtype=bool)
        inside = where < len(self.ids)
        known[inside] = self.ids[where[inside]] == ids[inside]
        new = ids[~known]
        if len(new):
            used = len(self.ids)
            if used + len(new) > len(self.rows):
                more = max(len(new), len(self.rows) // 2)
                self.rows = np.concatenate([self.rows, np.full((more, self.rows.shape[1]), NO_HASH, dtype=np.uint32)])
                self.own = np.concatenate([self.own, np.zeros(more, dtype=bool)])
            self.ids = np.insert(self.ids, where[~known], new)
            self.at = np.insert(self.at, where[~known], np.arange(used, used + len(new)))
            where = np.searchsorted(self.ids, ids)
        return self.at[where]

    def add(self, sketches: np.ndarray, lengths: np.ndarray, to: np.ndarray) -> None:
        """Sketch i goes to the next lengths[i] ids of `to`."""
        order = np.argsort(to, kind="stable")
        to, sent = to[order], np.repeat(np.arange(len(lengths)), lengths)[order]
        for k in range(0, len(to), GATHERED):
            ids, starts = np.unique(to[k : k + GATHERED], return_index=True)
            least, at = np.minimum.reduceat(sketches[sent[k : k + GATHERED]], starts, axis=0), self.places(ids)
            self.rows[at] = np.minimum(self.rows[at], least)


def messages(nodes: DataFrame, adj: DataFrame, *, k: int = 128) -> tuple[DataFrame, int]:
    """Who is sent whose sketch of k functions: (id, block, own, receivers), and the number of blocks.

    Nodes are dealt into blocks by stretches of ids, as many as a task holds
    sketches of in BLOCK_BYTES, and a node sends its sketch once to each block
    where it has neighbours, itself included (own, for nodes only). Links of
    unknown ids send nothing.
    """
    n = nodes.count()
    blocks = max(math.ceil(4 * k * n / BLOCK_BYTES), nodes.sparkSession.sparkContext.defaultParallelism)
    width = math.ceil(n / blocks) | 1
    block = lambda c: F.expr(f"pmod({c} div {width}, {blocks})")
    links = adj.select(F.col("dst").cast("bigint").alias("id"), F.col("src").cast("bigint").alias("src")).where("id is not null and src is not null")
    # Dealt by the sender alone first: lists are made after the one shuffle of the links, not sent in pieces. Sets, as links may repeat.
    near = links.repartition("id").groupBy("id", block("src").alias("block")).agg(F.collect_set("src").alias("receivers"))
    known = nodes.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct()
    near = near.join(known.hint("merge"), "id", "left_semi")
    own = known.select("id", block("id").alias("block"), F.lit(True).alias("own"), F.array("id").alias("receivers"))
    return near.select("id", "block", F.lit(False).alias("own"), "receivers").unionByName(own), blocks


def _a_task_each(spark: SparkSession, blocks: int) -> Column:
    """For each block (column block) a number that Spark deals to a partition of its own, of as many as there are blocks."""
    tried = spark.range(32 * blocks).select("id", F.pmod(F.hash("id"), F.lit(blocks)).alias("at")).groupBy("at").agg(F.min("id").alias("id"))
    found = {r["at"]: r["id"] for r in tried.collect()}
    return F.element_at(F.lit([found.get(b, b) for b in range(blocks)]).cast("array<bigint>"), F.col("block").cast("int") + 1)


def sketches(nodes: DataFrame, adj: DataFrame, *, hops: int = 2, family: Sequence[tuple[int, int]] | None = None) -> list[DataFrame]:
    """MinHash of closed neighbourhoods, for each hop: (id, s), s the minima of all functions as packed unsigned 32-bit numbers.

    Hop 0 hashes the node itself; each hop takes the minimum over the node
    and its neighbours. Sketches are sent by block, not by edge, and minima are
    taken in the task that holds the block: a hop shuffles the links and, of
    each sketch, as many copies as there are blocks at most. Those of hop 0 are
    made from the ids where they are needed. All joins are merges: sizes of
    sketches are guessed from the ids alone, and a broadcast would gather them
    in the driver.
    """
    family = hash_family(128) if family is None else family
    k, spark = len(family), nodes.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(_own_hashes(b.column(0).to_numpy(), family))], names=["id", "s"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Least(k)
        for b in batches:
            lists = b.column("receivers")
            to, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            held.add(_unpacked(b.column("s"), k) if "s" in b.schema.names else _own_hashes(b.column("id").to_numpy(), family), lengths, to)
            nodes_ = np.unique(b.column("id").filter(b.column("own")).to_numpy())
            held.own[held.places(nodes_)] = True
        at = held.at[held.own[held.at]]
        ids = held.ids[held.own[held.at]]
        for i in range(0, len(ids), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + SENT]), _packed(held.rows[at[i : i + SENT]])], names=["id", "s"])

    out = [nodes.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct().mapInArrow(hashed, "id bigint, s binary")]
    with temporary(spark):
        sent, blocks = messages(nodes, adj, k=k)
        sent, task = written(sent, "messages"), _a_task_each(spark, blocks)  # read at each hop
        for hop in range(hops):
            dealt = sent.join(out[-1].hint("merge"), "id").select("id", "block", "own", "receivers", "s") if hop else sent
            out.append(written(dealt.repartition(blocks, task).mapInArrow(least, "id bigint, s binary"), "sketches", keep=True))
    return out


def minhash(nodes: DataFrame, adj: DataFrame, *, hops: int = 2, family: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The sketches as numbers: id and columns s{hop}_{k}. A node without id has no hash and no neighbour."""
    family = hash_family(128) if family is None else family
    k, names = len(family), ["id", *(f"s{hop}_{j}" for hop in range(hops + 1) for j in range(len(family)))]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(k, dtype="<u4").tobytes(), *[np.full(k, NO_HASH, dtype="<u4").tobytes()] * hops]
        for b in batches:
            missing, columns = b.column(0).is_null().to_numpy(zero_copy_only=False), [b.column(0)]
            for hop in range(hops + 1):
                values = _unpacked(b.column(hop + 1).fill_null(none[hop]), k).astype(np.int64)
                columns += [pa.array(values[:, j], mask=missing if hop == 0 else None) for j in range(k)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = nodes.select("id")
    for hop, s in enumerate(sketches(nodes, adj, hops=hops, family=family)):
        rows = rows.join(s.withColumnRenamed("s", f"s{hop}").hint("merge"), "id", "left")
    return rows.mapInArrow(numbers, f"id {nodes.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in names[1:]))


def _cardinality(sketches: np.ndarray) -> np.ndarray:
    """Sizes of the sets behind MinHash values: K / sum(h / P) - 1, not below 0."""
    total = np.zeros(len(sketches))
    for j in range(sketches.shape[1]):
        total += sketches[:, j] / float(P)
    return np.maximum(sketches.shape[1] / np.maximum(total, 1e-9) - 1.0, 0.0)


def sketch_features(sketches: Sequence[DataFrame], pairs: DataFrame, family: Sequence[tuple[int, int]]) -> DataFrame:
    """c11, c12, c21, c22, i22, lcard2_i, lcard2_j of each pair, by inclusion and exclusion of hop intersections.

    sketches: of hops 0, 1 and 2; those of hop 0 are made anew from the ids instead of being sent. Neither pairs nor
    sketches are broadcast, as either grows with the nodes.
    """
    k, names = len(family), ["c11", "c12", "c21", "c22", "i22", "card_u2", "card_v2"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [_own_hashes(b.column(0).to_numpy(), family), _unpacked(b.column(2), k), _unpacked(b.column(3), k)]
            v = [_own_hashes(b.column(1).to_numpy(), family), _unpacked(b.column(4), k), _unpacked(b.column(5), k)]
            cu, cv, i = [*map(_cardinality, u)], [*map(_cardinality, v)], {}
            for p in range(3):
                for q in range(3):
                    same = (u[p] == v[q]).sum(axis=1) / float(k)
                    i[p, q] = np.maximum(same * (cu[p] + cv[q]) / (1 + same), 0.0)
            cells = [np.maximum(i[p, q] - i[p - 1, q] - i[p, q - 1] + i[p - 1, q - 1], 0.0) for p in (1, 2) for q in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, [*cells, i[2, 2], cu[2], cv[2]])], names=["u", "v", *names])

    both = sketches[1].withColumnRenamed("s", "s1").join(sketches[2].withColumnRenamed("s", "s2").hint("merge"), "id")
    # Written, so that no condition on pairs reaches the sketches: both ends read one shuffle of them.
    ends = written(pairs.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")), "pairs")
    for x in "uv":
        ends = ends.join(both.select(F.col("id").alias(x), F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2")).hint("merge"), x)
    out = ends.select("u", "v", "u1", "u2", "v1", "v2").mapInArrow(features, "u bigint, v bigint, " + ", ".join(f"{c} double" for c in names))
    return out.select("u", "v", "c11", "c12", "c21", "c22", "i22", F.log1p("card_u2").alias("lcard2_i"), F.log1p("card_v2").alias("lcard2_j"))


def normalized_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, val): both directions with multiplicity and a self-loop each; val = 1 / sqrt(deg src * deg dst)."""
    both = symmetrize(edges.select("src", "dst")).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    deg = both.groupBy(F.col("dst").alias("id")).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("d"))
    return (
        both.join(deg.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
        .select("src", "dst", (1 / F.sqrt("ds") * (1 / F.sqrt("dd"))).alias("val"))
    )


def diffuse(features: DataFrame, norm: DataFrame, hops: int = 2, *, checkpoint=None) -> list[DataFrame]:
    """[H, AH, ..., A^hops H] for features (id, numeric columns). checkpoint, if given, cuts lineage after each hop."""
    names = [c for c in features.columns if c != "id"]
    norm = written(norm, "norm")  # read at each hop
    out, now = [features], features
    for _ in range(hops):
        msg = norm.join(now.withColumnRenamed("id", "src"), "src")
        now = msg.groupBy(F.col("dst").alias("id")).agg(*(F.sum(F.col(c) * F.col("val")).alias(c) for c in names))
        now = checkpoint(now) if checkpoint else now
        out.append(now)
    return out


def hop_attention(hops: Sequence[DataFrame], logits: Sequence[float] | None = None) -> DataFrame:
    """Sum of the hops weighted by softmax of the logits (equal if none are given)."""
    logits = [0.0] * len(hops) if logits is None else logits
    top = max(logits)
    weights = [math.exp(x - top) for x in logits]
    names = [c for c in hops[0].columns if c != "id"]
    rows = [h.select("id", *((F.col(c) * F.lit(w / sum(weights))).alias(c) for c in names)) for h, w in zip(hops, weights)]
    total = rows[0]
    for r in rows[1:]:
        total = total.unionByName(r)
    return total.groupBy("id").agg(*(F.sum(c).alias(c) for c in names))


def hadamard(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Products of the two nodes' features: u, v and each feature column."""
    names = [c for c in features.columns if c != "id"]
    a = features.select(F.col("id").alias("u"), *(F.col(c).alias(f"a_{c}") for c in names))
    b = features.select(F.col("id").alias("v"), *(F.col(c).alias(f"b_{c}") for c in names))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", *((F.col(f"a_{c}") * F.col(f"b_{c}")).alias(c) for c in names))


def bfs_subgraph(adj: DataFrame, n: int) -> DataFrame:
    """(id, pos): the first n nodes of a breadth-first search from the node of highest degree (smallest id on ties).

    Neighbours are visited by ascending id, nodes leave the queue in the order
    they entered it. One round a level, until there are n nodes or no new
    ones; a level is ranked by its nodes only, of which at most n count. Each
    level is written, so the plan does not grow with them.
    """
    adj = written(adj.select("src", "dst"), "links")  # read at each level
    seen = written(degrees(adj).orderBy(F.desc("deg"), "id").limit(1).select("id", F.lit(0).cast("bigint").alias("pos")), "bfs")
    level, have = seen, seen.count()
    while have < n:
        near = level.join(adj.select(F.col("src").alias("id"), F.col("dst").alias("next")), "id").groupBy("next").agg(F.min("pos").alias("parent"))
        new = near.join(seen.select(F.col("id").alias("next")), "next", "left_anti").orderBy("parent", "next").limit(n - have)
        level = written(new.select(F.col("next").alias("id"), (F.row_number().over(W.orderBy("parent", "next")) + have - 1).cast("bigint").alias("pos")), "bfs")
        got = level.count()
        if not got:
            break
        seen, have = written(seen.unionByName(level), "bfs"), have + got
    return seen


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes, as dense indices (src_idx, dst_idx) by ascending id."""
    idx = running(nodes.select("id"), ["id"]).select("id", (F.col("rank") - 1).alias("idx"))
    return (
        edges.join(idx.select(F.col("id").alias("src"), F.col("idx").alias("src_idx")), "src").join(idx.select(F.col("id").alias("dst"), F.col("idx").alias("dst_idx")), "dst")
        .select("src_idx", "dst_idx")
    )


def known_edges(*splits: DataFrame) -> DataFrame:
    """The union of splits as canonical edges."""
    out = splits[0].select("src", "dst")
    for s in splits[1:]:
        out = out.unionByName(s.select("src", "dst"))
    return canonical_edges(out)


def sample_negatives(n_nodes: int, known: DataFrame, n: int, *, seed: tuple[int, int, int, int] = (16807, 7, 48271, 13)) -> DataFrame:
    """(k, u, v): the draws k = 0..n-1 of two affine-hashed ids in [0, n_nodes) that are neither equal nor a known edge."""
    a, b, c, d = seed
    spark = known.sparkSession
    draws = spark.range(n).select(F.col("id").alias("k"), (affine(F.col("id"), a, b) % n_nodes).alias("u"), (affine(F.col("id"), c, d) % n_nodes).alias("v")).where("u <> v")
    on = [F.least("u", "v") == F.col("src"), F.greatest("u", "v") == F.col("dst")]
    return draws.join(known, on, "left_anti")


def sample_hard_negatives(adj: DataFrame, n: int, *, seed: int = 1) -> DataFrame:
    """(k, u, v): n walks of two steps from a hashed start; start and end differ, real edges may occur.

    Neighbours are numbered by id and picked by hash modulo degree; starts
    are nodes with neighbours, numbered by id.
    """
    (a, b), (c, d), (e, f) = hash_family(3, seed)
    adj = written(adj.select("src", "dst"), "links")
    # By ranges of (src, dst), so a hub's neighbours are numbered by many tasks.
    numbered = running(adj, ["dst"], by=["src"]).select("src", "dst", (F.col("rank") - 1).alias("nth"))
    deg = written(degrees(adj), "degrees")
    order = running(deg, ["id"]).select("id", "deg", (F.col("rank") - 1).alias("rank"))
    total = deg.count()
    draws = adj.sparkSession.range(n).select(F.col("id").alias("k"), (affine(F.col("id"), a, b) % F.lit(max(total, 1))).alias("rank"))
    first = draws.join(order, "rank").select("k", F.col("id").alias("u"), (affine(F.col("k"), c, d) % F.col("deg")).alias("nth"))
    second = first.join(numbered.withColumnRenamed("src", "u"), ["u", "nth"]).select("k", "u", F.col("dst").alias("w"))
    third = second.join(deg.withColumnRenamed("id", "w"), "w").select("k", "u", "w", (affine(F.col("k"), e, f) % F.col("deg")).alias("nth"))
    return third.join(numbered.withColumnRenamed("src", "w"), ["w", "nth"]).select("k", "u", F.col("dst").alias("v")).where("u <> v")


def edge_split(edges: DataFrame, test: tuple[int, int] = (1, 10), valid: tuple[int, int] = (1, 20), *, seed: tuple[int, int, int] = (48271, 69621, 3)) -> DataFrame:
    """Canonical edges with split = test, valid or train: the first shares by floor, in the order of a hash."""
    a, b, c = seed
    h = (affine(F.col("src"), a, c) + affine(F.col("dst"), b, c)) % F.lit(P).cast("bigint")
    ranked = running(edges.select("src", "dst", h.alias("h")), ["h", "src", "dst"])
    n = F.col("total")
    n_test, n_valid = F.floor(n * test[0] / test[1]), F.floor(n * valid[0] / valid[1])
    name = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_valid, "valid").otherwise("train")
    return ranked.join(F.broadcast(ranked.agg(F.count(F.lit(1)).alias("total")))).select("src", "dst", name.alias("split"))


def message_graph(split: DataFrame) -> DataFrame:
    """Edges for evaluation: train and valid, each of weight 1."""
    return split.where(F.col("split").isin("train", "valid")).select("src", "dst", F.lit(1.0).alias("w"))


def build_context(links: DataFrame, vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rooms, edges): rooms (room, idx, emb) sorted by name with a zero vector where there is none; edges (u, v) by idx.

    links: from_room, to_room; vectors: room, emb.
    """
    names = links.select(F.col("from_room").alias("room")).union(links.select("to_room")).union(vectors.select("room")).distinct()
    idx = running(names.withColumn("name", F.col("room").cast("string")), ["name"]).select("room", (F.col("rank") - 1).alias("idx"))
    rooms = idx.join(vectors, "room", "left").withColumn("emb", F.coalesce("emb", F.array_repeat(F.lit(0.0).cast("float"), dim)))
    edges = links.join(idx.select(F.col("room").alias("from_room"), F.col("idx").alias("u")), "from_room").join(idx.select(F.col("room").alias("to_room"), F.col("idx").alias("v")), "to_room").select("u", "v")
    return rooms.select("room", "idx", "emb"), edges
