"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends region, rack and shard. At each level every child draws
-ln(u) / weight with u a hash of row key and child in (0, 1), and the lowest
draw wins, so children are chosen in proportion to their weights and a child
whose weight rises takes rows only into its own subtree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranges import running
from .common import written

#: Hash values of a draw: 48 bits of an MD5.
SPACE = 1 << 48


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n: int) -> list[Shard]:
    """n shards of equal weight: up to eight in two regions of two racks of two, each further one in a region of its own.

    As a further shard is a new subtree, no other weight changes and it takes
    rows only into itself; inside a region that grew, rows would also move to
    its other shards.
    """
    return [Shard(s // 4, s % 4 // 2, s) if s < 8 else Shard(s - 6, 0, s) for s in range(n)]


def _draw(key: Column, node: str, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + node))), 1, 12), 16, 10).cast("double") + 0.5) / SPACE
    return -F.log(u) / weight


LEVELS = ("region", "rack", "shard")


def tree(shards: list[Shard]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level the inner nodes, by path, with their children (path, weight); nodes without weight are left out."""
    out: list[dict[str, list[tuple[str, float]]]] = []
    here: dict[str, list[Shard]] = {"": [s for s in shards if s.weight > 0]}
    if not here[""]:
        raise ValueError("no shard has a positive weight")
    for level in LEVELS:
        below: dict[str, list[Shard]] = {}
        nodes: dict[str, list[tuple[str, float]]] = {}
        for path, own in here.items():
            parts: dict[str, list[Shard]] = {}
            for s in own:
                parts.setdefault(f"{path}/{level}{getattr(s, level)}", []).append(s)
            nodes[path] = [(p, sum(s.weight for s in part)) for p, part in sorted(parts.items())]
            below |= parts
        out.append(nodes)
        here = below
    return out


def assign(df: DataFrame, shards: list[Shard], *, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """The rows with their shard. A null key draws like the text 'null'. No shuffle.

    One column a level, each from the one before, so that the plan has one
    draw for each node of the tree and a row makes those of its own way only.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    out = df.withColumn("node__", F.lit(""))
    for nodes in tree(shards):
        chosen = None
        for path, children in sorted(nodes.items()):
            if len(children) == 1:
                best = F.lit(children[0][0])
            else:
                best = F.least(*(F.struct(_draw(text, p, w).alias("d"), F.lit(p).alias("p")) for p, w in children))["p"]
            chosen = F.when(F.col("node__") == path, best) if chosen is None else chosen.when(F.col("node__") == path, best)
        out = out.withColumn("node__", chosen)
    return out.withColumn(column, F.regexp_extract("node__", "shard(-?[0-9]+)$", 1).cast("int")).drop("node__")


#: Rows that one step of slots() writes out for a group of equal rows.
CHUNK_ROWS = 1 << 14


def slots(df: DataFrame, *, shard: str = "shard", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add slot: the row's place in its shard from 0, by the order's columns (nulls first), then by the others.

    Not one sort for each shard: equal rows are counted first, so that no
    value fills a range by itself, the rest is ranked by ranges of all
    columns, and each row is given out as often as it was there, in pieces of
    CHUNK_ROWS that are dealt anew. df: few and narrow columns.
    """
    names = [shard, *order, *(c for c in df.columns if c not in (shard, *order))]
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n__"))
    ranked = running(counted, names[1:], by=[shard], value="n__").withColumn("first__", F.col("cum") - F.col("n__"))
    starts = F.explode(F.sequence(F.col("first__"), F.col("cum") - 1, F.lit(CHUNK_ROWS).cast("bigint"))).alias("at__")
    pieces = ranked.select(*names, "cum", starts)
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.repartition(tasks, shard, "at__")
    place = F.explode(F.sequence("at__", F.least(F.col("at__") + CHUNK_ROWS, F.col("cum")) - 1)).alias("slot")
    return dealt.select(*df.columns, place)


def place(documents: DataFrame, *, shards: list[Shard], grown: list[Shard]) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: doc_id and the topology decide. size is the text's UTF-8 bytes
    plus 1, null counting as none. Equal texts under different ids are
    different rows; rows that repeat a doc_id share its shard and get a slot
    each; a null doc_id is a key of its own. Only doc_id and text are read. An
    empty table gives an empty result.
    """
    t = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select("doc_id", (F.octet_length(t) + 1).cast("bigint").alias("size"), F.crc32(t).alias("text_crc32"))
    rows = written(assign(assign(rows, shards), grown, column="grown_shard"), "shards")
    return slots(rows, order=("doc_id", "text_crc32", "size")).withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
