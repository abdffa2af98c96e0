"""Graph queries: parts that share an order are linked, weighted by the orders they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, read, rounded

FAMILY = graph.hash_family(8)
GRAPH = """
    lp AS MATERIALIZED (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem),
    und AS MATERIALIZED (SELECT a.i AS src, b.i AS dst, count(*)::DOUBLE AS w FROM lp a JOIN lp b ON a.g = b.g AND a.i < b.i GROUP BY 1, 2),
    adj AS MATERIALIZED (SELECT src, dst, w FROM und UNION ALL SELECT dst, src, w FROM und),
    deg AS MATERIALIZED (SELECT src AS id, count(*) AS deg FROM adj GROUP BY 1),
    pairs AS (SELECT p_partkey AS u, (48271 * p_partkey + 11) % 2147483647 % (SELECT count(*) FROM part) AS v FROM part WHERE p_partkey <> (48271 * p_partkey + 11) % 2147483647 % (SELECT count(*) FROM part))"""
NORM = """
    both_ AS (SELECT src, dst FROM adj UNION ALL SELECT p_partkey, p_partkey FROM part),
    nd AS (SELECT dst AS id, count(*)::DOUBLE AS d FROM both_ GROUP BY 1),
    norm AS (SELECT b.src, b.dst, 1 / sqrt(x.d) * (1 / sqrt(y.d)) AS val FROM both_ b JOIN nd x ON x.id = b.src JOIN nd y ON y.id = b.dst),
    h0 AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size FROM part),
    h1 AS (SELECT dst AS id, sum(price * val) AS price, sum(size * val) AS size FROM norm JOIN h0 ON h0.id = src GROUP BY 1),
    h2 AS (SELECT dst AS id, sum(price * val) AS price, sum(size * val) AS size FROM norm JOIN h1 ON h1.id = src GROUP BY 1)"""


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.co_occurrence(read(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


def part_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(part_edges(spark, sf))


def part_pairs(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("u"), (graph.affine(F.col("p_partkey"), 48271, 11) % part.count()).alias("v")).where("u <> v")


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def part_features(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))


@query(f"WITH {GRAPH} SELECT src, dst FROM und")
def canonical_edges(spark, sf):
    return graph.canonical_edges(part_edges(spark, sf))


@query(f"WITH {GRAPH} SELECT src, dst, w FROM adj")
def adjacency(spark, sf):
    return part_adjacency(spark, sf)


@query(f"WITH {GRAPH} SELECT id, deg FROM deg")
def degree(spark, sf):
    return graph.degrees(part_adjacency(spark, sf))


@query(
    f"""WITH {GRAPH},
    common AS (SELECT u, v, count(*)::DOUBLE AS cn, sum(1 / ln(greatest(d.deg, 2))) AS aa, sum(1.0::DOUBLE / greatest(d.deg, 1)) AS ra, sum(a.w * b.w) AS wcn, sum(d.deg)::DOUBLE AS cn_deg_sum, min(d.deg)::DOUBLE AS cn_deg_min
        FROM pairs p JOIN adj a ON a.src = p.u JOIN adj b ON b.src = p.v AND b.dst = a.dst JOIN deg d ON d.id = a.dst GROUP BY 1, 2),
    f AS (SELECT p.u, p.v, coalesce(cn, 0) AS cn, coalesce(aa, 0) AS aa, coalesce(ra, 0) AS ra, coalesce(wcn, 0) AS wcn, coalesce(cn_deg_sum, 0) AS cn_deg_sum, coalesce(cn_deg_min, 0) AS cn_deg_min, coalesce(x.deg, 0)::DOUBLE AS deg_i, coalesce(y.deg, 0)::DOUBLE AS deg_j
        FROM pairs p LEFT JOIN common c USING (u, v) LEFT JOIN deg x ON x.id = p.u LEFT JOIN deg y ON y.id = p.v)
    SELECT u, v, cn, round(aa, 6) AS aa, round(ra, 6) AS ra, round(ln(1 + deg_i * deg_j), 6) AS log_pa, round(CASE WHEN deg_i + deg_j - cn > 0 THEN cn / (deg_i + deg_j - cn) ELSE 0 END, 6) AS jaccard, wcn, cn_deg_sum, cn_deg_min, deg_i, deg_j FROM f"""
)
def pair_structural_features(spark, sf):
    return rounded(graph.structural_features(part_adjacency(spark, sf), part_pairs(spark, sf)))


_HASHES = ", ".join(f"({a} * p_partkey + {b}) % 2147483647 AS s0_{k}" for k, (a, b) in enumerate(FAMILY))


def _hop(h: int) -> str:
    mins = ", ".join(f"min(s{h - 1}_{k}) AS m{k}" for k in range(8))
    olds = ", ".join(f"g{h - 1}.s{j}_{k}" for j in range(h) for k in range(8))
    news = ", ".join(f"least(g{h - 1}.s{h - 1}_{k}, coalesce(m{k}, {graph.NO_HASH})) AS s{h}_{k}" for k in range(8))
    return f"n{h} AS (SELECT a.src AS id, {mins} FROM adj a JOIN g{h - 1} ON g{h - 1}.id = a.dst GROUP BY 1), g{h} AS (SELECT g{h - 1}.id, {olds}, {news} FROM g{h - 1} LEFT JOIN n{h} USING (id))"


SIGNATURES = f"g0 AS (SELECT p_partkey AS id, {_HASHES} FROM part), {_hop(1)}, {_hop(2)}"


@query(f"WITH {GRAPH}, {SIGNATURES} SELECT * FROM g2")
def minhash_sketch(spark, sf):
    return graph.minhash(part_nodes(spark, sf), part_adjacency(spark, sf), hops=2, family=FAMILY)


def _card(side: str, h: int) -> str:
    return f"greatest(8 / greatest({' + '.join(f'{side}.s{h}_{k} / 2147483647.0::DOUBLE' for k in range(8))}, 1e-9) - 1, 0)"


def _same(p: int, q: int) -> str:
    return "(" + " + ".join(f"(a.s{p}_{k} = b.s{q}_{k})::INTEGER" for k in range(8)) + ") / 8.0::DOUBLE"


_CARDS = ", ".join(f"{_card(s, h)} AS c{x}{h}" for s, x in (("a", "u"), ("b", "v")) for h in range(3))
_SAMES = ", ".join(f"{_same(p, q)} AS j{p}{q}" for p in range(3) for q in range(3))
_INTER = ", ".join(f"greatest(j{p}{q} * (cu{p} + cv{q}) / (1 + j{p}{q}), 0) AS i{p}{q}" for p in range(3) for q in range(3))
_CELLS = ", ".join(f"round(greatest(i{p}{q} - i{p - 1}{q} - i{p}{q - 1} + i{p - 1}{q - 1}, 0), 6) AS c{p}{q}" for p in (1, 2) for q in (1, 2))


@query(
    f"""WITH {GRAPH}, {SIGNATURES}, s AS (SELECT u, v, {_CARDS}, {_SAMES} FROM pairs JOIN g2 a ON a.id = u JOIN g2 b ON b.id = v), t AS (SELECT *, {_INTER} FROM s)
    SELECT u, v, {_CELLS}, round(i22, 6) AS i22, round(ln(1 + cu2), 6) AS lcard2_i, round(ln(1 + cv2), 6) AS lcard2_j FROM t"""
)
def sketch_features(spark, sf):
    sketches = graph.sketches(part_nodes(spark, sf), part_adjacency(spark, sf), hops=2, family=FAMILY)
    return rounded(graph.sketch_features(sketches, part_pairs(spark, sf), FAMILY))


# The same at the default of 128 functions, with a row for each function instead of a column.
_FULL = graph.hash_family(128)
_LONG = f"""
    fam AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a}::BIGINT, {b}::BIGINT)" for k, (a, b) in enumerate(_FULL))}) AS t(k, a, b)),
    z0 AS MATERIALIZED (SELECT p_partkey AS id, k, (a * p_partkey + b) % 2147483647 AS s FROM part, fam),
    z1 AS MATERIALIZED (SELECT id, k, min(s) AS s FROM (SELECT id, k, s FROM z0 UNION ALL SELECT src, k, s FROM adj JOIN z0 ON id = dst) GROUP BY 1, 2),
    z2 AS MATERIALIZED (SELECT id, k, min(s) AS s FROM (SELECT id, k, s FROM z1 UNION ALL SELECT src, k, s FROM adj JOIN z1 ON id = dst) GROUP BY 1, 2),
    z AS MATERIALIZED (SELECT id, k, z0.s AS s0, z1.s AS s1, z2.s AS s2 FROM z0 JOIN z1 USING (id, k) JOIN z2 USING (id, k)),
    card AS MATERIALIZED (SELECT id, {", ".join(f"greatest(128 / greatest(sum(s{h} / 2147483647.0::DOUBLE), 1e-9) - 1, 0) AS c{h}" for h in range(3))} FROM z GROUP BY 1)"""
_LONG_SAMES = ", ".join(f"sum((a.s{p} = b.s{q})::INTEGER) / 128.0::DOUBLE AS j{p}{q}" for p in range(3) for q in range(3))


@query(
    f"""WITH {GRAPH}, {_LONG}, j AS (SELECT u, v, {_LONG_SAMES} FROM pairs JOIN z a ON a.id = u JOIN z b ON b.id = v AND b.k = a.k GROUP BY 1, 2),
    s AS (SELECT j.*, x.c0 AS cu0, x.c1 AS cu1, x.c2 AS cu2, y.c0 AS cv0, y.c1 AS cv1, y.c2 AS cv2 FROM j JOIN card x ON x.id = u JOIN card y ON y.id = v), t AS (SELECT *, {_INTER} FROM s)
    SELECT u, v, {_CELLS}, round(i22, 6) AS i22, round(ln(1 + cu2), 6) AS lcard2_i, round(ln(1 + cv2), 6) AS lcard2_j FROM t"""
)
def sketch_features_full(spark, sf):
    links = graph.co_occurrence_links(read(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    sketches = graph.sketches(part_nodes(spark, sf), links, hops=2, family=_FULL)
    return rounded(graph.sketch_features(sketches, part_pairs(spark, sf), _FULL))


def _hops(spark, sf):
    norm = graph.normalized_adjacency(part_nodes(spark, sf), part_edges(spark, sf))
    return graph.diffuse(part_features(spark, sf), norm, 2)


@query(f"WITH {GRAPH}, {NORM} SELECT src, dst, round(val, 6) AS val FROM norm")
def normalized_adjacency(spark, sf):
    return rounded(graph.normalized_adjacency(part_nodes(spark, sf), part_edges(spark, sf)))


@query(f"WITH {GRAPH}, {NORM} SELECT h1.id, round(h1.price, 4) AS price_1, round(h1.size, 4) AS size_1, round(h2.price, 4) AS price_2, round(h2.size, 4) AS size_2 FROM h1 JOIN h2 USING (id)")
def diffuse_k2(spark, sf):
    _, one, two = _hops(spark, sf)
    out = one.withColumnsRenamed({"price": "price_1", "size": "size_1"}).join(two.withColumnsRenamed({"price": "price_2", "size": "size_2"}), "id")
    return rounded(out, 4)


@query(f"WITH {GRAPH}, {NORM}, x AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT id, round(sum(price) / 3, 4) AS price, round(sum(size) / 3, 4) AS size FROM x GROUP BY id")
def hop_attention(spark, sf):
    return rounded(graph.hop_attention(_hops(spark, sf)), 4)


@query(f"WITH {GRAPH}, {NORM} SELECT u, v, round(a.price * b.price, 4) AS price, round(a.size * b.size, 4) AS size FROM pairs JOIN h0 a ON a.id = u JOIN h0 b ON b.id = v")
def hadamard_pairs(spark, sf):
    return rounded(graph.hadamard(part_features(spark, sf), part_pairs(spark, sf)), 4)


_BFS = """
    q0 AS (SELECT id, 0::BIGINT AS pos FROM deg ORDER BY deg DESC, id LIMIT 1),
    l1 AS MATERIALIZED (SELECT dst AS id, row_number() OVER (ORDER BY dst) AS pos FROM q0 JOIN adj ON src = q0.id),
    q1 AS MATERIALIZED (SELECT * FROM q0 UNION ALL SELECT id, pos FROM l1),
    l2 AS MATERIALIZED (SELECT dst AS id, min(pos) AS parent FROM l1 JOIN adj ON src = l1.id WHERE dst NOT IN (SELECT id FROM q1) GROUP BY 1),
    q2 AS MATERIALIZED (SELECT id, pos FROM q1 UNION ALL SELECT id, (SELECT max(pos) FROM q1) + row_number() OVER (ORDER BY parent, id) FROM l2),
    sub AS MATERIALIZED (SELECT id, pos FROM q2 ORDER BY pos LIMIT 150)"""


@query(f"WITH {GRAPH}, {_BFS} SELECT id, pos FROM sub")
def bfs_subgraph(spark, sf):
    return graph.bfs_subgraph(part_adjacency(spark, sf), 150)


@query(
    f"""WITH {GRAPH}, {_BFS}, idx AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM sub)
    SELECT a.i AS src_idx, b.i AS dst_idx FROM und JOIN idx a ON a.id = src JOIN idx b ON b.id = dst"""
)
def induced_subgraph(spark, sf):
    return graph.induced_subgraph(part_edges(spark, sf), graph.bfs_subgraph(part_adjacency(spark, sf), 150))


SPLIT = """
    o AS (SELECT src, dst, row_number() OVER (ORDER BY ((48271 * src + 3) % 2147483647 + (69621 * dst + 3) % 2147483647) % 2147483647, src, dst) AS k, count(*) OVER () AS n FROM und),
    split AS (SELECT src, dst, CASE WHEN k <= n // 10 THEN 'test' WHEN k <= n // 10 + n // 20 THEN 'valid' ELSE 'train' END AS split FROM o)"""


@query(f"WITH {GRAPH}, {SPLIT} SELECT src, dst, split FROM split")
def edge_split(spark, sf):
    return graph.edge_split(graph.canonical_edges(part_edges(spark, sf)))


@query(f"WITH {GRAPH}, {SPLIT} SELECT src, dst, 1.0::DOUBLE AS w FROM split WHERE split IN ('train', 'valid')")
def message_graph(spark, sf):
    return graph.message_graph(graph.edge_split(graph.canonical_edges(part_edges(spark, sf))))


@query(
    f"""WITH {GRAPH}, d AS (SELECT k, (16807 * k + 7) % 2147483647 % (SELECT count(*) FROM part) AS u, (48271 * k + 13) % 2147483647 % (SELECT count(*) FROM part) AS v FROM (SELECT unnest(range(5000)) AS k))
    SELECT k, u, v FROM d WHERE u <> v AND NOT EXISTS (SELECT 1 FROM und WHERE src = least(u, v) AND dst = greatest(u, v))"""
)
def negatives_antijoin(spark, sf):
    return graph.sample_negatives(read(spark, sf, "part").count(), graph.canonical_edges(part_edges(spark, sf)), 5000)


_W = graph.hash_family(3)


@query(
    f"""WITH {GRAPH}, r AS MATERIALIZED (SELECT id, deg, row_number() OVER (ORDER BY id) - 1 AS rank FROM deg), nb AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS nth FROM adj),
    k AS MATERIALIZED (SELECT k, ({_W[0][0]} * k + {_W[0][1]}) % 2147483647 % (SELECT count(*) FROM deg) AS rank FROM (SELECT unnest(range(2000)) AS k)),
    a AS MATERIALIZED (SELECT k, id AS u, ({_W[1][0]} * k + {_W[1][1]}) % 2147483647 % deg AS nth FROM k JOIN r USING (rank)),
    b AS MATERIALIZED (SELECT k, u, dst AS w FROM a JOIN nb ON src = u AND nb.nth = a.nth),
    c AS MATERIALIZED (SELECT k, u, w, ({_W[2][0]} * k + {_W[2][1]}) % 2147483647 % deg AS nth FROM b JOIN deg ON id = w)
    SELECT k, u, dst AS v FROM c JOIN nb ON src = w AND nb.nth = c.nth WHERE u <> dst"""
)
def hard_negatives(spark, sf):
    return graph.sample_hard_negatives(part_adjacency(spark, sf), 2000)


_ORDERS = "SELECT o_custkey AS src, l_suppkey AS dst, year(o_orderdate)::INTEGER AS year FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _yearly(spark, sf):
    both = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.year("o_orderdate").alias("year"))


@query(f"SELECT src, dst, year FROM ({_ORDERS}) WHERE year >= 1996")
def edges_since(spark, sf):
    return graph.edges_since(_yearly(spark, sf), 1996)


@query(f"WITH e AS ({_ORDERS}) SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst")
def known_edges(spark, sf):
    e = _yearly(spark, sf)
    return graph.known_edges(e.where("year < 1996"), e.where("year >= 1996"))


@query(f"SELECT src, dst, year FROM ({_ORDERS}) UNION ALL SELECT dst, src, year FROM ({_ORDERS})")
def symmetrize(spark, sf):
    return graph.symmetrize(_yearly(spark, sf))


_ROOMS = """
    links AS (SELECT n_name AS from_room, r_name AS to_room FROM nation JOIN region ON n_regionkey = r_regionkey),
    vecs AS (SELECT r_name AS room, [r_regionkey::FLOAT, 1::FLOAT] AS emb FROM region),
    names AS (SELECT from_room AS room FROM links UNION SELECT to_room FROM links UNION SELECT room FROM vecs),
    idx AS (SELECT room, row_number() OVER (ORDER BY room) - 1 AS idx FROM names)"""


def _rooms(spark, sf):
    links = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("from_room"), F.col("r_name").alias("to_room"))
    vectors = read(spark, sf, "region").select(F.col("r_name").alias("room"), F.array(F.col("r_regionkey").cast("float"), F.lit(1.0).cast("float")).alias("emb"))
    return graph.build_context(links, vectors, 2)


@query(f"WITH {_ROOMS} SELECT idx.room, idx, coalesce(emb[1], 0)::DOUBLE AS e0, coalesce(emb[2], 0)::DOUBLE AS e1 FROM idx LEFT JOIN vecs ON vecs.room = idx.room")
def context_rooms(spark, sf):
    return _rooms(spark, sf)[0].select("room", "idx", F.col("emb")[0].cast("double").alias("e0"), F.col("emb")[1].cast("double").alias("e1"))


@query(f"WITH {_ROOMS} SELECT a.idx AS u, b.idx AS v FROM links JOIN idx a ON a.room = from_room JOIN idx b ON b.room = to_room")
def context_edges(spark, sf):
    return _rooms(spark, sf)[1]
