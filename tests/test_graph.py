"""Graph operators against brute force on a small random graph, and metamorphic cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from brightwell.operators import graph

N = 40


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(3)
    return sorted({tuple(sorted(rng.sample(range(N), 2))) for _ in range(120)})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src bigint, dst bigint")


def near(edges):
    out = {i: set() for i in range(N)}
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def test_structural_features(spark, edges):
    nb = near(edges)
    pairs = [(i, (i * 7 + 3) % N) for i in range(N)] + [(5, 1000)]
    adj = graph.adjacency(frame(spark, edges))
    got = {(r["u"], r["v"]): r for r in graph.structural_features(adj, spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    for u, v in pairs:
        a, b = nb[u], nb.get(v, set())
        c, r = a & b, got[u, v]
        assert (r["cn"], r["deg_i"], r["deg_j"], r["wcn"]) == (len(c), len(a), len(b), len(c))
        assert math.isclose(r["aa"], sum(1 / math.log(max(len(nb[k]), 2)) for k in c), abs_tol=1e-9)
        assert math.isclose(r["ra"], sum(1 / max(len(nb[k]), 1) for k in c), abs_tol=1e-9)
        assert math.isclose(r["jaccard"], len(c) / len(a | b) if a | b else 0, abs_tol=1e-9)
        assert r["cn_deg_min"] == min((len(nb[k]) for k in c), default=0)


def test_order_duplicates_and_direction_do_not_matter(spark, edges):
    other = [(b, a) for a, b in reversed(edges)] + edges[:10]
    a = graph.degrees(graph.adjacency(frame(spark, edges)))
    b = graph.degrees(graph.adjacency(frame(spark, other)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_weights_add_up_and_self_loops(spark):
    adj = graph.adjacency(spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (3, 3, 1.0)], "src bigint, dst bigint, w double"))
    assert {tuple(r) for r in adj.collect()} == {(1, 2, 3.0), (2, 1, 3.0), (3, 3, 2.0)}


def test_minhash(spark, edges):
    family, nb = graph.hash_family(4), near(edges)
    sig = graph.minhash(spark.range(N), graph.adjacency(frame(spark, edges)), hops=2, family=family)
    h = lambda x, k: (family[k][0] * x + family[k][1]) % graph.P
    for r in sig.collect():
        one = {r["id"]} | nb[r["id"]]
        two = one.union(*(nb[x] for x in one))
        for k in range(4):
            assert r[f"s1_{k}"] == min(h(x, k) for x in one)
            assert r[f"s2_{k}"] == min(h(x, k) for x in two)


def test_bfs(spark, edges):
    nb = near(edges)
    seed = max(range(N), key=lambda i: (len(nb[i]), -i))
    order, k = [seed], 0
    while k < len(order) and len(order) < 17:
        for v in sorted(nb[order[k]]):
            if v not in order and len(order) < 17:
                order.append(v)
        k += 1
    got = graph.bfs_subgraph(graph.adjacency(frame(spark, edges)), 17)
    assert [r["id"] for r in got.orderBy("pos").collect()] == order


def test_diffusion_and_attention(spark, edges):
    nodes = spark.range(N)
    h = nodes.select("id", F.col("id").cast("double").alias("x"))
    norm = graph.normalized_adjacency(nodes, frame(spark, edges))
    hops = graph.diffuse(h, norm, 2)
    deg = {i: len(s) + 1 for i, s in near(edges).items()}
    now = {i: float(i) for i in range(N)}
    total = dict(now)
    for hop in hops[1:]:
        now = {i: sum(now[j] / math.sqrt(deg[i] * deg[j]) for j in near(edges)[i] | {i}) for i in range(N)}
        assert all(math.isclose(r["x"], now[r["id"]], abs_tol=1e-9) for r in hop.collect())
        total = {i: total[i] + now[i] for i in range(N)}
    assert all(math.isclose(r["x"], total[r["id"]] / 3, abs_tol=1e-9) for r in graph.hop_attention(hops).collect())


def test_split_and_negatives(spark, edges):
    e = graph.canonical_edges(frame(spark, edges))
    split = {(r["src"], r["dst"]): r["split"] for r in graph.edge_split(e).collect()}
    assert set(split) == set(edges)
    assert list(split.values()).count("test") == len(edges) // 10
    assert list(split.values()).count("valid") == len(edges) // 20
    for r in graph.sample_negatives(N, e, 300).collect():
        assert r["u"] != r["v"] and tuple(sorted((r["u"], r["v"]))) not in set(edges)
    nb = near(edges)
    for r in graph.sample_hard_negatives(graph.adjacency(e), 100).collect():
        assert nb[r["u"]] & nb[r["v"]] and r["u"] != r["v"]


def test_context(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "from_room string, to_room string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 1.0])], "room string, emb array<float>")
    rooms, edges = graph.build_context(links, vectors, 2)
    assert [tuple(r) for r in rooms.orderBy("idx").collect()] == [("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 0.0]), ("c", 2, [0.0, 0.0]), ("z", 3, [0.0, 1.0])]
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)]
