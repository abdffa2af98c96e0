"""Sketches of 128 functions: what they shuffle, and blocks against brute force."""

import random

import pytest

from brightwell.operators import graph
from brightwell.plans.catalog import ORACLE_SQL, QUERIES

from .conftest import DATA
from .oracle import compare, connect

FOLDER = DATA.replace("sf0.001", "sf0.01")


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_full_sketches_are_not_shuffled_by_edge(spark):
    """2000 parts of 2 KB of sketches, 116,000 links: a sketch a link would be 120 MB a hop."""
    before = shuffled(spark)
    got = QUERIES["sketch_features_full"](spark, FOLDER)
    assert got.count() == 2000
    assert shuffled(spark) - before < 30e6


@pytest.mark.parametrize("block_bytes", [1 << 26, 16 * 7])
def test_blocks_against_brute_force(spark, block_bytes, monkeypatch):
    """Negative and far ids, repeated links, a node of its own, links of unknown nodes, a node without id; blocks of 7 ids too."""
    monkeypatch.setattr(graph, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(graph, "GATHERED", 5)
    rng, family = random.Random(5), graph.hash_family(4)
    ids = [*range(-20, 20), 10**15, 2**31 + 5]
    edges = {tuple(rng.sample(ids[1:], 2)) for _ in range(70)}
    near = {i: {i} for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    adj = graph.symmetrize(spark.createDataFrame([*edges, *edges, (3, 777), (None, 4)], "src bigint, dst bigint"))
    nodes = spark.createDataFrame([(i,) for i in [*ids, None]], "id bigint")
    got = {r["id"]: r for r in graph.minhash(nodes, adj, family=family).collect()}
    assert set(got) == {*ids, None}
    for j, (a, b) in enumerate(family):
        s = [{i: (a * (i % graph.P) + b) % graph.P for i in ids}]
        for _ in range(2):
            s.append({i: min(s[-1][x] for x in near[i]) for i in ids})
        assert all(got[i][f"s{hop}_{j}"] == s[hop][i] for hop in range(3) for i in ids)
        assert [got[None][f"s{hop}_{j}"] for hop in range(3)] == [None, graph.NO_HASH, graph.NO_HASH]


def test_full_features_against_sql(spark):
    compare(QUERIES["sketch_features_full"](spark, DATA), connect(DATA), ORACLE_SQL["sketch_features_full"])


@pytest.mark.parametrize("name", ["sketch_features_full", "sketch_features", "minhash_sketch"])
def test_nothing_that_grows_with_nodes_is_broadcast(spark, name):
    """Sizes of sketches are guessed from the ids, so a broadcast of 1.2 million of them took 600 MB to the driver."""
    executions = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    waited = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    waited()
    before = executions().apply(executions().size() - 1).executionId() if executions().size() else -1
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()
    waited()
    ran = [e for k in range(executions().size()) if (e := executions().apply(k)).executionId() > before]
    plans = [e.physicalPlanDescription() for e in ran]
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastExchange" in p for p in plans)


def test_links_are_the_edges_both_ways(spark):
    """Repeated for each group, without an aggregate of pairs; the limit of a group holds."""
    rows = spark.createDataFrame([(1, 5), (1, 7), (1, 5), (2, 5), (2, 7), (2, -3), (3, 9), (None, 4), (4, None)], "g bigint, i bigint")
    got = sorted((r["src"], r["dst"]) for r in graph.co_occurrence_links(rows, "g", "i").collect())
    edges = [(r["src"], r["dst"]) for r in graph.co_occurrence(rows, "g", "i").collect() for _ in range(int(r["w"]))]
    assert got == sorted([*edges, *((b, a) for a, b in edges)]) and len(got) == 8
    with pytest.raises(Exception, match="a group of 3 items, more than 2"):
        graph.co_occurrence_links(rows, "g", "i", max_group=2).collect()
