"""Near copies against brute force over exact five-word shingles."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightwell.llm import similar, simhash

from ..conftest import DATA

SCHEMA = "doc_id bigint, text string, lang string, d string, n int, keys string, node bigint"


def brute(rows):
    """doc_id to the smallest of its component."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def rows():
    """Chains of edits, a large cluster, pairs on both sides of 0.8, short, empty and null texts."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    out = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (6, " ".join(text(20_000)))]
    out.append((7, f"{out[-1][1]} end"))
    for _ in range(12):
        w = text(rng.choice([30, 60, 200]))
        for _ in range(8):
            out.append((len(out), " ".join(w)))
            for _ in range(rng.choice([1, 1, 2])):
                w = [*w]
                w[rng.randrange(len(w))] = "new"
    w = text(150)
    out += [(len(out) + k, " ".join([*w[:k], "x", *w[k:]])) for k in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [1000, 4])
def test_against_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "STAR_ROWS", block)
    frame = spark.createDataFrame([(i, t, "en", "d", 1, "k", 2) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(frame).collect()}
    want = brute(rows)
    assert got == want and 1 < len(set(want.values())) < len(want)
    left = simhash.unique(frame.unionByName(frame.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))), shingle=5, similarity=0.8)
    assert left.columns == frame.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


def test_empty_and_repeated(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert similar.classes(frame).count() == 0
    twice = spark.createDataFrame([(8, "a b c d e f"), (8, "other words here"), (9, "A b c d e f"), (None, "a  b c d e f"), (None, "alone")], "doc_id bigint, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in similar.classes(twice).collect()), key=repr) == sorted([(8, 8), (8, 8), (9, 8), (None, 8), (None, None)], key=repr)
    left = simhash.unique(twice, shingle=5, similarity=0.8)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(8, "a b c d e f"), (8, "other words here"), (None, "alone")], key=repr)


def test_stage_drops_near_copies(spark):
    """On the tables: copies with a few words changed, 5 to 11 bits of 64 apart, do not pass the stage."""
    folder = DATA.replace("sf0.001", "sf0.01")
    exact = corpus_pipeline.exact_deduplication(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    rows = [(r["doc_id"], r["text"]) for r in exact.collect()]
    want = set(brute(rows).values())
    assert len(want) < len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, exact, folder).collect()} == want
