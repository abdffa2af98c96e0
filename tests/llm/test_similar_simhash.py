"""The stage's links come from SimHash fingerprints and their Golay keys; MinHash is for the rest."""

import random
from collections import Counter

import pytest

from brightwell.llm import similar


def test_simhash_keys_retrieve(spark, monkeypatch):
    """Pairs at similarity 0.9: with MinHash keys that meet nowhere, those that a Golay key joins are linked, and nothing else is."""
    rng = random.Random(11)
    rows, both = [], []
    for _ in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        v = [*w]
        for at in (20, 90):
            v[at] = "new"
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
        both.append((len(rows) - 2, len(rows) - 1))
    monkeypatch.setattr(similar.Family, "keys", lambda self, shingles: shingles[:0].view("int64"))
    got = {r["doc_id"]: r["component_id"] for r in similar.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[a] == a and got[b] in (a, b) for a, b in both)
    assert sum(got[b] == a for a, b in both) >= 34


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm, none = spark._jvm, spark._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_keys_do_not_go_as_rows(spark):
    """Texts have some 220 keys each; none goes through the JVM as a row of its own, which filled an executor with aggregates of single keys."""
    rng = random.Random(12)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for k in range(1000)]
    before = shuffled_rows(spark)
    got = similar.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(k, k) for k in range(1000)]
    assert shuffled_rows(spark) - before < 30 * len(rows)


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_several_keys(spark, held, monkeypatch):
    """Keys that several rows have, against a count; one of them is in every row."""
    monkeypatch.setattr(similar, "HELD_KEYS", held)
    monkeypatch.setattr(similar, "BUCKET_KEYS", 1000)
    rng = random.Random(13)
    rows = [(bytes([k % 256, k // 256]), 9, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(k % 5)] + [rng.randrange(-9000, 9000) << 48 for _ in range(3)] + [-1]) for k in range(3000)]
    reps = spark.createDataFrame(rows, "d binary, n int, keys array<bigint>").repartition(7)
    want = {k for k, c in Counter(k for *_, keys in rows for k in keys).items() if c > 1}
    assert sorted(r["key"] for r in similar.several_keys(reps, similar.band_keyer, 6).collect()) == sorted(want) and len(want) > 1000
    of = Counter((bytes(r["d"]), r["key"]) for r in similar.shared_keys(reps, similar.band_keyer, 6).collect())
    every = Counter((d, k) for d, _, keys in rows for k in keys if k in want)
    assert of and all(every[x] == c for x, c in of.items())
