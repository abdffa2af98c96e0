"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from brightwell.llm import common, decontaminate, exact_dedup, licenses, line_dedup, quality, queries, rans, sentencepieces, sharding, simhash, token_files, warc
from brightwell.llm.components import components

from ..conftest import DATA
from ..oracle import compare, connect

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Also columns named like the operators' own.
SCHEMA = "doc_id bigint, text string, lang string, fp bigint, digest string, drop string, shard int, words string, t string, node bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x", "y", 99, "w", "t", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empties, ties, one very long text, repeated rows, case and white space."""
    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma", "Delta", "eps", "Été", "straße", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "This Line is shared by many documents, word for word, again."
    rows = [(0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "ONE"), (5, text(20_000)), (6, "İé Ü"), (7, "a\n\nb\n")]
    rows += [(10 + k, f"{text(6)}\n  {shared.upper() if k % 2 else shared}\t\n{text(4)}") for k in range(8)]
    rows += [(30, "same text"), (31, "same text"), (32, "Same Text"), (33, "same  text"), (33, "same  text")]
    rows += [(40 + k, text(60)) for k in range(12)]
    rows += [(60, rows[-1][1] + " tail"), (61, rows[-2][1])]
    rows += [(70, "one id, two texts, the first of them"), (70, "ONE"), (70, rows[10][1]), (None, "one"), (None, "alone here"), (None, "alone here")]
    return rows


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert exact_dedup.dedup(empty).count() == 0 and simhash.near_dedup(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0
    assert sharding.place(empty, shards=sharding.topology(8), grown=sharding.topology(9)).count() == 0
    assert token_files.round_trip(empty, queries.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert sentencepieces.digests(empty, queries.tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert licenses.scan(empty).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.search(empty, bench).count() == 0
    some = docs(spark, [(1, "a b"), (None, None)])
    assert decontaminate.search(some, bench).count() == 0 and decontaminate.clean(some, bench).count() == 2
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.classify(some, labels).collect()} == {0.5}
    with pytest.warns(UserWarning, match="all documents are accepted"):
        assert quality.accepted(some, labels).count() == 2
    assert exact_dedup.unique(empty).count() == 0 and simhash.unique(empty).count() == 0 and simhash.unique(empty, shingle=5, similarity=0.8).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_quality_held_out(spark):
    folder = DATA.replace("0.001", "0.01")
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.classify(documents, labels)
    assert got.count() == documents.count()
    held = got.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.93 * len(held)
    kept = {r["doc_id"] for r in quality.accepted(documents, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in got.where("predicted = 1").select("doc_id").collect()}


def test_quality_odd_rows(spark, odd_rows):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40, 52)] + [(None, 1, 0), (41, 0, 0), (42, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = [*odd_rows, (None, "no id")]
    out = quality.classify(docs(spark, rows), labels).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] in (True, False) for r in out)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    # Each row by its own text, and the same texts alike.
    by_text = {}
    model = quality.fit(docs(spark, rows), quality.training_labels(labels))
    for r in quality.score(docs(spark, rows).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), model).collect():
        by_text.setdefault(r["doc_id"], []).append(r["score"])
    assert len(set(by_text[70])) > 1
    kept = quality.accepted(docs(spark, rows), labels)
    assert kept.columns == docs(spark, []).columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    of = model.scorer()
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted((r for r in rows if of((r[1] or "").encode()) >= 0.7), key=key)


def test_quality_brute_force(spark):
    """Scores from the two dictionaries and the weights by definition; labels that are held out change none."""
    rng = random.Random(4)
    good, bad = ["river", "stone", "window", "garden", "letter", "morning"], ["win", "free", "click", "cash", "now", "bonus"]
    make = lambda ws, n: " ".join(rng.choice(ws) + str(rng.randrange(30)) for _ in range(n))
    rows = [(k, make(good if k % 2 else bad, rng.choice([40, 300]))) for k in range(160)]
    labels = [(k, k % 2, 0) for k in range(160)]
    frame = lambda ls: spark.createDataFrame(ls, "doc_id bigint, quality int, toxic int")
    held = {k for k in range(160) if zlib.crc32(str(k).encode()) % 4 == 2}
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs(spark, rows), frame(labels)).collect()}
    turned = [(k, 1 - q if k in held else q, t) for k, q, t in labels]
    assert got == {r["doc_id"]: r["score"] for r in quality.classify(docs(spark, rows), frame(turned)).collect()}
    assert sum((got[k] >= 0.5) == (k % 2 == 1) for k in held) >= 0.95 * len(held)
    model = quality.fit(docs(spark, rows), quality.training_labels(frame(labels)))

    def cost(text, raw):
        own = zstandard.ZstdCompressionDict(raw)
        small = lambda b: len(zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False).compress(b))
        return sum(small(text[i : i + 2048]) - small(b"") + 1 for i in range(0, len(text), 2048))

    for k, t in rows[:40]:
        b = t.encode()
        to_good, to_bad = cost(b, model.good), cost(b, model.bad)
        plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        alone = sum(len(plain.compress(b[i : i + 2048])) - len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(model.good), write_content_size=False, write_dict_id=False, write_checksum=False).compress(b"")) + 1 for i in range(0, len(b), 2048))
        d, ratio = (to_bad - to_good) / (to_bad + to_good), min(1.0, alone / len(b))
        w = model.weights
        z = w[0] + w[1] * 10 * d + w[2] * 100 * d * abs(d) + w[3] * 3 * ratio + w[4] * 10 * max(0.0, 0.25 - ratio)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_sample_is_not_starved(spark):
    """Labels of documents that are not at hand take no places in the sample."""
    rows = [(k, ("good words of a river " if k % 2 else "bad cash bonus click ") * (3 + k % 5)) for k in range(100)]
    labels = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs(spark, rows), quality.training_labels(labels), rows=50)
    assert model.fitted
    assert 0 < quality.accepted(docs(spark, rows), labels).count() < 100


def lowered(t):
    return (t or "").translate(UPPER)


@pytest.mark.parametrize(("digest_bytes", "fan"), [(32, 32), (32, 2), (1, 4)])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, odd_rows, keep, digest_bytes, fan, monkeypatch):
    """With one byte of digest different texts share one, which the byte comparison must tell; a small fan takes several levels."""
    monkeypatch.setattr(common, "DEAL_ROWS", 2)
    rows = odd_rows
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    got = exact_dedup.dedup(docs(spark, rows), keep=keep, digest_bytes=digest_bytes, memtable=5, fan=fan).collect()
    want = []
    for i, t in rows:
        own = groups[lowered(t)]
        ids = [x for x in own if x is not None]
        best = (min if keep == "min" else max)(ids) if ids else None
        want.append((i, best, len(own), i == best, hashlib.sha256(lowered(t).encode()).digest()[:digest_bytes]))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_unique(spark, odd_rows, keep, monkeypatch):
    """Each text once, under the id that stays; no text is lost with an id, none stays twice."""
    monkeypatch.setattr(common, "DEAL_ROWS", 2)
    rows = [(1, "x"), (1, "y"), (2, "x"), (7, "Q"), (7, "q"), *((100 + k, t) for k, (_, t) in enumerate(odd_rows)), *odd_rows]
    left = exact_dedup.unique(docs(spark, rows), keep=keep)
    assert left.columns == docs(spark, []).columns
    got = sorted(lowered(r["text"]) for r in left.collect())
    assert got == sorted({lowered(t) for _, t in rows})
    ids = {}
    for i, t in rows:
        if i is not None:
            ids.setdefault(lowered(t), []).append(i)
    for r in left.collect():
        own = ids.get(lowered(r["text"]))
        assert r["doc_id"] == ((min if keep == "min" else max)(own) if own else None)


def test_exact_index(spark, odd_rows):
    """Look-ups in runs of level 0 and in the merged run; a damaged file is told."""
    _, files = exact_dedup.flush_runs(docs(spark, odd_rows), memtable=4)
    assert files.count() > 8
    digest = lambda t: bytearray(hashlib.sha256(t).digest())
    asked = spark.createDataFrame([(digest(b"same text"),), (digest(b"one"),), (digest(b"no such text"),)], "d binary")
    found = exact_dedup.lookup(files, asked).collect()
    assert sum(r["group_size"] for r in found if bytes(r["digest"]) == digest(b"same text")) == 3
    merged = exact_dedup.compact(files, fan=2, file_entries=3)
    assert merged.count() > 4
    assert merged.agg(F.countDistinct("run")).first()[0] == 1
    assert {(bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in exact_dedup.lookup(merged, asked).collect()} == {(bytes(digest(b"same text")), 30, 3), (bytes(digest(b"one")), 3, 4)}
    every = exact_dedup.entries(merged).collect()
    assert sum(r["group_size"] for r in every) == len(odd_rows) and len(every) == len({lowered(t) for _, t in odd_rows})
    path = merged.first()["path"].removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(-exact_dedup.struct.calcsize(exact_dedup.Run.FOOTER) - 1, 2)
        f.write(b"\x00\x00")
    with pytest.raises(ValueError):
        exact_dedup.Run(f"file://{path}")


def test_key_filter(spark):
    """No key is missed at any size; a filter that is far too small lets all through."""
    from brightwell.llm.common import key_filter

    keys = spark.range(0, 5000).select(F.xxhash64("id").alias("k"))
    others = spark.range(5000, 25_000).select(F.xxhash64("id").alias("k"))
    for size, most in ((1 << 24, 0.02), (512, 1.0)):
        test = key_filter(keys, max_bytes=size)
        assert keys.where(~test(F.col("k"))).count() == 0
        assert others.where(test(F.col("k"))).count() <= most * 20_000 + 1
    assert others.where(key_filter(keys.limit(0))(F.col("k"))).count() == 0


def reference_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes_of(nodes, linked):
    """Class of each node (its smallest node) by brute force."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = list(nodes)
    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a], nodes[b]):
                x, y = sorted((find(nodes[a]), find(nodes[b])))
                root[y] = x
    return {n: find(n) for n in nodes}


def near_bits(a, b):
    return (a ^ b).bit_count() <= 2


def test_simhash(spark, odd_rows):
    """Each row by its own text; ids that repeat link nothing, rows without an id link like others."""
    chain = [(201, 0b1111), (None, 0b111111), (203, 0b11111111)]
    rows = [*odd_rows, (202, "one two three four"), (202, "four three two one"), (None, "one two three four")]
    fps = [reference_fingerprint(t) for _, t in rows]
    of = classes_of(set(fps), near_bits)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[of[f]] = min(i, first.get(of[f], i))
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_dedup(docs(spark, rows)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(((i, f, first.get(of[f])) for (i, _), f in zip(rows, fps)), key=key)
    placed = simhash.placed(spark.createDataFrame(chain, "doc_id bigint, fp bigint"), simhash.links, "fp")
    assert {r["component_id"] for r in placed.collect()} == {201}
    left = simhash.unique(docs(spark, rows)).collect()
    assert sorted(of[reference_fingerprint(r["text"])] for r in left) == sorted(set(of.values()))
    assert all(r["doc_id"] == first.get(of[reference_fingerprint(r["text"])]) for r in left)


def test_unique_loses_no_text(spark):
    a, b = "the first text of this id with some words", "quite another one that nothing else is like at all"
    for options in ({}, {"shingle": 5, "similarity": 0.8}):
        left = simhash.unique(docs(spark, [(1, a), (5, a), (5, b), (5, b)]), **options)
        assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, a), (5, b)]


@pytest.mark.parametrize("cap", [1, 24])
def test_simhash_links(spark, cap):
    """Clusters of flips around centres, with chains; groups over the cap take the other way."""
    rng = random.Random(5)
    fps = {0, 1, 3, 7, 15}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            fps.add(f)
            f = (f if rng.random() < 0.7 else rng.choice(sorted(fps))) ^ (1 << rng.randrange(64)) ^ ((1 << rng.randrange(64)) if rng.random() < 0.6 else 0)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes, pair_cap=cap)).collect()}
    assert {f: got.get(f, f) for f in signed} == classes_of(signed, lambda a, b: near_bits(a & (2**64 - 1), b & (2**64 - 1)))


def test_golay_keys_meet():
    """Words of 23 bits up to two bits apart share a key."""
    rng = np.random.default_rng(1)
    tables = simhash.golay_tables()
    a = rng.integers(0, 1 << 23, 4000)
    for flips in (0, 1, 2):
        b = a.copy()
        for k in range(len(b)):
            for bit in rng.choice(23, flips, replace=False):
                b[k] ^= 1 << int(bit)
        x, y = simhash.golay_keys(a, tables), simhash.golay_keys(b, tables)
        assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(x, y))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in root}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def test_ascii_lower(spark):
    """Every character that str.lower() changes, alone and between others."""
    from brightwell.llm.common import ascii_lower

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).lower() != chr(c)] + list("éßµ你😀ⅷ")
    texts = [t for c in chars for t in (c, f"Ab{c}Z", f"{c} plain")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_lower(F.col("t")).alias("x")).collect()
    assert all(r["x"] == r["t"].translate(UPPER) for r in got) and len(got) == len(texts)


def test_line_dedup(spark, odd_rows):
    shared = "This Line is shared by many documents, word for word, again."
    rows = [*odd_rows, (16, f"another text of an id\n{shared}"), (17, "other\n\n" + shared), (None, shared), (5000, "long\n" * 30_000 + shared)]
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders.setdefault(key(line), set()).add(i)
    out = line_dedup.dedup_lines(docs(spark, rows))
    assert out.columns == [*docs(spark, []).columns, "n_lines", "n_dropped"]
    want, dropped = [], 0
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i)]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
        dropped += len(lines) - len(kept)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=order) == sorted(want, key=order)
    assert dropped >= 10
    assert {r["drop"] for r in out.collect()} == {"y"}


def drawn(key, shards):
    """A shard by the tree's definition: at each level the child with the lowest -ln(u) / weight."""
    path, own = "", list(shards)
    for level in ("region", "rack", "shard"):
        parts = {}
        for s in own:
            parts.setdefault(f"{path}/{level}{getattr(s, level)}", []).append(s)
        u = lambda p: (int(hashlib.md5(f"{key}/{p}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        path = min(parts, key=lambda p: -np.log(u(p)) / sum(s.weight for s in parts[p])) if len(parts) > 1 else next(iter(parts))
        own = parts[path]
    return own[0].shard


def test_sharding(spark, odd_rows):
    rows = [*odd_rows, (None, "no id"), *((k, f"text {k}") for k in range(900, 1300))]
    got = sharding.place(docs(spark, rows), shards=sharding.topology(8), grown=sharding.topology(9)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
        name = "null" if r["doc_id"] is None else r["doc_id"]
        assert (r["shard"], r["grown_shard"]) == (drawn(name, sharding.topology(8)), drawn(name, sharding.topology(9)))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and 8 in {r["grown_shard"] for r in got}
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    texts = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=order)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=order) == texts


def test_slots_of_a_hot_key(spark, monkeypatch):
    """Rows of one id, alike or not, and rows without one are dealt over tasks and get places without gaps."""
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 100)
    df = spark.createDataFrame([(None, 0, 1, 5)] * 1234 + [(7, 0, k % 40, 5) for k in range(1000)] + [(k, 1, k, 5) for k in range(50)], "doc_id bigint, shard int, size int, other int")
    got = sharding.slots(df, order=("doc_id", "size"))
    rows = got.collect()
    assert sorted(r["slot"] for r in rows if r["shard"] == 0) == list(range(2234))
    ordered = sorted((r for r in rows if r["shard"] == 0), key=lambda r: r["slot"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0, r["size"]) for r in ordered] == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"]) for r in ordered)


def test_sharding_by_weight(spark):
    """Shares follow the weights; a changed weight moves rows only into or out of its subtree."""
    base = [sharding.Shard(0, 0, 0, 1), sharding.Shard(0, 1, 1, 2), sharding.Shard(1, 0, 2, 3), sharding.Shard(1, 0, 3, 2), sharding.Shard(1, 1, 4, 0)]
    more = [s if s.shard != 3 else sharding.Shard(1, 0, 3, 4) for s in base]
    df = sharding.assign(sharding.assign(spark.range(20_000).withColumnRenamed("id", "doc_id"), base), more, column="then")
    share = {r["shard"]: r["count"] / 20_000 for r in df.groupBy("shard").count().collect()}
    assert 4 not in share
    for s in base[:4]:
        assert abs(share[s.shard] - s.weight / 8) < 0.015
    moved = df.where("shard <> then").select("then").distinct().collect()
    assert {r["then"] for r in moved} <= {2, 3}  # the rack whose weight rose
    df.unpersist()


def test_sentencepiece(spark, odd_rows):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    alphabet = "abe tion \n▁  \t<s>é你\x00\r😀'-=# "
    rows = [*odd_rows, *((100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for k in range(300))]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sentencepieces.encode_decode(docs(spark, rows), path).collect()
    want = sorted(((i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in rows), key=order)
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=order) == want
    digests = sentencepieces.digests(docs(spark, rows), path).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    made = sorted(((i, len(ids), sha(",".join(map(str, ids))), sha(text)) for i, ids, text in want), key=order)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests), key=order) == made


def test_sentencepiece_decodes_any_ids():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        decode = sentencepieces.PieceModel(f.read()).decoder()
    rng = random.Random(9)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(9))]
        assert decode(ids) == sp.decode(ids)


def test_token_files(spark, odd_rows, tmp_path, monkeypatch):
    """Blocks of 40 ids: documents go over blocks and stretches, and are put together again."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*odd_rows, (80, "It's 12 o'CLOCK!! <|endoftext|> é Ⅷ ½ İstanbul ſ")]
    tokens = token_files.written(token_files.tokenize(docs(spark, rows), path), "t")
    table = token_files.frequencies(tokens)
    for block in (1 << 18, 40):
        monkeypatch.setattr(token_files, "BLOCK_IDS", block)
        folder = tmp_path / str(block)
        folder.mkdir()
        blocks = token_files.written(token_files.write(tokens, table, str(folder), file_ids=500), "b")
        assert blocks.count() > 2
        got = token_files.read(blocks, table.to_bytes()).collect()
        want = []
        for i, t in rows:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=order) == sorted(want, key=order)
        at = 0
        by_start = sorted(got, key=lambda r: r["start"])
        for r in by_start:
            assert r["start"] == at
            at += r["n_tokens"]
        assert [r["doc_id"] or -1 for r in by_start] == sorted(r["doc_id"] or -1 for r in got)
        files = {r["path"] for r in blocks.collect()}
        crc = zlib.crc32(table.to_bytes())
        whole = 0
        for name in files:
            with open(name.removeprefix("file:"), "rb") as f:
                whole += sum(ends for _, _, ends in token_files.read_file(f, rans.Coder(table), crc))
        assert whole == len(rows)
    assert token_files.round_trip(docs(spark, rows), path).count() == len(rows)


def test_words_are_the_librarys():
    """The cut of plain texts against the library: every character of PLAIN alone, beside letters, digits, marks and quotes, and random strings."""
    with open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        data = f.read()
    t = token_files.WordTokenizer(data)
    assert t.plain("abc") and not t.plain("Ω")
    chars = [chr(c) for c in range(0x100) if token_files.PLAIN.fullmatch(chr(c))]
    assert len(chars) > 150
    texts = [x for c in chars for x in (c, f"a{c}b", f"1{c}2", f"!{c}?", f" {c} ", f"it'{c}", f"'{c}e x", f"{c}{c}{c}")]
    rng = random.Random(6)
    texts += ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcIRLMDVSrlmdvst'’ \n0123.,-É") for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    for x, got in zip(texts, t.library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(t.ids(x), "<u2").tolist() == got.ids, x


def test_crc_of_parts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4, 1000, 70_000):
        x, y = rng.bytes(37), rng.bytes(n)
        assert token_files.crc32_joined(zlib.crc32(x), zlib.crc32(y), n) == zlib.crc32(x + y)


def test_long_documents_span_blocks(monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 100)
    rng = np.random.default_rng(4)
    texts = [(None, 3), (1, 450), (2, 1), (3, 100), (4, 99)]
    raw = [(i, rng.integers(0, 50, n).astype("<u2").tobytes()) for i, n in texts]
    table = rans.Table.of(np.ones(50))
    crc = zlib.crc32(table.to_bytes())
    parts, placed = token_files._file(rans.Coder(table), crc, raw)
    assert sum(p[2] for p in placed) == 653 and sum(p[3] for p in placed) == 5
    (tmp_path / "f").write_bytes(b"".join(parts))
    found = {}
    with open(tmp_path / "f", "rb") as f:
        for i, ids, _ in token_files.read_file(f, rans.Coder(table), crc):
            found[i] = found.get(i, b"") + ids.astype("<u2").tobytes()
    assert found == dict(raw)


@pytest.mark.parametrize(("n", "size"), [(0, 5), (1, 1), (63, 3), (5000, 300), (300_000, 40_000)])
def test_rans(n, size):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, size - 1).astype(np.int64)
    table = rans.Table.from_bytes(rans.Table.of(np.bincount(ids, minlength=size)).to_bytes())
    coder = rans.Coder(table)
    block = coder.encode(ids, check_steps=16)
    assert (coder.decode(block) == ids).all()
    marks = struct.unpack_from("<IIII", block, 16)[3]
    assert rans.stretches(n, check_steps=16) == (marks + 1, 16 * rans.lanes_of(n))
    parts = [coder.decode(block, k, k + 1) for k in range(marks)] + [coder.decode(block, marks)]
    assert (np.concatenate(parts) == ids).all()
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))
    if n > 1000:
        p = np.bincount(ids) / n
        assert len(coder.encode(ids)) * 8 < n * (-(p[p > 0] * np.log2(p[p > 0])).sum()) * 1.1 + 60_000


def test_warc(spark, tmp_path):
    big = "y" * 100
    rows = [(1, "http://a/é\n%41", "x" * 99), (2, None, "x" * 99), (3, "u", big), (4, "u", big), (None, "u", big), (5, "u", None), (6, "u", ""), (7, "u", "long " * 60_000), (3, "v", big)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, digest int, payload string")
    files = warc.write(pages, str(tmp_path), file_bytes=500)
    got = warc.read(files, payloads=True).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = []
    for i, u, h in rows:
        p = (h or "").encode()
        again = len(p) >= 100 and h == big and i != 3
        want.append((i, u, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", 3 if again else None, b"" if again else p))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert warc.round_trip(pages).count() == len(rows)
    wrong = spark.createDataFrame([(1, 200, "d", "response", None), (2, 200, "e", "revisit", 1)], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    with pytest.raises(Exception, match="page 1 is no response"):
        warc.checked(wrong).collect()


def test_warc_checks(tmp_path):
    payload = b"<p>hello</p>"
    good = warc.record(5, "u", payload, hashlib.sha256(payload).hexdigest(), None, False)
    assert warc.parse(good)[6] == payload
    for bad in (good[:-5], good.replace(b"hello", b"jello"), good.replace(b"Content-Length: 12", b"Content-Length: 13"), b"WARC/1.0" + good[8:], good.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    whole = tmp_path / "a"
    for data, ok in ((warc.dictionary_frame(b"") + frame + frame, True), (frame, False), (warc.dictionary_frame(b"") + frame[:-3], False), (b"", False)):
        whole.write_bytes(data)
        with open(whole, "rb") as f:
            if ok:
                assert list(warc.read_records(f)) == [good, good]
            else:
                with pytest.raises(warc.WarcError):
                    list(warc.read_records(f))
    # a compressed dictionary in the leading frame
    texts = [f"record {k} of the sample, with words {k * 7}".encode() * 3 for k in range(200)]
    raw = zstandard.train_dictionary(2048, texts).as_bytes()
    framed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(good)
    whole.write_bytes(warc.dictionary_frame(zstandard.ZstdCompressor().compress(raw)) + framed)
    with open(whole, "rb") as f:
        assert list(warc.read_records(f)) == [good]


def test_licenses(spark, odd_rows):
    filler = "lorem ipsum dolor sit amet consectetur " * 30
    long = licenses.TEMPLATES[2][2]
    cut = " ".join(long.split()[:-4])
    rows = [*odd_rows, (100, "Released under the MIT License."), (101, filler + "licensed under the APACHE license version 2 0 " + filler), (102, filler + long + " " + filler), (103, filler + cut), (104, " ".join(long.split()[:20])), (100, "Released under the MIT License.")]
    got = {(r["doc_id"], r["template"]): r["containment"] for r in licenses.scan(docs(spark, rows)).collect()}
    assert set(got) == {(100, "mit-short"), (101, "apache-short"), (102, "mit-grant"), (103, "mit-grant")}
    assert got[102, "mit-grant"] == 1.0 and 0.8 <= got[103, "mit-grant"] < 1


def reference_leaks(rows, items):
    sh = lambda t: {" ".join(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    out = set()
    for i, t in rows:
        own = sh(t)
        for k, u in items:
            s = sh(u)
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out.add((i, k, len(s & own), len(s)))
    return out


@pytest.mark.parametrize("block_chars", [16_000_000, 300])
def test_decontaminate(spark, odd_rows, block_chars):
    rng = random.Random(8)
    item = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    items = [(k, item(rng.choice([2, 5, 6, 12, 30, 60]))) for k in range(25)] + [(90, None), (91, ""), (92, "one")]
    rows = list(odd_rows)
    for k, (_, t) in enumerate(items[:25]):
        ws = t.split()
        rows.append((200 + k, f"{item(30)} {t.upper()} {item(200)}"))
        rows.append((300 + k, f"{item(9)} {' '.join(ws[: len(ws) * 9 // 10])} x {item(9)}"))
        rows.append((400 + k, " ".join(ws[: len(ws) // 2])))
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    got = decontaminate.search(docs(spark, rows), bench, block_chars=block_chars).collect()
    want = reference_leaks(rows, items)
    assert {(r["doc_id"], r["item_id"], r["matched"], r["item_shingles"]) for r in got} == want and len(want) > 25
    left = decontaminate.clean(docs(spark, rows), bench, block_chars=block_chars)
    clean = [(i, t) for i, t in rows if not reference_leaks([(0, t)], items)]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(clean, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    compare(queries.QUERIES[name](spark, DATA), connect(DATA), queries.ORACLE_SQL[name])


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def near_stage(rows):
    """(doc_id, shingle set) that stays of each class; sizes tell most pairs apart at once."""
    sets = sorted({shingles(t) for _, t in rows}, key=len)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[k + 1 :]:
            if 4 * len(b) > 5 * len(a):
                break
            if alike(a, b) and find(a) != find(b):
                root[find(a)] = find(b)
    best = {}
    for i, t in rows:
        c = find(shingles(t))
        if c not in best or (i is None, i or 0) < (best[c] is None, best[c] or 0):
            best[c] = i
    return sorted(best.values(), key=lambda i: (i is None, i or 0))


def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as p

    folder = DATA
    start = spark.read.parquet(f"{folder}/documents.parquet")
    after_quality = p.quality_classifier(spark, start, folder).cache()
    assert after_quality.columns == start.columns and 0 < after_quality.count() < start.count()
    rows = [(r["doc_id"], r["text"]) for r in after_quality.collect()]
    last = {}
    for i, t in rows:
        last[lowered(t)] = max(i, last.get(lowered(t), i))
    exact = p.exact_deduplication(spark, after_quality, folder).cache()
    assert exact.columns == start.columns and sorted(r["doc_id"] for r in exact.collect()) == sorted(last.values())
    rows = [(r["doc_id"], r["text"]) for r in exact.collect()]
    near = p.near_deduplication(spark, exact, folder).cache()
    assert near.columns == start.columns and sorted(r["doc_id"] for r in near.collect()) == near_stage(rows)
    rows = [(r["doc_id"], r["text"]) for r in near.collect()]
    leaks = {x[0] for x in reference_leaks(rows, [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()])}
    clean = p.benchmark_decontamination(spark, near, folder).cache()
    assert clean.columns == start.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - leaks
    done = p.run(spark, folder)
    assert {r["doc_id"] for r in done.collect()} == {r["doc_id"] for r in clean.collect()}
    assert done.where("not round_trip").count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd_rows):
    """Nulls, repeated ids, empty and long texts, columns named like the stages' own, and empty tables."""
    import corpus_pipeline as p

    names = [name for name, _ in p.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    frame = docs(spark, odd_rows)
    texts = {lowered(t) for _, t in odd_rows}
    exact = p.exact_deduplication(spark, frame, DATA)
    assert sorted(lowered(r["text"]) for r in exact.collect()) == sorted(texts)
    near = p.near_deduplication(spark, frame, DATA)
    assert sorted((r["doc_id"] for r in near.collect()), key=lambda i: (i is None, i or 0)) == near_stage(odd_rows)
    assert p.benchmark_decontamination(spark, frame, DATA).count() == len(odd_rows)
    assert p.sentencepiece(spark, frame, DATA).count() == len(odd_rows)
    for _, stage in p.STAGES[1:4]:
        assert stage(spark, frame, DATA).columns == frame.columns
    for _, stage in p.STAGES[1:]:
        assert stage(spark, docs(spark, []), DATA).count() == 0
    with pytest.warns(UserWarning):
        assert p.quality_classifier(spark, docs(spark, []), DATA).count() == 0
