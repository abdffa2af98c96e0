"""Queries read whole tables and whole texts."""

from brightwell.plans.catalog import QUERIES
from brightwell.sources import readers

from .conftest import DATA


def test_text_helpers_whole(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["text_helpers"](spark, DATA).collect()}
    assert set(got) == set(texts) and max(map(len, texts.values())) > 300
    for i, t in texts.items():
        assert len(got[i]["safe"]) == len(t) and got[i]["ascii"] == t.isascii() and got[i]["tail"] == t.split(" de ")[-1].strip()
        assert got[i]["chinese"] == any("一" <= c <= "鿿" for c in t)


def test_training_log_by_ranges(spark, monkeypatch):
    """A header goes on over ranges without one; no range holds the whole log."""
    monkeypatch.setattr(readers, "RANGE_LINES", 7)
    text = lambda k: f"Hits@{k}" if k in (3, 4, 60, 90) else f"Run: 01, Epoch: {k}, Loss: 1"
    lines = spark.createDataFrame([(k * k, text(k)) for k in range(100)], "ord bigint, line string")
    last = lambda k: max((h for h in (3, 4, 60, 90) if h <= k), default=None)
    got = {r["ord"]: r["metric"] for r in readers.training_log(lines).collect()}
    assert got == {k * k: last(k) and f"Hits@{last(k)}" for k in range(100) if k not in (3, 4, 60, 90)}
    assert 10 < lines.select(readers._order_range(lines)).distinct().count() <= 15
    assert readers.training_log(lines.limit(0)).count() == 0


def test_whole_log_and_pages(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber as ord").distinct().where("ord % 3 <> 0")
    assert QUERIES["training_log"](spark, DATA).count() == rows.count()
    texts = spark.read.parquet(f"{DATA}/documents.parquet")
    assert QUERIES["split_pages"](spark, DATA).select("doc_id").distinct().count() == texts.where("text is not null").count() > 50


def test_cluster_columns_whole(spark):
    edges, want = {}, set()
    for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id").collect():
        edges.setdefault(r["user_id"], []).append(float(r["event_id"] * 37 % 400))
    for user, xs in edges.items():
        cols = []
        for x in sorted(xs):
            if cols and x - cols[-1][0] <= 40:
                cols[-1][1] += 1
            else:
                cols.append([x, 1])
        want |= {(user, k, x, n) for k, (x, n) in enumerate(cols)}
    got = QUERIES["cluster_columns"](spark, DATA)
    assert {(r["user_id"], r["col"], r["x0"], r["n"]) for r in got.collect()} == want


def test_all_rows_of_events_and_turns(spark):
    assert QUERIES["reorder_authors"](spark, DATA).count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert QUERIES["image_contents"](spark, DATA).count() == spark.read.parquet(f"{DATA}/conversations.parquet").count()
