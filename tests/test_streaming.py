"""The event windows give the same on a stream as on the table."""

from pyspark.sql import functions as F

from brightwell.sources import readers
from brightwell.streaming import events

from .conftest import DATA


def test_windows_on_a_stream(spark, tmp_path):
    table = spark.read.parquet(f"{DATA}/events.parquet")
    table.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    counts = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), table.schema), late="60 days")
    run = counts.writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r[0], r[1], r[2]) for r in spark.sql("SELECT window_start, event_type, max(n) FROM counts GROUP BY 1, 2").collect()}
    assert got == {(r[0], r[1], r[2]) for r in events.windowed_counts(table.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}


def test_unknown_corpus(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        readers.graph_corpus(spark, str(tmp_path), "nothing")


def test_edges_corpus(spark, tmp_path):
    spark.createDataFrame([(k, k + 1) for k in range(40)], "src bigint, dst bigint").write.parquet(str(tmp_path / "edges.parquet"))
    corpus = readers.graph_corpus(spark, str(tmp_path), "edges")
    assert corpus["split"].count() == 40 and corpus["edges"].count() == 34
