"""Sources: tables with fixed schemas read by Spark, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx
from ..operators import graph

EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", T.DoubleType()), T.StructField("year", T.IntegerType())])
LINKS = T.StructType([T.StructField(n, k) for n, k in (("from_room", T.StringType()), ("to_room", T.StringType()), ("weight", T.DoubleType()), ("edge_class", T.StringType()), ("namespace", T.StringType()), ("user", T.StringType()))])
#: A log is read in ranges of its order.
RANGE_LINES, MAX_RANGES = 100_000, 1000
TITLES = "pid string, title string, abstract string"


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def graph_corpus(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """Named graphs: `presplit` has its splits in files, `edges` is split here (10 % test, 5 % valid).

    Other names are a ValueError.
    """
    if name == "presplit":
        return {"edges": parquet(spark, folder, "edges"), "split": parquet(spark, folder, "split")}
    if name == "edges":
        edges = graph.canonical_edges(parquet(spark, folder, "edges"))
        split = graph.edge_split(edges)
        return {"edges": split.where("split = 'train'").select("src", "dst", F.lit(1.0).alias("w")), "split": split}
    raise ValueError(f"unknown corpus: {name}")


def context_bundle(spark: SparkSession, folder: str, *, with_embeddings: bool = True) -> dict[str, DataFrame]:
    """edges, and nodes with or without their vectors."""
    out = {"edges": parquet(spark, folder, "edges")}
    return out | ({"nodes": parquet(spark, folder, "nodes")} if with_embeddings else {})


def positional_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",", header: bool = False) -> DataFrame:
    """Delimited text (also gzip) by position."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def titled_texts(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """(pid, text) of rows pid, title, abstract: numeric pids only, 'title. abstract' cut to limit; of repeated pids the last by text."""
    keyed = rows.withColumn("pid", F.expr("try_cast(pid AS BIGINT)")).where("pid IS NOT NULL")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))
    return keyed.groupBy("pid").agg(F.max(text).alias("text")).select("pid", F.substring("text", 1, limit).alias("text"))


def lookup_texts(nodes: DataFrame, node_to_pid: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) through two left joins; '' where either misses."""
    return nodes.join(node_to_pid, "id", "left").join(texts, "pid", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def scoped_links(links: DataFrame, namespace: str, user: str, classes: list[str] | None = None) -> DataFrame:
    """A user's links in a namespace; the filters reach the scan, and prune partitions of a table partitioned by namespace."""
    own = links.where((F.col("namespace") == namespace) & (F.col("user") == user))
    own = own if classes is None else own.where(F.col("edge_class").isin(classes))
    return own.select(F.col("from_room").cast("string").alias("from_room"), F.col("to_room").cast("string").alias("to_room"), F.col("weight").cast("double").alias("weight"))


def synthetic_links(spark: SparkSession, n_rooms: int, n_links: int, dim: int = 8) -> tuple[DataFrame, DataFrame]:
    """(links, vectors) made by hash: for tests of what reads a context."""
    links = spark.range(n_links).select(F.format_string("room%d", graph.affine(F.col("id"), 16807, 3) % n_rooms).alias("from_room"), F.format_string("room%d", graph.affine(F.col("id"), 48271, 5) % n_rooms).alias("to_room"), F.lit(1.0).alias("weight"))
    vectors = spark.range(n_rooms).select(F.format_string("room%d", "id").alias("room"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.sin(F.col("id") * dim + k).cast("float")).alias("emb"))
    return links, vectors


def filtered_corpus(documents: DataFrame, n: int, *, min_chars: int = 80, max_chars: int = 2000) -> DataFrame:
    """(doc_id, text): n documents of over min_chars without white space at the ends, in the order of a hash, cut to max_chars. A sampling operator."""
    long = documents.where(F.char_length(tx.strip(F.col("text"))) > min_chars)
    return long.orderBy(graph.affine(F.col("doc_id"), 48271, 11), "doc_id").limit(n).select("doc_id", F.substring("text", 1, max_chars).alias("text"))


def label_names(text: DataFrame) -> DataFrame:
    """(cls, name) from one text with a name a line."""
    return text.select(F.posexplode(F.split(tx.strip(F.col("text")), "\n")).alias("cls", "name")).select("cls", tx.strip(F.col("name")).alias("name"))


def weight_files(files: DataFrame) -> DataFrame:
    """(model, path): of each model's files the first weight shard by name. files: model, path."""
    return files.where(F.lower("path").endswith(".gguf")).groupBy("model").agg(F.min("path").alias("path"))


def _order_range(lines: DataFrame) -> Column:
    """The number of the range of ord that a line is in: ranges of about RANGE_LINES lines, at most MAX_RANGES."""
    n = min(MAX_RANGES, -(-lines.count() // RANGE_LINES))
    if n < 2:
        return F.lit(0)
    bounds = lines.agg(F.percentile_approx("ord", [k / n for k in range(1, n)])).first()[0]
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col("ord")))


def training_log(lines: DataFrame) -> DataFrame:
    """(ord, run, epoch, loss, lr, valid, test, metric) of a log's result lines (ord, line); metric is the last Hits@K header before."""
    number = lambda name: F.expr(f"try_cast(regexp_extract(line, '{name}: ([-0-9.eE]+)', 1) AS DOUBLE)")
    header = F.when(F.rlike("line", F.lit(r"^Hits@\d+$")), F.col("line"))
    lines = lines.withColumn("header", header).withColumn("range", _order_range(lines))
    own = F.last("header", ignorenulls=True).over(W.partitionBy("range").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    # The last header of each range goes on to the ranges after it; one row a range.
    last = lines.where("header is not null").groupBy(F.col("range").alias("before")).agg(F.max_by("header", "ord").alias("carried"))
    ranges = lines.select("range").distinct()
    last = ranges.join(last, F.col("before") < F.col("range")).groupBy("range").agg(F.max_by("carried", "before").alias("carried"))
    carried = lines.withColumn("own", own).join(F.broadcast(last), "range", "left").withColumn("metric", F.coalesce("own", "carried"))
    hit = carried.where(F.rlike("line", F.lit(r"^Run: \d+, Epoch: \d+")))
    return hit.select("ord", number("Run").cast("int").alias("run"), number("Epoch").cast("int").alias("epoch"), number("Loss").alias("loss"), number("Learning Rate").alias("lr"), number("Valid").alias("valid"), number("Test").alias("test"), "metric")


def page_lines(raw: DataFrame) -> DataFrame:
    """Lines or blocks of pages with clean white space, empty ones and non-text kinds dropped. raw: .., text, kind (0: text)."""
    return raw.where(F.coalesce("kind", F.lit(0)) == 0).withColumn("text", tx.clean_space(F.coalesce("text", F.lit("")))).where("text <> ''").drop("kind")


def decode_documents(uris: DataFrame) -> DataFrame:
    """(doc_id, format, is_pdf, n_bytes) of data URIs (doc_id, uri)."""
    return uris.select("doc_id", tx.document_format(F.col("uri")).alias("format"), tx.is_pdf(F.col("uri")).alias("is_pdf"), F.octet_length(tx.data_uri_payload(F.col("uri"))).alias("n_bytes"))
