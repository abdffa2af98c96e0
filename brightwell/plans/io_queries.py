"""Queries of sources, sinks and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..shared import scratch
from ..sources import readers, writers
from ..streaming import events as ev
from .graph_queries import GRAPH, SPLIT, part_edges
from .registry import query, read, rounded

# A training log made from order lines: a header for each third line, then a result.
_LOG = "SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) = 1"


def _log_lines(lineitem):
    from pyspark.sql import Window as W

    rows = lineitem.withColumn("k", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity", "l_extendedprice"))).where("k = 1")
    ord_, q = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_quantity")
    line = F.when(ord_ % 3 == 0, F.concat(F.lit("Hits@"), F.col("l_partkey") % 50)).otherwise(F.concat(F.lit("Run: 01, Epoch: "), (ord_ % 100), F.lit(", Loss: "), q, F.lit(", Learning Rate: 0.0010, Valid: "), q / 2, F.lit("%, Test: "), q / 4, F.lit("%")))
    return rows.select(ord_.alias("ord"), line.alias("line"))


@query(
    f"""WITH l AS ({_LOG}), h AS (SELECT *, last_value(CASE WHEN ord % 3 = 0 THEN 'Hits@' || (l_partkey % 50) END IGNORE NULLS) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS metric FROM l)
    SELECT ord, 1 AS run, (ord % 100)::INTEGER AS epoch, l_quantity AS loss, 0.001::DOUBLE AS lr, l_quantity / 2 AS valid, l_quantity / 4 AS test, metric FROM h WHERE ord % 3 <> 0"""
)
def training_log(spark, sf):
    return readers.training_log(_log_lines(read(spark, sf, "lineitem")))


@query("SELECT p_partkey AS pid, p_name || '. ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS text FROM part")
def titled_texts(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("pid"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("abstract"))
    return readers.titled_texts(rows.unionByName(rows.withColumn("pid", F.concat(F.lit("x"), "pid"))))


@query("SELECT c_custkey AS id, coalesce(p_name || '. ', '') AS text FROM customer LEFT JOIN part ON p_partkey = c_custkey * 3")
def lookup_texts(spark, sf):
    texts = readers.titled_texts(read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("pid"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("abstract")))
    nodes = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return readers.lookup_texts(nodes, nodes.select("id", (F.col("id") * 3).alias("pid")), texts)


@query("SELECT c_name AS from_room, c_mktsegment AS to_room, c_acctbal AS weight FROM customer WHERE c_nationkey = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def scoped_links(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_name").alias("from_room"), F.col("c_mktsegment").alias("to_room"), F.col("c_acctbal").alias("weight"), F.col("c_mktsegment").alias("edge_class"), F.lit("n").alias("namespace"), F.col("c_nationkey").cast("string").alias("user"))
    return readers.scoped_links(c, "n", "3", ["BUILDING", "MACHINERY"])


@query("SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INTEGER AS cls, r_name AS name FROM region")
def label_names(spark, sf):
    one = read(spark, sf, "region").groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]), " \n").alias("text"))
    return readers.label_names(one)


@query("SELECT c_nationkey::VARCHAR AS model, min(c_name || '.GGUF') AS path FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def weight_files(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("model"), F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".GGUF").otherwise(".txt")).alias("path"))
    return readers.weight_files(c)


@query("SELECT page_id AS doc_id, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END AS format, page_id % 3 <> 1 AS is_pdf, octet_length(encode(html)) + 5 AS n_bytes FROM pages".replace("octet_length(encode(html)) + 5", "(octet_length(encode(html)) + 5)::INTEGER"))
def decode_documents(spark, sf):
    p = read(spark, sf, "pages")
    k = F.col("page_id") % 3
    body = F.base64(F.encode(F.concat(F.when(k == 1, F.lit("12345")).otherwise(F.lit("%PDF-")), "html"), "UTF-8"))
    mime = F.when(k == 0, "data:application/pdf;base64,").when(k == 1, "data:application/vnd.openxmlformats-officedocument.wordprocessingml.document;base64,").otherwise("")
    return readers.decode_documents(p.select(F.col("page_id").alias("doc_id"), F.concat(mime, F.regexp_replace(body, "\\s", "")).alias("uri")))


@query("SELECT conv_id AS doc_id, (turn // 2)::BIGINT AS page_no, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1, 2")
def page_texts(spark, sf):
    return writers.page_texts(_parts(spark, sf))


def _parts(spark, sf):
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("page_no"), F.col("turn").alias("ord"), "text")


@query("WITH p AS (SELECT conv_id, turn // 2 AS page_no, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS m FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1, 2) SELECT conv_id AS doc_id, string_agg(m, '|' ORDER BY page_no) AS pages FROM p GROUP BY 1 UNION ALL SELECT DISTINCT conv_id, 'whole' FROM conversations WHERE conv_id % 2 = 1")
def page_list(spark, sf):
    pages = writers.page_texts(_parts(spark, sf).where("doc_id % 2 = 0"))
    docs = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("whole").alias("text")).distinct()
    return writers.page_list(docs, pages).select("doc_id", F.array_join("markdown_pages", "|").alias("pages"))


@query("SELECT doc_id, unnest(string_split(text, '. ')) AS markdown, generate_subscripts(string_split(text, '. '), 1)::INTEGER AS page_no FROM documents")
def split_pages(spark, sf):
    return writers.split_pages(read(spark, sf, "documents"), ". ")


@query("SELECT s_suppkey AS doc_id, 'a<!-- image -->' || chr(10) || '**AI-Generated Image Description:** ' || s_name || chr(10) || '<!-- end image description -->' || chr(10) || 'b<!-- image -->c' AS markdown FROM supplier")
def describe_images(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("page_no"), "s_name")
    pages = s.select("doc_id", "page_no", F.lit("a<!-- image -->b<!-- image -->c").alias("markdown"))
    return writers.describe_images(pages, s.select("doc_id", "page_no", F.lit(0).alias("ord"), F.col("s_name").alias("text"))).select("doc_id", "markdown")


@query("SELECT conv_id AS doc_id, CASE WHEN count(*) > 1 THEN 'application/pdf' ELSE 'image/*' END AS mimetype, count(*) AS n, '#/texts/' || min(turn) AS first_ref, length(arg_min(text, turn)) AS span FROM conversations GROUP BY 1")
def structured_document(spark, sf):
    pages = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.col("text").alias("markdown"), F.lit(100).alias("width"), F.lit(200).alias("height"))
    tree = writers.structured_document(pages, "document")
    j = lambda path: F.get_json_object("tree", path)
    return tree.select("doc_id", j("$.origin.mimetype").alias("mimetype"), F.json_array_length(j("$.texts")).cast("bigint").alias("n"), j("$.body[0]").alias("first_ref"), j("$.texts[0].prov[0].charspan[1]").cast("bigint").alias("span"))


@query("SELECT conv_id AS doc_id, turn + 1 AS page_no, 'img' || turn AS image FROM conversations WHERE turn % 2 = 0")
def split_images(spark, sf):
    t = F.col("turn")
    docs = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_list(F.struct((t + 1).alias("page_no"), F.col("text").alias("markdown"), F.when(t % 2 == 0, F.concat(F.lit("img"), t)).alias("image"))).alias("pages"))
    return writers.split_images(docs)[1]


@query("SELECT s_suppkey AS doc_id, s_name AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 4 END AS page_no FROM supplier WHERE s_suppkey % 3 = 0")
def image_list(spark, sf):
    k = F.col("s_suppkey")
    e = read(spark, sf, "supplier").select(k.alias("doc_id"), F.col("s_name").alias("ref"), F.when(k % 3 == 0, "picture").otherwise("text").alias("kind"), F.when(k % 2 == 1, 4).alias("page_no"))
    return writers.image_list(e)


@query("SELECT event_id, regexp_replace(trim(event_type || ' ' || props), ' +', ' ', 'g') AS text FROM events WHERE event_id % 10 = 0")
def page_lines(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("  "), "event_type", F.lit("  "), "props").alias("text"), (F.col("event_id") % 10).alias("kind"))
    return readers.page_lines(e)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return rounded(ev.windowed_counts(read(spark, sf, "events")), 4)


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '30 minutes' OR ts - lag(ts) OVER w = INTERVAL '30 minutes' THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM k GROUP BY user_id, k"""
)
def sessions(spark, sf):
    return ev.sessions(read(spark, sf, "events"))


@query("SELECT id, count(*) AS n FROM (SELECT user_id AS id FROM events UNION ALL SELECT event_id % 100 FROM events) GROUP BY 1")
def growing_degrees(spark, sf):
    return ev.growing_degrees(read(spark, sf, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 100).alias("dst")))


@query("SELECT ts::DATE AS day, arg_max(event_id, ts) AS last_event, arg_max(event_type, ts) AS last_type, count(*) AS n FROM events GROUP BY 1")
def log_status(spark, sf):
    return ev.rolling_status(read(spark, sf, "events"))


@query(f"WITH {GRAPH}, {SPLIT} SELECT src, dst, 1.0::DOUBLE AS w FROM split WHERE split = 'train'")
def corpus_edges(spark, sf):
    folder = scratch(spark, "corpus")
    writers.bundle(folder, edges=part_edges(spark, sf))
    return readers.graph_corpus(spark, folder, "edges")["edges"]


@query(f"WITH {GRAPH}, {SPLIT} SELECT src, dst, w, split FROM split JOIN und USING (src, dst)")
def corpus_presplit(spark, sf):
    folder, edges = scratch(spark, "corpus"), part_edges(spark, sf)
    writers.bundle(folder, edges=edges, split=graph.edge_split(graph.canonical_edges(edges)))
    corpus = readers.graph_corpus(spark, folder, "presplit")
    return corpus["edges"].join(corpus["split"], ["src", "dst"])


@query(f"WITH {GRAPH} SELECT src, dst, w, len(embedding)::INTEGER AS dim FROM und LEFT JOIN embeddings ON vec_id = src")
def context_bundle(spark, sf):
    folder = scratch(spark, "context")
    writers.bundle(folder, edges=part_edges(spark, sf), nodes=read(spark, sf, "embeddings").select(F.col("vec_id").alias("src"), "embedding"))
    context = readers.context_bundle(spark, folder)
    return context["edges"].join(context["nodes"], "src", "left").select("src", "dst", "w", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@query("SELECT p_partkey AS pid, p_name || '. ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS text FROM part")
def positional_csv(spark, sf):
    path = scratch(spark, "titles") + "/rows"
    rows = read(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 1, F.col("p_brand")))
    rows.write.csv(path, sep="\t", compression="gzip")
    return readers.titled_texts(readers.positional_csv(spark, path, readers.TITLES, sep="\t"))


@query(
    """WITH r AS (SELECT 'room' || id AS room, round(sin(id * 8 + 1)::FLOAT::DOUBLE, 5) AS first_value FROM (SELECT unnest(range(300)) AS id)),
    l AS (SELECT 'room' || ((16807 * p_partkey + 3) % 2147483647 % 300) AS from_room, 'room' || ((48271 * p_partkey + 5) % 2147483647 % 300) AS to_room FROM part)
    SELECT from_room, to_room, first_value, count(*) AS n FROM l JOIN r ON room = from_room GROUP BY ALL"""
)
def synthetic_links(spark, sf):
    links, vectors = readers.synthetic_links(spark, 300, read(spark, sf, "part").count())
    both = links.join(vectors, links["from_room"] == vectors["room"]).select("from_room", "to_room", F.round(F.col("emb")[0].cast("double"), 5).alias("first_value"))
    return both.groupBy("from_room", "to_room", "first_value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def written_once(spark, sf):
    path, nations = scratch(spark, "once") + "/nations", read(spark, sf, "nation").select("n_nationkey", "n_name")
    writers.once(nations, path)
    writers.once(nations.withColumn("n_name", F.lit("later")), path)
    return spark.read.schema(nations.schema).parquet(path)


@query("SELECT 'events' AS name, count(*) AS n, max(event_id) AS last_event FROM events")
def rolling_result(spark, sf):
    path, events = scratch(spark, "state") + "/newest", read(spark, sf, "events")
    state = lambda e: e.groupBy().agg(F.lit("events").alias("name"), F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
    writers.rolling_result(state(events.where("event_type = 'click'")), path)
    writers.rolling_result(state(events), path)
    return spark.read.schema("name string, n bigint, last_event bigint").json(path)
