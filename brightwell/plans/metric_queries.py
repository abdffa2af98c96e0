"""Metric queries: scores of labelled documents, synthetic detections from order lines, training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection, graph, metrics, scoring
from .registry import query, read, rounded

# A score that prefers good documents a little: hash plus label, over 2.
SCORES = "SELECT doc_id AS pair_id, quality AS label, ((48271 * doc_id + 11) % 2147483647 % 1000 / 1000.0::DOUBLE + quality) / 2 AS score FROM labels"


def scores(spark, sf):
    h = graph.affine(F.col("doc_id"), 48271, 11) % 1000 / 1000.0
    return read(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("label"), ((h + F.col("quality")) / 2).alias("score"))


@query(
    f"""WITH s AS ({SCORES}), n AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k FROM s WHERE label = 0),
    c AS (SELECT k, (SELECT score FROM n WHERE n.k = t.k) AS cut FROM (VALUES (1), (5), (10), (100000)) t(k))
    SELECT k, round(avg((cut IS NULL OR score > cut)::INTEGER), 6) AS hits FROM c, (SELECT score FROM s WHERE label = 1) GROUP BY k"""
)
def hits_at_k(spark, sf):
    return rounded(metrics.hits_at_k(scores(spark, sf), [1, 5, 10, 100000]))


_CURVE = f"""
    s AS ({SCORES}), t AS (SELECT sum(label)::DOUBLE AS total FROM s),
    c AS (SELECT pair_id, score, row_number() OVER w AS rank, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w::DOUBLE AS precision, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) / total AS recall FROM s, t WINDOW w AS (ORDER BY score DESC, pair_id))"""


@query(f"WITH {_CURVE} SELECT pair_id, round(score, 6) AS score, rank, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c")
def precision_curve(spark, sf):
    return rounded(metrics.precision_curve(scores(spark, sf)))


@query(
    f"""WITH {_CURVE}, g AS (SELECT target::DOUBLE AS target FROM (VALUES (0.95), (0.9), (0.8), (0.5)) v(target)), d AS (SELECT target, max(rank) AS rank FROM g JOIN c ON precision >= target GROUP BY 1)
    SELECT target, rank AS n_accepted, round(recall, 6) AS recall, round(score, 6) AS threshold FROM g LEFT JOIN d USING (target) LEFT JOIN c USING (rank)"""
)
def precision_coverage(spark, sf):
    return rounded(metrics.precision_coverage(metrics.precision_curve(scores(spark, sf))))


@query(f"WITH {_CURVE} SELECT rank AS k, round(precision, 6) AS precision FROM c WHERE rank IN (10, 50, 100)")
def precision_at_k(spark, sf):
    return rounded(metrics.precision_at(metrics.precision_curve(scores(spark, sf))))


@query(f"SELECT round(sum(abs(conf - acc) * n / total), 6) AS ece FROM (SELECT avg(score) AS conf, avg(label) AS acc, count(*) AS n FROM ({SCORES}) WHERE score < 1 GROUP BY floor(score * 10)), (SELECT count(*)::DOUBLE AS total FROM labels)")
def ece(spark, sf):
    return rounded(metrics.ece(scores(spark, sf).select(F.col("score").alias("p"), "label")))


@query("SELECT k::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 60)) AS k) LEFT JOIN (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) USING (k)")
def histogram(spark, sf):
    return metrics.histogram(read(spark, sf, "part"), "p_size", 60)


_WEIGHTS = "i AS (SELECT k AS bin, 1.0::DOUBLE / greatest(coalesce(n, 0), 1) AS inv FROM (SELECT unnest(range(0, 12)) AS k) LEFT JOIN (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY 1) USING (k)), w AS (SELECT bin, inv / (SELECT sum(inv) FROM i) AS weight FROM i)"


@query(f"WITH {_WEIGHTS} SELECT bin::BIGINT AS bin, round(weight, 6) AS weight FROM w")
def class_weights(spark, sf):
    return rounded(metrics.class_weights(read(spark, sf, "embeddings"), "label", 12))


@query(f"WITH {_WEIGHTS} SELECT vec_id % 20 AS image, round(sum(weight), 6) AS weight FROM embeddings JOIN w ON bin = label GROUP BY 1")
def image_weights(spark, sf):
    e = read(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("image"), "label")
    return rounded(metrics.image_weights(e, "image", "label", metrics.class_weights(e, "label", 12)))


# One line for each (order, line number): the pair is not unique in the table.
LINES = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"


def lines(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))


# Detections and truths of an order's lines: boxes from the keys, confidence and classes by hash.
DETS = f"""SELECT l_orderkey AS image_id, l_linenumber AS det_id, (l_partkey % 37)::DOUBLE AS x1, (l_suppkey % 29)::DOUBLE AS y1, (l_partkey % 37 + 20 + l_quantity)::DOUBLE AS x2, (l_suppkey % 29 + 25 + l_quantity / 2)::DOUBLE AS y2,
    ((l_orderkey * 31 + l_linenumber * 17) % 1009) / 1009.0::DOUBLE AS conf, (l_suppkey % 3)::INTEGER AS cls FROM {LINES}"""
TRUTHS = f"""SELECT l_orderkey AS image_id, l_linenumber AS truth_id, (l_partkey % 37 + l_linenumber % 3)::DOUBLE AS x1, (l_suppkey % 29)::DOUBLE AS y1, (l_partkey % 37 + 22 + l_quantity)::DOUBLE AS x2, (l_suppkey % 29 + 24 + l_quantity / 2)::DOUBLE AS y2,
    ((l_suppkey + l_linenumber // 6) % 3)::INTEGER AS cls FROM {LINES}"""


def dets(spark, sf):
    li = lines(spark, sf)
    x, y = F.col("l_partkey") % 37, F.col("l_suppkey") % 29
    return li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("det_id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 20 + F.col("l_quantity")).alias("x2"), (y + 25 + F.col("l_quantity") / 2).alias("y2"),
                     ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1009 / 1009.0).alias("conf"), (F.col("l_suppkey") % 3).cast("int").alias("cls"))


def truths(spark, sf):
    li = lines(spark, sf)
    x, y = F.col("l_partkey") % 37, F.col("l_suppkey") % 29
    return li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("truth_id"), (x + F.col("l_linenumber") % 3).cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 22 + F.col("l_quantity")).alias("x2"), (y + 24 + F.col("l_quantity") / 2).alias("y2"),
                     ((F.col("l_suppkey") + F.floor(F.col("l_linenumber") / 6)) % 3).cast("int").alias("cls"))


IOU = "CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1) THEN (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) + {eps}) ELSE 0 END"
_OVER = f"ov AS (SELECT d.image_id, det_id, truth_id, {IOU.format(a='d', b='t', eps='1e-7')} AS iou FROM d JOIN t USING (image_id) WHERE {IOU.format(a='d', b='t', eps='1e-7')} > 0.45)"
_MATCH = f"""
    d AS (SELECT * FROM ({DETS}) WHERE conf > 0.25), t AS ({TRUTHS}), {_OVER},
    m1 AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, truth_id) = 1),
    m AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY image_id, truth_id ORDER BY iou DESC, det_id) = 1)"""


def _matches(spark, sf):
    d, t = dets(spark, sf).where("conf > 0.25"), truths(spark, sf)
    return d, t, metrics.match_detections(detection.iou_pairs(d, t, "image_id", 0.45))


@query(f"WITH {_MATCH} SELECT image_id, det_id, truth_id, round(iou, 6) AS iou FROM m")
def match_detections(spark, sf):
    return rounded(_matches(spark, sf)[2])


_MATRIX = """
    c AS (SELECT coalesce(d.cls, 3) AS pred, t.cls AS truth FROM t LEFT JOIN m USING (image_id, truth_id) LEFT JOIN d USING (image_id, det_id)
        UNION ALL SELECT d.cls, 3 FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = d.image_id AND m.det_id = d.det_id)),
    cm AS (SELECT pred, truth, count(*) AS n FROM c GROUP BY 1, 2)"""


@query(f"WITH {_MATCH}, {_MATRIX} SELECT pred, truth, n FROM cm")
def confusion_matrix(spark, sf):
    d, t, m = _matches(spark, sf)
    return metrics.confusion_matrix(d, t, m, 3)


@query(f"WITH {_MATCH}, {_MATRIX} SELECT pred AS cls, coalesce(sum(n) FILTER (pred = truth), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (pred <> truth), 0)::BIGINT AS fp FROM cm WHERE pred < 3 GROUP BY 1")
def tp_fp(spark, sf):
    d, t, m = _matches(spark, sf)
    return metrics.tp_fp(metrics.confusion_matrix(d, t, m, 3), 3)


_CURVES = f"""{_MATCH},
    hit AS (SELECT d.cls, d.image_id * 10 + d.det_id AS det_id, d.conf, coalesce((t.cls = d.cls)::INTEGER, 0) AS tp FROM d LEFT JOIN m USING (image_id, det_id) LEFT JOIN t USING (image_id, truth_id)),
    nt AS (SELECT cls, count(*) AS n FROM t GROUP BY 1),
    cu AS (SELECT hit.cls, det_id, conf, row_number() OVER w AS rank, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) / (n + 1e-16) AS recall, sum(tp) OVER (w ROWS UNBOUNDED PRECEDING) / row_number() OVER w::DOUBLE AS precision FROM hit JOIN nt USING (cls) WINDOW w AS (PARTITION BY hit.cls ORDER BY conf DESC, det_id))"""


def _curves(spark, sf):
    d, t, m = _matches(spark, sf)
    hit = d.join(m.select("image_id", "det_id", "truth_id"), ["image_id", "det_id"], "left").join(t.select("image_id", "truth_id", F.col("cls").alias("tc")), ["image_id", "truth_id"], "left")
    hit = hit.select("cls", (F.col("image_id") * 10 + F.col("det_id")).alias("det_id"), "conf", F.coalesce((F.col("tc") == F.col("cls")).cast("int"), F.lit(0)).alias("tp"))
    return metrics.class_curves(hit, t.groupBy("cls").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_CURVES} SELECT cls, det_id, round(conf, 6) AS conf, rank::INTEGER AS rank, round(recall, 6) AS recall, round(precision, 6) AS precision FROM cu")
def class_curves(spark, sf):
    return rounded(_curves(spark, sf))


_AP = f"""{_CURVES},
    pt AS (SELECT cls, rank AS o, recall AS x, precision AS y FROM cu UNION ALL SELECT cls, 0, 0, 1 FROM nt WHERE cls IN (SELECT cls FROM cu) UNION ALL SELECT cls, 4000000000, 1, 0 FROM nt WHERE cls IN (SELECT cls FROM cu)),
    en AS (SELECT cls, o, x, max(y) OVER (PARTITION BY cls ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM pt),
    gr AS (SELECT DISTINCT cls, i / 100.0::DOUBLE AS xt FROM cu, (SELECT unnest(range(101)) AS i)),
    lo AS (SELECT gr.cls, xt, max(o) AS o FROM gr JOIN en ON en.cls = gr.cls AND x <= xt GROUP BY 1, 2),
    hi AS (SELECT gr.cls, xt, min(o) AS o FROM gr JOIN en ON en.cls = gr.cls AND x >= xt GROUP BY 1, 2),
    v AS (SELECT lo.cls, lo.xt, CASE WHEN l.x = lo.xt THEN l.y ELSE l.y + (h.y - l.y) * (lo.xt - l.x) / (h.x - l.x) END AS y FROM lo JOIN hi ON hi.cls = lo.cls AND hi.xt = lo.xt JOIN en l ON l.cls = lo.cls AND l.o = lo.o JOIN en h ON h.cls = lo.cls AND h.o = hi.o)"""


@query(f"WITH {_AP} SELECT cls, round(sum(a), 6) AS ap FROM (SELECT cls, (xt - lag(xt) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM v WINDOW w AS (PARTITION BY cls ORDER BY xt)) GROUP BY 1")
def average_precision_per_class(spark, sf):
    return rounded(metrics.average_precision(_curves(spark, sf)))


# Logs: for each customer segment, daily order totals by order date stand for an epoch's value.
LOG = "SELECT c_mktsegment AS run, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS epoch, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"


def log(spark, sf):
    both = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy(F.col("c_mktsegment").alias("run"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


@query(
    f"""WITH l AS ({LOG}), b AS (SELECT *, max(value) OVER w AS best FROM l WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT x.run, x.epoch, any_value(x.value) AS value, any_value(x.best) AS best, min(y.epoch) AS best_epoch FROM b x JOIN l y ON y.run = x.run AND y.epoch <= x.epoch AND y.value = x.best GROUP BY 1, 2)
    SELECT run, epoch, value, best, best_epoch, epoch - best_epoch >= 5 AS stop FROM e"""
)
def early_stopping(spark, sf):
    return metrics.early_stopping(log(spark, sf), 5)


@query(f"WITH l AS ({LOG}) SELECT run, epoch, value FROM l QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) = 1")
def best_epoch(spark, sf):
    return metrics.best_row(log(spark, sf))


@query(
    f"""WITH l AS ({LOG}), i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i, count(*) OVER (PARTITION BY run) AS n FROM l), t AS (SELECT *, (round_even(n * 0.1, 0)::BIGINT // 2 + 1) AS taps FROM i),
    s AS (SELECT run, epoch, taps, n, unnest(range(i - taps // 2, i - taps // 2 + taps)) AS place FROM t)
    SELECT s.run, s.epoch, round(sum(i.value) / max(taps), 4) AS smoothed FROM s JOIN i ON i.run = s.run AND i.i = least(greatest(place, 1), s.n) GROUP BY 1, 2"""
)
def smooth_series(spark, sf):
    return rounded(metrics.smooth(log(spark, sf), ["run"], "epoch", "value", 0.05), 4)


@query("SELECT p_partkey, round(0.1 * (p_size / 50.0::DOUBLE) + 0.9 * (p_retailprice / 10000), 6) AS fitness FROM part")
def fitness(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", F.lit(0.5).alias("precision"), F.lit(0.5).alias("recall"), (F.col("p_size") / 50.0).alias("map50"), (F.col("p_retailprice") / 10000).alias("map"))
    return rounded(metrics.fitness(part).select("p_partkey", "fitness"))


@query(
    f"""WITH l AS (SELECT run, epoch, value, lag(epoch) OVER w AS e0, lag(value) OVER w AS v0 FROM ({LOG}) WINDOW w AS (PARTITION BY run ORDER BY epoch))
    SELECT run, epoch - 0.5::DOUBLE AS at, round(v0 + (value - v0) * (epoch - 0.5 - e0) / (epoch - e0), 4) AS value FROM l WHERE e0 IS NOT NULL"""
)
def interpolate(spark, sf):
    points = log(spark, sf).select("run", F.col("epoch").cast("double").alias("x"), F.col("value").alias("y"), F.col("epoch").cast("bigint").alias("ord"))
    first = points.groupBy("run").agg(F.min("x").alias("first"))
    grid = points.join(first, "run").where("x > first").select("run", (F.col("x") - 0.5).alias("at"))
    return rounded(metrics.interpolate(points, grid, ["run"]), 4)


_LOGIT = "(p_size - 25) / 5.0::DOUBLE"


@query(
    f"""SELECT p_partkey, round(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))), 6) AS bce, round(greatest(-d, 0) + ln(1 + exp(-abs(d))), 6) AS bpr, round(ln(exp(x) + exp(z) + exp(z / 2)) - x, 6) AS infonce, round(1 / (1 + exp(-x)), 6) AS score, 1 / (1 + exp(-x)) >= 0.857 AS accept
    FROM (SELECT p_partkey, {_LOGIT} AS x, (p_partkey % 2)::DOUBLE AS y, p_retailprice / 1000 AS z, {_LOGIT} - p_retailprice / 1000 AS d FROM part)"""
)
def link_losses(spark, sf):
    x, z = (F.col("p_size") - 25) / 5.0, F.col("p_retailprice") / 1000
    part = read(spark, sf, "part").select("p_partkey", x.alias("x"), z.alias("z"), (F.col("p_partkey") % 2).cast("double").alias("y"))
    x, z, y = F.col("x"), F.col("z"), F.col("y")
    out = part.select("p_partkey", scoring.bce_loss(x, y).alias("bce"), scoring.bpr_loss(x, z).alias("bpr"), scoring.infonce_loss(x, F.array(z, z / 2)).alias("infonce"), x.alias("logit"))
    return rounded(scoring.decide(out).select("p_partkey", "bce", "bpr", "infonce", "score", "accept"))


MLP = scoring.Mlp(layers=[([[0.5, -0.25], [0.125, 1.0], [-0.75, 0.5]], [0.1, -0.2, 0.3], [1.0, 0.5, 2.0], [0.0, 0.1, -0.1])], head=([0.6, -0.4, 0.2], 0.05), mean=[25.0, 1400.0], deviation=[14.0, 300.0])


def _mlp_sql() -> str:
    rows, bias, scale, shift = MLP.layers[0]
    h = ", ".join(f"{r[0]} * a + {r[1]} * b + {c} AS h{k}" for k, (r, c) in enumerate(zip(rows, bias)))
    out = " + ".join(f"{w} * greatest((h{k} - m) / sqrt(v + 1e-5) * {s} + {t}, 0)" for k, (w, s, t) in enumerate(zip(MLP.head[0], scale, shift)))
    return f"""WITH z AS (SELECT p_partkey, (p_size - 25.0::DOUBLE) / 14 AS a, (p_retailprice - 1400) / 300 AS b FROM part), h AS (SELECT p_partkey, {h} FROM z),
    m AS (SELECT *, (h0 + h1 + h2) / 3 AS m FROM h), v AS (SELECT *, ((h0 - m) ** 2 + (h1 - m) ** 2 + (h2 - m) ** 2) / 3 AS v FROM m)
    SELECT p_partkey, round({out} + 0.05, 6) AS logit FROM v"""


@query(_mlp_sql())
def mlp_score(spark, sf):
    part = read(spark, sf, "part")
    return rounded(part.select("p_partkey", scoring.forward(F.array(F.col("p_size").cast("double"), F.col("p_retailprice")), MLP).alias("logit")))


@query("SELECT p_partkey, round(1 / (1 + exp(p_size / 10.0::DOUBLE - p_retailprice / 1000)), 6) AS score, round((1 - cos(p_size * pi() / 100)) / 2, 6) AS ramp FROM part")
def rerank_score(spark, sf):
    part = read(spark, sf, "part")
    return rounded(part.select("p_partkey", scoring.softmax_yes(F.col("p_size") / 10.0, F.col("p_retailprice") / 1000).alias("score"), scoring.one_cycle(F.col("p_size")).alias("ramp")))


@query()
def platt_calibration(spark, sf):
    a, b = scoring.platt(scores(spark, sf).select("score", "label"))
    out = scores(spark, sf).select("pair_id", scoring.sigmoid(F.col("score") * a + b).alias("p"))
    return rounded(out, 4)


@query()
def embed_texts(spark, sf):
    return scoring.embed_texts(read(spark, sf, "benchmark"), "item_id", "text")


@query(
    f"""WITH RECURSIVE l AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS k, value FROM ({LOG})),
    e AS (SELECT run, k, value AS v FROM l WHERE k = 0 UNION ALL SELECT l.run, l.k, e.v * 0.9999::DOUBLE * (1 - exp(-l.k / 2000.0::DOUBLE)) + l.value * (1 - 0.9999::DOUBLE * (1 - exp(-l.k / 2000.0::DOUBLE))) FROM e JOIN l ON l.run = e.run AND l.k = e.k + 1)
    SELECT run, round(max_by(v, k), 4) AS ema FROM e GROUP BY run"""
)
def ema(spark, sf):
    ordered = log(spark, sf).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "value"))), lambda x: x["value"]).alias("values"))
    return rounded(ordered.select("run", scoring.ema(F.col("values")).alias("ema")), 4)
