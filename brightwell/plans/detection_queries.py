"""Detection queries over boxes made from order lines and parts, and run lengths over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import detection
from .metric_queries import DETS, IOU, TRUTHS, dets, truths
from .registry import query, read, rounded


@query(f"WITH d AS ({DETS}), t AS ({TRUTHS}) SELECT * FROM (SELECT image_id, det_id, truth_id, round({IOU.format(a='d', b='t', eps='1e-7')}, 6) AS iou, {IOU.format(a='d', b='t', eps='1e-7')} AS x FROM d JOIN t USING (image_id)) WHERE x > 0.6".replace("SELECT * FROM", "SELECT image_id, det_id, truth_id, iou FROM"))
def iou_pairs(spark, sf):
    return rounded(detection.iou_pairs(dets(spark, sf), truths(spark, sf), "image_id", 0.6))


_BOTH = f"""SELECT image_id, det_id, d.x1 AS a1, d.y1 AS a2, d.x2 AS a3, d.y2 AS a4, t.x1 AS b1, t.y1 AS b2, t.x2 AS b3, t.y2 AS b4 FROM ({DETS}) d JOIN ({TRUTHS}) t ON d.image_id = t.image_id AND d.det_id = t.truth_id"""


@query(
    f"""WITH p AS (SELECT image_id, det_id, a3 - a1 AS w1, a4 - a2 AS h1, b3 - b1 AS w2, b4 - b2 AS h2, greatest(least(a3, b3) - greatest(a1, b1), 0) * greatest(least(a4, b4) - greatest(a2, b2), 0) AS i,
        greatest(a3, b3) - least(a1, b1) AS cw, greatest(a4, b4) - least(a2, b2) AS ch, b1 + b3 - a1 - a3 AS dx, b2 + b4 - a2 - a4 AS dy FROM (SELECT d.image_id, d.det_id, a1, a2, a3, a4, b1, b2, b3, b4 FROM ({_BOTH.replace("SELECT image_id,", "SELECT d.image_id,")}) d)),
    u AS (SELECT *, w1 * h1 + w2 * h2 - i + 1e-7 AS u FROM p), o AS (SELECT *, i / u AS iou, cw * cw + ch * ch + 1e-7 AS c2, (dx * dx + dy * dy) / 4 AS rho, cw * ch + 1e-7 AS hull, 4 / pi() ** 2 * (atan(w2 / (h2 + 1e-7)) - atan(w1 / (h1 + 1e-7))) ** 2 AS v FROM u)
    SELECT image_id, det_id, round(iou, 6) AS iou, round(iou - (hull - u) / hull, 6) AS giou, round(iou - rho / c2, 6) AS diou, round(iou - (rho / c2 + v * v / (v - iou + 1 + 1e-7)), 6) AS ciou, round(i / (w2 * h2 + 1e-7), 6) AS ioa,
        round(least(w1, w2) * least(h1, h2) / (w1 * h1 + w2 * h2 - least(w1, w2) * least(h1, h2) + 1e-7), 6) AS wh_iou FROM o"""
)
def iou_family(spark, sf):
    t = truths(spark, sf).select("image_id", F.col("truth_id").alias("det_id"), *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    a, b = g.box(), g.box("t_")
    both = dets(spark, sf).join(t, ["image_id", "det_id"])
    return rounded(both.select("image_id", "det_id", *(g.box_iou_family(a, b, k).alias(k) for k in ("iou", "giou", "diou", "ciou")), g.ioa(a, b).alias("ioa"), g.wh_iou(a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]).alias("wh_iou")))


@query(
    f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS r FROM ({DETS}) WHERE conf > 0.25), n AS (SELECT image_id, max(r) AS n FROM d GROUP BY 1),
    ov AS (SELECT b.image_id, b.r, list(a.r) AS l FROM d a JOIN d b ON a.image_id = b.image_id AND a.r < b.r AND a.cls = b.cls AND {IOU.format(a='a', b='b', eps='0')} > 0.45 GROUP BY 1, 2),
    s AS (SELECT image_id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM n UNION ALL SELECT s.image_id, s.r + 1, CASE WHEN list_has_any(s.kept, coalesce(ov.l, [])) THEN s.kept ELSE list_append(s.kept, s.r + 1) END FROM s JOIN n ON n.image_id = s.image_id AND s.r < n.n LEFT JOIN ov ON ov.image_id = s.image_id AND ov.r = s.r + 1),
    k AS (SELECT s.image_id, unnest(kept) AS r FROM s JOIN n ON n.image_id = s.image_id AND s.r = n.n)
    SELECT d.image_id, det_id, cls, round(conf, 6) AS conf FROM d JOIN k ON k.image_id = d.image_id AND k.r = d.r"""
)
def nms_per_group(spark, sf):
    return rounded(detection.nms(dets(spark, sf).where("conf > 0.25")).select("image_id", "det_id", "cls", "conf"))


@query(f"SELECT image_id, det_id, cls, round(conf, 6) AS conf FROM ({DETS}) WHERE NOT (cls = 0 AND conf <= 0.7) AND NOT (cls = 1 AND conf <= 0.3)")
def class_cutoffs(spark, sf):
    return rounded(detection.class_cutoffs(dets(spark, sf), {0: 0.7, 1: 0.3}).select("image_id", "det_id", "cls", "conf"))


@query(f"SELECT image_id, 'class ' || cls AS name, count(*) AS n FROM ({DETS}) GROUP BY ALL")
def detection_summary(spark, sf):
    names = spark.createDataFrame([(k, f"class {k}") for k in range(3)], "cls int, name string")
    return detection.summary(dets(spark, sf), names)


_PREDS = "SELECT vec_id, abs(embedding[1])::DOUBLE * 3 AS obj, [abs(embedding[2])::DOUBLE, abs(embedding[3])::DOUBLE, abs(embedding[4])::DOUBLE] AS s FROM embeddings"


def _preds(spark, sf):
    e = F.col("embedding")
    return read(spark, sf, "embeddings").select(F.lit(0).alias("image_id"), F.col("vec_id").alias("box_id"), *(F.lit(float(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))), (F.abs(e[0]).cast("double") * 3).alias("obj"), F.array(*(F.abs(e[k]).cast("double") for k in (1, 2, 3))).alias("scores"))


@query(f"WITH p AS ({_PREDS}), c AS (SELECT vec_id AS box_id, obj, unnest(s) * obj AS conf, generate_subscripts(s, 1) - 1 AS cls FROM p WHERE obj > 0.05) SELECT box_id, cls::INTEGER AS cls, round(conf, 6) AS conf FROM c WHERE conf > 0.05")
def score_candidates_multi(spark, sf):
    return rounded(detection.score_candidates(_preds(spark, sf), conf=0.05, multi_label=True).select("box_id", "cls", "conf"))


@query(f"WITH p AS ({_PREDS}), c AS (SELECT vec_id AS box_id, unnest(s) * obj AS conf, generate_subscripts(s, 1) - 1 AS cls FROM p WHERE obj > 0.05) SELECT box_id, cls::INTEGER AS cls, round(conf, 6) AS conf FROM c QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY conf DESC, cls) = 1 AND conf > 0.05")
def score_candidates_best(spark, sf):
    return rounded(detection.score_candidates(_preds(spark, sf), conf=0.05).select("box_id", "cls", "conf"))


@query(
    f"""SELECT image_id, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, x1 AS left_, y1 AS top_, round(least(greatest(x1 * 2 - 30, 0), 60), 9) AS clipped, round((x1 + x2) / 2 / 640, 9) AS nx, round((y2 - y1) / 480, 9) AS nh, (x2 - x1) * (y2 - y1) AS area FROM ({DETS})"""
)
def box_codecs(spark, sf):
    b = g.box()
    c, n = g.to_center(b), g.normalise(b, F.lit(640.0), F.lit(480.0))
    back = g.from_center(c)
    return rounded(dets(spark, sf).select("image_id", "det_id", c[0].alias("cx"), c[1].alias("cy"), c[2].alias("w"), c[3].alias("h"), back[0].alias("left_"), g.to_top_left(b)[1].alias("top_"), g.clip(tuple(x * 2 - 30 for x in b), 60, 60)[0].alias("clipped"), n[0].alias("nx"), n[3].alias("nh"), g.area(b).alias("area")), 9)


_SIZES = "SELECT p_partkey, (100 + p_partkey % 900)::INTEGER AS h, (100 + p_size * 20)::INTEGER AS w FROM part"


def _sizes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", (100 + F.col("p_partkey") % 900).cast("int").alias("h"), (100 + F.col("p_size") * 20).cast("int").alias("w"))


@query(
    f"""WITH s AS ({_SIZES}), g AS (SELECT *, least(640.0::DOUBLE / h, 640.0::DOUBLE / w) AS gain FROM s), r AS (SELECT *, round_even(w * gain, 0)::INTEGER AS rw, round_even(h * gain, 0)::INTEGER AS rh FROM g),
    d AS (SELECT *, ((640 - rw) % 32) / 2.0::DOUBLE AS dw, ((640 - rh) % 32) / 2.0::DOUBLE AS dh FROM r)
    SELECT p_partkey, rw AS resized_w, rh AS resized_h, round_even(dw - 0.1::DOUBLE, 0)::INTEGER AS "left", round_even(dw + 0.1::DOUBLE, 0)::INTEGER AS "right", round_even(dh - 0.1::DOUBLE, 0)::INTEGER AS top, round_even(dh + 0.1::DOUBLE, 0)::INTEGER AS bottom, round(gain, 6) AS gain FROM d"""
)
def letterbox_geometry(spark, sf):
    return rounded(_sizes(spark, sf).select("p_partkey", *(c.alias(k) for k, c in g.letterbox(F.col("h"), F.col("w")).items())))


@query(
    f"""WITH s AS ({_SIZES}), g AS (SELECT *, least(640.0::DOUBLE / h, 640.0::DOUBLE / w) AS k FROM s), p AS (SELECT *, (640 - w * k) / 2 AS px, (640 - h * k) / 2 AS py FROM g)
    SELECT p_partkey, round(least(greatest((200 - px) / k, 0), w), 4) AS x1, round(least(greatest((100 - py) / k, 0), h), 4) AS y1, round(least(greatest((500 - px) / k, 0), w), 4) AS x2, round(least(greatest((600 - py) / k, 0), h), 4) AS y2 FROM p"""
)
def rescale_boxes(spark, sf):
    b = g.rescale(tuple(F.lit(x) for x in (200.0, 100.0, 500.0, 600.0)), F.lit(640.0), F.lit(640.0), F.col("h"), F.col("w"))
    return rounded(_sizes(spark, sf).select("p_partkey", *(c.alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2")))), 4)


@query(
    f"""WITH s AS ({_SIZES}), c(k, cw, ch) AS (VALUES (0, 336, 672), (1, 672, 336), (2, 672, 672), (3, 1008, 336)), x AS (SELECT p_partkey, w, h, k, cw, ch, least(cw::DOUBLE / w, ch::DOUBLE / h) AS g FROM s, c),
    e AS (SELECT *, least((floor(w * g) * floor(h * g))::BIGINT, (w * h)::BIGINT) AS e FROM x)
    SELECT p_partkey, cw AS width, ch AS height FROM e QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY e DESC, cw * ch - e, k) = 1"""
)
def best_resolution(spark, sf):
    return _sizes(spark, sf).select("p_partkey", g.best_resolution(F.col("w"), F.col("h"), [(336, 672), (672, 336), (672, 672), (1008, 336)]).alias("b")).select("p_partkey", "b.*")


@query(
    f"""WITH s AS (SELECT p_partkey, (h * 4)::BIGINT AS h, (w * 4)::BIGINT AS w FROM ({_SIZES})), k AS (SELECT *, CASE WHEN w * h > 4000000 THEN sqrt(4000000.0::DOUBLE / (w * h)) ELSE 1 END AS k FROM s)
    SELECT p_partkey, greatest(1, floor(w * k))::INTEGER AS width, greatest(1, floor(h * k))::INTEGER AS height, (ceil(w / 32.0::DOUBLE) * 32)::INTEGER AS divisible FROM k"""
)
def capped_size(spark, sf):
    s = _sizes(spark, sf).select("p_partkey", (F.col("h") * 4).cast("bigint").alias("h"), (F.col("w") * 4).cast("bigint").alias("w"))
    w, h = g.capped_size(F.col("w"), F.col("h"))
    return s.select("p_partkey", w.alias("width"), h.alias("height"), g.make_divisible(F.col("w"), 32).alias("divisible"))


@query(f"SELECT p_partkey, unnest(range(0, w, 336))::INTEGER AS x, y FROM (SELECT p_partkey, w, unnest(range(0, h, 336))::INTEGER AS y FROM ({_SIZES}))")
def patch_grid(spark, sf):
    return _sizes(spark, sf).select("p_partkey", F.explode(g.patch_grid(F.col("w"), F.col("h"), 336)).alias("p")).select("p_partkey", "p.x", "p.y")


@query(
    f"""WITH s AS ({_SIZES}), t AS (SELECT *, w::DOUBLE / h > 1 AS wide, floor(h * (24.0::DOUBLE / w))::INTEGER AS nh, floor(w * (24.0::DOUBLE / h))::INTEGER AS nw FROM s)
    SELECT p_partkey, CASE WHEN wide THEN 0 ELSE (24 - nw) // 2 END::INTEGER AS x0, CASE WHEN wide THEN 24 ELSE 24 - (24 - nw) // 2 END::INTEGER AS x1, CASE WHEN wide THEN (24 - nh) // 2 ELSE 0 END::INTEGER AS y0, CASE WHEN wide THEN 24 - (24 - nh) // 2 ELSE 24 END::INTEGER AS y1 FROM t"""
)
def unpad_grid(spark, sf):
    return _sizes(spark, sf).select("p_partkey", *(c.cast("int").alias(k) for k, c in g.unpad(F.lit(24), F.lit(24), F.col("w"), F.col("h")).items()))


@query(
    """SELECT vec_id, round((2 / (1 + exp(-e[1])) + vec_id % 20 - 0.5) * 8, 6) AS cx, round((2 / (1 + exp(-e[2])) + vec_id % 10 - 0.5) * 8, 6) AS cy, round((2 / (1 + exp(-e[3]))) ** 2 * 10, 6) AS w, round((2 / (1 + exp(-e[4]))) ** 2 * 13, 6) AS h
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"""
)
def decode_anchors(spark, sf):
    s = tuple(F.col("embedding")[k].cast("double") for k in range(4))
    b = g.decode_anchor(s, (F.col("vec_id") % 20, F.col("vec_id") % 10), F.lit(8.0), (F.lit(10.0), F.lit(13.0)))
    return rounded(read(spark, sf, "embeddings").select("vec_id", *(c.alias(n) for c, n in zip(b, ("cx", "cy", "w", "h")))))


@query(f"SELECT image_id, det_id, round(CASE WHEN det_id % 3 = 1 THEN 640 - x1 / 0.83 ELSE x1 / 0.83 END, 6) AS cx, round(CASE WHEN det_id % 3 = 2 THEN 480 - y1 / 0.83 ELSE y1 / 0.83 END, 6) AS cy, round(x2 / 0.83, 6) AS w, round(y2 / 0.83, 6) AS h FROM ({DETS})")
def undo_augmentation(spark, sf):
    flip = F.when(F.col("det_id") % 3 == 1, "lr").when(F.col("det_id") % 3 == 2, "ud").otherwise("none")
    b = g.undo_augmentation(g.box(), F.lit(0.83), flip, F.lit(640.0), F.lit(480.0))
    return rounded(dets(spark, sf).select("image_id", "det_id", *(c.alias(n) for c, n in zip(b, ("cx", "cy", "w", "h")))))


@query(
    f"""WITH d AS (SELECT image_id, det_id, x1 / 120 AS l, y1 / 120 AS t, x2 / 120 AS r, y2 / 120 AS b FROM ({DETS})), e AS (SELECT *, (r - l) * 0.18 / 2 AS dw, (b - t) * 0.18 / 2 AS dh FROM d),
    p AS (SELECT image_id, det_id, trunc(greatest(0, l - dw) * 1240)::INTEGER AS px0, trunc(greatest(0, t - dh) * 1754)::INTEGER AS py0, trunc(least(1, r + dw) * 1240)::INTEGER AS px1, trunc(least(1, b + dh) * 1754)::INTEGER AS py1 FROM e)
    SELECT *, px1 > px0 AND py1 > py0 AS ok FROM p"""
)
def crop_windows(spark, sf):
    b = tuple(F.col(c) / 120 for c in ("x1", "y1", "x2", "y2"))
    return dets(spark, sf).select("image_id", "det_id", *(c.alias(k) for k, c in g.crop_window(b, 0.18, F.lit(1240), F.lit(1754)).items()))


_RUNS = """
    b AS (SELECT user_id, ts, event_id, (event_type = 'error')::INTEGER AS bit FROM events),
    t AS (SELECT *, CASE WHEN lag(bit) OVER w IS NULL OR lag(bit) OVER w <> bit THEN 1 ELSE 0 END AS turn FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM t),
    c AS (SELECT user_id, run, count(*) AS n, any_value(bit) AS bit FROM r GROUP BY 1, 2)"""


def _bits(spark, sf):
    return read(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bit"))


@query(f"WITH {_RUNS} SELECT user_id, CASE WHEN arg_min(bit, run) = 1 THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY run) AS rle FROM c GROUP BY 1")
def rle_encode(spark, sf):
    return detection.run_lengths(_bits(spark, sf), "user_id", ["ts", "event_id"], "bit").select("user_id", detection.rle_string(F.col("counts")).alias("rle"))


@query("SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS pos, (event_type = 'error')::INTEGER AS bit FROM events")
def rle_decode(spark, sf):
    return detection.rle_decode(detection.run_lengths(_bits(spark, sf), "user_id", ["ts", "event_id"], "bit"), "user_id")


@query(
    """WITH t AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM t)
    SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM r GROUP BY ALL"""
)
def type_runs(spark, sf):
    return detection.type_runs(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


_PROTO = "SELECT p_partkey % 10 AS image_id, p_partkey // 10 % 20 AS y, p_partkey // 200 % 20 AS x, avg(p_size / 25.0::DOUBLE - 1) AS a, avg(p_retailprice / 1000 - 1) AS b FROM part GROUP BY 1, 2, 3"


def _masks(spark, sf):
    part = read(spark, sf, "part")
    k = F.col("p_partkey")
    protos = part.groupBy((k % 10).alias("image_id"), (F.floor(k / 10) % 20).alias("y"), (F.floor(k / 200) % 20).alias("x")).agg(F.array(F.avg(F.col("p_size") / 25.0 - 1), F.avg(F.col("p_retailprice") / 1000 - 1)).alias("p"))
    boxes = spark.range(10).crossJoin(spark.range(2).withColumnRenamed("id", "det_id")).select(F.col("id").alias("image_id"), "det_id", F.array(F.lit(1.0) - F.col("det_id") * 2, F.lit(0.5)).alias("coef"), F.lit(0.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(8.0).alias("x2"), F.lit(18.0).alias("y2"))
    return detection.masks(protos, boxes)


_MASKS = f"p AS ({_PROTO}), d AS (SELECT i AS image_id, k AS det_id FROM (SELECT unnest(range(10)) AS i), (SELECT unnest(range(2)) AS k)), m AS (SELECT image_id, det_id, y, x FROM p JOIN d USING (image_id) WHERE x >= 0 AND x < 8 AND y >= 2 AND y < 18 AND 1 / (1 + exp(-(a * (1 - 2 * det_id) + b * 0.5))) > 0.5)"


@query(f"WITH {_MASKS} SELECT image_id, det_id, y, x FROM m")
def mask_pixels(spark, sf):
    return _masks(spark, sf)


@query(f"WITH {_MASKS}, n AS (SELECT image_id, det_id, count(*) AS n FROM m GROUP BY 1, 2), i AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, count(*) AS n FROM m a JOIN m b USING (image_id, y, x) GROUP BY 1, 2, 3) SELECT i.image_id, a_id, b_id, round(i.n / (x.n + y.n - i.n + 1e-7), 6) AS iou FROM i JOIN n x ON x.image_id = i.image_id AND x.det_id = a_id JOIN n y ON y.image_id = i.image_id AND y.det_id = b_id")
def mask_iou(spark, sf):
    m = _masks(spark, sf).withColumnRenamed("det_id", "mask_id")
    return rounded(detection.mask_iou(m, m))


@query("SELECT s_suppkey AS page_id, 0 AS x0, (20 + s_suppkey % 20)::INTEGER AS y0, 40 AS x1, (30 + s_suppkey % 20)::INTEGER AS y1 FROM supplier")
def ink_regions(spark, sf):
    """A page with a blob for each supplier."""
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit(100).alias("h"), F.lit(80).alias("w"), (20 + F.col("s_suppkey") % 20).cast("int").alias("y"))
    blob = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda r: F.when((r >= F.col("y")) & (r < F.col("y") + 10), F.lit("FF" * 10 + "00" * 30 + "FF" * 40)).otherwise(F.lit("FF" * 80))))
    return detection.ink_regions(rows.select("page_id", "h", "w", F.unhex(blob).alias("gray"), F.expr("cast(array() as array<array<double>>)").alias("erase")))


_POINTS = "SELECT l_orderkey AS image_id, 0 AS seg_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ord, (l_partkey % 120 - 10)::DOUBLE AS x, (l_suppkey % 70 - 5)::DOUBLE AS y FROM {lines}"


def _points(spark, sf):
    from pyspark.sql import Window as W

    from .metric_queries import lines

    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    return lines(spark, sf).select(F.col("l_orderkey").alias("image_id"), F.lit(0).alias("seg_id"), place.alias("ord"), (F.col("l_partkey") % 120 - 10).cast("double").alias("x"), (F.col("l_suppkey") % 70 - 5).cast("double").alias("y"))


def _points_sql() -> str:
    from .metric_queries import LINES

    return _POINTS.format(lines=LINES)


_INSIDE = "x >= 0 AND y >= 0 AND x <= 100 AND y <= 60"


@query(f"SELECT image_id, seg_id, coalesce(min(x) FILTER ({_INSIDE}), 0) AS x1, coalesce(min(y) FILTER ({_INSIDE}), 0) AS y1, coalesce(max(x) FILTER ({_INSIDE}), 0) AS x2, coalesce(max(y) FILTER ({_INSIDE}), 0) AS y2 FROM ({_points_sql()}) GROUP BY 1, 2")
def segment_boxes(spark, sf):
    return detection.segment_boxes(_points(spark, sf), 100, 60)


@query(
    f"""WITH p AS MATERIALIZED ({_points_sql()}), m AS MATERIALIZED (SELECT image_id, count(*) AS m FROM p GROUP BY 1), c AS MATERIALIZED (SELECT image_id, ord::BIGINT AS ord, x, y FROM p UNION ALL SELECT image_id, m, x, y FROM p JOIN m USING (image_id) WHERE ord = 0),
    g AS MATERIALIZED (SELECT image_id, i, i * m / 8.0::DOUBLE AS pos, floor(i * m / 8.0::DOUBLE)::BIGINT AS lo FROM m, (SELECT unnest(range(9)) AS i))
    SELECT g.image_id, 0 AS seg_id, i::INTEGER AS i, round(a.x + (coalesce(b.x, a.x) - a.x) * (pos - a.ord), 6) AS x, round(a.y + (coalesce(b.y, a.y) - a.y) * (pos - a.ord), 6) AS y
    FROM g JOIN c a ON a.image_id = g.image_id AND a.ord = lo LEFT JOIN c b ON b.image_id = g.image_id AND b.ord = lo + 1"""
)
def resample_segments(spark, sf):
    return rounded(detection.resample_segments(_points(spark, sf), 9))


@query(f"SELECT image_id, det_id, cls, round(conf, 6) AS conf FROM ({DETS}) UNION ALL SELECT image_id, truth_id, cls, 1.0 FROM ({TRUTHS}) UNION ALL SELECT image_id, det_id, cls, round(conf, 6) FROM ({DETS}) WHERE conf > 0.9")
def joined_candidates(spark, sf):
    d = dets(spark, sf)
    given = detection.with_given_labels(d, truths(spark, sf).withColumnRenamed("truth_id", "det_id"))
    return rounded(detection.concat_stages(given, d.where("conf > 0.9")).select("image_id", "det_id", "cls", "conf"))


_CELLS = "SELECT p_partkey % 5 AS image_id, p_partkey // 5 % 3 AS scale, row_number() OVER (PARTITION BY p_partkey % 5, p_partkey // 5 % 3 ORDER BY p_partkey) - 1 AS cell, p_partkey FROM part"


@query(f"WITH c AS (SELECT *, count(*) OVER (PARTITION BY image_id, scale) // 21 AS g, count(*) OVER (PARTITION BY image_id, scale) AS n FROM ({_CELLS})) SELECT image_id, scale, cell, p_partkey FROM c WHERE CASE scale WHEN 0 THEN cell < n - g WHEN 2 THEN cell >= g * 16 ELSE TRUE END")
def clip_scale_tails(spark, sf):
    from pyspark.sql import Window as W

    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select((k % 5).alias("image_id"), (F.floor(k / 5) % 3).alias("scale"), "p_partkey")
    return detection.clip_scale_tails(rows.withColumn("cell", (F.row_number().over(W.partitionBy("image_id", "scale").orderBy("p_partkey")) - 1).cast("bigint")))


@query(f"WITH {_MASKS} SELECT image_id, det_id, y + 3 AS y, x + 2 AS x FROM m WHERE x + 2 < 20 AND y + 3 < 20")
def shift_masks(spark, sf):
    return detection.shift_masks(_masks(spark, sf), 2, 3, 20, 20)


@query("SELECT 2 - p_partkey % 3 AS layer, p_partkey AS a, (10 * (3 - p_partkey % 3))::DOUBLE AS w, 5.0::DOUBLE AS h, 8 * (3 - p_partkey % 3) AS stride FROM part")
def order_anchors(spark, sf):
    k = F.col("p_partkey") % 3
    return detection.order_anchors(read(spark, sf, "part").select(k.alias("layer"), F.col("p_partkey").alias("a"), (10 * (3 - k)).cast("double").alias("w"), F.lit(5.0).alias("h"), (8 * (k + 1)).alias("stride")))


@query("SELECT p_name AS name, p_size::VARCHAR AS shape FROM part WHERE p_partkey % 2 = 0 AND p_size < 40 AND NOT contains(p_name, '7')")
def matching_shapes(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("shape"), "p_size")
    other = part.where("p_partkey % 2 = 0 AND p_size < 40")
    return detection.matching_shapes(part.where("p_partkey % 2 = 0").select("name", "shape"), other, ("7",))


@query("SELECT p_partkey, round(200 * (0.5 - p_size / 200.0::DOUBLE) + 3, 6) AS x1, round(100 * (0.4 - p_size / 400.0::DOUBLE) + 4, 6) AS y1, round(200 * (0.5 + p_size / 200.0::DOUBLE) + 3, 6) AS x2, round(100 * (0.4 + p_size / 400.0::DOUBLE) + 4, 6) AS y2 FROM part")
def denormalise(spark, sf):
    size = F.col("p_size")
    box = g.denormalise((F.lit(0.5), F.lit(0.4), size / 100.0, size / 200.0), 200.0, 100.0, 3.0, 4.0)
    return rounded(read(spark, sf, "part").select("p_partkey", *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2")))))


@query("SELECT p_partkey, 0.1::DOUBLE AS l, round(CASE WHEN p_partkey % 2 = 0 THEN 1 - (p_size + 10) / 100.0::DOUBLE ELSE p_size / 100.0::DOUBLE END, 6) AS t, 0.5::DOUBLE AS r, round(CASE WHEN p_partkey % 2 = 0 THEN 1 - p_size / 100.0::DOUBLE ELSE (p_size + 10) / 100.0::DOUBLE END, 6) AS b FROM part")
def top_left_page(spark, sf):
    """Boxes of 100 x 100 pages, of even parts from the bottom left."""
    size = F.col("p_size").cast("double")
    box = g.top_left_page((F.lit(10.0), size, F.lit(50.0), size + 10), F.lit(100.0), F.lit(100.0), F.col("p_partkey") % 2 == 0)
    return rounded(read(spark, sf, "part").select("p_partkey", *(c.alias(n) for c, n in zip(box, "ltrb"))))
