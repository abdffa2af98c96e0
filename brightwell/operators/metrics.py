"""Ranking, calibration and detection metrics as ordered windows and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ranges import running


def hits_at_k(scores: DataFrame, ks: list[int]) -> DataFrame:
    """(k, hits): the share of positives that score strictly above the k-th best negative; 1.0 with fewer than k negatives.

    scores: label 0/1, score. Only the best max(ks) negatives are ranked.
    """
    spark = scores.sparkSession
    top = scores.where("label = 0").select("score").orderBy(F.desc("score")).limit(max(ks))
    ranked = top.withColumn("k", F.row_number().over(W.orderBy(F.desc("score"))))
    cuts = spark.createDataFrame([(k,) for k in ks], "k int").join(ranked.withColumnRenamed("score", "cut"), "k", "left")
    # The cuts are as many as ks.
    return (
        scores.where("label = 1").select("score").join(F.broadcast(cuts))
        .groupBy("k").agg(F.avg((F.col("cut").isNull() | (F.col("score") > F.col("cut"))).cast("double")).alias("hits"))
    )


def precision_curve(scores: DataFrame) -> DataFrame:
    """Rows by falling score (ties by pair_id) with rank, precision and recall."""
    total = scores.agg(F.sum("label").alias("total"))
    ranked = running(scores.select("pair_id", "label", "score"), [F.desc("score"), F.asc("pair_id")], value="label")
    return ranked.join(F.broadcast(total)).select("pair_id", "score", "rank", (F.col("cum") / F.col("rank")).alias("precision"), (F.col("cum") / F.col("total")).alias("recall"))


def precision_coverage(curve: DataFrame, targets: tuple[float, ...] = (0.95, 0.9, 0.8, 0.5)) -> DataFrame:
    """(target, n_accepted, recall, threshold): the deepest cut whose precision reaches each target; nulls if none does."""
    goals = curve.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    deep = curve.join(F.broadcast(goals), F.col("precision") >= F.col("target")).groupBy("target").agg(F.max_by(F.struct(F.col("rank").alias("n_accepted"), "recall", F.col("score").alias("threshold")), "rank").alias("x"))
    return goals.join(deep, "target", "left").select("target", "x.*")


def precision_at(curve: DataFrame, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    return curve.where(F.col("rank").isin(*ks)).select(F.col("rank").alias("k"), "precision")


def ece(probs: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over half-open bins, weighted by their share of all rows; p = 1 is in no bin but counts in the shares."""
    total = probs.agg(F.count(F.lit(1)).alias("total"))
    by = probs.where("p >= 0 and p < 1").groupBy(F.floor(F.col("p") * bins).alias("bin")).agg(F.avg("p").alias("conf"), F.avg("label").alias("acc"), F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(total)).agg(F.coalesce(F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n") / F.col("total")), F.lit(0.0)).alias("ece"))


def histogram(df: DataFrame, column: str, minlength: int) -> DataFrame:
    """(bin, n) for 0..minlength-1 and beyond, zeros included."""
    counts = df.groupBy(F.col(column).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(minlength).withColumnRenamed("id", "bin")
    return grid.join(counts, "bin", "full").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_weights(labels: DataFrame, column: str, n_classes: int) -> DataFrame:
    """(bin, weight): inverse counts, an absent class counting as one, scaled to the sum 1."""
    inv = histogram(labels, column, n_classes).withColumn("inv", 1.0 / F.greatest("n", F.lit(1)))
    return inv.join(F.broadcast(inv.agg(F.sum("inv").alias("total")))).select("bin", (F.col("inv") / F.col("total")).alias("weight"))


def image_weights(labels: DataFrame, image: str, column: str, weights: DataFrame) -> DataFrame:
    """(image, weight): the class weights of an image's labels added up."""
    return labels.join(weights.select(F.col("bin").alias(column), "weight"), column).groupBy(image).agg(F.sum("weight").alias("weight"))


def class_curves(dets: DataFrame, truths: DataFrame) -> DataFrame:
    """Per class, by falling confidence (ties by det_id): rank, recall, precision. dets: cls, det_id, conf, tp; truths: cls, n."""
    both = dets.join(truths.select("cls", "n"), "cls").where("n > 0")
    ranked = running(both.select("cls", "det_id", "conf", "tp", "n"), [F.desc("conf"), "det_id"], by=["cls"], value="tp")
    return ranked.select("cls", "det_id", "conf", "rank", (F.col("cum") / (F.col("n") + 1e-16)).alias("recall"), (F.col("cum") / F.col("rank")).alias("precision"))


def interpolate(points: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Linear interpolation of points (keys, x, y, ord) at grid (keys, at): (keys, at, value); constant beyond the ends.

    Of points with the same x the last by ord counts from the left. Points
    and grid are merged and scanned once by x, forwards and backwards.
    """
    merged = points.select(*keys, "x", "y", "ord", F.lit(0).alias("q")).unionByName(grid.select(*keys, F.col("at").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("bigint").alias("ord"), F.lit(1).alias("q")))
    left = W.partitionBy(*keys).orderBy("x", "q", "ord").rowsBetween(W.unboundedPreceding, 0)
    # Backwards, as a frame to the end would be scanned anew for each row.
    right = W.partitionBy(*keys).orderBy(F.desc("x"), F.asc("q"), F.desc("ord")).rowsBetween(W.unboundedPreceding, 0)
    point = F.when(F.col("q") == 0, F.struct("x", "y"))
    both = merged.withColumn("l", F.last(point, ignorenulls=True).over(left)).withColumn("r", F.last(point, ignorenulls=True).over(right)).where("q = 1")
    l, r = F.col("l"), F.col("r")
    value = (
        F.when(l.isNull(), r["y"]).when(r.isNull(), l["y"]).when(l["x"] == F.col("x"), l["y"])
        .otherwise(l["y"] + (r["y"] - l["y"]) * (F.col("x") - l["x"]) / (r["x"] - l["x"]))
    )
    return both.select(*keys, F.col("x").alias("at"), value.alias("value"))


def average_precision(curves: DataFrame, points: int = 101) -> DataFrame:
    """(cls, ap): the precision envelope, read at `points` recalls and integrated by trapezia.

    Between two of the recalls only the first and the last point of the curve
    can be next to one of them, so at most 2 * points + 2 rows of a class are
    interpolated, however long its curve.
    """
    ends = curves.select("cls").distinct()
    body = curves.select("cls", F.col("rank").cast("bigint").alias("ord"), F.col("recall").alias("x"), F.col("precision").alias("y"))
    padded = body.unionByName(ends.select("cls", F.lit(0).cast("bigint").alias("ord"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))).unionByName(ends.select("cls", F.lit(1 << 62).alias("ord"), F.lit(1.0).alias("x"), F.lit(0.0).alias("y")))
    envelope = running(padded, [F.desc("ord")], by=["cls"], value="y", how="max").select("cls", "ord", "x", F.col("cum").alias("y"))
    last = F.lit(float(points - 1))
    near = F.round(F.col("x") * last)
    between = near + (F.col("x") > near / last).cast("int")  # recalls of the grid below x
    outer = envelope.groupBy("cls", between.alias("b")).agg(F.min(F.struct("x", "ord", "y")).alias("p"), F.max(F.struct("x", "ord", "y")).alias("q"))
    few = outer.select("cls", "p.*").unionByName(outer.select("cls", "q.*")).distinct()
    grid = ends.select("cls", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select("cls", (F.col("i") / last).alias("at"))
    at = interpolate(few, grid, ["cls"])
    before = W.partitionBy("cls").orderBy("at")
    area = (F.col("at") - F.lag("at").over(before)) * (F.col("value") + F.lag("value").over(before)) / 2
    return at.withColumn("area", area).groupBy("cls").agg(F.sum("area").alias("ap"))


def smooth(df: DataFrame, keys: list[str], order: str, value: str, fraction: float = 0.05) -> DataFrame:
    """(keys, order, smoothed): box filter of floor(round(2 * fraction * length) / 2) + 1 taps, the ends repeated.

    The sum in a window is the difference of two running sums, each looked up
    by its place, so the cost of a point does not grow with the window.
    """
    rows = running(df.select(*keys, order, value), [order], by=keys, value=value)
    ends = rows.groupBy(*keys).agg(F.max("rank").alias("n"), F.min_by(value, "rank").alias("first"), F.max_by(value, "rank").alias("last"))
    taps = (F.floor(F.bround(F.col("n") * F.lit(2 * fraction)) / 2) + 1).cast("bigint")
    both = rows.select(*keys, order, "rank").join(ends, keys).withColumn("taps", taps)
    lo = F.col("rank") - F.floor(F.col("taps") / 2)
    both = both.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("taps") - 1)
    sums = rows.select(*keys, F.col("rank").alias("place"), F.col("cum").alias("upto"))
    upto = lambda at, name: sums.select(*keys, F.col("place").alias(at), F.col("upto").alias(name))
    both = both.withColumn("a", F.greatest("lo", F.lit(1)) - 1).withColumn("b", F.least("hi", F.col("n")))
    both = both.join(upto("b", "sb"), [*keys, "b"]).join(upto("a", "sa"), [*keys, "a"], "left")
    beyond = F.greatest(1 - F.col("lo"), F.lit(0)) * F.col("first") + F.greatest(F.col("hi") - F.col("n"), F.lit(0)) * F.col("last")
    return both.select(*keys, order, ((F.col("sb") - F.coalesce("sa", F.lit(0.0)) + beyond) / F.col("taps")).alias("smoothed"))


def fitness(df: DataFrame, weights: tuple[float, float, float, float] = (0.0, 0.0, 0.1, 0.9)) -> DataFrame:
    """Add fitness: precision, recall, map50 and map weighted."""
    names = ("precision", "recall", "map50", "map")
    return df.withColumn("fitness", sum((F.col(c) * w for c, w in zip(names, weights)), F.lit(0.0)))


def match_detections(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of pairs (image_id, det_id, truth_id, iou) above a threshold: the best truth of each detection, then the best detection of each truth."""
    a = W.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "truth_id")
    b = W.partitionBy("image_id", "truth_id").orderBy(F.desc("iou"), "det_id")
    return pairs.withColumn("n", F.row_number().over(a)).where("n = 1").withColumn("n", F.row_number().over(b)).where("n = 1").drop("n")


def confusion_matrix(dets: DataFrame, truths: DataFrame, matches: DataFrame, n_classes: int) -> DataFrame:
    """(pred, truth, n): detections against truths, n_classes standing for the background on either side."""
    m = matches.select("image_id", "det_id", "truth_id")
    t = truths.select("image_id", "truth_id", F.col("cls").alias("truth")).join(m, ["image_id", "truth_id"], "left").join(dets.select("image_id", "det_id", F.col("cls").alias("pred")), ["image_id", "det_id"], "left").select(F.coalesce("pred", F.lit(n_classes)).alias("pred"), "truth")
    free = dets.join(m, ["image_id", "det_id"], "left_anti").select(F.col("cls").alias("pred"), F.lit(n_classes).alias("truth"))
    return t.unionByName(free).groupBy("pred", "truth").agg(F.count(F.lit(1)).alias("n"))


def tp_fp(matrix: DataFrame, n_classes: int) -> DataFrame:
    """(cls, tp, fp) of each predicted class but the background."""
    return matrix.where(F.col("pred") < n_classes).groupBy(F.col("pred").alias("cls")).agg(F.sum(F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("pred") != F.col("truth"), F.col("n")).otherwise(0)).alias("fp"))


def early_stopping(log: DataFrame, patience: int, *, epoch: str = "epoch", value: str = "value") -> DataFrame:
    """Rows of each run with the best value so far, its epoch, and whether patience has run out. log: run, epoch, value."""
    so_far = W.partitionBy("run").orderBy(epoch).rowsBetween(W.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))).over(so_far)
    return log.withColumn("best", best["v"]).withColumn("best_epoch", -best["e"]).withColumn("stop", F.col(epoch) - F.col("best_epoch") >= patience)


def best_row(log: DataFrame, *, epoch: str = "epoch", value: str = "value") -> DataFrame:
    """(run, epoch, value) of the best value of each run, the first on ties."""
    return log.groupBy("run").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))).alias("b")).select("run", (-F.col("b.e")).alias(epoch), F.col("b.v").alias(value))
