"""Measurements of small grey images as relational operations over (image_id, y, x, v) rows.

The numpy kernels measure real pages; these forms state the same measures in
DataFrame terms and check them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 8


def pixels(vectors: DataFrame) -> DataFrame:
    """image_id, y, x, v of vectors of 64 values in about +-0.5, as 8 x 8 images of grey levels."""
    level = lambda e: F.floor(F.least(F.greatest((e.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    rows = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode(F.transform("embedding", level)).alias("k", "v"))
    return rows.select("image_id", F.floor(F.col("k") / SIDE).cast("int").alias("y"), (F.col("k") % SIDE).cast("int").alias("x"), "v")


def grid(vectors: DataFrame) -> DataFrame:
    """image_id, g: the image as an array of rows."""
    level = lambda e: F.floor(F.least(F.greatest((e.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    flat = F.transform("embedding", level)
    return vectors.select(F.col("vec_id").alias("image_id"), flat.alias("g"))


def mirrored(k: Column) -> Column:
    """An index beyond the border, mirrored at it without repeating the border itself."""
    return F.when(k < 0, -k).when(k >= SIDE, 2 * SIDE - 2 - k).otherwise(k)


def laplacian_variance(vectors: DataFrame) -> DataFrame:
    """image_id, blur_score: population variance of the four-neighbour Laplacian; nothing is shuffled."""
    at = lambda g, y, x: F.get(g, mirrored(y) * SIDE + mirrored(x))

    def value(g: Column) -> Column:
        def one(k: Column) -> Column:
            y, x = F.floor(k / SIDE).cast("int"), (k % SIDE).cast("int")
            return (at(g, y - 1, x) + at(g, y + 1, x) + at(g, y, x - 1) + at(g, y, x + 1) - 4 * at(g, y, x)).cast("double")

        return F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), one)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = float(SIDE * SIDE)
    laid = grid(vectors).select("image_id", value(F.col("g")).alias("l"))
    sums = laid.select("image_id", total(F.col("l")).alias("s"), total(F.transform("l", lambda v: v * v)).alias("q"))
    return sums.select("image_id", F.round(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n), 4).alias("blur_score"))


def glare(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.round(F.avg((F.col("v") >= 250).cast("double")), 6).alias("glare_ratio"))


def brightness(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.median("v").alias("median_brightness"))


def profile_score(px: DataFrame, dark_below: int = 128) -> DataFrame:
    """image_id, score: population variance of differences between neighbouring rows' dark pixels; level lines of text score high."""
    rows = px.groupBy("image_id", "y").agg(F.sum((F.col("v") < dark_below).cast("int")).alias("ink"))
    step = F.col("ink") - F.lag("ink").over(Window.partitionBy("image_id").orderBy("y"))
    d = rows.select("image_id", step.cast("double").alias("d")).where("d is not null")
    return d.groupBy("image_id").agg(F.round(F.var_pop("d"), 4).alias("score"))


def paper_mask(px: DataFrame, share: float = 0.6, percentile: float = 0.9) -> DataFrame:
    """image_id, n_paper: pixels whose 3 x 3 mean reaches share of the image's percentile of such means."""
    near = px.select("image_id", "v", F.explode(F.sequence(F.greatest(F.col("y") - 1, F.lit(0)), F.least(F.col("y") + 1, F.lit(SIDE - 1)))).alias("cy"), "x")
    near = near.select("image_id", "v", "cy", F.explode(F.sequence(F.greatest(F.col("x") - 1, F.lit(0)), F.least(F.col("x") + 1, F.lit(SIDE - 1)))).alias("cx"))
    means = near.groupBy("image_id", "cy", "cx").agg((F.sum("v") / F.count(F.lit(1))).alias("m"))
    level = means.groupBy("image_id").agg(F.percentile("m", F.lit(percentile)).alias("p")).withColumnRenamed("image_id", "i")
    return means.join(level, F.col("image_id") == F.col("i")).groupBy("image_id").agg(F.count_if(F.col("m") >= share * F.col("p")).alias("n_paper"))


def ink_ratio(px: DataFrame, dark_below: int = 100) -> DataFrame:
    """image_id, top, bottom, left, right: dark share of the outermost two rows and columns, and the largest of them."""
    dark = (F.col("v") < dark_below).cast("double")
    side = lambda where: F.round(F.avg(F.when(where, dark)), 6)
    out = px.groupBy("image_id").agg(side(F.col("y") < 2).alias("top"), side(F.col("y") >= SIDE - 2).alias("bottom"), side(F.col("x") < 2).alias("left"), side(F.col("x") >= SIDE - 2).alias("right"))
    return out.withColumn("border_ink", F.greatest("top", "bottom", "left", "right"))


def largest_component(images: DataFrame, dark_below: int = 100) -> DataFrame:
    """image_id, n_components, largest: eight-connected dark blobs, by least labels that spread within each image's few pixels.

    Labels live in one array an image; a pass gives every dark pixel the least
    label around it, and SIDE * SIDE passes reach the farthest pixel.
    """
    n = SIDE * SIDE
    far = n + 1
    start = lambda g: F.transform(g, lambda v, k: F.when(v < dark_below, k).otherwise(F.lit(far)))

    def around(a: Column, k: Column) -> Column:
        y, x = F.floor(k / SIDE).cast("int"), (k % SIDE).cast("int")
        near = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                ok = (y + dy >= 0) & (y + dy < SIDE) & (x + dx >= 0) & (x + dx < SIDE)
                near.append(F.when(ok, F.get(a, k + dy * SIDE + dx)).otherwise(F.lit(far)))
        return F.least(*near)

    spread = lambda a: F.transform(a, lambda v, k: F.when(v == far, v).otherwise(around(a, k)))
    dark = F.aggregate(F.sequence(F.lit(1), F.lit(n // 2)), start(F.col("g")), lambda a, _: spread(a))
    labelled = images.select("image_id", dark.alias("labels"))
    each = labelled.select("image_id", F.explode("labels").alias("label")).where(F.col("label") < far).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("c"))
    found = each.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_components"), F.max("c").alias("largest")).withColumnRenamed("image_id", "i")
    return labelled.select("image_id").join(found, F.col("image_id") == F.col("i"), "left").select("image_id", F.coalesce("n_components", F.lit(0)).alias("n_components"), F.coalesce("largest", F.lit(0)).alias("largest"))
