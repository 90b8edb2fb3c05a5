"""Geometry of page layouts: boxes have ``page, pos, label, x1, y1, x2, y2``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Least sizes of boxes, greatest sizes, distance of a title, score thresholds of labels.
TARGETS, MAX_WIDTH, MAX_HEIGHT, TITLE_DISTANCE = ("image", "chart"), 800, 850, 50
THRESHOLDS = {"paragraph_title": 0.3, "formula": 0.3, "seal": 0.45}
OTHER_THRESHOLD = 0.5


def gap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Distance of two intervals, 0 where they touch."""
    return F.greatest(F.lit(0.0), b1 - a2, a1 - b2)


def distance(a: str, b: str) -> Column:
    """Least distance of two boxes whose columns are prefixed ``a`` and ``b``."""
    c = lambda p, n: F.col(f"{p}{n}").cast("double")
    x, y = gap(c(a, "x1"), c(a, "x2"), c(b, "x1"), c(b, "x2")), gap(c(a, "y1"), c(a, "y2"), c(b, "y1"), c(b, "y2"))
    return F.sqrt(x * x + y * y)


def sized(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("w", F.abs(F.col("x2") - F.col("x1"))).withColumn("h", F.abs(F.col("y2") - F.col("y1")))


def keep_boxes(boxes: DataFrame, min_w: float = 40, min_h: float = 40) -> DataFrame:
    """Images and charts that are not too small in both directions nor too large in one."""
    return sized(boxes).where(F.col("label").isin(*TARGETS)).where(~((F.col("w") < min_w) & (F.col("h") < min_h)) & (F.col("w") <= MAX_WIDTH) & (F.col("h") <= MAX_HEIGHT))


def nearest_titles(boxes: DataFrame) -> DataFrame:
    """``page, pos, title_pos, distance``: for each target box the nearest title of its page within reach, the later
    on ties. An equi-join on the page, then one aggregation."""
    targets = boxes.where(F.col("label").isin(*TARGETS)).select("page", "pos", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    titles = boxes.where("label = 'figure_title'").select("page", F.col("pos").alias("title_pos"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    met = targets.join(titles, "page").withColumn("d", distance("a_", "b_")).where(F.col("d") <= TITLE_DISTANCE)
    return met.groupBy("page", "pos").agg(F.min(F.struct("d", (-F.col("title_pos")).alias("minus"))).alias("m")).select("page", "pos", (-F.col("m.minus")).alias("title_pos"), F.round("m.d", 6).alias("distance"))


def numbered_in_page(boxes: DataFrame) -> DataFrame:
    """A two-digit number of each target box by page, label and whether it has a title."""
    titled = nearest_titles(boxes).select("page", "pos", F.lit(True).alias("titled"))
    rows = boxes.where(F.col("label").isin(*TARGETS)).join(titled, ["page", "pos"], "left").withColumn("titled", F.coalesce("titled", F.lit(False)))
    w = Window.partitionBy("page", "titled", "label").orderBy("pos")
    return rows.select("page", "pos", "label", "titled", F.lpad(F.row_number().over(w).cast("string"), 2, "0").alias("number"))


def padded(box_prefix: str, width: Column, height: Column, pad: int = 5) -> list[Column]:
    c = lambda n: F.col(f"{box_prefix}{n}")
    return [F.greatest(F.lit(0), c("x1") - pad).alias("x1"), F.greatest(F.lit(0), c("y1") - pad).alias("y1"), F.least(width, c("x2") + pad).alias("x2"), F.least(height, c("y2") + pad).alias("y2")]


def fitted(width: Column, height: Column, side: int = 1280) -> list[Column]:
    """Size whose longer side is ``side``, cut to whole pixels."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    return [(width * scale).cast("int").alias("new_width"), (height * scale).cast("int").alias("new_height")]


def unit_pixels(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.greatest(F.lit(1), (v.cast("double") / 100 * 3.78).cast("int"))


def above_threshold(boxes: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return boxes.where(F.col("score") >= F.coalesce(table[F.col("label")], F.lit(OTHER_THRESHOLD)))


def kept_pages(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, page, level``: where a document has entries of level 2 or more, the pages whose current level (that of
    the last page with entries) is not 1; all pages of other documents. ``toc (doc, level, page)``, ``pages (doc, page)``."""
    deep = toc.groupBy("doc").agg((F.max("level") >= 2).alias("deep"))
    by_page = toc.groupBy("doc", "page").agg(F.min("level").alias("own"))
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    current = pages.join(by_page, ["doc", "page"], "left").withColumn("level", F.last("own", ignorenulls=True).over(w)).join(deep, "doc", "left")
    return current.where(~F.coalesce("deep", F.lit(False)) | F.col("level").isNull() | (F.col("level") != 1)).select("doc", "page", "level")
