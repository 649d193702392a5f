"""Page layout: margin line numbers, overlap of boxes, greedy suppression, merged boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def body_lines(lines: DataFrame) -> DataFrame:
    """layout_lines without line numbers: numbers left of 8 % or right of 92 % of the page's width."""
    number = F.col("text").rlike(r"^\s*\d{1,4}\s*$")
    margin = (F.col("x0") < F.col("page_width") * 0.08) | (F.col("x1") > F.col("page_width") * 0.92)
    return lines.where(~(number & margin))


def page_text(lines: DataFrame) -> DataFrame:
    """Per document one text, each page led by its mark."""
    page = body_lines(lines).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return page.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "t"))), lambda x: F.concat(F.lit("\n[Page "), x["page"], F.lit("]\n"), x["t"])), "").alias("text"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 for boxes without area."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def overlaps(boxes: DataFrame, over: float = 0.5) -> DataFrame:
    """Pairs of boxes (doc_id, page, idx, bbox) of one page with an IoU over the limit."""
    b = boxes.select("doc_id", "page", F.col("idx").alias("idx2"), F.col("bbox").alias("bbox2"))
    j = boxes.join(b, ["doc_id", "page"]).where("idx < idx2").withColumn("iou", iou(F.col("bbox"), F.col("bbox2")))
    return j.where(F.col("iou") > over).select("doc_id", "page", "idx", "idx2", "iou")


def suppress(boxes: DataFrame, over: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression per page: larger boxes first, a box that overlaps a kept one goes."""
    item = F.struct((-area(F.col("bbox"))).alias("less"), F.col("idx").alias("idx"), F.col("bbox").alias("bbox"))
    pages = boxes.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("all"))
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k["bbox"], b["bbox"]) > over), kept).otherwise(F.concat(kept, F.array(b))))
    return pages.select("doc_id", "page", F.explode(fold).alias("k")).select("doc_id", "page", "k.idx")


def merged_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox"))


def image_priority(sources: DataFrame, forced: bool = False) -> DataFrame:
    """Image paths of hits (query_id, rank, image_path, is_caption, mentions) by priority; each path once, the best first."""
    p = F.when(F.col("is_caption") & (F.col("rank") == 1), 100).when(F.col("is_caption"), 95).when(F.col("mentions") & (F.col("rank") <= 3), 80).when(F.col("mentions"), 70).when(F.col("rank") <= 3, 50).otherwise(30)
    rows = sources.where(F.length("image_path") > 0).withColumn("priority", p)
    best = rows.groupBy("query_id", "image_path").agg(F.max("priority").alias("priority"), F.min("rank").alias("rank"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("priority"), "rank", "image_path")))
