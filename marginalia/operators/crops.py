"""Crop boxes and picture names for rectangles and stroke clusters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.geometry import pixel_box
from marginalia.operators.blocks import ANNOTATION, PAGE, block_of, number_rows, page_block, spread_join
from marginalia.operators.names import file_stems
from marginalia.operators.stored import stored
from marginalia.operators.strokes import cluster_bounds

# File names of the crops, numbered per document, and their folder.
CROP_NAME = "annotation_%03d.png"
IMAGE_DIR_SUFFIX = "-annotations-images"


def drawable_pages(ann: DataFrame) -> DataFrame:
    """Pages with a rectangle or stroke, the only ones whose picture is needed."""
    return ann.where(F.col("kind").isin("rect", "freehand")).select(*PAGE).distinct()


def pixel_boxes(ann: DataFrame, clusters: DataFrame, geometry: DataFrame) -> DataFrame:
    """Pixel boxes of rectangles and clusters on pages that could be drawn.

    `is_cluster` is 0 for rectangles and 1 for clusters, `entry_idx` the (smallest) annot_idx.
    """
    box = ["x", "y", "w", "h"]
    rects = ann.where(F.col("kind") == "rect").select(
        *PAGE, F.lit(0).alias("is_cluster"), F.col("annot_idx").alias("entry_idx"), *box)
    groups = cluster_bounds(clusters).select(
        *PAGE, F.lit(1).alias("is_cluster"), F.col("cluster_idx").alias("entry_idx"), *box)
    entries = spread_join(rects.unionByName(groups), geometry.select(*PAGE, "bmp_w", "bmp_h"),
                          PAGE, "entry_idx", "inner")
    cut = pixel_box(*(F.col(c) for c in [*box, "bmp_w", "bmp_h"]))
    return (entries.withColumn("_box", cut).where(F.col("_box").isNotNull())
            .select(*PAGE, "is_cluster", "entry_idx", "_box.*"))


def image_dirs(names: DataFrame) -> DataFrame:
    """The folder of each document's crops, next to its digest; no two documents share one."""
    return file_stems(names).select("doc_id", F.concat("stem", F.lit(IMAGE_DIR_SUFFIX)).alias("image_dir"))


def number_crops(boxes: DataFrame, image_dir: str | DataFrame) -> DataFrame:
    """Add crop_no, counted per document by page, rectangles before clusters, and image_path.

    `image_dir` is one folder or the table of `image_dirs`.
    """
    rows = (stored(boxes).withColumn("_pages", page_block())
            .withColumn("_part", block_of(F.col("entry_idx"))))
    levels = [["_pages"], ["page_idx", "is_cluster", "_part"]]
    numbered = number_rows(rows, ["doc_id"], levels, ["entry_idx"], "crop_no")
    if isinstance(image_dir, str):
        folder = F.lit(_folder(image_dir))
    else:
        numbered = spread_join(numbered, image_dir, ["doc_id"], "page_idx")
        folder = F.coalesce(F.concat("image_dir", F.lit("/")), F.lit(""))
    name = F.format_string(CROP_NAME, F.col("crop_no"))
    return (numbered.withColumn("image_path", F.concat(folder, name))
            .select(*boxes.columns, "crop_no", "image_path"))


def crops(ann: DataFrame, clusters: DataFrame, geometry: DataFrame,
          image_dir: str | DataFrame) -> DataFrame:
    """image_path by annotation; the strokes of a cluster share one picture."""
    numbered = number_crops(pixel_boxes(ann, clusters, geometry), image_dir)
    rects = numbered.where("is_cluster = 0").select(
        *PAGE, F.col("entry_idx").alias("annot_idx"), "image_path")
    pictures = numbered.where("is_cluster = 1").select(
        *PAGE, F.col("entry_idx").alias("cluster_idx"), "image_path")
    members = spread_join(clusters.select(*ANNOTATION, "cluster_idx"), pictures,
                          [*PAGE, "cluster_idx"], "annot_idx", "inner")
    return rects.unionByName(members.select(*ANNOTATION, "image_path"))


def with_images(ann: DataFrame, images: DataFrame, rel_dir: str | None = None,
                how: str = "left") -> DataFrame:
    """Add image_path as seen from the digest: file name below `rel_dir`, or below the last
    folder of its own path."""
    name = F.substring_index("image_path", "/", -2)
    if rel_dir is not None:
        name = F.concat(F.lit(_folder(rel_dir)), F.substring_index("image_path", "/", -1))
    shown = images.select(*ANNOTATION, name.alias("image_path"))
    return ann.join(shown, ANNOTATION, how)


def _folder(path: str) -> str:
    return path if not path or path.endswith("/") else path + "/"
