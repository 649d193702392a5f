"""Figures, tables and formulas of pages: what a parser finds, the files and names they get, and triplets across text and image."""

from __future__ import annotations

import base64
import io
import json
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One row an item: images have a size, tables and formulas a text.
ITEMS = "path string, kind string, page_number int, item_index int, caption string, text string, width int, height int, saved_path string"
#: Images of fewer pixels on a side are ornaments.
LEAST_PIXELS = 10
LABEL = r"(?i)(?:figures?|figs?\.?|tables?|tab\.?)\s*\.?\s*(\d+)"


def page_items(files: DataFrame, parser: Callable[[bytes, str], list[dict]], command: list[str] | None = None, timeout: int = 600) -> DataFrame:
    """Images, tables and formulas of binary files (path, content). command: an outside converter that gets the bytes on its
    input and prints a JSON array of items; where it fails or is not given, `parser` reads the file in the worker."""

    def one(path: str, content: bytes) -> list[dict]:
        if command:
            try:
                return json.loads(subprocess.run([*command, path], input=content, capture_output=True, timeout=timeout, check=True).stdout)
            except (OSError, subprocess.SubprocessError, ValueError):
                pass  # the parser takes over
        return parser(content, path)

    names = [c.split()[0] for c in ITEMS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p} | x for p, c in zip(pdf["path"], pdf["content"], strict=True) for x in one(p, c)]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names).astype(object)

    items = files.select("path", "content").mapInPandas(run, ITEMS)
    return items.where((F.col("kind") != "image") | (F.col("width") >= LEAST_PIXELS) & (F.col("height") >= LEAST_PIXELS))


def figures_and_tables(items: DataFrame) -> DataFrame:
    """(path, file, caption) of captioned images and tables: the file is <page>-<Figure or Table><number>-<index>.png, the number
    that of the caption, else the index; an image is a table if its caption says so."""
    rows = items.where(F.col("kind").isin("image", "table") & (F.length("caption") > 0))
    kind = F.when((F.col("kind") == "table") | F.upper("caption").startswith("TABLE"), "Table").otherwise("Figure")
    number = F.coalesce(F.nullif(F.regexp_extract("caption", LABEL, 1), F.lit("")), F.col("item_index").cast("string"))
    return rows.select("path", F.concat("page_number", F.lit("-"), kind, number, F.lit("-"), "item_index", F.lit(".png")).alias("file"), "caption")


def figure_paths(items: DataFrame) -> DataFrame:
    """Of images that were saved: the first path for each (caption, page, place among the file's images); captions may repeat."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("page_number", "item_index")) - 1
    images = items.where("kind = 'image'").withColumn("place", place).where(F.length("saved_path") > 0)
    return images.select("path", F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("page_number", F.lit(0)).alias("page_number"), "place", "saved_path")


def write_figures(figures: DataFrame, folder: str) -> DataFrame:
    """Writes (paper_id, figure_id, content) to <folder>/<paper_id>/<figure_id>.png in any file system that pyarrow opens, and
    returns the paths. A task that runs again writes the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            paths = []
            for paper, figure, content in zip(pdf["paper_id"], pdf["figure_id"], pdf["content"], strict=True):
                store.create_dir(f"{root}/{paper}", recursive=True)
                with store.open_output_stream(f"{root}/{paper}/{figure}.png") as out:
                    out.write(content)
                paths.append(f"{folder}/{paper}/{figure}.png")
            yield pd.DataFrame({"paper_id": pdf["paper_id"], "figure_id": pdf["figure_id"], "path": paths})

    return figures.select("paper_id", "figure_id", "content").mapInPandas(run, "paper_id string, figure_id string, path string")


def image_for_model(content: Column, most: int = 1024, quality: int = 85) -> Column:
    """The image as base64 JPEG of at most 1024 pixels a side; null if it can't be read. Needs Pillow in the workers."""

    def one(raw: bytes | None) -> str | None:
        from PIL import Image

        try:
            image = Image.open(io.BytesIO(raw or b""))
            image.thumbnail((most, most), Image.Resampling.LANCZOS)
            out = io.BytesIO()
            image.convert("RGB").save(out, format="JPEG", quality=quality, optimize=True)
        except OSError:
            return None
        return base64.b64encode(out.getvalue()).decode()

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "string")(content)


def cross_triplets(items: DataFrame, extract: Callable[[Column, Column, Column], Column], most: int = 5) -> DataFrame:
    """Triplets of figures (item_id, text, caption, image_path): extract(text, caption, path) gives the array that graph.build
    reads; of each figure the first `most` stay. The text goes in with 2,000 characters."""
    found = extract(F.substring(F.coalesce("text", F.lit("")), 1, 2000), F.coalesce(F.nullif("caption", F.lit("")), F.lit("No caption")), F.col("image_path"))
    rows = items.select(F.col("item_id").alias("chunk_id"), F.posexplode(F.slice(found, 1, most)).alias("ord", "x"))
    return rows.select("chunk_id", F.col("ord").cast("long").alias("ord"), "x.*")
