"""Crops of photos for training: what isn't the animal made black, the photo scaled down, a square cut out, and written as a JPEG."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from trailframe.functions import geometry
from trailframe.operators.tensors import PICTURE, changed
from trailframe.sources import jpeg, media

BOX = ("x_min", "y_min", "Width", "Height")


@lru_cache(maxsize=256)
def _places(old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of `new` pixels in a row of `old` ones: the two that it lies between, and its share of the second."""
    at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, old - 1), at - low


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By interpolation between the four nearest pixels, as pixels' middles lie; at the edges the edge goes on."""
    (y0, y1, fy), (x0, x1, fx) = _places(image.shape[0], height), _places(image.shape[1], width)
    fx, fy = fx[:, None], fy[:, None, None]
    rows = image[y0] * (1 - fy) + image[y1] * fy
    return np.clip(np.round(rows[:, x0] * (1 - fx) + rows[:, x1] * fx), 0, 255).astype(np.uint8)


def blackened(image: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    """Black outside of these pixels."""
    out = np.zeros_like(image)
    out[top:bottom, left:right] = image[top:bottom, left:right]
    return out


def padded(image: np.ndarray, side: int) -> np.ndarray:
    """In the middle of a black square; a larger image stays."""
    height, width, _ = image.shape
    h, w = max(side - height, 0), max(side - width, 0)
    return np.pad(image, ((h // 2, h - h // 2), (w // 2, w - w // 2), (0, 0))) if h or w else image


def _cut(image: np.ndarray, rect: dict | None, scaled: dict, window: dict, size: int) -> np.ndarray:
    if rect is not None:
        image = blackened(image, rect["left"], rect["top"], rect["right"], rect["bottom"])
    if scaled["scale"] is not None:
        image = resized(image, scaled["width"], scaled["height"])
    return padded(image[window["top"] : window["bottom"], window["left"] : window["right"]], size)


def cropped(pictures: DataFrame, size: int, margin: float | None = None, buffer: float | None = 0.0, box: tuple[str, ...] = BOX) -> DataFrame:
    """Pictures (image_width, image_height, pixels, and a box in shares) as squares of `size` pixels around their boxes, with `Crop`, what was cut out in
    shares of the photo. With `margin` what lies further from the box than margin times its smaller side becomes black; with `buffer` a
    photo whose box and buffer are longer than the square is scaled down until they fit. A square that stands over an edge is moved in;
    what a smaller photo lacks is black. Rows without a picture or with a null in the box have no crop: their pixels become null."""
    x, y, w, h = (F.col(c).cast("double") for c in box)
    whole = F.col("pixels").isNotNull()
    for c in box:
        whole &= F.col(c).isNotNull()
    rows = pictures.withColumn("pixels", F.when(whole, F.col("pixels")))
    scale = geometry.new_scale(x, y, w, h, F.col("image_width"), F.col("image_height"), float(buffer), size) if buffer is not None else F.lit(None).cast("double")
    struct = lambda values: F.struct(*[v.alias(k) for k, v in values.items()])
    rows = rows.withColumn("__scaled", struct({"scale": scale, "width": geometry.scaled_side(F.col("image_width"), scale), "height": geometry.scaled_side(F.col("image_height"), scale)}))
    width, height = F.col("__scaled.width"), F.col("__scaled.height")
    window = geometry.crop_window(x, y, w, h, width, height, size, inside=True)
    rows = rows.withColumns({"__window": struct(window), "Crop": geometry.normalised(window, width, height)})
    rect = struct(geometry.background(x, y, w, h, F.col("image_width"), F.col("image_height"), F.lit(float(margin)), of_box=True)) if margin is not None else F.lit(None).cast("string")
    out = changed(rows.withColumn("__rect", rect), lambda image, r, s, v: _cut(image, r, s, v, size), "__rect", "__scaled", "__window")
    return out.drop("__rect", "__scaled", "__window")


def encoded(pictures: DataFrame, quality: int = 95, name: str = "content") -> DataFrame:
    """The table with the JPEG of each picture in place of its pixels; null where there are none."""
    at = [pictures.columns.index(c) for c in PICTURE]
    rest = [c for c in pictures.columns if c != "pixels"]

    def run(batches):
        for batch in batches:
            three = zip(*[batch.column(a) for a in at], strict=True)
            images = (np.frombuffer(p.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), 3) if p.is_valid else None for w, h, p in three)
            for rows, out in media.pieces(batch, jpeg.encoded(images, quality)):
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rest], pa.array(out, pa.binary())], [*rest, name])

    return pictures.mapInArrow(run, StructType([f for f in pictures.schema.fields if f.name != "pixels"] + [StructField(name, BinaryType())]))
