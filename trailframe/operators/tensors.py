"""Pictures as rows (image_width, image_height, pixels: rows of red, green and blue bytes): fading, random changes whose numbers are columns, tensors.

A change is drawn by Spark expressions from the hash of a key, and done in Arrow batches, one picture at a time. So the draws can be looked
at, stored, or given by hand, and a picture changes alike wherever it lies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailframe.operators import effects
from trailframe.operators.curation import order_of
from trailframe.sources import jpeg, media

#: Mean and deviation of the colours that models were trained with.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Of red, green and blue in grey.
GREY = np.array([0.299, 0.587, 0.114])
PICTURE = ("image_width", "image_height", "pixels")


def _array(width: int, height: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def changed(df: DataFrame, change: Callable[..., np.ndarray], *inputs: str) -> DataFrame:
    """The table with its pictures replaced by change(picture, *values of inputs). Rows without a picture stay as they are."""
    at = [df.columns.index(c) for c in (*PICTURE, *inputs)]

    def run(batches):
        for batch in batches:
            sizes = []

            def images(batch=batch, sizes=sizes):
                for width, height, pixels, *values in zip(*[batch.column(a) for a in at], strict=True):
                    if not pixels.is_valid:
                        sizes.append((width.as_py(), height.as_py()))
                        yield None
                        continue
                    image = change(_array(width.as_py(), height.as_py(), pixels.as_py()), *[v.as_py() for v in values])
                    sizes.append((image.shape[1], image.shape[0]))
                    yield np.ascontiguousarray(image).tobytes()

            for rows, made in media.pieces(batch, images()):
                for a, values in zip(at, (*zip(*sizes, strict=True), made), strict=False):
                    rows = rows.set_column(a, rows.schema.field(a), pa.array(values, rows.schema.field(a).type))
                sizes.clear()
                yield rows

    return df.mapInArrow(run, df.schema)


def ramp(length: int, margin: int) -> np.ndarray:
    """From 0 up to 1 over `margin` places, and down again at the end. A margin of one place darkens the first place only."""
    if not 0 <= 2 * margin <= length:
        raise ValueError(f"margins of {margin} don't fit in {length} places")
    out = np.ones(length)
    if margin:
        rise = np.arange(margin) / max(margin - 1, 1)
        out[:margin] = rise
        out[length - margin :] = rise[::-1] if margin > 1 else 1
    return out


def fade(image: np.ndarray, margin: float) -> np.ndarray:
    """The picture, black outside of the box of what isn't black, and faded towards the box's edges over `margin` of its shorter side. The
    box ends before its last row and column. Black pictures stay."""
    rows, columns = np.flatnonzero(image.any((1, 2))), np.flatnonzero(image.any((0, 2)))
    out = np.zeros_like(image)
    if len(rows):
        top, bottom, left, right = rows[0], rows[-1], columns[0], columns[-1]
        places = int(margin * min(bottom - top, right - left))
        mask = ramp(bottom - top, places)[:, None, None] * ramp(right - left, places)[:, None]
        out[top:bottom, left:right] = image[top:bottom, left:right] * mask
    return out


def uniform(seed: int, name: str, key: str, low: float = 0.0, high: float = 1.0) -> Column:
    """A number for each key and name."""
    n = F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(name), order_of(seed, key))), F.lit(1), F.lit(12)), 16, 10).cast("double")
    return F.lit(low) + (n + 0.5) / float(16**12) * (high - low)


def faded(df: DataFrame, key: str, least: float = 0.05, most: float = 0.05, seed: int = 0) -> DataFrame:
    """Every picture faded over a margin between `least` and `most`, half at the utmost, drawn by its key."""
    return changed(df.withColumn("__margin", uniform(seed, "margin", key, least, most)), fade, "__margin").drop("__margin")


def affine(image: np.ndarray, dx: float, dy: float, scale: float, degrees: float) -> np.ndarray:
    """Turned (against the clock) and scaled around its middle, then shifted by shares of width and height. What comes from outside is
    mirrored, between pixels it is interpolated."""
    height, width, _ = image.shape
    cx, cy = (width - 1) / 2, (height - 1) / 2
    cos, sin = np.cos(np.radians(degrees)) / scale, np.sin(np.radians(degrees)) / scale
    y, x = np.mgrid[:height, :width].astype(np.float64)
    x, y = x - cx - dx * width, y - cy - dy * height
    sx, sy = cos * x - sin * y + cx, sin * x + cos * y + cy
    return effects.sampled(image, sx, sy)


def cropped(image: np.ndarray, size: int, x: float = 0.5, y: float = 0.5) -> np.ndarray:
    """size x size pixels at a share of the room to the left and above; pictures that are smaller are padded with black first, evenly."""
    height, width, _ = image.shape
    if height < size or width < size:
        h, w = max(size - height, 0), max(size - width, 0)
        image = np.pad(image, ((h // 2, h - h // 2), (w // 2, w - w // 2), (0, 0)))
        height, width, _ = image.shape
    top, left = min(int((height - size + 1) * y), height - size), min(int((width - size + 1) * x), width - size)
    return image[top : top + size, left : left + size]


DRAWS = (
    "weather int, fog double, slant double, weather_x double, weather_y double, moved boolean, dx double, dy double, scale double, degrees double, "
    "warped boolean, columns array<double>, rows array<double>, x double, y double, colour int, red double, green double, blue double, brightness double, "
    "contrast double, hue double, saturation double, value double, grey boolean, shadow array<double>, flare array<double>, flipped boolean, quality int, blur double, blur_size int"
)


def draws(key: str, seed: int = 0, turned: float = 30, shifted: float = 0.1, smaller: float = 0.75, larger: float = 0.1) -> Column:
    """A struct of DRAWS for each key: with a chance of 0.2 fog (1) or rain (2); with 0.8 a shift, scale and turn; with 0.1 a grid of five by
    five cells, a tenth larger or smaller at most; a place of the crop; with 0.5 a change of colour: of each of the three by 15 levels at most (1),
    of brightness and contrast by a fifth at most (2), or of hue by 40 degrees, saturation by 30 and value by 20 levels at most (3); with 0.2
    grey; with 0.2 a shadow of five corners in the lower half; with 0.2 a light in the upper half (else both are null); with 0.5 mirrored;
    with 0.2 a compression of quality 70 to 100 (else 0); with 0.1 a blur over 3, 5 or 7 pixels with a sigma of up to 9 (else 0)."""
    u = lambda name, low=0.0, high=1.0: uniform(seed, name, key, low, high)
    cells = lambda name: F.array(*[u(f"{name}{k}", 0.9, 1.1) for k in range(5)])
    corners = F.array(*[c for k in range(5) for c in (u(f"shadow_x{k}"), u(f"shadow_y{k}", 0.5, 1.0))])
    values = {
        "weather": F.when(u("weather") < 0.2, F.when(u("sort") < 0.5, 1).otherwise(2)).otherwise(0), "fog": u("fog", 0.3, 1.0), "slant": u("slant", -10, 10),
        "weather_x": u("weather_x"), "weather_y": u("weather_y"),
        "moved": u("moved") < 0.8, "dx": u("dx", -shifted, shifted), "dy": u("dy", -shifted, shifted), "scale": 1 + u("scale", -smaller, larger),
        "degrees": u("degrees", -turned, turned), "warped": u("warped") < 0.1, "columns": cells("column"), "rows": cells("row"), "x": u("x"), "y": u("y"),
        "colour": F.when(u("colour") < 0.5, F.floor(u("kind", 1, 4)).cast("int")).otherwise(0), "red": u("red", -15, 15), "green": u("green", -15, 15),
        "blue": u("blue", -15, 15), "brightness": u("brightness", -0.2, 0.2), "contrast": u("contrast", -0.2, 0.2), "hue": u("hue", -40, 40),
        "saturation": u("saturation", -30, 30), "value": u("value", -20, 20), "grey": u("grey") < 0.2, "shadow": F.when(u("shadow") < 0.2, corners),
        "flare": F.when(u("flare") < 0.2, F.array(u("flare_x"), u("flare_y", 0, 0.5), u("flare_turn", 0, 360))), "flipped": u("flipped") < 0.5,
        "quality": F.when(u("compressed") < 0.2, F.floor(u("quality", 70, 101)).cast("int")).otherwise(0),
        "blur": F.when(u("blurred") < 0.1, u("blur", 0, 9)).otherwise(0.0), "blur_size": 2 * F.floor(u("blur_size", 1, 4)).cast("int") + 1,
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def augment(image: np.ndarray, drawn: dict, size: int) -> np.ndarray:
    """The drawn changes, in the order of DRAWS; what is null isn't done."""
    d = drawn
    if d.get("weather") == 1:
        image = effects.fogged(image, d["fog"], d["weather_x"], d["weather_y"])
    elif d.get("weather") == 2:
        image = effects.rained(image, d["slant"], d["weather_x"], d["weather_y"])
    if d["moved"]:
        image = affine(image, d["dx"], d["dy"], d["scale"], d["degrees"])
    if d.get("warped"):
        image = effects.warped(image, d["columns"], d["rows"])
    image = cropped(image, size, d["x"], d["y"])
    if d["colour"] == 1:
        image = effects.to_bytes(image + np.array([d["red"], d["green"], d["blue"]]))
    elif d["colour"] == 2:
        image = effects.to_bytes(image * (1 + d["contrast"]) + 255 * d["brightness"])
    elif d["colour"] == 3:
        image = effects.hue_moved(image, d["hue"], d["saturation"], d["value"])
    if d["grey"]:
        image = effects.to_bytes(np.repeat((image @ GREY)[..., None], 3, -1))
    if d.get("shadow"):
        image = effects.shaded(image, d["shadow"])
    if d.get("flare"):
        image = effects.flared(image, *d["flare"])
    if d["flipped"]:
        image = image[:, ::-1]
    if d["quality"]:
        image = jpeg.decode(jpeg.encode(image, d["quality"]))
    return effects.blurred(image, d["blur"], d["blur_size"]) if d.get("blur") else image


def augmented(df: DataFrame, key: str, size: int = 480, seed: int = 0, drawn: Column | None = None) -> DataFrame:
    """Every picture changed by `drawn` (the numbers of its key), size x size pixels large."""
    rows = df.withColumn("__drawn", draws(key, seed) if drawn is None else drawn)
    return changed(rows, lambda image, d: augment(image, d, size), "__drawn").drop("__drawn")


def centred(df: DataFrame, size: int = 480) -> DataFrame:
    """The middle of every picture."""
    return changed(df, lambda image: cropped(image, size))


def tensors(df: DataFrame, mean: tuple[float, ...] = MEAN, deviation: tuple[float, ...] = DEVIATION) -> DataFrame:
    """The table with `tensor`, array<float>: all red values, then green and blue, as shares of 255 less the mean, by the deviation. In
    place of the pixels; null where there are none."""
    at = [df.columns.index(c) for c in PICTURE]
    rest = [c for c in df.columns if c != "pixels"]

    def run(batches):
        for batch in batches:

            def values(batch=batch):
                for width, height, pixels in zip(*[batch.column(a) for a in at], strict=True):
                    whole = pixels.is_valid
                    yield ((_array(width.as_py(), height.as_py(), pixels.as_py()) / 255 - mean) / deviation).transpose(2, 0, 1).ravel().astype("<f4").tobytes() if whole else None

            for rows, made in media.pieces(batch, values()):
                tensor = pa.array([None if v is None else np.frombuffer(v, "<f4") for v in made], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in rest], tensor], [*rest, "tensor"])

    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name != "pixels"] + StructType.fromDDL("tensor array<float>").fields))
