"""Boxes [x_min, y_min, width, height], in shares of the image from its top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def crop_window(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column, size: Column | int, inside: bool = False) -> dict[str, Column]:
    """A square of `size` pixels centred on the box, whatever the box's size, moved by as much as it stands over an edge.

    Where it stands over both edges of a side it starts at 0, and with `inside` ends at the image's edge. Without `inside` a square
    that is larger than the image may start below 0; with it, it is cut to the image. Starts are cut towards zero.
    """
    side = F.lit(size) if isinstance(size, int) else size
    zero = F.lit(0)

    def ends(at: Column, length: Column, whole: Column) -> tuple[Column, Column]:
        first = ((at + length / 2) * whole - side / 2).cast("int")
        below, above = F.least(first, zero), F.greatest(first + side - whole, zero)
        start = first - below - above
        stop = start + side
        if inside:
            start, stop = F.greatest(start, zero), F.least(stop, whole)
        over = (below < 0) & (above > 0)
        return F.when(over, zero).otherwise(start), F.when(over, whole if inside else side).otherwise(stop)

    (left, right), (top, bottom) = ends(x, w, img_w), ends(y, h, img_h)
    return {"left": left, "top": top, "right": right, "bottom": bottom}


def new_scale(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column, buffer: Column | float, size: Column | int) -> Column:
    """The factor that brings the longer side of the box, with `buffer` (a share of the image) on each side and cut to the image, down
    to `size` pixels; null for boxes that fit."""
    room = F.lit(buffer) if isinstance(buffer, float) else buffer
    side = F.lit(size) if isinstance(size, int) else size
    zero, one = F.lit(0.0), F.lit(1.0)

    def pixels(at: Column, length: Column, whole: Column) -> Column:
        return (clamp(at + length + room, zero, one) - clamp(at - room, zero, one)) * whole

    longest = F.greatest(pixels(x, w, img_w), pixels(y, h, img_h))
    return F.when(longest > side, side / longest)


def scaled_side(length: Column, scale: Column) -> Column:
    """Pixels of a side after scaling, halves to even; a null scale leaves it."""
    return F.when(scale.isNull(), length).otherwise(F.bround(length * scale).cast("int"))


def normalised(window: dict[str, Column], img_w: Column, img_h: Column) -> Column:
    """[left, top, right, bottom] in shares of the (scaled) image, to four digits."""
    sides = (("left", img_w), ("top", img_h), ("right", img_w), ("bottom", img_h))
    return F.array(*[F.bround(window[k] / whole, 4) for k, whole in sides])


def background(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column, margin: Column, of_box: bool = False) -> dict[str, Column]:
    """Pixels of the box with a margin, in the image. The margin is a share of the image's sides, or `of_box`: times the box's smaller one."""
    if of_box:
        margin = margin * F.least(w, h)
    zero, one = F.lit(0.0), F.lit(1.0)
    return {
        "left": F.floor(clamp(x - margin, zero, one) * img_w).cast("int"), "top": F.floor(clamp(y - margin, zero, one) * img_h).cast("int"),
        "right": F.floor(clamp(x + w + margin, zero, one) * img_w).cast("int"), "bottom": F.floor(clamp(y + h + margin, zero, one) * img_h).cast("int"),
    }


def pad_offset(length: Column, side: Column) -> Column:
    return F.floor((side - length) / 2).cast("int")


def centre_square(w: Column, h: Column) -> dict[str, Column]:
    side = F.least(w, h)
    return {"left": F.floor((w - side) / 2).cast("int"), "top": F.floor((h - side) / 2).cast("int"), "side": side}


def as_text(values: Column, size: int = 4) -> Column:
    """The first `size` four-digit numbers as a list in text, `[0.1, 0.0, 1.0, 0.0005]`."""

    def plain(v: Column) -> Column:
        digits = F.rtrim(v.cast("decimal(20,4)").cast("string"), F.lit("0"))
        return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)

    # four fixed places, not a lambda, so that generated code does it
    return F.concat(F.lit("["), F.concat_ws(", ", *[plain(F.get(values, F.lit(i))) for i in range(size)]), F.lit("]"))
