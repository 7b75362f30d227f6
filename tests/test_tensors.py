"""Fading, random changes with given numbers, and tensors, against pixels worked by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.operators import crops, effects, tensors
from trailframe.sources import jpeg

SCHEMA = "id long, image_width int, image_height int, pixels binary"
STILL = {"moved": False, "dx": 0.0, "dy": 0.0, "scale": 1.0, "degrees": 0.0, "x": 0.0, "y": 0.0, "colour": 0, "red": 0.0, "green": 0.0, "blue": 0.0, "brightness": 0.0, "contrast": 0.0, "grey": False, "flipped": False, "quality": 0}


def numbered(height, width):
    return np.stack([np.arange(height * width).reshape(height, width) + c for c in (0, 50, 100)], -1).astype(np.uint8)


def test_ramp_by_hand():
    assert tensors.ramp(8, 3).tolist() == [0, 0.5, 1, 1, 1, 1, 0.5, 0]
    assert tensors.ramp(5, 1).tolist() == [0, 1, 1, 1, 1]
    assert tensors.ramp(4, 0).tolist() == [1, 1, 1, 1]
    assert tensors.ramp(4, 2).tolist() == [0, 1, 1, 0]
    with pytest.raises(ValueError, match="fit"):
        tensors.ramp(5, 3)


def test_fade_by_hand():
    """A bright box of 9 x 7 pixels at (2, 1): it ends before its last row and column, and a third of 6 places fades."""
    image = np.zeros((12, 12, 3), np.uint8)
    image[2:11, 1:8] = 201
    got = tensors.fade(image, 0.34)
    row = np.array([0, 1, 1, 1, 1, 1, 1, 0])
    column = np.array([0, 1, 1, 1, 1, 0])
    want = np.zeros((12, 12), np.uint8)
    want[2:10, 1:7] = 201 * np.outer(row, column)
    assert (got == want[..., None]).all()
    wide = np.zeros((20, 20, 3), np.uint8)
    wide[0:13, 0:13] = 99
    assert tensors.fade(wide, 0.25)[6, :12, 0].tolist() == [0, 49, 99, 99, 99, 99, 99, 99, 99, 99, 49, 0]  # 49.5 is cut
    assert (tensors.fade(np.zeros((3, 3, 3), np.uint8), 0.05) == 0).all()


def test_affine_by_hand():
    image = numbered(4, 4)
    assert (tensors.affine(image, 0, 0, 1, 0) == image).all()
    assert (tensors.affine(image, 0, 0, 1, 90) == np.rot90(image)).all()
    assert (tensors.affine(image, 0.25, 0, 1, 0)[:, 1:] == image[:, :-1]).all()
    assert (tensors.affine(image, 0.25, 0, 1, 0)[:, 0] == image[:, 1]).all()  # mirrored at the first column
    assert (tensors.affine(image, 0, -0.5, 1, 0)[:2] == image[2:]).all()
    half = tensors.affine(image, 0.125, 0, 1, 0)
    assert half[1, 1].tolist() == [4, 54, 104]  # between 4 and 5, halves to even
    big = tensors.affine(image, 0, 0, 2, 0)
    assert big[0, 0, 0] == 4 and big[3, 3, 0] == 11  # 0.75 + 0.75 * 4 = 3.75, and 2.25 + 2.25 * 4


def test_crop_by_hand():
    image = numbered(5, 6)
    assert tensors.cropped(image, 3)[0, 0, 0] == 6 * 1 + 2
    assert tensors.cropped(image, 3, 0, 0)[0, 0, 0] == 0 and tensors.cropped(image, 3, 0.999, 0.999)[0, 0, 0] == 6 * 2 + 3
    small = tensors.cropped(image, 8)
    assert small.shape == (8, 8, 3) and (small[1:6, 1:7] == image).all() and small.sum() == image.sum()


def test_colours_by_hand():
    image = np.full((2, 3, 3), [100, 250, 3], np.uint8)
    one = lambda **d: tensors.augment(image, STILL | d, 2)[0, 0].tolist()
    assert one(colour=1, red=10.4, green=15.0, blue=-15.0) == [110, 255, 0]
    assert one(colour=2, contrast=0.2, brightness=-0.1) == [94, 255, 0]  # 120 - 25.5, halves to even
    assert one(grey=True) == [177, 177, 177]  # 29.9 + 146.75 + 0.342
    assert one() == [100, 250, 3]
    assert np.abs(np.array(one(quality=95)) - [100, 250, 3]).max() <= 3
    assert (tensors.augment(numbered(2, 2), STILL | {"flipped": True}, 2) == numbered(2, 2)[:, ::-1]).all()


def test_blur_by_hand():
    image = np.zeros((5, 5, 3), np.uint8)
    image[2, 2] = 160
    got = effects.blurred(image, 1 / np.sqrt(2 * np.log(2)), 3)[..., 0]  # weights 1/4, 1/2, 1/4
    assert got[1:4, 1:4].tolist() == [[10, 20, 10], [20, 40, 20], [10, 20, 10]] and got.sum() == 160
    edge = np.zeros((1, 4, 3), np.uint8)
    edge[0, 1] = 100
    assert effects.blurred(edge, 1 / np.sqrt(2 * np.log(2)), 3)[0, :, 0].tolist() == [50, 50, 25, 0]  # mirrored at the first pixel
    assert effects.blurred(image, 0, 7) is image
    assert (effects.blurred(np.full((3, 9, 3), 77, np.uint8), 9, 7) == 77).all()


def test_shadow_by_hand():
    image = np.full((4, 6, 3), 101, np.uint8)
    got = effects.shaded(image, [0.0, 0.5, 0.5, 0.5, 0.5, 1.0, 0.0, 1.0])[..., 0]
    assert got.tolist() == [[101] * 6, [101] * 6, [50, 50, 50, 101, 101, 101], [50, 50, 50, 101, 101, 101]]  # 50.5: halves to even
    triangle = effects.inside(4, 4, [0, 0, 1, 1, 0, 1])
    assert np.tril(np.ones((4, 4)), -1).astype(bool).tolist() == (triangle & ~np.eye(4, dtype=bool)).tolist()
    crossed = effects.inside(8, 8, [0, 0, 1, 1, 1, 0, 0, 1])  # two triangles that meet in the middle
    assert crossed[4, 0] and crossed[4, 7] and not crossed[0, 4] and not crossed[7, 4]
    twice = [0, 0, 1, 0, 1, 1, 0, 1]
    assert effects.inside(3, 3, twice).all() and not effects.inside(3, 3, twice * 2).any()
    assert not effects.inside(3, 3, [0.1, 0.1]).any()


def test_hue_by_hand():
    colours = np.array([[[200, 100, 100], [100, 200, 100], [100, 100, 200], [60, 60, 60], [0, 0, 0], [255, 255, 255]]], np.uint8)
    assert (effects.hue_moved(colours, 0, 0, 0) == colours).all()
    assert effects.hue_moved(colours, 120, 0, 0)[0].tolist() == [[100, 200, 100], [100, 100, 200], [200, 100, 100], [60] * 3, [0] * 3, [255] * 3]
    assert effects.hue_moved(colours, -60, 0, 0)[0, 0].tolist() == [200, 100, 200]
    assert effects.hue_moved(colours, 0, 51, 0)[0, 0].tolist() == [200, 60, 60]  # saturation from 0.5 to 0.7
    assert effects.hue_moved(colours, 0, 0, 20)[0, 3:].tolist() == [[80] * 3, [20] * 3, [255] * 3]
    assert effects.hue_moved(colours, 0, 0, -50)[0, 0].tolist() == [150, 75, 75]
    r = np.random.default_rng(5).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    assert (effects.hue_moved(r, 360, 0, 0) == r).all() and np.abs(effects.hue_moved(effects.hue_moved(r, 40, 0, 0), -40, 0, 0).astype(int) - r).max() <= 3


def test_grid_by_hand():
    image = numbered(3, 11)
    assert (effects.warped(image, [1] * 5, [1] * 5) == image).all()
    assert effects.stretched(11, [1, 3]).tolist() == pytest.approx([0, 0.5, 1, 1.5, 2, 2.5, 4, 5.5, 7, 8.5, 10])
    assert effects.warped(image, [1, 3], [1])[0, :, 0].tolist() == [0, 0, 1, 2, 2, 2, 4, 6, 7, 8, 10]  # halves to even
    assert (effects.warped(numbered(1, 1), [1, 3], [2, 1]) == numbered(1, 1)).all()


def test_weather_by_hand():
    image = np.full((40, 60, 3), 100, np.uint8)
    one = effects.fogged(image, 0.3, 0.5, 0.5, puffs=1, density=0.2)  # a puff of 3 pixels at (30, 20), not blurred
    near = (np.arange(60) - 30) ** 2 + (np.arange(40)[:, None] - 20) ** 2 <= 9
    assert (one == np.where(near, 131, 100)[..., None]).all()
    fog = effects.fogged(image, 1.0, 0.1, 0.2)
    assert fog.min() >= 100 and fog.mean() > 120 and (effects.fogged(np.full_like(image, 255), 1.0, 0.1, 0.2) == 255).all()
    assert (effects.rained(np.full((9, 9, 3), 100, np.uint8), 5, 0.5, 0.5) == 70).all()  # too small for a streak
    streak = effects.rained(np.zeros((100, 50, 3), np.uint8), 0, 0.5, 0.0, room=5000)  # one, straight down at x = 25 from the top, 60 long
    assert (streak[10, 22:29, 0] == 20).all() and (streak[10, [21, 29]] == 0).all() and (streak[70:] == 0).all()  # 200 / 7 * 0.7
    slanted = effects.rained(np.zeros((100, 50, 3), np.uint8), 20, 0.5, 0.0, room=5000)[..., 0]
    assert slanted[55, 40:47].any() and not slanted[55, :38].any()
    dark = np.zeros((50, 100, 3), np.uint8)
    flare = effects.flared(dark, 0.5, 0.5, 0.0, radius=20, discs=0)[..., 0].astype(int)
    assert flare[25, 50] == 255 and flare[25, 71] == 0 and (np.diff(flare[25, 50:72]) <= 0).all() and flare[25, 69:71].tolist() == [0, 0]
    assert flare[25, 68] == round(255 * (1 - (1 - 0.1**3) * (1 - 0.05**3)))
    assert effects.flared(dark, 0.5, 0.5, 0.0, radius=20, discs=1)[25, 99].tolist() == [0] * 3  # its disc lies beyond the edge
    assert effects.flared(dark, 0.0, 0.5, 0.0, radius=20, discs=2)[25, 50].tolist() == [26, 24, 24]  # a tenth of 255, 235, 235


def test_effects_in_their_order():
    image = np.random.default_rng(1).integers(0, 256, (30, 30, 3)).astype(np.uint8)
    drawn = STILL | {"weather": 2, "slant": 3.0, "weather_x": 0.1, "weather_y": 0.2, "fog": 0.5, "warped": True, "columns": [1, 2], "rows": [3, 1], "colour": 3, "hue": 20.0, "saturation": 9.0,
                     "value": -9.0, "shadow": [0, 0.5, 1, 0.5, 0.3, 1], "flare": [0.2, 0.1, 45.0], "flipped": True, "blur": 2.0, "blur_size": 5}
    want = effects.warped(effects.rained(image, 3.0, 0.1, 0.2), [1, 2], [3, 1])[:24, :24]
    want = effects.flared(effects.shaded(effects.hue_moved(want, 20, 9, -9), [0, 0.5, 1, 0.5, 0.3, 1]), 0.2, 0.1, 45.0)
    assert (tensors.augment(image, drawn, 24) == effects.blurred(want[:, ::-1], 2.0, 5)).all()
    fog = tensors.augment(image, STILL | {"weather": 1, "fog": 0.5, "weather_x": 0.1, "weather_y": 0.2}, 30)
    assert (fog == effects.fogged(image, 0.5, 0.1, 0.2)).all()


def test_tables(spark):
    rows = [(i, 6, 5, numbered(5, 6).tobytes()) for i in range(40)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    fixed = F.from_json(F.lit('{"moved": false, "x": 0.0, "y": 0.0, "colour": 0, "grey": false, "flipped": true, "quality": 0}'), tensors.DRAWS)
    got = {r.id: r for r in tensors.augmented(df, "id", 3, drawn=fixed).collect()}
    assert (np.frombuffer(got[7].pixels, np.uint8).reshape(3, 3, 3) == numbered(5, 6)[:3, 2::-1]).all() and got[99].pixels is None
    a, b = ({r.id: bytes(r.pixels or b"") for r in tensors.augmented(df.repartition(n), "id", 4, seed=3).collect()} for n in (2, 5))
    assert a == b and len(set(a.values())) > 20
    middle = {r.id: r for r in tensors.centred(df, 3).collect()}
    assert middle[0].pixels[0] == 8 and middle[0].image_width == 3
    faded = {r.id: r for r in tensors.faded(df, "id").collect()}
    assert (np.frombuffer(faded[0].pixels, np.uint8).reshape(5, 6, 3) == tensors.fade(numbered(5, 6), 0.05)).all()
    tensor = {r.id: r for r in tensors.tensors(df).collect()}
    assert tensor[99].tensor is None and len(tensor[0].tensor) == 90
    assert tensor[0].tensor[31] == pytest.approx(((1 + 50) / 255 - 0.456) / 0.224)


def test_draws(spark):
    d = spark.range(4000).select(tensors.draws("id", 1).alias("d")).select("d.*").toPandas()
    assert abs(d.moved.mean() - 0.8) < 0.03 and abs(d.grey.mean() - 0.2) < 0.03 and abs(d.flipped.mean() - 0.5) < 0.03
    assert d.scale.between(0.25, 1.1).all() and d.degrees.abs().max() <= 30 and d.dx.abs().max() <= 0.1
    assert all(abs((d.colour == k).mean() - 1 / 6) < 0.03 for k in (1, 2, 3)) and abs((d.colour == 0).mean() - 0.5) < 0.03
    assert all(abs((d.weather == k).mean() - 0.1) < 0.03 for k in (1, 2)) and abs(d.warped.mean() - 0.1) < 0.03 and abs((d.blur > 0).mean() - 0.1) < 0.03
    assert abs(d.shadow.notna().mean() - 0.2) < 0.03 and abs(d.flare.notna().mean() - 0.2) < 0.03 and set(d.blur_size) == {3, 5, 7} and d.blur.max() <= 9
    assert all(len(s) == 10 and min(s[1::2]) >= 0.5 for s in d.shadow.dropna()) and all(0.9 <= c <= 1.1 for cells in d["columns"] for c in cells)
    assert set(d.quality[d.quality > 0]) == set(range(70, 101)) and abs((d.quality > 0).mean() - 0.2) < 0.03
    assert [f"{f.name} {f.dataType.simpleString()}" for f in spark.range(1).select(tensors.draws("id").alias("d")).schema[0].dataType] == [x.strip() for x in tensors.DRAWS.split(",")]


def test_resized_by_hand():
    image = np.array([[[0] * 3, [100] * 3]], np.uint8)
    assert crops.resized(image, 4, 1)[0, :, 0].tolist() == [0, 25, 75, 100]
    assert crops.resized(image, 1, 1)[0, 0, 0] == 50
    assert (crops.resized(numbered(6, 8), 8, 6) == numbered(6, 8)).all()
    assert crops.resized(numbered(4, 4), 2, 2)[..., 0].tolist() == [[2, 4], [10, 12]]  # 2.5, 4.5, 10.5, 12.5: halves to even


def test_crops_by_hand(spark):
    """A box of 2 x 2 pixels in a photo of 10 x 6: a square of 4 around it; at the corner; with all but the box black; scaled down."""
    image = numbered(6, 10)
    rows = [(1, 10, 6, image.tobytes(), 0.4, 1 / 3, 0.2, 1 / 3), (2, 10, 6, image.tobytes(), 0.8, 2 / 3, 0.2, 1 / 3), (3, None, None, None, 0.1, 0.1, 0.1, 0.1), (4, 10, 6, image.tobytes(), None, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "id int, image_width int, image_height int, pixels binary, x_min double, y_min double, Width double, Height double")
    pixels = lambda r, n: np.frombuffer(r.pixels, np.uint8).reshape(n, n, 3)
    got = {r.id: r for r in crops.cropped(df, 4).collect()}
    assert (pixels(got[1], 4) == image[1:5, 3:7]).all() and got[1].Crop == [0.3, 0.1667, 0.7, 0.8333]
    assert (pixels(got[2], 4) == image[2:6, 6:10]).all() and got[3].pixels is None and got[4].pixels is None
    black = {r.id: r for r in crops.cropped(df, 4, margin=0.0).collect()}
    assert (pixels(black[1], 4)[1:3, 1:3] == image[2:4, 4:6]).all() and (pixels(black[1], 4)[0] == 0).all() and (pixels(black[1], 4)[:, 3] == 0).all()
    large = pixels({r.id: r for r in crops.cropped(df, 8).collect()}[1], 8)
    assert (large[1:7] == image[:, 1:9]).all() and (large[[0, 7]] == 0).all()
    half = {r.id: r for r in crops.cropped(df.where("id = 1"), 2, buffer=0.1).collect()}[1]  # 4 pixels with the buffer: half the size
    assert (pixels(half, 2) == crops.resized(image, 5, 3)[0:2, 1:3]).all()  # of 5 x 3 pixels, from 1.5 and 0.5 cut
    written = crops.encoded(crops.cropped(df, 4)).collect()
    assert [jpeg.decode(bytes(r.content)).shape for r in written if r.content is not None] == [(4, 4, 3)] * 2
