"""Changes of a picture (rows of red, green and blue bytes) that imitate weather, light and lenses. Their numbers are arguments, so that
`tensors` can draw them as columns; nothing here is random."""

from __future__ import annotations

import numpy as np

#: Steps of a sequence that fills a square evenly (powers of the inverse of the root of x^3 = x + 1).
EVEN = (0.7548776662466927, 0.5698402909980532)


def to_bytes(image: np.ndarray) -> np.ndarray:
    return np.clip(np.round(image), 0, 255).astype(np.uint8)


def reflected(at: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the ends as places mirrored at the first and last."""
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * n - 2)
    return np.where(at < n, at, 2 * n - 2 - at)


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The picture whose pixels come from the places x, y of another: mirrored outside of it, interpolated between pixels."""
    height, width, _ = image.shape
    x, y = x.round(9), y.round(9)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    cell = lambda i, j: image[reflected(y0 + i, height), reflected(x0 + j, width)].astype(np.float64)
    return to_bytes((cell(0, 0) * (1 - fx) + cell(0, 1) * fx) * (1 - fy) + (cell(1, 0) * (1 - fx) + cell(1, 1) * fx) * fy)


def _weighed(image: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums of neighbours, down and then across, mirrored at the edges."""
    reach = len(weights) // 2
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        out = sum(w * np.take(out, reflected(np.arange(n) + k - reach, n), axis) for k, w in enumerate(weights))
    return out


def blurred(image: np.ndarray, sigma: float, size: int) -> np.ndarray:
    """Weighed by a bell curve over `size` (odd) pixels each way. A sigma of 0 changes nothing."""
    if sigma <= 0:
        return image
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return to_bytes(_weighed(image, weights / weights.sum()).round(9))


def _even(n: int, x: float, y: float) -> np.ndarray:
    """n places in a square of side 1, evenly spread from x, y on."""
    return (np.array([x, y]) + np.arange(n)[:, None] * EVEN) % 1


def fogged(image: np.ndarray, amount: float, x: float, y: float, puffs: int = 60, density: float = 0.08) -> np.ndarray:
    """Round puffs, `amount` / 6 of the width in radius and spread from x, y on, that each bring a pixel `density` closer to white; then
    blurred over a fifth of their radius."""
    height, width, _ = image.shape
    radius = max(1.0, width * amount / 6)
    clear = np.ones((height, width))
    rows, columns = np.ogrid[:height, :width]
    for px, py in _even(puffs, x, y):
        clear[(columns - px * width) ** 2 + (rows - py * height) ** 2 <= radius * radius] *= 1 - density
    out = 255 - (255 - image.astype(np.float64)) * clear[..., None]
    size = 2 * int(radius / 10) + 1
    return to_bytes(_weighed(out, np.full(size, 1 / size)).round(9))


def rained(image: np.ndarray, slant: float, x: float, y: float, length: int = 60, room: int = 500, level: int = 200, light: float = 0.7) -> np.ndarray:
    """A streak of grey for each `room` pixels, `length` pixels down and `slant` across, from evenly spread places on; the whole blurred over
    7 pixels and darkened."""
    height, width, _ = image.shape
    out = image.copy()
    starts = _even(height * width // room, x, y) * [width, height]
    down = np.arange(length)
    columns = np.floor(starts[:, :1] + down * slant / length).astype(int).ravel()
    rows = np.floor(starts[:, 1:] + down).astype(int).ravel()
    inside = (0 <= columns) & (columns < width) & (rows < height)
    out[rows[inside], columns[inside]] = level
    return to_bytes((_weighed(out, np.full(7, 1 / 7)) * light).round(9))


def stretched(n: int, shares: list[float]) -> np.ndarray:
    """For n pixels the places they come from, where the line is cut into equal cells that take up room by their shares."""
    shares = np.asarray(shares, float)
    return np.interp(np.arange(n), np.linspace(0, n - 1, len(shares) + 1), np.r_[0, np.cumsum(shares) / shares.sum()] * (n - 1))


def warped(image: np.ndarray, columns: list[float], rows: list[float]) -> np.ndarray:
    """Distorted over a grid of cells."""
    height, width, _ = image.shape
    x, y = np.meshgrid(stretched(width, columns), stretched(height, rows))
    return sampled(image, x, y)


def inside(width: int, height: int, corners: list[float]) -> np.ndarray:
    """Which pixels' middles lie inside of a polygon (x, y, x, y, ... as shares of the sides), by the even-odd rule."""
    x, y = ((np.arange(n) + 0.5) / n for n in (width, height))
    out = np.zeros((height, width), bool)
    points = np.asarray(corners, float).reshape(-1, 2)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, 0), strict=True):
        if ay != by:
            crossed = (ay > y) != (by > y)
            out ^= crossed[:, None] & (x < ((bx - ax) * (y - ay) / (by - ay) + ax)[:, None])
    return out


def shaded(image: np.ndarray, corners: list[float], light: float = 0.5) -> np.ndarray:
    """A polygon's inside with less light."""
    shadow = inside(image.shape[1], image.shape[0], corners)
    return np.where(shadow[..., None], to_bytes(image * light), image)


def flared(image: np.ndarray, x: float, y: float, degrees: float, radius: int = 200, discs: int = 6) -> np.ndarray:
    """A white light at x, y (shares of the sides) that grows over 20 rings towards its middle, and faint discs of changing colour on a line
    from it at an angle."""
    height, width, _ = image.shape
    cx, cy = x * width, y * height
    rows, columns = np.ogrid[:height, :width]
    out = image.astype(np.float64)
    for k in range(1, discs + 1):
        step = k * width / discs
        dx, dy = columns - cx - step * np.cos(np.radians(degrees)), rows - cy - step * np.sin(np.radians(degrees))
        colour = np.array([255, 255 - 20 * (k % 4), 255 - 20 * (k % 7)])
        disc = dx * dx + dy * dy <= (radius * k / (4 * discs)) ** 2
        out[disc] += 0.1 * (colour - out[disc])
    distance = np.sqrt((columns - cx) ** 2 + (rows - cy) ** 2)
    clear = np.ones((height, width))
    for share in np.arange(1, 21) / 20:
        clear = np.where(distance <= share * radius, clear * (1 - (1 - share) ** 3), clear)
    return to_bytes((255 - (255 - out) * clear[..., None]).round(9))


def hue_moved(image: np.ndarray, degrees: float, saturation: float, value: float) -> np.ndarray:
    """Hue turned, saturation and value (both 0 to 255) raised. Greys have neither hue nor saturation, and stay grey."""
    rgb = image / 255
    high, low = rgb.max(-1), rgb.min(-1)
    spread = high - low
    safe = np.where(spread > 0, spread, 1)
    r, g, b = np.moveaxis(rgb, -1, 0)
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(spread > 0, hue + degrees / 60, 0.0)
    full = np.where(spread > 0, np.clip(spread / np.where(high > 0, high, 1) + saturation / 255, 0, 1), 0.0)
    bright = np.clip(high + value / 255, 0, 1)
    # each colour falls off with the distance of the hue from its own third of the circle
    part = np.stack([np.clip(np.abs((hue - at + 3) % 6 - 3) - 1, 0, 1) for at in (0, 2, 4)], -1)
    return to_bytes((255 * bright[..., None] * (1 - full[..., None] * part)).round(9))
