"""NumPy for selections: painted pixels, bridges, the whole clean-up, brush lines, placing, seeds and colour growth."""

from __future__ import annotations

from math import ceil, floor

import numpy as np

from .kernels import close_pinholes, fill_holes, grow_by_colour, half_up, keep_prompted, resample, shifted
from .matte import recover_band

#: (x, y, radius) of a stroke point
Point = tuple[float, float, float]


def _discs(height: int, width: int, points: list[Point], reach) -> np.ndarray:
    on = np.zeros((height, width), bool)
    for x, y, radius in points:
        r = reach(radius)
        y0, x0 = max(0, floor(y - r)), max(0, floor(x - r))
        ys, xs = np.ogrid[y0 : min(height, ceil(y + r) + 1), x0 : min(width, ceil(x + r) + 1)]
        on[y0 : y0 + ys.shape[0], x0 : x0 + xs.shape[1]] |= (xs + 0.5 - x) ** 2 + (ys + 0.5 - y) ** 2 <= r * r
    return on


def painted(visible: np.ndarray, points: list[Point]) -> np.ndarray:
    """Visible pixels in the core of a stroke: max(1.5, 0.32 r)."""
    return visible & _discs(*visible.shape, points, lambda r: max(1.5, 0.32 * r))


def bridge(on: np.ndarray, paint: np.ndarray, visible: np.ndarray, radius: float) -> np.ndarray:
    """Painted gaps between selected pixels in opposite octants, within 72% of the radius (2 to 8)."""
    d = int(np.clip(half_up(np.float64(0.72 * radius)), 2, 8))
    seen = np.zeros((8, *on.shape), bool)
    for dy in range(-d, d + 1):
        for dx in range(-d, d + 1):
            if 0 < dx * dx + dy * dy <= d * d:
                across, along = 2 * abs(dy) < abs(dx), 2 * abs(dx) < abs(dy)
                octant = (0 if dx > 0 else 4) if across else (2 if dy > 0 else 6) if along else (1 if dy > 0 else 7) if dx > 0 else (3 if dy > 0 else 5)
                seen[octant] |= shifted(on, dy, dx, 0).astype(bool)
    return on | paint & visible & (seen[:4] & seen[4:]).any(0)


def refine(mask: np.ndarray, rgba: np.ndarray, points: list[Point]) -> np.ndarray:
    """A candidate mask cleaned up around what was painted: bridges, pinholes, prompted islands, holes, edge band, like colours."""
    visible, radius = rgba[..., 3] > 4, max([1.0, *(p[2] for p in points)])
    paint, on = painted(visible, points), (mask >= 128) & visible
    on = close_pinholes(bridge(on, paint, visible, radius), allowed=visible)
    on = fill_holes(keep_prompted(on, paint), visible, radius)
    return grow_by_colour(recover_band(on, visible, radius), rgba[..., :3], visible)


def place(mask: np.ndarray, window: tuple[int, int, int, int], height: int, width: int) -> np.ndarray:
    """A crop's mask at the size of its window (left, top, right, bottom) in an empty frame."""
    left, top, right, bottom = window
    out = np.zeros((height, width), np.uint8)
    out[top:bottom, left:right] = resample(mask[..., None], bottom - top, right - left)[..., 0]
    return out


def brush(selection: np.ndarray, alpha: np.ndarray, line: tuple[float, float, float, float], radius: float, add: bool) -> np.ndarray:
    """A line with round ends added to or taken from a selection. Edges cover by distance; added pixels stay on what is visible.

    The tiles of 256 that an added line touches are cleared wherever nothing is visible."""
    x0, y0, x1, y1 = line
    h, w = selection.shape
    left, top = max(0, floor(min(x0, x1) - radius)), max(0, floor(min(y0, y1) - radius))
    right, bottom = min(w, ceil(max(x0, x1) + radius)), min(h, ceil(max(y0, y1) + radius))
    if right <= left or bottom <= top:
        return selection
    ys, xs = np.mgrid[top:bottom, left:right] + 0.5
    dx, dy = x1 - x0, y1 - y0
    t = np.clip(((xs - x0) * dx + (ys - y0) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else np.zeros(xs.shape)
    cover = np.clip(radius + 0.5 - np.hypot(xs - x0 - t * dx, ys - y0 - t * dy), 0, 1)
    out = selection.copy()
    old = out[top:bottom, left:right].astype(np.float64)
    out[top:bottom, left:right] = np.rint(old + (255 - old) * cover if add else old * (1 - cover))
    if add:
        tiles = np.s_[top // 256 * 256 : ((bottom - 1) // 256 + 1) * 256, left // 256 * 256 : ((right - 1) // 256 + 1) * 256]
        out[tiles] = np.where(alpha[tiles] > 4, out[tiles], 0)
    return out


def hint_box(points: list[Point], height: int, width: int) -> tuple[int, int, int, int]:
    """The painted box with a margin of max(24, 2.5 radii), inside the image: left, top, right, bottom."""
    r = [max(1.0, p[2]) for p in points]
    pad = max(24.0, 2.5 * max(r))
    left, top = max(0, floor(min(p[0] - q for p, q in zip(points, r, strict=True)) - pad)), max(0, floor(min(p[1] - q for p, q in zip(points, r, strict=True)) - pad))
    right, bottom = min(width, ceil(max(p[0] + q for p, q in zip(points, r, strict=True)) + pad)), min(height, ceil(max(p[1] + q for p, q in zip(points, r, strict=True)) + pad))
    return left, top, max(left + 1, right), max(top + 1, bottom)


def seeded_box(mask: np.ndarray, points: list[Point], height: int, width: int) -> tuple[bool, tuple[int, int, int, int]] | None:
    """(whether the paint means the foreground, padded box in the image of the side regions with paint), or None if there is none."""
    mh, mw = mask.shape
    seed = np.zeros(mask.shape, bool)
    for x, y, radius in points:
        cx, cy, rx, ry = x / width * mw, y / height * mh, max(1, radius / width * mw), max(1, radius / height * mh)
        ys, xs = np.ogrid[:mh, :mw]
        seed |= ((xs + 0.5 - cx) / rx) ** 2 + ((ys + 0.5 - cy) / ry) ** 2 <= 1
    if not seed.any():
        return None
    foreground = bool(mask[seed].mean() >= 127.5)
    side = (mask if foreground else 255 - mask) >= 32
    on = reached(seed & side, side)
    if not on.any():
        return None
    ys, xs = np.nonzero(on)
    left, top = floor(xs.min() / mw * width), floor(ys.min() / mh * height)
    right, bottom = ceil((xs.max() + 1) / mw * width), ceil((ys.max() + 1) / mh * height)
    pad = max(4, int(half_up(np.float64(max(right - left, bottom - top) * 0.1))))
    left, top, right, bottom = max(0, left - pad), max(0, top - pad), min(width, right + pad), min(height, bottom + pad)
    return foreground, (left, top, max(left + 1, right), max(top + 1, bottom))


CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def reached(start: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """What is 4-connected to start over allowed pixels."""
    on, front = start.copy(), start
    while front.any():
        beside = np.zeros(on.shape, bool)
        for dy, dx in CROSS:
            beside |= shifted(front, dy, dx, 0).astype(bool)
        front = beside & allowed & ~on
        on |= front
    return on


#: How far colour, light, chroma and model may lie from a point's sample: strictly, and for filling gaps.
STRICT, LOOSE = (76, 58, 42, 104), (98, 74, 58, 136)
#: How far colour, alpha and model may lie between neighbours across which a selection grows.
STEP = (68, 64, 104)


def by_colour(rgba: np.ndarray, model: np.ndarray, points: list[Point]) -> np.ndarray:
    """Painted discs, and what is 4-connected to them and like the nearest stroke point's sample in colour, light, chroma and model.

    A point's sample is the visible pixel nearest to it within 26% of its radius. Points reach 1.08 radii, less near the stroke's
    ends. Last, gaps with three or more selected neighbours are filled where the looser limits hold."""
    h, w = model.shape
    visible, c, m = rgba[..., 3] > 4, rgba[..., :3].astype(np.float64), model.astype(np.float64)
    traits = np.dstack([c, 0.2126 * c[..., 0] + 0.7152 * c[..., 1] + 0.0722 * c[..., 2], c.max(-1) - c.min(-1), m])
    way = np.concatenate([[0.0], np.cumsum([np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(points, points[1:], strict=False)])])
    near, sample = np.full((h, w), np.inf, np.float32), np.full((h, w, traits.shape[2]), np.nan)
    ys, xs = np.mgrid[:h, :w] + 0.5
    for (x, y, radius), at in zip(points, way, strict=False):
        d = (xs - x) ** 2 + (ys - y) ** 2
        seen = np.where(visible & (d <= max(1, 0.26 * radius) ** 2), d, np.inf)
        if not np.isfinite(seen).any():
            continue
        own = traits[np.unravel_index(seen.argmin(), seen.shape)]
        inner = np.clip(min(at, way[-1] - at) / max(1, 0.9 * radius), 0, 1) if way[-1] > 0 else 0.25
        reach = max(1, radius * (1 + 0.08 * inner))
        share = ((ys - y) / reach) ** 2 + ((xs - x) / reach) ** 2
        closer = (share <= 1) & (share < near)
        near[closer], sample[closer] = share[closer], own
    apart = np.abs(traits - sample)
    like = lambda t: ((apart[..., :3] ** 2).sum(-1) <= t[0] ** 2) & (apart[..., 3] <= t[1]) & (apart[..., 4] <= t[2]) & (apart[..., 5] <= t[3])
    hint = visible & _discs(h, w, points, lambda r: r)
    strict, loose = visible & like(STRICT) | hint, visible & like(LOOSE) | hint
    on, front, a = hint.copy(), hint, rgba[..., 3].astype(np.int64)
    joined = {
        (dy, dx): (((c - shifted(c, dy, dx)) ** 2).sum(-1) <= STEP[0] ** 2) & (np.abs(a - shifted(a, dy, dx)) <= STEP[1]) & (np.abs(m - shifted(m, dy, dx)) <= STEP[2])
        for dy, dx in CROSS
    }
    while front.any():
        beside = np.zeros(on.shape, bool)
        for (dy, dx), open_ in joined.items():
            beside |= shifted(front, dy, dx, 0).astype(bool) & open_
        front = beside & strict & ~on
        on |= front
    return on | loose & (sum(shifted(on, dy, dx, 0).astype(np.int8) for dy, dx in CROSS) >= 3)


def prompt_score(mask: np.ndarray, quality: float, positive: list[Point], negative: list[Point]) -> float:
    """quality + 2.5 x share of positive points inside - 3.5 x share of negative ones - 2.25 x share of area outside the painted box."""
    h, w = mask.shape
    inside = lambda ps: sum(bool(mask[int(np.clip(floor(y + 0.5), 0, h - 1)), int(np.clip(floor(x + 0.5), 0, w - 1))]) for x, y, _ in ps) / max(1, len(ps))
    outside = 1.0
    if mask.any() and positive:
        r = [max(2.0, 1.35 * p[2]) for p in positive]
        low = lambda i: max(0, floor(min(p[i] - q for p, q in zip(positive, r, strict=True))))
        high = lambda i, n: min(n - 1, ceil(max(p[i] + q for p, q in zip(positive, r, strict=True))))
        focused = int(mask[low(1) : high(1, h) + 1, low(0) : high(0, w) + 1].astype(bool).sum())
        outside = 1 - focused / int(mask.astype(bool).sum())
    return quality + 2.5 * inside(positive) - 3.5 * inside(negative) - 2.25 * outside
