"""NumPy for masks of crops laid over a frame, brush stamps and band recovery. Votes use unrounded predictions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .kernels import RING, component_stats, components, half_up, shifted

#: Predictions that vote for background, and that veto it; votes that clear a pixel.
BACKGROUND, FOREGROUND, VOTES = 56, 210, 2


@dataclass
class Layer:
    """A crop's mask, its place in the frame (right and bottom exclusive), the band of columns that it owns, if any, and its kind."""

    mask: np.ndarray
    left: int
    top: int
    right: int
    bottom: int
    band: tuple[int, int] | None = None
    detail: str = "person"

    @property
    def size(self) -> tuple[int, int]:
        return self.bottom - self.top, self.right - self.left

    def laid(self) -> np.ndarray:
        """The mask at the crop's own size: half-pixel bilinear, weights across in single precision."""

        def taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = (np.arange(n) + 0.5) * m / n - 0.5
            low = np.clip(np.floor(at), 0, m - 1).astype(int)
            return low, np.minimum(low + 1, m - 1), np.clip(at - low, 0, 1)

        h, w = self.size
        ly, uy, wy = taps(h, self.mask.shape[0])
        lx, ux, wx = taps(w, self.mask.shape[1])
        wx, m = wx.astype(np.float32).astype(np.float64), self.mask.astype(np.float64)
        rows = m[:, lx] * (1 - wx) + m[:, ux] * wx
        return rows[ly] * (1 - wy[:, None]) + rows[uy] * wy[:, None]

    def owned(self) -> np.ndarray:
        h, w = self.size
        columns = np.arange(self.left, self.right)
        keep = np.ones(w, bool) if self.band is None else (columns >= self.band[0]) & (columns < self.band[1])
        return np.broadcast_to(keep, (h, w))

    def interior(self) -> np.ndarray:
        h, w = self.size
        m = max(2, int(half_up(np.float64(min(h, w) * 0.04))))
        inside = np.zeros((h, w), bool)
        inside[m : h - m, m : w - m] = True
        return inside

    def strength(self) -> np.ndarray:
        """Smoothstep of the distance to the borders of the crop, or of band and crop where there is a band."""
        h, w = self.size
        y, x = np.arange(h)[:, None], np.arange(w)[None, :]
        short = lambda n: max(2, int(half_up(np.float64(n * 0.035))))
        if self.band is None:
            near = np.minimum(np.minimum(x, w - 1 - x), np.minimum(y, h - 1 - y)) / short(min(h, w))
        else:
            feather = max(2, int(half_up(np.float64((self.band[1] - self.band[0]) * 0.12))))
            column = x + self.left
            near = np.minimum(np.minimum(column - self.band[0], self.band[1] - 1 - column) / feather, np.minimum(y, h - 1 - y) / short(h))
        s = np.clip(near, 0, 1)
        return s * s * (3 - 2 * s)

    def window(self) -> tuple[slice, slice]:
        return slice(self.top, self.bottom), slice(self.left, self.right)


def fuse(height: int, width: int, layers: list[Layer]) -> np.ndarray:
    """Layers in order: the first is written, each later one reshapes what is uncertain; then the consensus clears."""
    alpha = np.zeros((height, width), np.float64)
    for i, layer in enumerate(layers):
        at, owned, new = layer.window(), layer.owned(), layer.laid()
        old = alpha[at]
        if i == 0:
            value = np.clip(np.rint(new), 0, 255)
        else:
            safe = old + (new - old) * (1 - np.abs(old - 127.5) / 127.5)
            s = layer.strength()
            value = np.clip(half_up(old * (1 - s) + safe * s), 0, 255)
        alpha[at] = np.where(owned, value, old)
    voters = [x for x in layers[1:] if x.band is not None and x.detail == "person"]
    if len(voters) >= 2:
        votes, veto, lowest = vote(height, width, voters)
        alpha = np.where((votes >= VOTES) & ~veto, np.minimum(alpha, lowest), alpha)
    return alpha.astype(np.uint8)


def vote(height: int, width: int, layers: list[Layer], owned_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Background votes, foreground veto and lowest background prediction of every pixel, from the interiors of crops."""
    votes, veto, lowest = np.zeros((height, width), int), np.zeros((height, width), bool), np.full((height, width), 255.0)
    for layer in layers:
        at, p = layer.window(), layer.laid()
        counts = layer.interior() & (layer.owned() if owned_only else True)
        background = counts & (p <= BACKGROUND)
        votes[at] += background
        veto[at] |= counts & (p >= FOREGROUND)
        lowest[at] = np.where(background, np.minimum(lowest[at], half_up(p)), lowest[at])
    return np.minimum(votes, 127), veto, lowest


def recover_band(on: np.ndarray, visible: np.ndarray, radius: float) -> np.ndarray:
    """Visible pixels between the selection and the edge of what is visible, if both are near: a band of 26% of the radius."""
    band = int(np.clip(half_up(np.float64(0.26 * radius)), 3, 8))
    far = band + 9

    def distance(start: np.ndarray, first: int) -> np.ndarray:
        d = np.where(start, first, far)
        front = start
        for step in range(first + 1, band + 2):
            reached = np.zeros(on.shape, bool)
            for dy, dx in RING:
                reached |= shifted(front, dy, dx, 0).astype(bool)
            front = reached & visible & (d == far)
            d = np.where(front, step, d)
        return d

    outside = np.zeros(on.shape, bool)
    outside[[0, -1]] = outside[:, [0, -1]] = True
    for dy, dx in RING:
        outside |= shifted(~visible, dy, dx)
    return on | visible & (distance(on & visible, 0) + distance(outside & visible, 1) <= band + 1)


def brush_box(height: int, width: int, x: float, y: float, radius: float) -> tuple[slice, slice]:
    """The rows and columns that a brush may reach."""
    span = lambda at, n: slice(int(np.clip(np.floor(at - radius), 0, n)), int(np.clip(np.ceil(at + radius) + 1, 0, n)))
    return span(y, height), span(x, width)


def coverage(height: int, width: int, x: float, y: float, radius: float, box: tuple[slice, slice] | None = None) -> np.ndarray:
    """A round brush: whole inside, then fading to nothing at the radius. box: only these rows and columns."""
    rows, columns = box or (slice(0, height), slice(0, width))
    ys, xs = np.mgrid[rows, columns]
    d = np.hypot(xs + 0.5 - x, ys + 0.5 - y)
    t = (d - 0.42 * radius) / (0.58 * radius)
    return np.where(d < radius, np.clip((1 - t) / 0.45, 0, 1), 0)


def erase(rgba: np.ndarray, x: float, y: float, radius: float, out: np.ndarray | None = None) -> np.ndarray:
    """out: the picture itself, to be changed in place; a copy if there is none. Only the brush's box is looked at."""
    out = rgba.copy() if out is None else out
    box = brush_box(*rgba.shape[:2], x, y, radius)
    out[box][..., 3] = np.clip(np.rint(rgba[box][..., 3] * (1 - coverage(*rgba.shape[:2], x, y, radius, box))), 0, 255)
    return out


def restore(rgba: np.ndarray, source: np.ndarray, x: float, y: float, radius: float, out: np.ndarray | None = None) -> np.ndarray:
    """The source's pixels over the picture, as far as the brush covers; what it doesn't cover stays as it is."""
    out = rgba.copy() if out is None else out
    box = brush_box(*rgba.shape[:2], x, y, radius)
    cover, old, new = coverage(*rgba.shape[:2], x, y, radius, box)[..., None], rgba[box].astype(float), source[box].astype(float)
    over = new[..., 3:] / 255 * cover
    under = old[..., 3:] / 255 * (1 - over)
    a = over + under
    colour = np.divide(new[..., :3] * over + old[..., :3] * under, a, out=np.zeros(old[..., :3].shape), where=a > 0)
    mixed = np.clip(np.rint(np.concatenate([colour, a * 255], axis=-1)), 0, 255)
    out[box] = np.where(cover > 0, mixed, old).astype(np.uint8)
    return out


def expand_pockets(mask: np.ndarray) -> np.ndarray:
    """Enclosed background pockets (32 or less, 48 pixels to 1.5% of the mask) are cleared out to 6 pixels, fading until 9."""
    labels, n = components(mask <= 32)
    h, w = mask.shape
    pocket = np.zeros(n + 1, bool)
    for label, area, x0, y0, x1, y1, _ in component_stats(labels, n):
        pocket[label] = x0 > 0 and y0 > 0 and x1 < w - 1 and y1 < h - 1 and 48 <= area <= 0.015 * mask.size
    inside, near = pocket[labels], np.full(mask.shape, np.inf)
    for dy in range(-9, 10):
        for dx in range(-9, 10):
            if (d := np.hypot(dy, dx)) <= 9 and inside.any():
                near = np.where(shifted(inside, dy, dx, 0).astype(bool), np.minimum(near, d), near)
    cap = np.where(near <= 6, 0, np.where(near <= 9, half_up((near - 6) / 3 * 255), 255)) if inside.any() else np.full(mask.shape, 255)
    return np.minimum(mask, cap).astype(np.uint8)
