"""NumPy that finishes a matte at full size: colour islands, detached bits, snapping to colour edges, colour spill, curves.

Work goes to lists of the soft pixels and to arrays of one frame; solid pixels cost nothing but their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .kernels import component_stats, components, edge_filter, half_up, shifted
from .matte import Layer, fuse, vote

#: The eight rays (dx, dy), in the order in which ties between them fall.
RAYS = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)]
#: Alpha that counts as background and as foreground in the colour model, and that a hole may start from.
ISLAND_BACKGROUND, ISLAND_FOREGROUND, ISLAND_SEED = 24, 232, 224
#: Shares of background in a colour's pixels for seeds and for growth; padding of the growth.
SEED_SHARE, GROWTH_SHARE, GROWTH_PADDING = 0.97, 0.5, 12
#: Edge of the map on which detached bits are found, its threshold, and how low and how small they are.
MAP_EDGE, MAP_ON, LOWER_SHARE, SMALL_SHARE = 512, 128, 0.48, 0.012
#: The part of a head crop that keeps fine detail, and the powers of the two curves.
HAIR_ZONE, FINE_POWER, PLAIN_POWER = 0.72, 2.2, 4


def _rounded(x: float) -> int:
    return int(half_up(np.float64(x)))


def _flood(seeds: list[int], free: np.ndarray, width: int, box: tuple[int, int, int, int], most: float = np.inf) -> list[int]:
    """Pixels reached from seeds over free ones inside box, in queue order; they are no longer free afterwards, even if `most` is passed."""
    left, top, right, bottom = box
    flat, queue = free.ravel(), list(seeds)
    flat[queue] = False
    for p in queue:
        if len(queue) > most:
            break
        y, x = divmod(p, width)
        for row in range(max(top, y - 1), min(bottom, y + 1) + 1):
            at = row * width
            for q in range(at + max(left, x - 1), at + min(right, x + 1) + 1):
                if flat[q]:
                    flat[q] = False
                    queue.append(q)
    return queue


def _islands(rgba: np.ndarray, alpha: np.ndarray, permitted: np.ndarray) -> Iterator[list[int]]:
    h, w = alpha.shape
    n = alpha.size
    r, g, b = (rgba[..., i].astype(np.int64) >> 4 for i in range(3))
    bucket, solid = r | g << 4 | b << 8, rgba[..., 3] >= 128
    background = np.bincount(bucket[solid & (alpha <= ISLAND_BACKGROUND)], minlength=4096)
    foreground = np.bincount(bucket[solid & (alpha >= ISLAND_FOREGROUND)], minlength=4096)
    share = np.where(background >= max(24, _rounded(n * 1e-5)), background / np.maximum(1, background + foreground), 0)[bucket]
    may = permitted & solid & (alpha >= ISLAND_SEED)
    seeds, growth = may & (share >= SEED_SHARE), may & (share >= GROWTH_SHARE)
    least = max(64, _rounded(n * 4e-5))
    most = max(least, _rounded(n * 0.004))
    far = max(12, _rounded(min(w, h) * 0.08))
    labels, count = components(seeds)
    for _, area, x0, y0, x1, y1, first in component_stats(labels, count):
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        if not least <= area <= most or area / (bw * bh) < 0.38:
            continue
        room = max(12, min(far, int(np.ceil(max(bw, bh) * 1.2))))
        if x0 - room <= 0 or y0 - room <= 0 or x1 + room >= w - 1 or y1 + room >= h - 1:
            continue
        if (alpha[y0 - room : y1 + room + 1, x0 - room : x1 + room + 1] <= ISLAND_BACKGROUND).any():
            continue
        island = _flood([first], seeds, w, (0, 0, w - 1, h - 1))
        pad = GROWTH_PADDING
        limit = min(most, 3 * area)
        grown = _flood(island, growth, w, (max(0, x0 - pad), max(0, y0 - pad), min(w - 1, x1 + pad), min(h - 1, y1 + pad)), limit)
        yield grown if len(grown) <= limit else island


def clear_islands(rgba: np.ndarray, alpha: np.ndarray, votes: np.ndarray, veto: np.ndarray) -> np.ndarray:
    """Enclosed patches in the colour of what was removed become holes, where a refinement crop votes for it and none objects."""
    permitted = (votes >= 1) & ~veto
    inside = np.zeros(alpha.shape, bool)
    for island in _islands(rgba, alpha, permitted):
        inside.ravel()[island] = True
    if not inside.any():
        return alpha
    cap = np.full(alpha.shape, 255.0)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            if (d := np.hypot(dy, dx)) <= 2:
                cap = np.where(shifted(inside, dy, dx, 0).astype(bool), np.minimum(cap, half_up(d / 2 * 255)), cap)
    return np.where(permitted, np.minimum(alpha, cap), alpha).astype(np.uint8)


def max_pool(alpha: np.ndarray, edge: int = MAP_EDGE) -> np.ndarray:
    """The largest alpha of each cell of a map with a longer side of `edge` at most."""
    h, w = alpha.shape
    scale = min(1, edge / max(h, w))
    mh, mw = max(1, _rounded(h * scale)), max(1, _rounded(w * scale))
    starts = lambda n, m: np.searchsorted(np.minimum(m - 1, np.floor(np.arange(n) / n * m)), np.arange(m))
    return np.maximum.reduceat(np.maximum.reduceat(alpha, starts(h, mh), axis=0), starts(w, mw), axis=1)


def remove_detached(alpha: np.ndarray) -> np.ndarray:
    """Small regions beside the largest one, in the lower part of its height, go."""
    h, w = alpha.shape
    small = max_pool(alpha)
    mh, mw = small.shape
    labels, n = components(small >= MAP_ON)
    found = sorted(component_stats(labels, n), key=lambda c: -c[1])
    if not found:
        return alpha
    _, area, px0, py0, px1, py1, _ = found[0]
    low, most, out = py0 + (py1 - py0 + 1) * LOWER_SHARE, max(8, _rounded(area * SMALL_SHARE)), alpha.copy()
    for _, a, x0, y0, x1, y1, _ in found[1:]:
        if y0 >= low and (x1 < px0 or x0 > px1) and a <= most:
            top, bottom = int(max(0, y0 - 1) / mh * h), int(np.ceil((min(mh - 1, y1 + 1) + 1) / mh * h))
            left, right = int(max(0, x0 - 1) / mw * w), int(np.ceil((min(mw - 1, x1 + 1) + 1) / mw * w))
            out[top : bottom + 1, left : right + 1] = 0
    return out


def _along(alpha: np.ndarray, at: np.ndarray, radius: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, float]]:
    """(ray, which, pixel, alpha, distance) step by step along each ray; a ray goes on while alpha lies strictly between low and high."""
    h, w = alpha.shape
    ys, xs = np.divmod(at, w)
    for k, (dx, dy) in enumerate(RAYS):
        going = np.arange(len(at))
        for step in range(1, radius + 1):
            y, x = ys[going] + dy * step, xs[going] + dx * step
            inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            going, pixel = going[inside], (y * w + x)[inside]
            if not len(going):
                break
            value = alpha.ravel()[pixel]
            yield k, going, pixel, value, step * (np.sqrt(2) if dx and dy else 1.0)
            going = going[(value > low) & (value < high)]


def snap_to_edges(rgb: np.ndarray, alpha: np.ndarray, radius: int) -> np.ndarray:
    """Soft pixels move toward the alpha that their colour has between the nearest solid foreground and background on eight rays."""
    low, high = 12, 243
    at = np.flatnonzero((alpha > low) & (alpha < high))
    if not len(at):
        return alpha
    near = {side: (np.full((8, len(at)), np.inf), np.full((8, len(at)), -1)) for side in (0, 1)}
    for k, which, pixel, value, distance in _along(alpha, at, radius, low, high):
        for side, hit in ((0, value <= low), (1, value >= high)):
            near[side][0][k, which[hit]] = distance
            near[side][1][k, which[hit]] = pixel[hit]
    (back_d, back), (fore_d, fore) = (((d.min(0)), p[d.argmin(0), np.arange(len(at))]) for d, p in near.values())
    both = (back >= 0) & (fore >= 0)
    at, back, fore, back_d, fore_d = at[both], back[both], fore[both], back_d[both], fore_d[both]
    c = rgb.reshape(-1, rgb.shape[-1])[:, :3].astype(np.float64)
    line = c[fore] - c[back]
    contrast = (line**2).sum(1)
    ok = contrast >= 192
    at, back, line, contrast, far = at[ok], back[ok], line[ok], contrast[ok], np.maximum(back_d, fore_d)[ok]
    of_colour = np.clip(((c[at] - c[back]) * line).sum(1) / contrast, 0, 1)
    sure = np.clip((np.sqrt(contrast / 3) - 8) / 48, 0, 0.82) * np.maximum(0.35, 1 - far / (radius * 2))
    out = alpha.copy()
    out.ravel()[at] = np.clip(half_up((alpha.ravel()[at] / 255 * (1 - sure) + of_colour * sure) * 255), 0, 255)
    return out


SOFT_LOW, SOFT_HIGH = 5, 250


def pulls(rgb: np.ndarray, alpha: np.ndarray, at: np.ndarray, radius: int) -> dict[str, np.ndarray]:
    """For those of the soft pixels `at` that are to be cleaned: where they are, their alpha (own), the most opaque pixel on their rays (inner)
    and its alpha (best), and colour and distance of the removed background that each ray meets (infinite where it meets none)."""
    own = alpha.ravel()[at].astype(np.int64)
    best, best_d, inner = np.full(len(at), -1), np.full(len(at), np.inf), np.full(len(at), -1)
    back, back_d = np.full((8, len(at)), -1), np.full((8, len(at)), np.inf)
    for k, which, pixel, value, distance in _along(alpha, at, radius, SOFT_LOW, SOFT_HIGH):
        value = value.astype(np.int64)
        better = (value > best[which]) | (value == best[which]) & (distance < best_d[which])
        w = which[better]
        best[w], best_d[w], inner[w] = value[better], distance, pixel[better]
        hit = value <= SOFT_LOW
        back[k, which[hit]], back_d[k, which[hit]] = pixel[hit], distance
    todo = best >= own + 12
    colours = rgb.reshape(-1, rgb.shape[-1])[:, :3].astype(np.float64)
    return {"at": at[todo], "own": own[todo], "best": best[todo], "inner": inner[todo], "back": colours[back[:, todo]], "back_d": back_d[:, todo]}


def decontaminate(rgb: np.ndarray, alpha: np.ndarray, radius: int) -> np.ndarray:
    """Colour of soft pixels without the background's share, pulled to the most opaque pixel on eight rays.

    A pixel reads its own colour, removed background, and one more opaque pixel, which counts as corrected if it comes earlier in
    raster order. Alpha rises by 12 at each such step, so few rounds of whole arrays settle them all."""
    at = np.flatnonzero((alpha > SOFT_LOW) & (alpha < SOFT_HIGH))
    out = rgb.copy()
    if not len(at):
        return out
    p = pulls(rgb, alpha, at, radius)
    at, inner = p["at"], p["inner"]
    place = np.full(alpha.size, -1)
    place[at] = np.arange(len(at))
    waits = np.where(inner < at, place[inner], -1)
    level = np.zeros(len(at), int)
    while not np.array_equal(deeper := np.where(waits >= 0, level[waits] + 1, 0), level):
        level = deeper
    before, now = rgb.reshape(-1, rgb.shape[-1])[:, :3].astype(np.float64), out.reshape(-1, rgb.shape[-1])
    for i in range(level.max(initial=-1) + 1):
        s = np.flatnonzero(level == i)
        toward = np.where((inner[s] < at[s])[:, None], now[inner[s], :3].astype(np.float64), before[inner[s]])
        now[at[s], :3] = cleaned(before[at[s]], toward, p["own"][s], p["best"][s], p["back"][:, s], p["back_d"][:, s], radius)
    return out


def cleaned(c: np.ndarray, toward: np.ndarray, own: np.ndarray, best: np.ndarray, back: np.ndarray, back_d: np.ndarray, radius: int) -> np.ndarray:
    """Colours c of soft pixels, un-mixed from the background of their rays and drawn to the colour toward."""
    share = own / 255
    pull = np.minimum(0.75, (best - own) / 255 + (1 - share) * 0.25)[:, None]
    alone = c * (1 - pull) + toward * pull
    near_d, nearest = back_d.min(0), back[back_d.argmin(0), np.arange(len(own))]
    mean, weights = np.zeros(c.shape, np.float32), np.zeros(len(own))
    for k in range(8):
        alike = np.isfinite(back_d[k]) & (((back[k] - nearest) ** 2).sum(1) <= 72**2 * 3)
        weight = np.where(alike, 1 / np.maximum(1, back_d[k].astype(np.float32).astype(np.float64)), 0)
        weights += weight
        mean = (mean + back[k] * weight[:, None]).astype(np.float32)
    mean = (mean / np.where(weights > 0, weights, 1)[:, None]).astype(np.float32).astype(np.float64)
    contrast = np.clip((np.sqrt(((toward - mean) ** 2).sum(1) / 3) - 6) / 42, 0, 1)
    solve = np.maximum(0.08, share)[:, None]
    raw = (c - (1 - solve) * mean) / solve
    pure = np.clip(raw, 0, 255)
    clipped = np.abs(raw - pure).sum(1)
    close = np.maximum(0.25, 1 - np.where(np.isfinite(near_d), near_d, 0) / (radius * 1.5))
    trust = (np.clip((share - 0.08) / 0.42, 0, 1) * np.clip(1 - clipped / 480, 0, 1) * close)[:, None]
    strength = (np.minimum(0.92, (1 - share) * 1.35) * contrast * close)[:, None]
    safe = pure.astype(np.float32).astype(np.float64) * trust + toward * (1 - trust)
    mixed = np.where(contrast[:, None] == 0, c, c * (1 - strength) + safe * strength)
    return np.clip(half_up(np.where(np.isinf(near_d)[:, None], alone, mixed)), 0, 255).astype(np.uint8)


def _curve(power: float, low: float, high: float) -> np.ndarray:
    v = np.arange(256) / 255
    middle = half_up(v**power / (v**power + (1 - v) ** power) * 255)
    return np.where(v <= low, 0, np.where(v >= high, 255, middle)).astype(np.uint8)


PLAIN, FINE = _curve(PLAIN_POWER, 0.015, 0.985), _curve(FINE_POWER, 0.003, 0.997)


def fine_zones(height: int, width: int, layers: list[Layer]) -> np.ndarray:
    """Where hair and edge crops keep partial alpha; of a hair crop the upper 72%."""
    fine = np.zeros((height, width), bool)
    for q in layers:
        if q.detail in ("hair", "edge"):
            bottom = int(np.ceil(q.top + (q.bottom - q.top) * (HAIR_ZONE if q.detail == "hair" else 1)))
            fine[q.top : min(height, bottom), q.left : q.right] = True
    return fine


def finish(rgba: np.ndarray, layers: list[Layer], colours: bool = True) -> np.ndarray:
    """The picture with its matte as alpha; its colours are cleaned unless only the matte is wanted."""
    h, w = rgba.shape[:2]
    alpha = fuse(h, w, layers)
    if len(layers) >= 2:
        votes, veto, _ = vote(h, w, layers[1:], owned_only=True)
        alpha = clear_islands(rgba, alpha, votes, veto)
    alpha = remove_detached(alpha)
    scale = max(max(q.size[1] / q.mask.shape[1], q.size[0] / q.mask.shape[0]) for q in layers)
    alpha = edge_filter(rgba[..., :3], alpha)
    alpha = snap_to_edges(rgba, alpha, int(np.clip(np.ceil(scale * 1.75), 4, 24)))
    out = decontaminate(rgba, alpha, int(np.clip(np.ceil(scale), 6, 16))) if colours else rgba.copy()
    curved = np.where(fine_zones(h, w, layers), FINE[alpha], PLAIN[alpha])
    out[..., 3] = np.clip(half_up(curved.astype(np.float64) * rgba[..., 3] / 255), 0, 255)
    return out
