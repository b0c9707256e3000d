"""The finish of a matte against loops over pixels, written from the rules."""

import math

import numpy as np
import pytest

from imgspark.functions import finish as N
from imgspark.functions import matte as M

RNG = np.random.default_rng(21)
up = lambda v: math.floor(v + 0.5)


def soft_frame(h, w, colours=6):
    """A blob with a wide soft rim, noise, and few colours."""
    y, x = np.mgrid[:h, :w]
    r = min(h, w) * 0.33
    d = np.hypot(y - h / 2, x - w / 2)
    alpha = np.clip((r - d) * RNG.integers(8, 40) + 128 + RNG.integers(-40, 40, (h, w)), 0, 255).astype(np.uint8)
    palette = RNG.integers(0, 256, (colours, 3))
    rgba = np.dstack([palette[RNG.integers(0, colours, (h, w))], np.full((h, w), 255)]).astype(np.uint8)
    return rgba, alpha


def walk(alpha, y, x, radius):
    h, w = alpha.shape
    for dx, dy in N.RAYS:
        cells = []
        for k in range(1, radius + 1):
            v, u = y + dy * k, x + dx * k
            if 0 <= v < h and 0 <= u < w:
                cells.append((int(alpha[v, u]), k * (math.sqrt(2) if dx and dy else 1), v, u))
        yield cells


def loop_snap(rgb, alpha, radius):
    out = alpha.copy()
    for y in range(alpha.shape[0]):
        for x in range(alpha.shape[1]):
            own = int(alpha[y, x])
            if not 12 < own < 243:
                continue
            near = {}
            for cells in walk(alpha, y, x, radius):
                hit = next((c for c in cells if not 12 < c[0] < 243), None)
                if hit and ((side := hit[0] >= 243) not in near or hit[1] < near[side][1]):
                    near[side] = hit
            if len(near) < 2:
                continue
            f, b = (rgb[near[s][2], near[s][3], :3].astype(float) for s in (True, False))
            span = ((f - b) ** 2).sum()
            if span < 192:
                continue
            at = min(1, max(0, ((rgb[y, x, :3] - b) * (f - b)).sum() / span))
            sure = min(0.82, max(0, (math.sqrt(span / 3) - 8) / 48)) * max(0.35, 1 - max(near[True][1], near[False][1]) / (radius * 2))
            out[y, x] = up((own / 255 * (1 - sure) + at * sure) * 255)
    return out


def loop_clean(rgb, alpha, radius):
    """One pixel after another, in place."""
    px = rgb.astype(np.float64).copy()
    for y in range(alpha.shape[0]):
        for x in range(alpha.shape[1]):
            own = int(alpha[y, x])
            if not 5 < own < 250:
                continue
            seen, back = [], []
            for cells in walk(alpha, y, x, radius):
                for c in cells:
                    seen.append(c)
                    if c[0] <= 5:
                        back.append(c)
                    if not 5 < c[0] < 250:
                        break
            inner = max(seen, key=lambda c: (c[0], -c[1]), default=None)
            if inner is None or inner[0] < own + 12:
                continue
            share, toward = own / 255, px[inner[2], inner[3], :3].copy()
            if not back:
                s = min(0.75, (inner[0] - own) / 255 + (1 - share) * 0.25)
                px[y, x, :3] = [up(v) for v in px[y, x, :3] * (1 - s) + toward * s]
                continue
            nearest = min(back, key=lambda c: c[1])
            mean, total = np.zeros(3, np.float32), 0.0
            for c in back:
                if ((px[c[2], c[3], :3] - px[nearest[2], nearest[3], :3]) ** 2).sum() <= 72 * 72 * 3:
                    weight = 1 / max(1, float(np.float32(c[1])))
                    total += weight
                    mean = (mean + px[c[2], c[3], :3] * weight).astype(np.float32)
            mean = (mean / total).astype(np.float32).astype(float)
            contrast = min(1, max(0, (math.sqrt(((toward - mean) ** 2).sum() / 3) - 6) / 42))
            if contrast == 0:
                continue
            solve = max(0.08, share)
            raw = (px[y, x, :3] - (1 - solve) * mean) / solve
            pure = np.clip(raw, 0, 255)
            close = max(0.25, 1 - nearest[1] / (radius * 1.5))
            trust = min(1, max(0, (share - 0.08) / 0.42)) * min(1, max(0, 1 - np.abs(raw - pure).sum() / 480)) * close
            s = min(0.92, (1 - share) * 1.35) * contrast * close
            safe = pure.astype(np.float32).astype(float) * trust + toward * (1 - trust)
            px[y, x, :3] = [min(255, max(0, up(v))) for v in px[y, x, :3] * (1 - s) + safe * s]
    return px.astype(np.uint8)


@pytest.mark.parametrize("h, w, radius", [(1, 1, 4), (7, 30, 6), (31, 24, 8), (40, 40, 16)])
def test_snap_and_clean_equal_loops(h, w, radius):
    for _ in range(3):
        rgba, alpha = soft_frame(h, w)
        assert (N.snap_to_edges(rgba, alpha, radius) == loop_snap(rgba, alpha, radius)).all()
        assert (N.decontaminate(rgba, alpha, radius) == loop_clean(rgba, alpha, radius)).all()


def test_steep_chain_of_soft_pixels_is_cleaned_in_raster_order():
    alpha = np.tile(np.arange(250, 5, -12).astype(np.uint8), (3, 1))
    rgba = RNG.integers(0, 256, (*alpha.shape, 4)).astype(np.uint8)
    for flip in (alpha, alpha[:, ::-1].copy(), alpha.T.copy()):
        p = rgba if flip.shape == alpha.shape else np.swapaxes(rgba, 0, 1).copy()
        assert (N.decontaminate(p, flip, 6) == loop_clean(p, flip, 6)).all()


def loop_islands(rgba, alpha, votes, veto):
    h, w = alpha.shape
    counts = {}
    key = lambda y, x: tuple(int(v) >> 4 for v in rgba[y, x, :3])
    cells = [(y, x) for y in range(h) for x in range(w)]
    for y, x in cells:
        if rgba[y, x, 3] >= 128:
            c = counts.setdefault(key(y, x), [0, 0])
            c[0] += alpha[y, x] <= 24
            c[1] += alpha[y, x] >= 232
    ok = lambda y, x: votes[y, x] >= 1 and not veto[y, x]
    ratio = {}
    for y, x in cells:
        b, f = counts.get(key(y, x), (0, 0))
        if alpha[y, x] >= 224 and ok(y, x) and rgba[y, x, 3] >= 128 and b >= max(24, up(h * w * 1e-5)):
            ratio[y, x] = b / max(1, b + f)
    strict, loose = {c for c, v in ratio.items() if v >= 0.97}, {c for c, v in ratio.items() if v >= 0.5}
    least = max(64, up(h * w * 4e-5))
    most, out = max(least, up(h * w * 0.004)), alpha.copy()

    def spread(queue, free, box, limit=10**9):
        free.difference_update(queue)
        for y, x in queue:
            if len(queue) > limit:
                break
            for c in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if c in free and box[0] <= c[0] <= box[1] and box[2] <= c[1] <= box[3]:
                    free.discard(c)
                    queue.append(c)
        return queue

    holes = []
    for c in cells:
        if c not in strict:
            continue
        part = spread([c], strict, (0, h, 0, w))
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        y0, y1, x0, x1 = min(ys), max(ys), min(xs), max(xs)
        bh, bw = y1 - y0 + 1, x1 - x0 + 1
        room = max(12, min(max(12, up(min(h, w) * 0.08)), math.ceil(max(bh, bw) * 1.2)))
        if not least <= len(part) <= most or len(part) / (bh * bw) < 0.38:
            continue
        if y0 - room <= 0 or x0 - room <= 0 or y1 + room >= h - 1 or x1 + room >= w - 1:
            continue
        if (alpha[y0 - room : y1 + room + 1, x0 - room : x1 + room + 1] <= 24).any():
            continue
        limit = min(most, 3 * len(part))
        grown = spread(list(part), loose, (y0 - 12, y1 + 12, x0 - 12, x1 + 12), limit)
        holes += grown if len(grown) <= limit else part
    for y, x in holes:
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                v, u, d = y + dy, x + dx, math.hypot(dy, dx)
                if d <= 2 and 0 <= v < h and 0 <= u < w and ok(v, u):
                    out[v, u] = min(out[v, u], up(d / 2 * 255))
    return out


def island_frame(patch, fringe, votes=1, seed=0):
    """An opaque square with one patch in the colour of the surroundings and a fringe of a mixed colour; 150 x 150 so 0.4% is 90 pixels."""
    rng = np.random.default_rng(seed)
    h = w = 150
    alpha, rgba = np.zeros((h, w), np.uint8), np.zeros((h, w, 4), np.uint8)
    alpha[15:135, 15:135] = 255
    rgba[..., :3], rgba[..., 3] = (200, 30, 90), 255
    rgba[15:135, 15:135, :3] = (40, 160, 40)
    rgba[5:10, 5:130, :3] = (120, 120, 10)
    y, x = 70, 60
    rgba[y - fringe : y + patch + fringe, x - fringe : x + patch + fringe, :3] = (120, 120, 10)
    rgba[y : y + patch, x : x + patch, :3] = (200, 30, 90)
    holes = rng.random((h, w)) < 0.02
    rgba[holes & (alpha == 255), :3] = (40, 160, 40)
    v = np.zeros((h, w), int)
    v[40:110, 40:110] = votes
    return rgba, alpha, v, rng.random((h, w)) < 0.01


@pytest.mark.parametrize("patch, fringe, votes", [(9, 0, 1), (9, 1, 1), (9, 3, 1), (7, 1, 1), (9, 1, 0), (8, 2, 2), (20, 0, 1)])
def test_islands_equal_loop(patch, fringe, votes):
    for seed in range(2):
        f = island_frame(patch, fringe, votes, seed)
        assert (N.clear_islands(*f) == loop_islands(*f)).all()
    # a patch of 9 is within 64 to 90 pixels; one of 8 loses pixels to the sprinkled holes and is too small
    assert (N.clear_islands(*f) != f[1]).any() == (votes > 0 and patch == 9)


@pytest.mark.parametrize("h, w", [(40, 60), (700, 300), (1, 900)])
def test_pooling_and_detached_bits(h, w):
    a = RNG.integers(0, 256, (h, w)).astype(np.uint8)
    scale = min(1, 512 / max(h, w))
    mh, mw = max(1, up(h * scale)), max(1, up(w * scale))
    want = np.zeros((mh, mw), int)
    for y in range(h):
        for x in range(w):
            at = min(mh - 1, math.floor(y / h * mh)), min(mw - 1, math.floor(x / w * mw))
            want[at] = max(want[at], a[y, x])
    assert (N.max_pool(a) == want).all()
    if h > 30:
        m = np.zeros((h, w), np.uint8)
        m[: h - 5, 4:24] = 255
        m[h - 6 : h - 4, w - 8 : w - 6] = 200  # low, beside, small: goes
        m[2:4, w - 8 : w - 6] = 200  # high: stays
        out = N.remove_detached(m)
        assert (out[: h // 3] == m[: h // 3]).all() and (out[:, :26] == m[:, :26]).all() and not out[h - 6 :, w - 8 :].any()
    assert not N.remove_detached(np.zeros((h, w), np.uint8)).any()


def test_finish_keeps_rules():
    rgba, alpha = soft_frame(48, 60)
    rgba[:10, :, 3] = 90
    mask = alpha[::2, ::2].copy()
    layers = [M.Layer(mask, 0, 0, 60, 48), M.Layer(mask, 10, 5, 50, 40, (20, 40), "hair"), M.Layer(mask, 5, 5, 40, 44, None, "edge")]
    out = N.finish(rgba, layers)
    assert (out[..., 3] <= rgba[..., 3]).all() and out.shape == rgba.shape
    only = N.finish(rgba, layers, colours=False)
    assert (only[..., 3] == out[..., 3]).all() and (only[..., :3] == rgba[..., :3]).all()
    zones = N.fine_zones(48, 60, layers)
    assert zones.sum() == len({(y, x) for y in range(5, 44) for x in range(5, 40)} | {(y, x) for y in range(5, 31) for x in range(10, 50)})


def test_hair_crops_give_no_consensus():
    whole = M.Layer(np.full((4, 4), 255, np.uint8), 0, 0, 20, 20)
    low = lambda kind: M.Layer(np.full((4, 4), 10, np.uint8), 0, 0, 20, 20, (0, 1), kind)
    assert M.fuse(20, 20, [whole, low("person"), low("person")])[10, 10] == 10
    assert M.fuse(20, 20, [whole, low("person"), low("hair")])[10, 10] == 255
