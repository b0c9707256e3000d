"""Crop plans, bridges and brushes against plain loops and known places."""

import math

import numpy as np
import pytest

from imgspark.functions import crops as C
from imgspark.functions import selection as S

RNG = np.random.default_rng(5)
up = lambda v: math.floor(v + 0.5)


def people(n, h=200, w=320, seed=0):
    """A body along the bottom with n heads on necks."""
    rng = np.random.default_rng(seed)
    m = np.zeros((h, w), np.uint8)
    m[80:190, 20 : w - 20] = 255
    y, x = np.mgrid[:h, :w]
    for i in range(n):
        cx, r = 40 + (w - 80) * (i + 0.5) / n, 11 + int(rng.integers(0, 3))
        m[(y - 60) ** 2 + (x - cx) ** 2 <= r * r] = 255
        m[60:82, int(cx) - 4 : int(cx) + 4] = 255
    return m


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_heads_and_bands(n):
    m = people(n)
    body = C.parts(m >= 24)[0]
    found = C.heads(m, body)
    assert len(found) == n
    plan = C.person_crops(m, 3200, 2000)
    whole, close = [c for c in plan if c.detail == "person"], [c for c in plan if c.detail == "hair"]
    assert len(whole) == len(close) == n and [c.band for c in whole] == [c.band for c in close]
    assert whole[0].band[0] == body.x0 * 10 and whole[-1].band[1] == body.x1 * 10
    for a, b, p, q in zip(whole, whole[1:], found, found[1:], strict=False):
        middle = ((p.x0 + p.x1) / 2 + (q.x0 + q.x1) / 2) / 2 / 320 * 3200  # the order of operations matters to ceil and floor
        assert a.band[1] == math.ceil(middle) and b.band[0] == math.floor(middle)
    for c, p in zip(close, found, strict=True):
        assert c.left < p.center * 10 < c.right and c.top <= p.y0 * 10 < c.bottom
    for c in whole:
        assert c.right - c.left >= min(3200, math.ceil((c.bottom - c.top) * 0.75))


def loop_tiles(m, width, height):
    """Edge tiles with every sum taken anew."""
    h, w = m.shape
    found = C.parts(m >= 24)
    if not found:
        return []
    limit = max(2, math.floor(min(w, h) * 0.42))
    side = min(limit, max(min(72, limit), up(max(found[0].width, found[0].height) * 0.3)))
    detail = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            part = m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            lo, hi, a = int(part.min()), int(part.max()), int(m[y, x])
            if lo <= 72 and hi >= 183:
                detail[y, x] = (hi - lo) / 255 * (0.25 + min(a, 255 - a) / 127.5 * 0.75)
    stride = max(8, up(side * 0.22))
    line = lambda most: sorted({*range(0, most + 1, stride), most})
    tiles, densest = [], 0
    for y in line(h - side):
        for x in line(w - side):
            cover = (m[y : y + side, x : x + side] >= 24).mean()
            d = detail[y : y + side, x : x + side].sum()
            if 0.04 <= cover <= 0.9:
                densest = max(densest, d / side**2)
                if d / side**2 >= 0.006:
                    tiles.append((d * (1.16 - 0.16 * (y + side / 2) / h), x, y))
    if densest < 0.012:
        return []
    want, kept = 4 if densest >= 0.02 else 3 if densest >= 0.015 else 2, []
    for _, x, y in sorted(tiles, key=lambda t: -round(t[0], 6)):
        both = [max(0, side - abs(x - a)) * max(0, side - abs(y - b)) for a, b in kept]
        if len(kept) < want and all(v / (2 * side * side - v) <= 0.3 for v in both):
            kept.append((x, y))
    pad, out = up(side * 0.12), []
    for x, y in kept if len(kept) >= 2 else []:
        l, t, r, b = max(0, x - pad), max(0, y - pad), min(w, x + side + pad), min(h, y + side + pad)
        c = C.Crop(math.floor(l / w * width), math.floor(t / h * height), math.ceil(r / w * width), math.ceil(b / h * height), "edge")
        if max(width, height) / max(c.right - c.left, c.bottom - c.top) >= 1.5:
            out.append(c)
    return out


@pytest.mark.parametrize("h, w", [(60, 80), (120, 90), (33, 200), (3, 3)])
def test_edge_tiles_equal_loop(h, w):
    y, x = np.mgrid[:h, :w]
    for _ in range(4):
        d = np.hypot(y - h * RNG.uniform(0.3, 0.7), (x - w * RNG.uniform(0.3, 0.7)) * RNG.uniform(0.4, 1))
        m = np.clip((min(h, w) * 0.35 - d) * 60 + RNG.integers(-90, 90, (h, w)), 0, 255).astype(np.uint8)
        assert C.edge_crops(m, 10 * w, 10 * h) == loop_tiles(m, 10 * w, 10 * h)


def test_combined_plan_stays_in_budget_and_drops_doubles():
    for n in range(8):
        plan = C.all_crops(people(n, seed=n), 3200, 2000)
        edges = [c for c in plan if c.detail == "edge"]
        assert len(plan) <= 12 and plan[len(plan) - len(edges) :] == edges
        others = [c for c in plan if c.detail != "edge"]
        assert not any(min(e.area, o.area) / max(e.area, o.area) >= 0.55 and C.overlap(e, o) >= 0.58 for e in edges for o in others)
    assert C.all_crops(np.zeros((20, 30), np.uint8), 300, 200) == []


def loop_bridge(on, paint, visible, radius):
    d, out = min(8, max(2, up(0.72 * radius))), on.copy()
    for y, x in zip(*np.nonzero(paint & visible & ~on), strict=True):
        seen = set()
        for v, u in zip(*np.nonzero(on), strict=True):
            dy, dx = int(v - y), int(u - x)
            if 0 < dx * dx + dy * dy <= d * d:
                turn = math.atan2(dy, dx)
                flat = 2 * abs(dy) < abs(dx)
                steep = 2 * abs(dx) < abs(dy)
                seen.add(("e" if dx > 0 else "w") if flat else ("s" if dy > 0 else "n") if steep else ("s" if turn > 0 else "n") + ("e" if dx > 0 else "w"))
        if any(a in seen and b in seen for a, b in (("e", "w"), ("n", "s"), ("se", "nw"), ("ne", "sw"))):
            out[y, x] = True
    return out


@pytest.mark.parametrize("h, w", [(1, 1), (12, 20), (25, 17)])
def test_bridges_equal_loop(h, w):
    for _ in range(4):
        on, paint, visible = RNG.random((h, w)) < 0.08, RNG.random((h, w)) < 0.7, RNG.random((h, w)) < 0.9
        radius = float(RNG.uniform(1, 9))
        assert (S.bridge(on, paint, visible, radius) == loop_bridge(on, paint, visible, radius)).all()


def test_painted_equals_loop():
    for _ in range(4):
        visible = RNG.random((20, 26)) < 0.9
        points = [(float(RNG.uniform(-3, 30)), float(RNG.uniform(-3, 25)), float(RNG.uniform(0, 14))) for _ in range(5)]
        want = [[bool(visible[y, x]) and any((x + 0.5 - a) ** 2 + (y + 0.5 - b) ** 2 <= max(1.5, 0.32 * r) ** 2 for a, b, r in points) for x in range(26)] for y in range(20)]
        assert (S.painted(visible, points) == np.array(want)).all()


def test_refined_selection_is_visible_and_keeps_prompted_island():
    rgba = np.zeros((40, 60, 4), np.uint8)
    rgba[..., 3] = 255
    rgba[:, 30] = 0
    mask = np.zeros((40, 60), np.uint8)
    mask[10:20, 5:15] = mask[10:20, 40:50] = 255
    on = S.refine(mask, rgba, [(10.0, 15.0, 4.0)])
    assert on[12:18, 6:14].all() and not on[:, 31:].any() and not on[:, 30].any()
    assert S.refine(mask, rgba, []).any(axis=0)[45]


def test_brush_adds_removes_and_clips_to_visible():
    alpha = np.full((300, 300), 255, np.uint8)
    alpha[:, 100:110] = 0
    on = S.brush(np.zeros((300, 300), np.uint8), alpha, (50, 50, 150, 50), 6, True)
    assert on[50, 60] == 255 and not on[:, 100:110].any() and on[50, 120] == 255 and not on[70].any()
    assert not S.brush(on, alpha, (40, 50, 160, 50), 9, False)[45:56].any()
    assert (S.brush(on, alpha, (-90, -90, -80, -80), 4, True) == on).all()
    dot = S.brush(np.zeros((40, 40), np.uint8), np.full((40, 40), 255, np.uint8), (20, 20, 20, 20), 5, True)
    assert abs(int((dot > 127).sum()) - math.pi * 25) < 8


def test_placed_selection_fills_its_window():
    out = S.place(np.full((5, 7), 255, np.uint8), (10, 20, 31, 33), 50, 60)
    assert (out[20:33, 10:31] == 255).all() and out.sum() == 255 * 13 * 21


def test_seeded_box_takes_the_painted_side():
    m = np.zeros((20, 30), np.uint8)
    m[5:10, 5:12] = 255
    side, box = S.seeded_box(m, [(75.0, 75.0, 10.0)], 200, 300)
    assert side and box == (43, 43, 127, 107)
    side, box = S.seeded_box(m, [(250.0, 150.0, 10.0)], 200, 300)
    assert not side and box == (0, 0, 300, 200)
    assert S.hint_box([(100, 100, 10)], 200, 300) == (65, 65, 135, 135)


def loop_by_colour(rgba, model, points):
    h, w = model.shape
    cells = [(y, x) for y in range(h) for x in range(w)]
    see = lambda p: rgba[p][3] > 4

    def trait(p):
        r, g, b = (float(v) for v in rgba[p][:3])
        return r, g, b, 0.2126 * r + 0.7152 * g + 0.0722 * b, max(r, g, b) - min(r, g, b), float(model[p])

    def fits(p, q, limits):
        a, b = trait(p), trait(q)
        return sum((u - v) ** 2 for u, v in zip(a[:3], b[:3], strict=True)) <= limits[0] ** 2 and all(abs(a[i] - b[i]) <= limits[i - 2] for i in (3, 4, 5))

    run = [0.0]
    for a, b in zip(points, points[1:], strict=False):
        run.append(run[-1] + math.hypot(b[0] - a[0], b[1] - a[1]))
    owner = {}
    for (x, y, r), at in zip(points, run, strict=False):
        d = {p: (p[1] + 0.5 - x) ** 2 + (p[0] + 0.5 - y) ** 2 for p in cells}
        pool = [p for p in cells if see(p) and d[p] <= max(1, 0.26 * r) ** 2]
        if not pool:
            continue
        sample = min(pool, key=lambda p: d[p])
        inner = min(1, max(0, min(at, run[-1] - at) / max(1, 0.9 * r))) if run[-1] else 0.25
        reach = max(1, r * (1 + (1.08 - 1) * inner))
        for p in cells:
            share = ((p[0] + 0.5 - y) / reach) ** 2 + ((p[1] + 0.5 - x) / reach) ** 2
            if share <= 1 and (p not in owner or share < owner[p][0]):
                owner[p] = float(np.float32(share)), sample
    hint = {p for p in cells if see(p) and any((p[1] + 0.5 - x) ** 2 + (p[0] + 0.5 - y) ** 2 <= r * r for x, y, r in points)}
    allow = [hint | {p for p in cells if see(p) and p in owner and fits(p, owner[p][1], t)} for t in ((76, 58, 42, 104), (98, 74, 58, 136))]
    on, todo = set(hint), list(hint)
    cross = lambda p: [(p[0] + a, p[1] + b) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    for p in todo:
        for q in cross(p):
            if q in allow[0] and q not in on:
                a, b = trait(p), trait(q)
                if sum((u - v) ** 2 for u, v in zip(a[:3], b[:3], strict=True)) <= 68**2 and abs(int(rgba[p][3]) - int(rgba[q][3])) <= 64 and abs(a[5] - b[5]) <= 104:
                    on.add(q)
                    todo.append(q)
    on |= {p for p in allow[1] - on if sum(q in on for q in cross(p)) >= 3}
    return np.array([[(y, x) in on for x in range(w)] for y in range(h)])


def test_colour_growth_equals_loop():
    grown = 0
    for k in range(6):
        h, w = 24, 30
        y, x = np.mgrid[:h, :w]
        rgba = np.dstack([x * 6 + RNG.integers(0, 30, (h, w)), y * 7 + RNG.integers(0, 30, (h, w)), RNG.integers(90, 130, (h, w)), np.where(RNG.random((h, w)) < 0.05, 0, 255)]).astype(np.uint8)
        model = np.clip(x * 8 + RNG.integers(-20, 20, (h, w)), 0, 255).astype(np.uint8)
        points = [(5.0 + 3 * i, 8.0 + i * (k % 3), 3.0 + k) for i in range(1 + k)]
        on = S.by_colour(rgba, model, points)
        assert (on == loop_by_colour(rgba, model, points)).all()
        grown += int(on.sum()) - int((S._discs(h, w, points, lambda r: r) & (rgba[..., 3] > 4)).sum())
    assert grown
    assert not S.by_colour(np.zeros((5, 5, 4), np.uint8), np.zeros((5, 5), np.uint8), [(2.0, 2.0, 3.0)]).any()
