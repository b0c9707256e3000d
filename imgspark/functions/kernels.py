"""NumPy on one raster or mask: no Spark here. Rounding: half_up where the rule says so, np.rint (half to even) on clamped bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np


def half_up(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def shifted(a: np.ndarray, dy: int, dx: int, fill: float | None = None) -> np.ndarray:
    """a seen from its neighbour at (dy, dx): edge values repeat, or fill stands outside."""
    h, w = a.shape[:2]
    ys, xs = np.arange(h) + dy, np.arange(w) + dx
    out = a[np.clip(ys, 0, h - 1)][:, np.clip(xs, 0, w - 1)]
    if fill is not None:
        out = out.copy()
        out[(ys < 0) | (ys >= h)] = fill
        out[:, (xs < 0) | (xs >= w)] = fill
    return out


RING = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def sharpen16(frame: np.ndarray, amount: float = 0.42, least: int = 256) -> np.ndarray:
    """Capture sharpening of the first three channels of a 16-bit frame; small differences from the blur are left alone."""
    if frame.dtype != np.uint16 or min(frame.shape[:2]) < 3 or frame.shape[2] < 3:
        return frame
    c = frame[..., :3].astype(np.float64)
    blur = (4 * c + sum(shifted(c, dy, dx) for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)))) / 8
    strong = np.abs(c - blur) >= least
    out = frame.copy()
    out[..., :3] = np.where(strong, np.clip(half_up(c + amount * (c - blur)), 0, 65535), c).astype(np.uint16)
    return out


def to_rgba8(frame: np.ndarray) -> np.ndarray:
    """8-bit RGBA; of one or two channels the last stands for those that lack, alpha is 255."""
    wide = np.stack([frame[..., min(i, frame.shape[2] - 1)] for i in range(3)], axis=-1)
    rgb = np.clip(np.rint(wide / 257), 0, 255) if frame.dtype == np.uint16 else wide
    return np.concatenate([rgb.astype(np.uint8), np.full((*frame.shape[:2], 1), 255, np.uint8)], axis=-1)


def flatten_alpha(rgba: np.ndarray) -> np.ndarray:
    """Transparent pixels over black."""
    return np.clip(np.rint(rgba[..., :3] * (rgba[..., 3:] / 255)), 0, 255).astype(np.uint8)


def over_black(rgba: np.ndarray) -> np.ndarray:
    """flatten_alpha() with an alpha of 255 throughout."""
    return np.dstack([flatten_alpha(rgba), np.full(rgba.shape[:2], 255, np.uint8)])


def resample(raster: np.ndarray, height: int, width: int, black: bool = False) -> np.ndarray:
    """Area average to reduce, half-pixel bilinear to enlarge, each axis by itself; colours weighted by alpha.

    black: the result as over_black() has it, of RGBA bytes alone."""
    if raster.shape[2] == 4 and width > raster.shape[1]:
        return _enlarged(raster, height, width, black)
    if raster.shape[2] == 4 and height > raster.shape[0]:
        return _enlarged(raster.swapaxes(0, 1), width, height, black).swapaxes(0, 1)
    a = raster.astype(np.float64)
    if raster.shape[2] == 4:
        a[..., :3] *= a[..., 3:] / 255
    a = np.swapaxes(_scaled(np.swapaxes(_scaled(a, height), 0, 1), width), 0, 1)
    if raster.shape[2] == 4:
        a[..., :3] = np.divide(a[..., :3] * 255, a[..., 3:], out=np.zeros_like(a[..., :3]), where=a[..., 3:] > 0)
    top = np.iinfo(raster.dtype).max
    a = np.clip(np.rint(a), 0, top).astype(raster.dtype)
    return over_black(a) if black else a


def _scaled(a: np.ndarray, n: int) -> np.ndarray:
    """a with n places on its first axis."""
    m = a.shape[0]
    if n <= m:
        edges = np.arange(n + 1) * (m / n)
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        low = np.minimum(np.floor(edges).astype(int), m)
        part = (edges - low).reshape(-1, *[1] * (a.ndim - 1))
        at = total[low] + part * (total[np.minimum(low + 1, m)] - total[low])
        return np.diff(at, axis=0) / (m / n)
    low, part = _places(m, n)
    part = part.reshape(-1, *[1] * (a.ndim - 1))
    return a[low] * (1 - part) + a[np.minimum(low + 1, m - 1)] * part


def _places(m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n places on m pixels: the pixel before each, and the share of the next one."""
    pos = np.clip((np.arange(n) + 0.5) * (m / n) - 0.5, 0, m - 1)
    low = np.floor(pos).astype(int)
    return low, pos - low


#: Values of a strip of an enlarged raster, 8 bytes each: about what the cache of a core holds.
STRIP = 1 << 18
#: Running sums leave traces of alpha up to the one; the other stands for no alpha in a division.
TRACE, TINY = 1e-6, np.finfo(np.float64).tiny


def _enlarged(rgba: np.ndarray, height: int, width: int, black: bool) -> np.ndarray:
    """resample() of RGBA to a larger width, in strips: beside the result STRIP values are held (a column of it at least).

    The places between two columns of the source are one product of their shares and these columns. Where both are transparent
    nothing is left to do, and between opaque pixels no colour has to be weighted."""
    top = np.iinfo(rgba.dtype).max
    a = rgba.astype(np.float64)
    a[..., :3] *= a[..., 3:]
    columns = _scaled(a, height).transpose(1, 2, 0)
    columns = np.concatenate([columns, columns[-1:]])
    columns *= columns[:, 3:] > TRACE
    low, part = _places(rgba.shape[1], width)
    shares = np.stack([1 - part, part], axis=1)
    first = np.searchsorted(low, np.arange(len(columns))).tolist()
    out = np.full((width, height, 1), 255 << 24, "<u4").view(np.uint8) if black else np.zeros((width, height, 4), rgba.dtype)
    for i, lo, hi, opaque in _stretches(columns[:, 3], top - TRACE):
        both = columns[i : i + 2, :3, lo:hi] / top if opaque else columns[i : i + 2, :, lo:hi]
        if opaque:
            out[first[i] : first[i + 1], lo:hi, 3] = top
        step = max(1, STRIP // both[0].size)
        for x in range(first[i], first[i + 1], step):
            share = shares[x : min(x + step, first[i + 1])]
            v = (share @ both.reshape(2, -1)).reshape(len(share), *both.shape[1:])
            colour, alpha = v[:, :3], v[:, 3:]
            if not opaque:
                colour /= np.maximum(alpha, TINY)
            np.rint(v, out=v)
            if black and not opaque:
                alpha /= 255
                colour *= alpha
                v = np.rint(colour, out=colour)
            v = v.astype(rgba.dtype)
            for k in range(v.shape[1]):
                out[x : x + len(v), lo:hi, k] = v[:, k]
    return out.swapaxes(0, 1)


def _stretches(alpha: np.ndarray, solid: float) -> Iterator[tuple[int, int, int, bool]]:
    """(column, from, to, opaque) along each pair of neighbouring columns, less what is transparent at its ends; opaque is the longest
    stretch of opaque pixels, if there is one."""
    seen = (alpha[:-1] > 0) | (alpha[1:] > 0)
    begin, end = seen.argmax(1).tolist(), (seen.shape[1] - seen[:, ::-1].argmax(1)).tolist()
    opaque = np.zeros((len(seen), seen.shape[1] + 2), np.int8)
    opaque[:, 1:-1] = np.minimum(alpha[:-1], alpha[1:]) >= solid
    longest: dict[int, tuple[int, int]] = {}
    for (i, start), (_, stop) in np.argwhere(np.diff(opaque)).reshape(-1, 2, 2).tolist():
        if stop - start > longest.get(i, (0, 0))[1] - longest.get(i, (0, 0))[0]:
            longest[i] = start, stop
    for i in np.flatnonzero(seen.any(1)).tolist():
        start, stop = longest.get(i, (end[i], end[i]))
        yield from ((i, *s) for s in ((begin[i], start, False), (start, stop, True), (stop, end[i], False)) if s[0] < s[1])


def components(on: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels 1.. of 8-connected regions in raster order of their first pixels, 0 elsewhere; and their count."""
    h, w = on.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = on
    step = np.diff(padded, axis=1)
    ys, starts = np.nonzero(step == 1)
    stops = np.nonzero(step == -1)[1]
    first = np.searchsorted(ys, np.arange(h + 1)).tolist()
    up = list(range(len(ys)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    s, e = starts.tolist(), stops.tolist()
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if s[i] <= e[j] and s[j] <= e[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    number: dict[int, int] = {}
    labels = np.zeros((h, w), np.int32)
    for k, y in enumerate(ys.tolist()):
        labels[y, s[k] : e[k]] = number.setdefault(root(k), len(number) + 1)
    return labels, len(number)


def component_stats(labels: np.ndarray, n: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(label, area, min_x, min_y, max_x, max_y, first_pixel) of each."""
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs]
    area = np.bincount(of, minlength=n + 1)
    low_x, low_y, first = (np.full(n + 1, 1 << 40) for _ in range(3))
    high_x, high_y = np.full(n + 1, -1), np.full(n + 1, -1)
    np.minimum.at(low_x, of, xs)
    np.minimum.at(low_y, of, ys)
    np.minimum.at(first, of, ys * labels.shape[1] + xs)
    np.maximum.at(high_x, of, xs)
    np.maximum.at(high_y, of, ys)
    return [tuple(int(v[i]) for v in (np.arange(n + 1), area, low_x, low_y, high_x, high_y, first)) for i in range(1, n + 1)]


def close_pinholes(on: np.ndarray, passes: int = 2, allowed: np.ndarray | None = None) -> np.ndarray:
    """Interior (and allowed) pixels with five or more of eight neighbours selected are added, twice."""
    on = on.copy()
    for _ in range(passes):
        count = sum(shifted(on, dy, dx, 0).astype(np.int8) for dy, dx in RING)
        add = count >= 5 if allowed is None else (count >= 5) & allowed
        add[[0, -1]] = add[:, [0, -1]] = False
        on |= add
    return on


def keep_prompted(on: np.ndarray, painted: np.ndarray) -> np.ndarray:
    """Regions with a painted pixel; all of them if none has one."""
    labels, _ = components(on)
    hit = np.unique(labels[painted & on])
    return np.isin(labels, hit) & on if len(hit) else on


def fill_holes(on: np.ndarray, visible: np.ndarray, radius: float) -> np.ndarray:
    """Small visible holes are filled unless they touch the border or what is invisible."""
    labels, n = components(visible & ~on)
    if not n:
        return on
    most = np.clip(half_up(np.float64(0.35 * radius * radius)), 24, 512)
    outside = np.zeros(on.shape, bool)
    outside[[0, -1]] = outside[:, [0, -1]] = True
    for dy, dx in RING:
        outside |= shifted(~visible, dy, dx)
    open_ones = np.unique(labels[outside])
    small = np.bincount(labels.ravel(), minlength=n + 1) <= most
    small[0] = False
    small[open_ones] = False
    return on | small[labels]


def grow_by_colour(on: np.ndarray, rgb: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Two passes: interior (and allowed) pixels next to a selected one of like colour, light and chroma."""
    c = rgb.astype(np.float64)
    light = 0.2126 * c[..., 0] + 0.7152 * c[..., 1] + 0.0722 * c[..., 2]
    chroma = c.max(-1) - c.min(-1)
    on = on.copy()
    for _ in range(2):
        add = np.zeros(on.shape, bool)
        for dy, dx in RING:
            near = (((c - shifted(c, dy, dx)) ** 2).sum(-1) <= 118**2) & (np.abs(light - shifted(light, dy, dx)) <= 72) & (np.abs(chroma - shifted(chroma, dy, dx)) <= 48)
            add |= near & shifted(on, dy, dx, 0).astype(bool)
        if allowed is not None:
            add &= allowed
        add[[0, -1]] = add[:, [0, -1]] = False
        on |= add
    return on


def edge_filter(rgb: np.ndarray, alpha: np.ndarray, sigma_colour: float = 32, sigma_space: float = 1.35, passes: int = 2) -> np.ndarray:
    """Joint bilateral filter of a soft alpha by the picture's colours, 5 x 5; solid pixels stay and cost nothing."""
    h, w = alpha.shape
    c, a = rgb.reshape(-1, rgb.shape[-1]), alpha.ravel().astype(np.float64)
    for _ in range(passes):
        at = np.flatnonzero((a > 2) & (a < 253))
        ys, xs = np.divmod(at, w)
        own = c[at].astype(np.float64)
        total, weight = np.zeros(len(at)), np.zeros(len(at))
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                y, x = ys + dy, xs + dx
                inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
                near = np.where(inside, y * w + x, at)
                v = np.exp(-((own - c[near]) ** 2).sum(-1) / (2 * sigma_colour**2) - (dy * dy + dx * dx) / (2 * sigma_space**2)) * inside
                total += v * a[near]
                weight += v
        a = a.copy()
        a[at] = np.clip(np.rint(total / weight), 0, 255)
    return a.reshape(h, w).astype(np.uint8)


def suppress_overlaps(rects: list[tuple[float, int, int, int, int]], limit: int, most: float = 0.30) -> list[int]:
    """Indices kept: by score, unless IoU with one that is kept exceeds most; rects: (score, l, t, r, b)."""
    kept: list[int] = []
    for i in sorted(range(len(rects)), key=lambda i: (-rects[i][0], i)):
        _, l, t, r, b = rects[i]
        clear = True
        for j in kept:
            _, ml, mt, mr, mb = rects[j]
            both = max(0, min(r, mr) - max(l, ml)) * max(0, min(b, mb) - max(t, mt))
            clear &= both <= most * ((r - l) * (b - t) + (mr - ml) * (mb - mt) - both)
        if clear:
            kept.append(i)
            if len(kept) == limit:
                break
    return kept


def png(raster: np.ndarray) -> bytes:
    """8-bit grey, RGB or RGBA as it is; 16-bit RGB with every row Paeth-filtered. Lossless."""
    h, w, n = raster.shape
    deep = raster.dtype == np.uint16
    if deep and n < 3:
        raise ValueError("16-bit frames need three channels")
    a = np.ascontiguousarray(raster[..., :3].astype(">u2") if deep else raster).view(np.uint8).reshape(h, -1)
    lines = np.zeros((h, a.shape[1] + 1), np.uint8)
    lines[:, 1:] = a
    if deep:
        size = 6
        left, above, corner = np.zeros((3, *a.shape), np.int16)
        left[:, size:], above[1:], corner[1:, size:] = a[:, :-size], a[:-1], a[:-1, :-size]
        p = left + above - corner
        to_left, to_above, to_corner = abs(p - left), abs(p - above), abs(p - corner)
        best = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        lines[:, 1:] = (a - best).astype(np.uint8)
        lines[:, 0] = 4
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    colour = {1: 0, 3: 2, 4: 6}[3 if deep else n]
    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


#: Frame markers of a JPEG that carry its size.
SIZED = {*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)}


def embedded_jpegs(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, width, height) of the pictures embedded in a file."""
    at = data.find(b"\xff\xd8\xff")
    while at >= 0:
        found = _jpeg_at(data, at)
        if found:
            yield at, *found
        at = data.find(b"\xff\xd8\xff", found[0] if found else at + 1)


def _jpeg_at(data: bytes, start: int) -> tuple[int, int, int] | None:
    at, size = start + 2, None
    while at + 3 < len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return (at + 2, *size) if size else None
        if 0xD0 <= kind <= 0xD7 or kind == 0x01:
            at += 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4])
        if n < 2 or at + 2 + n > len(data):
            return None
        if kind in SIZED and n >= 7:
            size = int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        if kind == 0xDA:
            end = data.find(b"\xff\xd9", at + 2 + n)
            return (end + 2, *size) if end >= 0 and size else None
        at += 2 + n
    return (at + 2, *size) if size and data[at : at + 2] == b"\xff\xd9" else None
