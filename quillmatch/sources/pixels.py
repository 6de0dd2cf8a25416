"""Image variants for OCR, in numpy on the executors: grey, evened out, thresholded, inverted, thickened, turned.

Only formats that need no codec are decoded here (binary PGM and PPM); another decoder can be passed
in, as can another step that evens out contrast and noise before the thresholds. What follows the grey
image takes one image or a stack of equal size, images along the last axis: small ones cost numpy's
calls otherwise, of which the denoising makes thousands.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillmatch.operators.ocr import ANGLES, LONGEST_SIDE

#: Block and offset of the adaptive threshold; clip limit and tiles a side of the contrast step;
#: strength, template and search window of the denoising; weights of red, green and blue.
BLOCK, OFFSET = 15, 8
CLIP, TILES = 3.0, 8
STRENGTH, TEMPLATE, SEARCH = 12, 7, 21
GREY = np.array([0.299, 0.587, 0.114])
#: Pixels of a stack, which with what is derived from them should fit a core's cache; pixels that may wait for others of their size.
STACK, WAITING = 1 << 16, 1 << 22
PNM = re.compile(rb"\s*(P[56])\s+(?:#[ \t]*([^\n]*)\n\s*)?(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")
SCHEMA = "image_id string, variant int, angle int, width int, height int, pixels binary"


def decode_pnm(data: bytes) -> np.ndarray | None:
    """Pixels of a binary PGM or PPM of one byte a sample; None for anything else."""
    head = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not head or int(head[4]) > 255:
        return None
    shape = (int(head[3]), int(head[2])) + ((3,) if head[1] == b"P6" else ())
    body = np.frombuffer(data, np.uint8, offset=head.end())
    return body[: int(np.prod(shape))].reshape(shape) if body.size >= np.prod(shape) else None


def split_pnm(data: bytes) -> Iterator[tuple[str | None, bytes]]:
    """The images of a file with one or more binary PGM or PPM images, each with the first comment of its header."""
    at = 0
    while head := PNM.match(data, at):
        at = head.end() + int(head[3]) * int(head[4]) * (3 if head[1] == b"P6" else 1) * (2 if int(head[5]) > 255 else 1)
        yield head[2].decode("utf-8", "replace").strip() or None if head[2] is not None else None, data[head.start(1) : at]


def shrink(image: np.ndarray, longest: int = LONGEST_SIDE) -> np.ndarray:
    """The image with its longest side at most ``longest``: each new pixel is the mean of the area it covers."""
    for axis in (0, 1):
        new = round(image.shape[axis] * min(1.0, longest / max(image.shape[:2]))) if max(image.shape[:2]) > longest else image.shape[axis]
        if new < image.shape[axis]:
            edges = np.linspace(0, image.shape[axis], max(new, 1) + 1)
            total = np.concatenate([np.zeros_like(image.take([0], axis), float), np.cumsum(image, axis=axis, dtype=float)], axis=axis)
            low = np.floor(edges).astype(int)
            part = (edges - low).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
            at = total.take(low, axis) + part * (total.take(np.minimum(low + 1, image.shape[axis]), axis) - total.take(low, axis))
            image = np.rint(np.diff(at, axis=axis) / (edges[1] - edges[0])).astype(np.uint8)
    return image


def grey(image: np.ndarray) -> np.ndarray:
    return np.rint(image @ GREY).astype(np.uint8) if image.ndim == 3 else image


def even_contrast(g: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: a clipped grey scale for each tile, interpolated between tiles."""
    if g.ndim == 2:
        return even_contrast(g[..., None], clip, tiles)[..., 0]
    high, wide = (-(-n // tiles) for n in g.shape[:2])
    nth, levels = np.arange(g.shape[2]), np.arange(256)
    step = np.maximum(256 // np.maximum(levels, 1), 1)[:, None]
    spread = (levels % step == 0) & (levels // step < levels[:, None])  # where so many of a clipped rest go
    p = np.pad(g, ((0, high * tiles - g.shape[0]), (0, wide * tiles - g.shape[1]), (0, 0)), mode="symmetric" if min(g.shape[:2]) >= tiles else "edge")
    most = max(int(clip * high * wide / 256), 1)
    scales, share = np.zeros((tiles, tiles, nth.size, 256), np.uint8), np.rint(np.arange(high * wide + 1) * 255 / (high * wide)).astype(np.uint8)
    for i in range(tiles):
        for j in range(tiles):
            tile = p[i * high : (i + 1) * high, j * wide : (j + 1) * wide]
            count = np.bincount((tile + 256 * nth).ravel(), minlength=256 * nth.size).reshape(nth.size, 256)
            above = np.maximum(count - most, 0)
            over = above.sum(axis=1)
            count += spread[over % 256] + (over // 256)[:, None] - above
            scales[i, j] = share[np.cumsum(count, axis=1)]
    y, x = (np.arange(g.shape[0]) / high - 0.5, np.arange(g.shape[1]) / wide - 0.5)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    at = lambda dy, dx: scales[np.clip(y0 + dy, 0, tiles - 1)[:, None, None], np.clip(x0 + dx, 0, tiles - 1)[None, :, None], nth, g]
    return np.rint((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy).astype(np.uint8)


def _sums(a: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Sums of ``k`` neighbours along the first or second axis, from sums of 1, 2, 4, ... of them."""
    part = lambda start, end: a[start:end] if axis == 0 else a[:, start:end]
    out, at, size, n = None, 0, 1, a.shape[axis] - k + 1
    while True:
        if k & size:
            out, at = part(at, at + n) if out is None else out + part(at, at + n), at + size
        if 2 * size > k:
            return out
        a, size = part(0, a.shape[axis] - size) + part(size, None), 2 * size


def denoise(g: np.ndarray, strength: float = STRENGTH, template: int = TEMPLATE, search: int = SEARCH) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by how alike their surroundings are.

    Two pixels have the same weight for each other, so it is worked out once. Squared differences are summed as integers, so
    the weight of a sum is the product of two from tables: of its upper and its lower bits.
    """
    t, s = template // 2, search // 2
    p = np.pad(g.astype(np.int32), [(t + s, t + s)] * 2 + [(0, 0)] * (g.ndim - 2), mode="symmetric" if min(g.shape[:2]) > t + s else "edge")
    levels = p.astype(float)
    low, wide = 11, g.shape[1]
    fine = np.exp(-np.arange(1 << low) / (template * strength) ** 2)
    coarse = np.exp(-np.arange(((template * 255) ** 2 >> low) + 1) * (1 << low) / (template * strength) ** 2)
    out = np.empty(g.shape, np.uint8)
    rows = max(STACK // (g.size // g.shape[0]), 4 * template)
    for top in range(0, g.shape[0], rows):  # what is at work stays in the cache
        high = min(rows, g.shape[0] - top)
        moved = lambda dy, dx: levels[top + t + s + dy : top + t + s + dy + high, t + s + dx : t + s + dx + wide]
        total, weight, part = moved(0, 0).copy(), np.ones((high, *g.shape[1:])), np.empty((high, *g.shape[1:]))
        for dy in range(s + 1):
            for dx in range(-s if dy else 1, s + 1):  # half of the window; from pixels of the strip and those that meet one there
                left, right = max(-dx, 0), max(dx, 0)
                gap = p[top + s - dy : top + s + high + 2 * t, s - right : s + wide + left + 2 * t] - p[top + s : top + s + high + dy + 2 * t, s - left : s + wide + right + 2 * t]
                gap *= gap
                both = _sums(_sums(gap, template, 0), template, 1).astype(np.intp)
                w = coarse.take(both >> low, mode="clip")
                both &= (1 << low) - 1
                w *= fine.take(both, mode="clip")
                for one, other in ((w[dy:, right : right + wide], moved(dy, dx)), (w[:high, left : left + wide], moved(-dy, -dx))):
                    weight += one
                    total += np.multiply(one, other, out=part)
        out[top : top + high] = np.rint(total / weight)
    return out


def evened(g: np.ndarray) -> np.ndarray:
    """Contrast evened out, then noise."""
    return denoise(even_contrast(g))


def turned(image: np.ndarray, angle: float) -> np.ndarray:
    """The image turned counter-clockwise on a canvas that holds all of it: cubic interpolation, edges repeated."""
    if angle % 90 == 0:
        return np.rot90(image, int(angle // 90))
    high, wide = image.shape[:2]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    new_w, new_h = int(high * abs(s) + wide * abs(c)), int(high * abs(c) + wide * abs(s))
    cx, cy = wide // 2, high // 2
    x, y = np.meshgrid(np.arange(new_w) - cx - (new_w - wide) / 2, np.arange(new_h) - cy - (new_h - high) / 2)
    sx, sy = c * x - s * y + cx, s * x + c * y + cy

    def weights(f: np.ndarray) -> list[np.ndarray]:
        a = -0.75
        near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
        far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
        return [far(1 + f), near(f), near(1 - f), far(2 - f)]

    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    deep = lambda f: f.reshape(f.shape + (1,) * (image.ndim - 2))
    out = np.zeros(sx.shape + image.shape[2:])
    for j, wy in enumerate(weights(sy - y0)):
        for i, wx in enumerate(weights(sx - x0)):
            out += deep(wy * wx) * image[np.clip(y0 + j - 1, 0, high - 1), np.clip(x0 + i - 1, 0, wide - 1)]
    return np.rint(out).clip(0, 255).astype(np.uint8)


def local_threshold(g: np.ndarray) -> np.ndarray:
    """White where a pixel is above its Gaussian-weighted neighbourhood less the offset."""
    half = BLOCK // 2
    sigma = 0.3 * (half - 1) + 0.8
    kernel = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    mean = np.pad(g.astype(float), [(half, half)] * 2 + [(0, 0)] * (g.ndim - 2), mode="edge")
    mean = sum(k * mean[i : i + g.shape[0]] for i, k in enumerate(kernel))
    mean = sum(k * mean[:, i : i + g.shape[1]] for i, k in enumerate(kernel))
    return np.where(g > np.rint(mean) - OFFSET, 255, 0).astype(np.uint8)


def global_threshold(g: np.ndarray) -> np.ndarray:
    """White above the level that parts the grey values into the two most distant classes."""
    if g.ndim == 2:
        return global_threshold(g[..., None])[..., 0]
    n = g.shape[2]
    count = np.bincount((g + 256 * np.arange(n)).ravel(), minlength=256 * n).reshape(n, 256).astype(float)
    below, mass = np.cumsum(count, axis=1), np.cumsum(count * np.arange(256), axis=1)
    above = count.sum(axis=1, keepdims=True) - below
    with np.errstate(all="ignore"):
        spread = np.nan_to_num(below * above * (mass / below - (mass[:, -1:] - mass) / above) ** 2)
    return np.where(g > np.argmax(spread, axis=1), 255, 0).astype(np.uint8)


def thicken(g: np.ndarray) -> np.ndarray:
    """Each pixel becomes the brightest of itself and its upper and left neighbours."""
    p = np.pad(g, [(1, 0)] * 2 + [(0, 0)] * (g.ndim - 2))
    return np.maximum.reduce([p[1:, 1:], p[:-1, 1:], p[1:, :-1], p[:-1, :-1]])


def thresholded(g: np.ndarray) -> list[np.ndarray]:
    """The four variants in their order, of a grey image with contrast and noise evened out."""
    two = global_threshold(g)
    return [local_threshold(g), two, 255 - two, thicken(two)]


def variants(image: np.ndarray, even: Callable[[np.ndarray], np.ndarray] = evened) -> list[np.ndarray]:
    """The four variants of an image, grey or in colours."""
    return thresholded(even(grey(shrink(image))))


def unpacked(files: DataFrame) -> DataFrame:
    """``image_id, content`` of ``files(content)`` that hold one or more binary PGM or PPM images each; the first comment of an image is its id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(split_pnm(bytes(content)), columns=["image_id", "content"])

    return files.select("content").mapInPandas(run, "image_id string, content binary")


def image_variants(images: DataFrame, decode: Callable[[bytes], np.ndarray | None] = decode_pnm, even: Callable[[np.ndarray], np.ndarray] = evened) -> DataFrame:
    """``image_id, variant, angle, width, height, pixels`` of ``images(image_id, content)``: twelve rows for each that decodes.

    Images of equal size are worked on in stacks of about ``STACK`` pixels; with another ``even`` than this module's, one by one.
    """
    most = STACK if even is evened else 0

    def rows(group: list[tuple[str, np.ndarray]]) -> pd.DataFrame:
        names, greys = zip(*group)
        made = thresholded(even(np.stack(greys, -1)) if most else even(greys[0])[..., None])
        out = []
        for v, p in enumerate(made):
            for a in ANGLES:
                each = np.ascontiguousarray(np.moveaxis(turned(p, a), -1, 0))
                out += [(n, v, a, x.shape[1], x.shape[0], x.tobytes()) for n, x in zip(names, each)]
        return pd.DataFrame(out, columns=["image_id", "variant", "angle", "width", "height", "pixels"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, ...], list] = {}
        waiting = 0
        for frame in frames:
            for name, content in zip(frame["image_id"], frame["content"]):
                image = decode(bytes(content)) if content is not None else None
                if image is not None:
                    g = grey(shrink(image))
                    group = held.setdefault(g.shape, [])
                    group.append((name, g))
                    waiting += g.size
                    if len(group) * g.size >= most:
                        waiting -= len(group) * g.size
                        yield rows(held.pop(g.shape))
                    elif waiting >= WAITING:
                        yield from map(rows, held.values())
                        held, waiting = {}, 0
        yield from map(rows, held.values())

    return images.select("image_id", "content").mapInPandas(run, SCHEMA)
