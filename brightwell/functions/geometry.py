"""Box expressions. A box is four columns (x1, y1, x2, y2) or (l, t, r, b); nothing here shuffles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: str = "x1 y1 x2 y2") -> Box:
    return tuple(F.col(prefix + n) for n in names.split())


def _pos(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    return _pos(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * _pos(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Intersection over union with eps added to the union; 0 for disjoint boxes or an empty union."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter + eps
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def page_iou(a: Box, b: Box) -> Column:
    """As iou, with areas of inverted boxes counted as 0."""
    inter = intersection(a, b)
    size = lambda x: _pos(x[2] - x[0]) * _pos(x[3] - x[1])
    union = size(a) + size(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def ioa(a: Box, b: Box, eps: float = 1e-7) -> Column:
    """Intersection over the second box's area."""
    return intersection(a, b) / (area(b) + eps)


def wh_iou(w1: Column, h1: Column, w2: Column, h2: Column, eps: float = 1e-7) -> Column:
    inter = F.least(w1, w2) * F.least(h1, h2)
    return inter / (w1 * h1 + w2 * h2 - inter + eps)


def box_iou_family(a: Box, b: Box, kind: str = "iou", eps: float = 1e-7) -> Column:
    """iou, giou, diou or ciou of corner boxes."""
    w1, h1, w2, h2 = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    inter = intersection(a, b)
    union = w1 * h1 + w2 * h2 - inter + eps
    over = inter / union
    if kind == "iou":
        return over
    cw, ch = F.greatest(a[2], b[2]) - F.least(a[0], b[0]), F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    if kind == "giou":
        hull = cw * ch + eps
        return over - (hull - union) / hull
    diagonal = cw * cw + ch * ch + eps
    dx, dy = b[0] + b[2] - a[0] - a[2], b[1] + b[3] - a[1] - a[3]
    distance = (dx * dx + dy * dy) / 4 / diagonal
    if kind == "diou":
        return over - distance
    if kind == "ciou":
        turn = F.atan(w2 / (h2 + eps)) - F.atan(w1 / (h1 + eps))
        v = F.lit(4 / math.pi**2) * turn * turn
        return over - (distance + v * v / (v - over + (1 + eps)))
    raise ValueError(f"unknown kind {kind!r}")


def to_center(b: Box) -> Box:
    """Corners to (centre x, centre y, width, height)."""
    return ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])


def from_center(b: Box) -> Box:
    return (b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2)


def to_top_left(b: Box) -> Box:
    """Corners to (left, top, width, height)."""
    return (b[0], b[1], b[2] - b[0], b[3] - b[1])


def denormalise(b: Box, w: Column | float, h: Column | float, padw: float = 0.0, padh: float = 0.0) -> Box:
    """Normalised centre form to corners in pixels."""
    return (w * (b[0] - b[2] / 2) + padw, h * (b[1] - b[3] / 2) + padh, w * (b[0] + b[2] / 2) + padw, h * (b[1] + b[3] / 2) + padh)


def normalise(b: Box, w: Column | float, h: Column | float, clip_eps: float | None = None) -> Box:
    """Corners in pixels to normalised centre form, clipped to the image if clip_eps is given."""
    if clip_eps is not None:
        b = clip(b, w - clip_eps, h - clip_eps)
    return ((b[0] + b[2]) / 2 / w, (b[1] + b[3]) / 2 / h, (b[2] - b[0]) / w, (b[3] - b[1]) / h)


def clip(b: Box, w: Column | float, h: Column | float) -> Box:
    lim = lambda c, most: F.least(F.greatest(c, F.lit(0.0)), most if isinstance(most, Column) else F.lit(float(most)))
    return (lim(b[0], w), lim(b[1], h), lim(b[2], w), lim(b[3], h))


def rescale(b: Box, from_h: Column, from_w: Column, to_h: Column, to_w: Column) -> Box:
    """Boxes on a letterboxed image back to the original: padding off, gain off, clipped."""
    gain = F.least(from_h / to_h, from_w / to_w)
    px, py = (from_w - to_w * gain) / 2, (from_h - to_h * gain) / 2
    return clip(((b[0] - px) / gain, (b[1] - py) / gain, (b[2] - px) / gain, (b[3] - py) / gain), to_w.cast("double"), to_h.cast("double"))


def letterbox(h: Column, w: Column, new: int = 640, stride: int = 32, *, auto: bool = True, scaleup: bool = True) -> dict[str, Column]:
    """Resized size, left/right/top/bottom padding and gain of an image fitted into new x new.

    With auto only the padding modulo the stride is kept. Halves of a pixel go to the far side.
    """
    gain = F.least(F.lit(float(new)) / h, F.lit(float(new)) / w)
    if not scaleup:
        gain = F.least(gain, F.lit(1.0))
    rw, rh = F.bround(w * gain).cast("int"), F.bround(h * gain).cast("int")
    dw, dh = F.lit(new) - rw, F.lit(new) - rh
    if auto:
        dw, dh = F.pmod(dw, F.lit(stride)), F.pmod(dh, F.lit(stride))
    dw, dh = dw / 2.0, dh / 2.0
    near = lambda c: F.bround(c - 0.1).cast("int")
    far = lambda c: F.bround(c + 0.1).cast("int")
    return {"resized_w": rw, "resized_h": rh, "left": near(dw), "right": far(dw), "top": near(dh), "bottom": far(dh), "gain": gain}


def make_divisible(x: Column, divisor: int) -> Column:
    return (F.ceil(x / divisor) * divisor).cast("int")


def capped_size(w: Column, h: Column, max_pixels: int = 4_000_000) -> tuple[Column, Column]:
    """Width and height scaled down to at most max_pixels, at least 1 each."""
    scale = F.when(w * h > max_pixels, F.sqrt(F.lit(float(max_pixels)) / (w * h))).otherwise(1.0)
    return F.greatest(F.lit(1), F.floor(w * scale).cast("int")), F.greatest(F.lit(1), F.floor(h * scale).cast("int"))


def best_resolution(w: Column, h: Column, candidates: list[tuple[int, int]]) -> Column:
    """struct(width, height): the candidate with most effective pixels, then least waste, then first."""
    rows = []
    for k, (cw, ch) in enumerate(candidates):
        gain = F.least(F.lit(cw) / w, F.lit(ch) / h)
        effective = F.least((F.floor(w * gain) * F.floor(h * gain)).cast("bigint"), (w * h).cast("bigint"))
        rows.append(F.struct((-effective).alias("e"), (F.lit(cw * ch) - effective).alias("waste"), F.lit(k).alias("k"), F.lit(cw).alias("width"), F.lit(ch).alias("height")))
    best = F.least(*rows) if len(rows) > 1 else rows[0]
    return F.struct(best["width"].alias("width"), best["height"].alias("height"))


def patch_grid(w: Column, h: Column, patch: int) -> Column:
    """Array of (x, y) offsets of the patches of a w x h image, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1, F.lit(patch)), lambda y: F.transform(F.sequence(F.lit(0), w - 1, F.lit(patch)), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def unpad(w: Column, h: Column, orig_w: Column, orig_h: Column) -> dict[str, Column]:
    """The part of a padded w x h grid that an image of the original aspect fills: x0, x1, y0, y1."""
    wide = orig_w / orig_h > w / h
    new_h, new_w = F.floor(orig_h * (w / orig_w)).cast("int"), F.floor(orig_w * (h / orig_h)).cast("int")
    py, px = F.floor((h - new_h) / 2).cast("int"), F.floor((w - new_w) / 2).cast("int")
    return {"x0": F.when(wide, 0).otherwise(px), "x1": F.when(wide, w).otherwise(w - px), "y0": F.when(wide, py).otherwise(0), "y1": F.when(wide, h - py).otherwise(h)}


def decode_anchor(s: tuple[Column, Column, Column, Column], grid: tuple[Column, Column], stride: Column | float, anchor: tuple[Column, Column]) -> Box:
    """Grid-cell logits to a centre box in pixels: xy = (2 sigma + grid - 0.5) stride, wh = (2 sigma)^2 anchor."""
    sig = lambda c: 1 / (1 + F.exp(-c))
    return ((sig(s[0]) * 2 + grid[0] - 0.5) * stride, (sig(s[1]) * 2 + grid[1] - 0.5) * stride, F.pow(sig(s[2]) * 2, 2) * anchor[0], F.pow(sig(s[3]) * 2, 2) * anchor[1])


def undo_augmentation(b: Box, scale: Column, flip: Column, w: Column, h: Column) -> Box:
    """Centre boxes of a scaled and flipped image back: scale off, then un-flip ('ud', 'lr' or null)."""
    x, y = b[0] / scale, b[1] / scale
    return (F.when(flip == "lr", w - x).otherwise(x), F.when(flip == "ud", h - y).otherwise(y), b[2] / scale, b[3] / scale)


def crop_window(b: Box, expansion: float, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners of a normalised box grown by `expansion` of its size and clipped; ok is false for an empty window."""
    dw, dh = (b[2] - b[0]) * expansion / 2, (b[3] - b[1]) * expansion / 2
    lo = lambda c: F.greatest(F.lit(0.0), c)
    hi = lambda c: F.least(F.lit(1.0), c)
    l, t, r, u = lo(b[0] - dw), lo(b[1] - dh), hi(b[2] + dw), hi(b[3] + dh)
    px = {"px0": (l * width).cast("int"), "py0": (t * height).cast("int"), "px1": (r * width).cast("int"), "py1": (u * height).cast("int")}
    return px | {"ok": (px["px1"] > px["px0"]) & (px["py1"] > px["py0"])}


def top_left_page(b: Box, page_w: Column, page_h: Column, bottom_left: Column) -> Box:
    """A page box of either origin to 0..1 with the origin at the top left."""
    t = F.when(bottom_left, page_h - F.greatest(b[1], b[3])).otherwise(F.least(b[1], b[3]))
    u = F.when(bottom_left, page_h - F.least(b[1], b[3])).otherwise(F.greatest(b[1], b[3]))
    return (b[0] / page_w, t / page_h, b[2] / page_w, u / page_h)
