"""Detectors of visible marks on one image: a table of marks as data, one search for the marks of fixed places, and the
searches that differ from it.  Templates are the caller's; a detector without its template finds nothing.

A result is a dict: provider, found, and where found confidence and the region; scores are given either way."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from markfield.functions import kernels as k

Templates = dict[str, np.ndarray]


def whole(x: float) -> int:
    return math.floor(x + 0.5)


def share(x: float) -> float:
    return max(0.0, min(1.0, x))


@dataclass(frozen=True)
class Mark:
    """Lengths are in pixels of an image whose short side is `base`."""

    name: str
    provider: str
    base: int
    size: tuple[int, int]  # width, height of the template
    at: tuple[int | None, int | None, int | None, int | None]  # left, top, right, bottom: distance of that side of the mark
    origin: bool  # right and bottom are distances of the mark's left and top instead
    radius: tuple[int, int]  # least, and by scale
    contrast: tuple[float, float]  # limit, range of the confidence
    shape: tuple[float, float]
    box: tuple[int, int, int, int]  # what the region adds: left, top; its width and height (0: the mark's, plus twice that)
    context: tuple[int, int]
    both: bool = False  # dark marks on light ground count as well
    high_pass: int = 0  # sigma of the surroundings that are taken off before the shape is compared


# The marks of one place each.
MARKS = (
    Mark("yuanbao", "元宝AI", 1152, (108, 75), (None, None, 128, 95), True, (4, 10), (30, 45), (0.60, 0.30), (4, 5, 110, 78), (48, 64), both=True),
    Mark("wenxin", "文心AI", 1600, (240, 64), (25, None, None, 82), True, (4, 10), (35, 60), (0.65, 0.25), (2, 3, 240, 60), (56, 80)),
    Mark("qianwen", "千问AI", 768, (184, 33), (None, None, 26, 26), False, (4, 12), (25, 25), (0.50, 0.50), (5, 5, 0, 0), (48, 64), high_pass=4),
    Mark("qingyan", "清言AI", 768, (163, 34), (None, None, 17, 12), False, (4, 12), (8, 20), (0.50, 0.50), (5, 5, 0, 0), (48, 64), high_pass=4),
    Mark("jimeng", "即梦AI", 1728, (468, 160), (None, None, 0, 184), True, (5, 18), (18, 35), (0.42, 0.35), (0, 0, 0, 0), (56, 80)),
)
# The second mark of jimeng (size of its template, place, margin, sigma, limit) and the regions of both
# (name, left, top, right, bottom distances, width, height, context).
JIMENG_TOP, JIMENG_LIMIT = (315, 130, 10, 30, 12, 3), 0.18
JIMENG_REGIONS = (("AI生成", 8, 8, None, None, 345, 150, (64, 112)), ("即梦AI", None, None, 400, 150, 350, 98, (56, 80)))
# doubao's scales, template, place; limits and ranges of contrast, shape and the left part for its variants;
# padding of the repair (least, share of the short side).
DOUBAO_FACTORS, DOUBAO_SIZE, DOUBAO_AT, DOUBAO_RADIUS, DOUBAO_MASK = (0.78, 0.84, 0.90, 0.96, 1.00, 1.06, 1.12), (251, 55, 30, 8), (27, 32), (12, 34), 70
DOUBAO = {"classic": ((8, 18), (0.45, 0.35), (8, 0.006)), "v2": ((18, 30), (0.36, 0.30), (16, 0.012))}
DOUBAO_OUTLINE = ((20, 30), (0.22, 0.20), (0.32, 0.30))
# xiaohongshu's label (scales, template, place, radius), its limits and ranges; the account's tolerances
# (factor, place, density, columns); the badge on an image of that width (scales, template, place, radius, edges).
LABEL_FACTORS, LABEL_SIZE, LABEL_AT, LABEL_RADIUS = (0.78, 0.88, 1.00, 1.12, 1.24), (99, 25, 40, 10), (253, 47), (12, 28)
LEGACY, BADGE, ACCOUNT = (0.70, 0.25), (0.25, 0.35), (0.36, 0.20)
ACCOUNT_LIMITS = (0.001, 8, 0.09, 0.65)
BADGE_WIDTH, BADGE_FACTORS, BADGE_SIZE, BADGE_AT, BADGE_RADIUS, EDGES = 1440, (0.85, 0.92, 1.0, 1.08, 1.16), (116, 53, 30, 12), (36, 84), 18, (40, 120)
SMOOTH = 0.120
# gemini's layouts (size, margin, radius and step of the offsets), its limits, and those of its decision.
LAYOUTS = ((48, 32, 16, 2), (96, 64, 24, 4), (96, 192, 0, 1))
GEMINI_FAR, GEMINI_NEAR, GEMINI_QUALITY, GEMINI_FALLBACK = (0.36, 0.20, 0.10), (0.32, 0.30), (0.001, 0.60, 0.25), 0.35
OVERLAP = 0.60


class Image:
    """An image's planes, computed when asked for."""

    def __init__(self, rgb: np.ndarray):
        self.rgb = rgb[..., :3]
        self.height, self.width = rgb.shape[:2]
        self.short = min(self.height, self.width)
        self.gray = k.gray_of(self.rgb)


def window(image: Image, x: int, y: int, radius: int, width: int, height: int) -> tuple[int, int, int, int] | None:
    """First and last places that a mark of this size can have around (x, y): x0, y0, x1, y1."""
    x0, y0 = max(0, x - radius), max(0, y - radius)
    x1, y1 = min(image.width - width, x + radius), min(image.height - height, y + radius)
    return (x0, y0, x1, y1) if x0 <= x1 and y0 <= y1 else None


def search(plane: np.ndarray, places: tuple[int, int, int, int], kernel: np.ndarray) -> np.ndarray:
    x0, y0, x1, y1 = places
    return k.slide(plane[y0 : y1 + kernel.shape[0], x0 : x1 + kernel.shape[1]], kernel)


def missed(provider: str, **scores) -> dict:
    return {"provider": provider, "found": False, **scores}


def region(provider: str, confidence: float, x: int, y: int, width: int, height: int, context: int, **more) -> dict:
    return {"provider": provider, "found": True, "confidence": confidence, "x": x, "y": y, "width": width, "height": height, "context": context, **more}


def margin(value: float, limit: tuple[float, float]) -> float:
    return share((value - limit[0]) / limit[1])


def fixed_mark(image: Image, mark: Mark, template: np.ndarray | None) -> dict:
    """Best contrast of the template near its place, then the shape there."""
    scale = image.short / mark.base
    w, h = (max(1, whole(n * scale)) for n in mark.size)
    if template is None or w >= image.width or h >= image.height:
        return missed(mark.provider)
    left, top, right, bottom = (None if n is None else whole(n * scale) for n in mark.at)
    x = left if left is not None else image.width - right - (w if not mark.origin or not mark.at[2] else 0)
    y = top if top is not None else image.height - bottom - (0 if mark.origin else h)
    places = window(image, x, y, max(mark.radius[0], whole(mark.radius[1] * scale)), w, h)
    if places is None:
        return missed(mark.provider)
    mask = k.resize_nearest(template, h, w)
    scores = search(image.gray, places, k.contrast_kernel(mask, k.odd_width(7 * scale)))
    contrast, dx, dy = k.first_best(scores)
    if mark.both:
        low, lx, ly = k.first_best(-scores)
        if low > abs(contrast):
            contrast, dx, dy = -low, lx, ly
    x, y = places[0] + dx, places[1] + dy
    patch = image.gray[y : y + h, x : x + w]
    if mark.high_pass:
        patch = patch - k.blur(patch, max(1, mark.high_pass * scale))
    shape = k.pearson(patch, mask)
    strength, likeness = (abs(contrast), abs(shape)) if mark.both else (contrast, shape)
    told = {"contrast": contrast, "shape": shape}
    if strength < mark.contrast[0] or likeness < mark.shape[0]:
        return missed(mark.provider, **told)
    confidence = min(margin(strength, mark.contrast), margin(likeness, mark.shape))
    bx, by, bw, bh = (whole(n * scale) for n in mark.box)
    if not mark.box[2]:
        bx = by = max(2, bx)
        x0, y0, x1, y1 = max(0, x - bx), max(0, y - by), min(image.width, x + w + bx), min(image.height, y + h + by)
    else:
        x0, y0 = max(0, x - bx), max(0, y - by)
        x1, y1 = x0 + min(image.width - x0, max(1, bw)), y0 + min(image.height - y0, max(1, bh))
    if mark.both:
        told["polarity"] = "light" if contrast >= 0 else "dark"
    return region(mark.provider, confidence, x0, y0, x1 - x0, y1 - y0, max(mark.context[0], whole(mark.context[1] * scale)), **told)


def jimeng(image: Image, templates: Templates) -> dict:
    """The lower mark decides; the upper one, if it is there as well, is a second region."""
    mark = next(m for m in MARKS if m.name == "jimeng")
    hit = fixed_mark(image, mark, templates.get("jimeng"))
    if not hit["found"]:
        return hit
    scale = image.short / mark.base
    top = jimeng_top(image, templates.get("jimeng_top"), scale)
    regions = []
    for name, left, above, right, below, w, h, context in JIMENG_REGIONS:
        x = whole(left * scale) if left is not None else image.width - whole(right * scale)
        y = whole(above * scale) if above is not None else image.height - whole(below * scale)
        box = boxed(x, y, max(1, whole(w * scale)), max(1, whole(h * scale)))
        if name != "AI生成" or top >= JIMENG_LIMIT:
            regions.append(region(mark.provider, hit["confidence"], *box, max(context[0], whole(context[1] * scale)), name=name))
    return {**hit, "top": top, "regions": regions}


def boxed(x: float, y: float, w: float, h: float) -> tuple[int, int, int, int]:
    return max(0, whole(x)), max(0, whole(y)), max(1, whole(w)), max(1, whole(h))


def jimeng_top(image: Image, template: np.ndarray | None, scale: float) -> float:
    tw, th, first, last, around, sigma = JIMENG_TOP
    if template is None:
        return 0.0
    w, h = max(1, whole(tw * scale)), max(1, whole(th * scale))
    start, end, room, sigma = max(0, whole(first * scale)), whole(last * scale), max(4, whole(around * scale)), max(0.5, sigma * scale)
    corner = image.gray[: min(image.height, end + h + room), : min(image.width, end + w + room)]
    part = (corner - k.blur(corner, sigma))[start:, start:]
    if part.shape[0] < h or part.shape[1] < w:
        return 0.0
    small = k.resize_nearest(template, h, w).astype(np.float64)
    return k.ncc(part, small - k.blur(small, sigma))[0]


def doubao_mode(variant: str, contrast: float, shape: float, left: float | None = None) -> str | None:
    c, s, _ = DOUBAO[variant]
    if contrast >= c[0] and shape >= s[0]:
        return "solid"
    c, s, p = DOUBAO_OUTLINE
    return "outline" if variant == "v2" and left is not None and contrast >= c[0] and shape >= s[0] and left >= p[0] else None


def doubao_variant(image: Image, variant: str, template: np.ndarray | None) -> dict:
    """The scale with the best contrast; solid letters by their shape, outlined ones by the left part as well."""
    best = None
    width, height, least_w, least_h = DOUBAO_SIZE
    for factor in DOUBAO_FACTORS if template is not None else ():
        scale = image.short / 1600 * factor
        w, h = max(least_w, whole(width * scale)), max(least_h, whole(height * scale))
        if w >= image.width or h >= image.height:
            continue
        x, y = whole(image.width - DOUBAO_AT[0] * scale - w), whole(image.height - DOUBAO_AT[1] * scale - h)
        places = window(image, x, y, max(DOUBAO_RADIUS[0], whole(DOUBAO_RADIUS[1] * scale)), w, h)
        if places is None:
            continue
        small = k.resize_area(template.astype(np.float64), h, w)
        contrast, dx, dy = k.first_best(search(image.gray, places, k.contrast_kernel(small > DOUBAO_MASK, 7)))
        if best is None or contrast > best[0]:
            best = contrast, places[0] + dx, places[1] + dy, small
    if best is None:
        return missed("豆包", variant=variant, contrast=0.0, shape=0.0)
    contrast, x, y, small = best
    h, w = small.shape
    patch = image.gray[y : y + h, x : x + w]
    shape, left = k.pearson(patch, small), None
    mode = doubao_mode(variant, contrast, shape)
    if mode is None and variant == "v2":
        split = max(1, whole(w * 0.35))
        left = k.pearson((patch - k.blur(patch, max(1, 4 * w / width)))[:, :split], small[:, :split])
        mode = doubao_mode(variant, contrast, shape, left)
    told = {"variant": variant, "contrast": contrast, "shape": shape, "left": left}
    if mode is None:
        return missed("豆包", **told)
    limits, padding = DOUBAO[variant][:2], DOUBAO[variant][2]
    scores = [contrast, shape]
    if mode == "outline":
        limits, scores = DOUBAO_OUTLINE, [contrast, shape, left]
    pad = max(padding[0], whole(image.short * padding[1]))
    return region("豆包", min(margin(v, m) for v, m in zip(scores, limits, strict=True)), x, y, w, h, max(160, pad * 16), mode=mode, padding=pad, **told)


def doubao(image: Image, templates: Templates) -> dict:
    """The variant that is found with more confidence; of two that are not, the one nearer to its limits."""
    both = [doubao_variant(image, v, templates.get(t)) for v, t in (("classic", "doubao"), ("v2", "doubao_v2"))]
    found = [r for r in both if r["found"]]
    nearness = lambda r: min(r["contrast"] / DOUBAO[r["variant"]][0][0], r["shape"] / DOUBAO[r["variant"]][1][0])
    return max(found, key=lambda r: r["confidence"]) if found else max(both, key=nearness)


def label_place(image: Image, plane: np.ndarray, template: np.ndarray | None) -> dict | None:
    best = None
    width, height, least_w, least_h = LABEL_SIZE
    for factor in LABEL_FACTORS if template is not None else ():
        scale = image.short / 960 * factor
        w, h = max(least_w, whole(width * scale)), max(least_h, whole(height * scale))
        if w >= image.width or h >= image.height:
            continue
        x, y = whole(image.width - LABEL_AT[0] * scale), whole(image.height - LABEL_AT[1] * scale)
        places = window(image, x, y, max(LABEL_RADIUS[0], whole(LABEL_RADIUS[1] * scale)), w, h)
        if places is None:
            continue
        x0, y0, x1, y1 = places
        score, dx, dy = k.ncc(plane[y0 : y1 + h, x0 : x1 + w], k.resize_area(template.astype(np.float64), h, w))
        if best is None or score > best["score"]:
            best = {"score": score, "x": x0 + dx, "y": y0 + dy, "w": w, "h": h, "scale": scale, "factor": factor, "dx": x0 + dx - x, "dy": y0 + dy - y}
    return best


def label_region(image: Image, best: dict, variant: str, limit: tuple[float, float], **more) -> dict:
    x, y = max(0, best["x"] - whole(5 * best["scale"])), max(0, best["y"] - best["h"] * 2)
    w, h = min(image.width - x, whole(best["w"] * 2.5)), min(image.height - y, whole(best["h"] * 3.2))
    return region("小红书", margin(best["score"], limit), x, y, w, h, 64, variant=variant, score=best["score"], **more)


def strokes(image: Image, best: dict) -> tuple[float, float]:
    """Right of a label: share of bright, pale pixels that stand out, and of columns with any that stands out."""
    x0, x1 = max(0, best["x"] + whole(best["w"] * 0.92)), min(image.width, image.width - max(2, whole(8 * best["scale"])))
    y0, y1 = max(0, best["y"] - whole(best["h"] * 0.15)), min(image.height, best["y"] + whole(best["h"] * 1.15))
    if x1 - x0 <= 2 or y1 - y0 <= 2:
        return 0.0, 0.0
    part = image.gray[y0:y1, x0:x1]
    out = part - k.blur(part, max(1, best["scale"] * 1.2)) > 2.5
    _, saturation, value = k.hsv_of(image.rgb[y0:y1, x0:x1])
    return float((out & (saturation < 80) & (value > 120)).mean()), float(out.any(0).mean())


def account_holds(score: float, factor: float, scale: float, dx: float, dy: float, density: float, columns: float) -> bool:
    off, near, dense, active = ACCOUNT_LIMITS
    reach = max(4, near * scale)
    return score >= ACCOUNT[0] and abs(factor - 1) <= off and abs(dx) <= reach and abs(dy) <= reach and density >= dense and columns >= active


def badge_holds(score: float) -> bool:
    return math.isfinite(score) and score >= BADGE[0]


def at_badge_width(image: Image, height: int, y0: int, x0: int) -> np.ndarray:
    """The image at the badge's fixed width, from row y0 and column x0 on."""
    if image.width == BADGE_WIDTH:
        return image.gray[y0:, x0:]
    return np.clip(k.half_up(k.resize_area(image.gray, height, BADGE_WIDTH, y0, x0)), 0, 255)


def badge(image: Image, template: np.ndarray | None) -> dict:
    """Edges of the image at a fixed width against the badge; the mask is the badge with round corners and the account's
    line, whole where it is smooth, else its strokes."""
    scale, best = image.width / BADGE_WIDTH, None
    height = max(1, whole(image.height / scale))
    if template is not None:
        bw, bh, least_w, least_h = BADGE_SIZE
        places = []
        for factor in BADGE_FACTORS:
            w, h = max(least_w, whole(bw * factor)), max(least_h, whole(bh * factor))
            x, y = BADGE_WIDTH - whole(BADGE_AT[0] * factor) - w, height - whole(BADGE_AT[1] * factor) - h
            x0, y0, x1, y1 = max(0, x - BADGE_RADIUS), max(0, y - BADGE_RADIUS), min(BADGE_WIDTH - w, x + BADGE_RADIUS), min(height - h, y + BADGE_RADIUS)
            if h < height and x0 <= x1 and y0 <= y1:
                places.append((x0, y0, x1, y1, w, h))
        left, top = (min((p[i] for p in places), default=0) for i in (0, 1))
        edges = k.canny_corner(lambda y0, x0: at_badge_width(image, height, y0, x0), top, left, *EDGES) * 255.0 if places else None
        for x0, y0, x1, y1, w, h in places:
            score, dx, dy = k.ncc(edges[y0 - top : y1 + h - top, x0 - left : x1 + w - left], k.resize_nearest(template, h, w))
            if best is None or score > best[0]:
                best = score, x0 + dx, y0 + dy, w, h
    if best is None or not badge_holds(best[0]):
        return missed("小红书", score=best[0] if best else 0.0)
    score, bx, by, w, h = best
    x, y = max(0, whole((bx - 260) * scale)), max(0, whole((by - 5) * scale))
    width = max(1, min(image.width, whole((bx + w + 12) * scale)) - x)
    tall = max(1, min(image.height, whole((by + h + 64) * scale)) - y)
    mask, how = badge_mask(image, scale, (x, y, width, tall), (whole(bx * scale) - x, whole(by * scale) - y, max(1, whole(w * scale)), max(1, whole(h * scale))))
    return region("小红书", margin(score, BADGE), x, y, width, tall, max(64, whole(96 * scale)), variant="badge", score=score, strategy=how, mask=mask)


def rounded(shape: tuple[int, int], x: int, y: int, w: int, h: int, inset: int, corner: int, margin_: int) -> np.ndarray:
    """A box as two crossing bars and four discs."""
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    bar = lambda x0, y0, x1, y1: (xx >= x0) & (xx <= x1) & (yy >= y0) & (yy <= y1)
    out = bar(x + inset, max(0, y - margin_), x + w - inset, y + h + margin_) | bar(max(0, x - margin_), y + inset, x + w + margin_, y + h - inset)
    for cx in (x + inset, x + w - inset):
        for cy in (y + inset, y + h - inset):
            out |= (xx - cx) ** 2 + (yy - cy) ** 2 <= corner**2
    return out


def badge_mask(image: Image, scale: float, box: tuple[int, int, int, int], own: tuple[int, int, int, int]) -> tuple[np.ndarray, str]:
    x, y, width, height = box
    mask = rounded((height, width), *own, max(3, whole(10 * scale)), max(4, whole(13 * scale)), max(2, whole(3 * scale)))
    low = own[1] + own[3]
    first, last = min(height, low + max(4, whole(7 * scale))), min(height, low + max(20, whole(57 * scale)))
    if last <= first:
        return mask, "badge-only"
    part = image.gray[y : y + height, x : x + width]
    if k.canny(part[first:last], *EDGES).mean() < SMOOTH:
        mask[first:last] = True
        return mask, "smooth-line"
    _, saturation, value = k.hsv_of(image.rgb[y : y + height, x : x + width])
    text = (part - k.blur(part, max(1, 3 * scale)) > 3.5) & (saturation < 105) & (value > 100)
    mask[first:last] |= k.widened(text[first:last], max(3, whole(5 * scale)) | 1)
    return mask, "text-strokes"


def xiaohongshu(image: Image, templates: Templates) -> dict:
    """The dark label, else the badge, else the light label with an account's strokes right of it."""
    label = templates.get("xiaohongshu")
    dark = label_place(image, 255 - image.gray, label)
    if dark and dark["score"] >= LEGACY[0]:
        return label_region(image, dark, "legacy", LEGACY)
    found = badge(image, templates.get("xiaohongshu_badge"))
    if found["found"]:
        return found
    light = label_place(image, image.gray, label)
    if light is None:
        return missed("小红书", variant="light-account", score=0.0)
    density, columns = strokes(image, light)
    if not account_holds(light["score"], light["factor"], light["scale"], light["dx"], light["dy"], density, columns):
        return missed("小红书", variant="light-account", score=light["score"], density=density, columns=columns)
    return label_region(image, light, "light-account", ACCOUNT, density=density, columns=columns)


def gemini_holds(size: int, margin_: int, score: float, spatial: float, gradient: float) -> bool:
    if (size, margin_) == LAYOUTS[-1][:2]:
        return all(v >= limit for v, limit in zip((score, spatial, gradient), GEMINI_FAR, strict=True))
    return spatial >= GEMINI_NEAR[0] and gradient >= GEMINI_NEAR[1]


def fallback_holds(residual: float) -> bool:
    return math.isfinite(residual) and residual <= GEMINI_FALLBACK


def offset_scores(part: np.ndarray, template: np.ndarray, edges: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlation of brightness and of edges at every `step`-th offset of the template in part, to rounding, and whether a
    patch varies enough for that.  A patch's edges are those of part, but on its border, where the patch is mirrored: there
    they are twice the sum of two differences along the border, and 0 in the corners."""
    n, size = len(template), template.size
    part = part - part.mean()

    def sums(plane: np.ndarray, weights: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(plane, weights.shape)[::step, ::step]
        return np.stack([row.reshape(len(row), -1) @ weights.ravel() for row in view])

    flat = template - template.mean()
    spread = k.box_sums(part * part, (n, n)) - k.box_sums(part, (n, n)) ** 2 / size
    sx = spread[::step, ::step]
    down, across = part[2:] - part[:-2], part[:, 2:] - part[:, :-2]
    inner = k.edge_magnitude(part)[1:-1, 1:-1]
    upright, level = np.abs(2 * (down[:, :-1] + down[:, 1:])), np.abs(2 * (across[:-1] + across[1:]))
    own = edges - edges.mean()
    total = square = both = 0.0
    high, wide = part.shape[0] - n + 1, part.shape[1] - n + 1
    for plane, weights in (
        (inner, own[1:-1, 1:-1]), (upright[:, :wide], own[1:-1, :1]), (upright[:, n - 2 : n - 2 + wide], own[1:-1, -1:]),
        (level[:high], own[:1, 1:-1]), (level[n - 2 : n - 2 + high], own[-1:, 1:-1]),
    ):
        both = both + sums(plane, weights)
        total = total + k.box_sums(plane, weights.shape)[::step, ::step]
        square = square + k.box_sums(plane * plane, weights.shape)[::step, ::step]
    ex = square - total * total / size
    ok = (sx > 1e-4) & (ex > 1e-4)
    by = lambda v, t: np.sqrt(np.where(ok, v, 1) * max(float((t * t).sum()), 1e-300))
    return sums(part, flat) / by(sx, flat), both / by(ex, own), ok


def gemini_places(image: Image, luma: np.ndarray, templates: Templates) -> list[tuple]:
    """size, margin, x, y of the places that can be the best one, in the order of the search: those within rounding of it by
    offset_scores, and those without enough variation to say."""
    near, told = 1e-6, []
    for size, margin_, radius, step in LAYOUTS:
        template = templates.get(f"gemini_{size}")
        x, y = image.width - margin_ - size, image.height - margin_ - size
        if template is None or size >= image.short or x < 0 or y < 0:
            continue
        xs, ys = ([p + d for d in range(-radius, radius + 1, step) if p + d >= 0 and p + d + size <= most] for p, most in ((x, image.width), (y, image.height)))
        t = template.astype(np.float64)
        spatial, gradient, ok = offset_scores(luma[ys[0] : ys[-1] + size, xs[0] : xs[-1] + size], t, k.edge_magnitude(t), step)
        score = spatial + 0.8 * np.maximum(0.0, gradient)
        for i, px in enumerate(xs):
            for j, py in enumerate(ys):
                s, g, v = float(spatial[j, i]), float(gradient[j, i]), float(score[j, i])
                surely, maybe = (gemini_holds(size, margin_, v + d, s + d, g + d) for d in (-near, near))
                told.append((size, margin_, px, py, v, bool(ok[j, i]), surely, maybe))
    known = [r for r in told if r[5]]
    sure = [r[4] for r in known if r[6]]
    most = max(sure or [r[4] for r in known], default=0.0) - 2 * near
    return [r[:4] for r in told if not r[5] or (r[4] >= most and (r[7] or not sure)) or (r[7] and not sure)]


def gemini(image: Image, templates: Templates) -> dict:
    """Best place over layouts and offsets, by correlation of brightness and of edges; one that holds goes first."""
    best: tuple | None = None
    luma = k.luma_of(image.rgb)
    for size, margin_, px, py in gemini_places(image, luma, templates):
        template = templates[f"gemini_{size}"]
        patch = luma[py : py + size, px : px + size]
        spatial = k.pearson(patch, template)
        gradient = k.pearson(k.edge_magnitude(patch), k.edge_magnitude(template))
        score = spatial + 0.8 * max(0.0, gradient)
        rank = (gemini_holds(size, margin_, score, spatial, gradient), score)
        if best is None or rank > best[0]:
            best = rank, {"x": px, "y": py, "size": size, "margin": margin_, "spatial": spatial, "gradient": gradient, "score": score}
    if best is None:
        return missed("Gemini", confidence=0.0)
    (holds, _), at = best
    return {"provider": "Gemini", "found": holds, "confidence": share((max(0.0, at["spatial"]) + max(0.0, at["gradient"])) / 2), "width": at["size"], "height": at["size"], "context": 160, **at}


def linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def gemini_decision(image: Image, templates: Templates) -> dict:
    """What is known of a place that gemini() finds: the gain at which the template is explained best, what is left of it,
    and whether that is good enough (`clear`), enough to be taken for a mark (`mark`), or nothing.  The decision only; no
    pixels are restored."""
    found = gemini(image, templates)
    if not found["found"]:
        return {**found, "status": "not-found"}
    x, y, size = found["x"], found["y"], found["size"]
    template = templates[f"gemini_{size}"]
    patch = image.rgb[y : y + size, x : x + size] / 255
    light = linear(patch)
    mean = light.mean(-1)
    best = (math.inf, 1.0)
    for step in range(83):
        a = np.minimum(template * (0.35 + 0.02 * step), 0.99)
        left = np.clip(np.where(a > 0.002, (mean - a) / (1 - a), mean), 0, 1)
        best = min(best, (abs(k.pearson(left, template)), 0.35 + 0.02 * step))
    a = np.minimum(template * best[1], 0.99)[..., None]
    masked = np.broadcast_to(a > 0.002, light.shape)
    left = (light - a) / (1 - a)
    clipped = float(((left < 0) | (left > 1))[masked].mean()) if masked.any() else 0.0
    core = template > 0.05
    edges = float(k.edge_magnitude(patch.mean(-1))[core].mean()) if core.any() else 0.0
    residual, most, least = GEMINI_QUALITY
    clear = best[0] <= residual and clipped <= most and edges >= least
    status = "clear" if clear else "mark" if fallback_holds(best[0]) else "not-found"
    told = {**found, "found": status != "not-found", "status": status, "gain": best[1], "residual": best[0], "clipped": clipped, "edges": edges}
    return told if status != "mark" else {**told, "mask": k.widened(template > 0.012, 7)}


def overlap(a: dict, b: dict) -> float:
    side = lambda p, n: max(0, min(a[p] + a[n], b[p] + b[n]) - max(a[p], b[p]))
    smaller = min(a["width"] * a["height"], b["width"] * b["height"])
    return side("x", "width") * side("y", "height") / smaller if smaller else 0.0


def fixed(name: str) -> Callable[[Image, Templates], dict]:
    mark = next(m for m in MARKS if m.name == name)
    return lambda image, templates: fixed_mark(image, mark, templates.get(name))


#: Detectors in the order in which their regions are taken.
DETECTORS: dict[str, Callable[[Image, Templates], dict]] = {
    "jimeng": jimeng, "yuanbao": fixed("yuanbao"), "wenxin": fixed("wenxin"), "qianwen": fixed("qianwen"), "qingyan": fixed("qingyan"), "doubao": doubao, "xiaohongshu": xiaohongshu,
}


def detect(image: Image, templates: Templates) -> list[dict]:
    """Regions of all detectors; one that overlaps an earlier region by OVERLAP of the smaller is left out."""
    kept: list[dict] = []
    for f in DETECTORS.values():
        found = f(image, templates)
        for r in found.get("regions", [found]) if found["found"] else []:
            if all(overlap(r, other) < OVERLAP for other in kept):
                kept.append(r)
    return kept


def detect_all(image: Image, templates: Templates, read: Callable[[Image], list[dict]] | None = None) -> list[dict]:
    """Regions of all detectors, gemini's after them; where there is none and gemini is not clear, those of recognised
    text (read)."""
    kept, decided = detect(image, templates), gemini_decision(image, templates)
    if decided["status"] == "mark":
        kept.append(decided)
    if not kept and decided["status"] != "clear" and read is not None:
        kept = read(image)
    return kept
