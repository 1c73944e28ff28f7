"""Recognised text of marks: normal form, kind, lines and regions.  Plain functions; operators apply them in batches."""

from __future__ import annotations

import math
import unicodedata

import regex

# Platform names whose marks are recognised, what generated content is called, an account's label, and the
# least score of an item.
NAMES = ("豆包", "即梦", "千问", "清言", "元宝", "文心", "GEMINI")
SUFFIX, BRAND, ACCOUNT, LEAST = "AI生成", "小红书", "小红书号[0-9]{3,}", 0.45
_SHOWN = {"GEMINI": "Gemini"}
_ACCOUNT = regex.compile(ACCOUNT)
_OTHER = regex.compile(r"[\s\ufeff\p{P}\p{S}]+")


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def normal_form(text: str | None) -> str:
    """NFKC in upper case without white space, punctuation and symbols."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text or "").upper())


def kind_of(text: str | None) -> str | None:
    """Whose mark a text is: an account's, a platform's name standing alone, or of generated content; else nobody's."""
    t = normal_form(text)
    if _ACCOUNT.search(t):
        return BRAND
    for name in NAMES:
        if t.startswith(name) and t[len(name) :] in ("", "AI", "生成", SUFFIX):
            return _SHOWN.get(name, name)
    return SUFFIX if SUFFIX in t else None


def bounds_of(poly: list[list[float]] | None) -> tuple[float, float, float, float] | None:
    """left, top, right, bottom; none without points or with one that is not finite."""
    if not poly or not all(p is not None and len(p) > 1 and all(c is not None and math.isfinite(c) for c in p[:2]) for p in poly):
        return None
    xs, ys = ([p[k] for p in poly] for k in (0, 1))
    return min(xs), min(ys), max(xs), max(ys)


def on_one_line(a: tuple, b: tuple) -> bool:
    height = max(a[3] - a[1], b[3] - b[1])
    apart = max(a[0] - b[2], b[0] - a[2], 0)
    return abs((a[1] + a[3] - b[1] - b[3]) / 2) <= height * 0.55 and apart <= height * 2.5


def lines_of(items: list[dict]) -> list[tuple[tuple, list[tuple[tuple, str]]]]:
    """Greedy first fit in input order: a line is its box and its items (box, text); the box grows with them."""
    lines: list[tuple[tuple, list]] = []
    for item in items or []:
        score, box = item.get("score"), bounds_of(item.get("poly"))
        if not item.get("text") or score is None or not math.isfinite(score) or score < LEAST or box is None:
            continue
        own = next((k for k, (line, _) in enumerate(lines) if on_one_line(line, box)), None)
        if own is None:
            lines.append((box, [(box, item["text"])]))
        else:
            line, members = lines[own]
            grown = (min(line[0], box[0]), min(line[1], box[1]), max(line[2], box[2]), max(line[3], box[3]))
            lines[own] = (grown, [*members, (box, item["text"])])
    return lines


def regions_of(items: list[dict], at_x: float, at_y: float, width: int, height: int) -> list[dict]:
    """Regions of the lines that are marks, in the image of width x height at whose (at_x, at_y) the items were read."""
    lines, out = lines_of(items), []
    as_read = ["".join(t for _, t in members) for _, members in lines]
    in_order = ["".join(t for _, t in sorted(members, key=lambda m: m[0][0])) for _, members in lines]
    for k, (line, _) in enumerate(lines):
        kind = kind_of(in_order[k])
        if kind is None:
            continue
        left, top, right, bottom = line
        tall = bottom - top
        if kind == BRAND:  # the badge can stand above the account's line
            for j, (other, _) in enumerate(lines):
                text = in_order[j] if j < k else as_read[j]
                if j != k and normal_form(text) == BRAND and other[3] <= line[1] and line[1] - other[3] <= 2 * tall and other[2] >= line[0] - 2 * tall:
                    left, top, right, bottom = min(left, other[0]), min(top, other[1]), max(right, other[2]), max(bottom, other[3])
                    break
        tall = max(1, tall)
        before = tall * 3.5 if normal_form(in_order[k]) == SUFFIX else 0  # room for a name that was not read
        pad = max(3, half_up(tall * 0.35))
        x, y = max(0, math.floor(at_x + left - pad - before)), max(0, math.floor(at_y + top - pad))
        x1, y1 = min(width, math.ceil(at_x + right + pad)), min(height, math.ceil(at_y + bottom + pad))
        if x1 <= x or y1 <= y or x1 - x > width * 0.5 or y1 - y > height * 0.2:
            continue
        out.append({"provider": kind, "text": in_order[k], "x": x, "y": y, "width": x1 - x, "height": y1 - y, "context": max(64, half_up(tall * 3)), "padding": max(2, half_up(tall * 0.15))})
    return out
