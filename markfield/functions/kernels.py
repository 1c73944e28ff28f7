"""Image kernels on whole arrays (height x width), for operators that work on one image a row.  Rounding is half up."""

from __future__ import annotations

import base64
import math
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def half_up(x):
    return np.floor(np.asarray(x, np.float64) + 0.5)


def mirrored(n: int, at: np.ndarray) -> np.ndarray:
    """Places mirrored at the borders without repeating the edge: a triangle wave."""
    if n == 1:
        return np.zeros_like(at)
    wave = np.mod(at, 2 * n - 2)
    return np.where(wave >= n, 2 * n - 2 - wave, wave)


def taps(sigma: float) -> np.ndarray:
    """A Gaussian of 8 sigma + 1 taps, made odd upwards."""
    r = max(3, math.floor(8 * sigma + 1.5) | 1) // 2
    w = np.exp(-np.square(np.arange(-r, r + 1)) / (2 * sigma * sigma))
    return w / w.sum()


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    w = taps(max(0.1, sigma))
    r = len(w) // 2
    for axis in (1, 0):
        n = a.shape[axis]
        a = sum(x * np.take(a, mirrored(n, np.arange(n) + k - r), axis) for k, x in enumerate(w))
    return a


def gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, w = a.shape
    p = np.pad(a.astype(np.float64), [(1, 1), (1, 1)], "reflect" if min(h, w) > 1 else "edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def edge_l1(a: np.ndarray) -> np.ndarray:
    gx, gy = gradients(a)
    return np.abs(gx) + np.abs(gy)


def edge_magnitude(a: np.ndarray) -> np.ndarray:
    return np.hypot(*gradients(a))


def ridges(gray: np.ndarray) -> np.ndarray:
    """L1 gradient where it is a ridge in one of four directions, else 0; 0 on the borders."""
    gx, gy = gradients(gray)
    m, ax, ay = np.abs(gx) + np.abs(gy), np.abs(gx), np.abs(gy)
    if min(m.shape) < 3:
        return np.zeros_like(m)
    inner = (slice(1, -1), slice(1, -1))
    shifted = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    level, upright, falling = ay <= 0.4142 * ax, ay >= 2.4142 * ax, gx * gy > 0
    most = np.select(
        [level[inner], upright[inner], falling[inner]],
        [np.maximum(shifted(0, -1), shifted(0, 1)), np.maximum(shifted(-1, 0), shifted(1, 0)), np.maximum(shifted(-1, -1), shifted(1, 1))],
        np.maximum(shifted(-1, 1), shifted(1, -1)),
    )
    thin = np.zeros_like(m)
    thin[inner] = np.where(m[inner] >= most, m[inner], 0)
    return thin


def grown(seeds: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """The seeds and the weak places that are connected with one; neither on a border."""
    out, weak, width = seeds.ravel().copy(), weak.ravel(), seeds.shape[1]  # neighbours are places of the flat image
    around = np.array([-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1])
    front = np.flatnonzero(out)
    while len(front):
        near = np.unique((front[:, None] + around).ravel())
        front = near[weak[near] & ~out[near]]
        out[front] = True
    return out.reshape(seeds.shape)


def canny(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Boolean edges: ridges of the gradient in four directions, seeds at `high` grown over neighbours at `low`."""
    thin = ridges(gray)
    return grown(thin >= high, thin >= max(low, 1e-12))


def canny_corner(part: Callable[[int, int], np.ndarray], y: int, x: int, low: float, high: float, room: int = 48) -> np.ndarray:
    """canny(whole, low, high)[y:, x:], where part(y0, x0) is whole[y0:, x0:].  Edges are grown in the corner and `room`
    around it; where weak places lead from there into the corner, which an edge from further away could take, more is read."""
    while True:
        y0, x0 = max(0, y - room), max(0, x - room)
        thin = ridges(part(y0, x0))
        if y0:  # places whose neighbours are not all there
            thin[:2] = 0
        if x0:
            thin[:, :2] = 0
        weak = thin >= max(low, 1e-12)
        out = grown(thin >= high, weak)
        entry = np.zeros_like(weak)
        if y0:
            entry[2] = weak[2] & ~out[2]
        if x0:
            entry[:, 2] = weak[:, 2] & ~out[:, 2]
        if not entry.any() or not grown(entry, weak & ~out)[y - y0 :, x - x0 :].any():
            return out[y - y0 :, x - x0 :]
        room *= 4


def widened(mask: np.ndarray, width: int) -> np.ndarray:
    """Square maximum of an odd width, nothing beyond the borders."""
    r = (width - 1) // 2
    for axis in (0, 1):
        padded = np.pad(mask, [(r, r) if k == axis else (0, 0) for k in (0, 1)])
        mask = np.lib.stride_tricks.sliding_window_view(padded, 2 * r + 1, axis).any(-1)
    return mask


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return half_up(rgb[..., :3] @ np.array([0.299, 0.587, 0.114]))


def luma_of(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3] @ np.array([0.2126, 0.7152, 0.0722]) / 255


def hsv_of(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in half degrees, saturation and value in 0..255."""
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    top, low = rgb[..., :3].max(-1).astype(np.float64), rgb[..., :3].min(-1).astype(np.float64)
    d = np.where(top == low, 1, top - low)
    hue = 60 * np.select([top == low, top == r, top == g], [0, (g - b) / d, (b - r) / d + 2], (r - g) / d + 4)
    return half_up(np.where(hue < 0, hue + 360, hue) / 2), half_up((top - low) / np.maximum(top, 1) * 255), top


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a.ravel().astype(np.float64) - a.mean(), b.ravel().astype(np.float64) - b.mean()
    xx, yy = float(x @ x), float(y @ y)
    return float(x @ y) / math.sqrt(xx * yy) if xx > 0 and yy > 0 else 0.0


def slide(search: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of products of a kernel at every offset, a row of offsets at a time."""
    view = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(search, np.float64), kernel.shape)
    flat = kernel.astype(np.float64).ravel()
    return np.stack([row.reshape(len(row), -1) @ flat for row in view])


def slide_fft(search: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """As slide, to rounding, by Fourier transforms."""
    shape = tuple(1 << (n - 1).bit_length() for n in search.shape)
    out = np.fft.irfft2(np.fft.rfft2(search, shape) * np.conj(np.fft.rfft2(kernel, shape)), shape)
    return out[: search.shape[0] - kernel.shape[0] + 1, : search.shape[1] - kernel.shape[1] + 1]


def box_sums(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sum over a box of that shape at every offset."""
    c = np.pad(a.astype(np.float64), [(1, 0), (1, 0)]).cumsum(0).cumsum(1)
    h, w = shape
    return c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w]


def first_best(score: np.ndarray) -> tuple[float, int, int]:
    """Greatest value, x and y of its first place by rows."""
    y, x = np.unravel_index(int(np.argmax(score)), score.shape)
    return float(score[y, x]), int(x), int(y)


def ncc(search: np.ndarray, template: np.ndarray) -> tuple[float, int, int]:
    """Best normalised correlation, x, y over the offsets where both sides vary; 0 at the origin where none does."""
    t = template.astype(np.float64) - template.mean()
    norm, n = math.sqrt(float((t * t).sum())), t.size
    total, squares = box_sums(search, t.shape), box_sums(np.square(search.astype(np.float64)), t.shape)
    spread = squares - total * total / n
    ok = spread > max(1e-10, 1e-13 * float(np.square(search.astype(np.float64)).sum()))  # beyond rounding
    if norm <= 1e-10 or not ok.any():
        return 0.0, 0, 0
    by = np.sqrt(np.where(ok, spread, 1)) * norm
    if ok.size * n <= 1 << 20:
        return first_best(np.where(ok, slide(search, t) / by, -np.inf))
    near = np.where(ok, slide_fft(search, t) / by, -np.inf)  # places beside the best one are summed up as above
    score = np.full(ok.shape, -np.inf)
    for y, x in np.argwhere(near >= near.max() - 1e-7):
        score[y, x] = search[y : y + t.shape[0], x : x + t.shape[1]].astype(np.float64).ravel() @ t.ravel() / by[y, x]
    return first_best(score)


def resize_nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    ys, xs = (np.minimum(n - 1, np.floor(np.arange(m) * (n / m)).astype(int)) for n, m in zip(a.shape, (height, width), strict=True))
    return a[np.ix_(ys, xs)]


@lru_cache(64)
def _shares(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n cells lies in each of m equal parts."""
    lo, hi, cell = np.arange(m)[:, None] * n / m, np.minimum(n, (np.arange(m)[:, None] + 1) * n / m), np.arange(n)
    return np.maximum(0, np.minimum(cell + 1, hi) - np.maximum(cell, lo))


@lru_cache(64)
def _between(n: int, m: int) -> np.ndarray:
    """(m, n): weights of linear interpolation between cell centres."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - (at - low))
    np.add.at(out, (np.arange(m), np.minimum(n - 1, low + 1)), at - low)
    return out


def resize_area(a: np.ndarray, height: int, width: int, y0: int = 0, x0: int = 0) -> np.ndarray:
    """Means over areas; interpolation where a side does not shrink.  From row y0 and column x0 of the result on."""
    if width >= a.shape[1] or height >= a.shape[0]:
        return _between(a.shape[0], height)[y0:] @ a @ _between(a.shape[1], width)[x0:].T
    y, x = _shares(a.shape[0], height)[y0:], _shares(a.shape[1], width)[x0:]
    return (y / y.sum(1, keepdims=True)) @ a @ (x / x.sum(1, keepdims=True)).T


def odd_width(value: float) -> int:
    return max(3, int(half_up(value))) // 2 * 2 + 1


def contrast_kernel(mask: np.ndarray, ring: int) -> np.ndarray:
    """+1/N on the mask, -1/M on its ring of the given width."""
    inside = mask > 0
    around = widened(inside, ring) & ~inside
    return inside / max(1, inside.sum()) - around / max(1, around.sum())


def clahe(gray: np.ndarray, tile: int = 64, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation, blended between the four tiles around a pixel."""
    h, w = gray.shape
    ny, nx = (max(1, min(8, int(half_up(n / tile)))) for n in (h, w))
    level = gray.astype(int)
    tables = np.zeros((ny, nx, 256))
    for y in range(ny):
        for x in range(nx):
            part = level[y * h // ny : (y + 1) * h // ny, x * w // nx : (x + 1) * w // nx]
            cap = max(1, int(half_up(clip * part.size / 256)))
            counts = np.bincount(part.ravel(), minlength=256)
            over = int(np.maximum(counts - cap, 0).sum())
            counts = np.minimum(counts, cap) + over // 256
            if rest := over % 256:
                counts += np.bincount(np.arange(rest) * 256 // rest, minlength=256)
            tables[y, x] = np.minimum(255, half_up(np.cumsum(counts) * 255 / part.size))

    def sides(n: int, tiles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) * tiles / n - 0.5
        low = np.clip(np.floor(at), 0, tiles - 1).astype(int)
        return low, np.minimum(tiles - 1, low + 1), np.clip(at - low, 0, 1)

    (y0, y1, wy), (x0, x1, wx) = sides(h, ny), sides(w, nx)
    mapped = lambda ys, xs: tables[ys[:, None], xs[None, :], level]
    top = mapped(y0, x0) * (1 - wx) + mapped(y0, x1) * wx
    low = mapped(y1, x0) * (1 - wx) + mapped(y1, x1) * wx
    return half_up(np.round(top * (1 - wy)[:, None] + low * wy[:, None], 9))


def decode_mask(bits: str, height: int, width: int) -> np.ndarray:
    """A mask from base64 of deflated bits, most significant first; another length than the shape's is an error."""
    raw = zlib.decompress(base64.b64decode(bits))
    if len(raw) != (height * width + 7) // 8:
        raise ValueError(f"{len(raw)} bytes for a mask of {height} x {width}")
    return np.unpackbits(np.frombuffer(raw, np.uint8))[: height * width].reshape(height, width) * np.uint8(255)


def encode_mask(mask: np.ndarray) -> str:
    return base64.b64encode(zlib.compress(np.packbits(mask > 0).tobytes())).decode()


def decode_shares(text: str, size: int) -> np.ndarray:
    """A square template of shares from base64 of bytes."""
    raw = base64.b64decode(text)
    if len(raw) != size * size:
        raise ValueError(f"{len(raw)} bytes for a template of {size} x {size}")
    return np.frombuffer(raw, np.uint8).reshape(size, size) / 255


def share_bytes(template: np.ndarray) -> bytes:
    return half_up(template * 255).astype(np.uint8).tobytes()


_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG of 8 bits a channel without interlace or palette."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in _CHANNELS:
        raise ValueError("8 bits a channel, no palette, no interlace")
    n = _CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    before = np.zeros(width * n, np.int64)
    for y, row in enumerate(rows):
        filter_, line = int(row[0]), row[1:].astype(np.int64)
        if filter_ == 1:
            line = np.cumsum(line.reshape(-1, n), 0).ravel()
        elif filter_ == 2:
            line = line + before
        elif filter_ in (3, 4):
            for x in range(len(line)):
                a, b, c = (line[x - n] if x >= n else 0), before[x], (before[x - n] if x >= n else 0)
                if filter_ == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                line[x] = (line[x] + guess) & 255
        before = line & 255
        out[y] = before
    return out.reshape(height, width, n)


def encode_png(a: np.ndarray) -> bytes:
    """A PNG of (height, width) or (height, width, channels) bytes."""
    a = a if a.ndim == 3 else a[..., None]
    height, width, n = a.shape
    colour = {c: k for k, c in _CHANNELS.items()}[n]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), a.astype(np.uint8).reshape(height, width * n)], 1)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
