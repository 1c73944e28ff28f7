"""Kernels against plain loops and against the SQL forms; detectors on planted marks; failures stay with their image."""

import math

import numpy as np
import pytest
from conftest import SMALL

from markfield.functions import detectors as det
from markfield.functions import kernels as k
from markfield.operators import detectors as op
from markfield.plans import catalogue

RNG = np.random.default_rng(1)


def mirror(i, n):
    while n > 1 and (i < 0 or i >= n):
        i = -i if i < 0 else 2 * n - 2 - i
    return i if n > 1 else 0


def loops(a, weights):
    """Sum of weights[dy, dx] times the neighbour, mirrored."""
    h, w = a.shape
    return np.array([[sum(v * a[mirror(y + dy, h), mirror(x + dx, w)] for (dy, dx), v in weights.items()) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (5, 4), (9, 12)])
def test_neighbourhoods(shape):
    a = RNG.integers(0, 256, shape).astype(float)
    assert [int(i) for i in k.mirrored(5, np.arange(-20, 25))] == [mirror(i, 5) for i in range(-20, 25)]
    for sigma in (0.1, 1.0, 1.6, 2.4):
        size = max(3, math.floor(8 * sigma + 1.5) | 1)
        w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
        w = [x / sum(w) for x in w]
        want = loops(loops(a, {(0, i - size // 2): x for i, x in enumerate(w)}), {(i - size // 2, 0): x for i, x in enumerate(w)})
        assert np.allclose(k.blur(a, sigma), want)
    if min(shape) > 1:
        gx = loops(a, {(dy, dx): dx * (2 - abs(dy)) for dy in (-1, 0, 1) for dx in (-1, 1)})
        gy = loops(a, {(dy, dx): dy * (2 - abs(dx)) for dx in (-1, 0, 1) for dy in (-1, 1)})
        assert np.allclose(k.edge_l1(a), np.abs(gx) + np.abs(gy)) and np.allclose(k.edge_magnitude(a), np.hypot(gx, gy))


def test_search():
    a, t = RNG.integers(0, 9, (12, 15)).astype(float), RNG.integers(0, 9, (4, 5)).astype(float)
    a[:6, :8] = 3
    places = [(y, x) for y in range(9) for x in range(11)]
    sums = {p: float((a[p[0] : p[0] + 4, p[1] : p[1] + 5] * t).sum()) for p in places}
    assert np.allclose(k.slide(a, t).ravel(), list(sums.values()))
    scores = {p: k.pearson(a[p[0] : p[0] + 4, p[1] : p[1] + 5], t) for p in places if np.ptp(a[p[0] : p[0] + 4, p[1] : p[1] + 5])}
    (y, x), best = max(scores.items(), key=lambda s: round(s[1], 12))
    assert np.allclose(k.ncc(a, t)[0], best) and k.ncc(a, t)[1:] == (x, y)
    assert k.ncc(np.ones((6, 6)), t) == (0.0, 0, 0) and k.ncc(a, np.ones((4, 5))) == (0.0, 0, 0)


def test_resampling():
    a = RNG.integers(0, 256, (10, 14)).astype(float)
    near = k.resize_nearest(a, 4, 5)
    assert all(near[y, x] == a[math.floor(y * 2.5), math.floor(x * 2.8)] for y in range(4) for x in range(5))
    fine = np.kron(a, np.ones((4, 5)))  # each part of the result is whole cells of this
    assert np.allclose(k.resize_area(a, 4, 5), fine.reshape(4, 10, 5, 14).mean((1, 3)))
    assert np.allclose(k.resize_area(a, 20, 28)[:, 0][[0, -1]], a[[0, -1], 0])


def test_canny_and_masks():
    a = RNG.integers(0, 256, (20, 24)).astype(float)
    gx, gy = k.gradients(a)
    m = np.abs(gx) + np.abs(gy)
    thin = np.zeros_like(m)
    for y in range(1, 19):
        for x in range(1, 23):
            ax, ay = abs(gx[y, x]), abs(gy[y, x])
            d = (0, 1) if ay <= 0.4142 * ax else (1, 0) if ay >= 2.4142 * ax else (1, 1) if gx[y, x] * gy[y, x] > 0 else (-1, 1)
            if m[y, x] >= max(m[y + d[0], x + d[1]], m[y - d[0], x - d[1]]):
                thin[y, x] = m[y, x]
    for low, high in ((200, 600), (40, 120), (1, 900)):
        seen, todo = set(), [tuple(p) for p in np.argwhere(thin >= high)]
        while todo:
            y, x = todo.pop()
            if (y, x) in seen:
                continue
            seen.add((y, x))
            todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if thin[y + dy, x + dx] >= low and thin[y + dy, x + dx] > 0]
        assert {tuple(p) for p in np.argwhere(k.canny(a, low, high))} == seen
    mask = a > 250
    for width in (3, 5):
        r = width // 2
        want = np.array([[mask[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].any() for x in range(24)] for y in range(20)])
        assert (k.widened(mask, width) == want).all()
    kernel = k.contrast_kernel(mask, 3)
    assert np.isclose(kernel[mask].sum(), 1) and np.isclose(kernel[~mask].sum(), -1)
    assert (k.decode_mask(k.encode_mask(mask), 20, 24) == mask * 255).all()
    with pytest.raises(ValueError):
        k.decode_mask(k.encode_mask(mask), 21, 24)


def test_clahe_brings_out_faint_marks():
    y, x = np.mgrid[:128, :128]
    faint = 100 + x // 8 + np.where((y >= 50) & (y < 62) & (x >= 30) & (x < 100), 5, 0)
    out = k.clahe(faint)
    assert faint[55, 40] - faint[45, 40] == 5 and out[55, 40] - out[45, 40] > 5


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    a = RNG.integers(0, 256, (9, 11, channels)).astype(np.uint8)
    assert (k.decode_png(k.encode_png(a)) == a).all()
    # Rows with each kind of filter decode to the same.
    import struct
    import zlib

    n, rows = channels, []
    for y, row in enumerate(a.reshape(9, -1).astype(int)):
        up = a.reshape(9, -1).astype(int)[y - 1] if y else np.zeros_like(row)
        left, corner = (np.concatenate([np.zeros(n, int), r[:-n]]) for r in (row, up))
        paeth = [min((abs(p - l), 0, l), (abs(p - u), 1, u), (abs(p - c), 2, c))[2] for l, u, c in zip(left, up, corner, strict=True) for p in [l + u - c]]
        guess = [0, left, up, (left + up) // 2, np.array(paeth)][y % 5]
        rows.append(bytes([y % 5]) + bytes(((row - guess) & 255).astype(np.uint8)))
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 11, 9, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (k.decode_png(data) == a).all()
    with pytest.raises(ValueError):
        k.decode_png(data.replace(b"IDAT", b"IDAX", 1))


def planes(spark):
    """The 8 x 8 images that the SQL operators see."""
    return {r.vec_id: k.half_up((np.array(r.embedding).reshape(8, 8) + 1) * 127.5) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}


@pytest.mark.parametrize(("name", "column", "f"), [
    ("gaussian_blur", "g", lambda a: k.blur(a, 1.0)),
    ("sobel_l1", "edge", k.edge_l1),
    ("edge_magnitude", "edge", k.edge_magnitude),
    ("clahe", "g", lambda a: k.clahe(a, tile=4)),
    ("dilate_square", "mask", lambda a: k.widened(a > 150, 3) * 255),
])
def test_same_as_the_sql_form(spark, name, column, f):
    told = {i: f(a) for i, a in planes(spark).items()}
    rows = catalogue.QUERIES[name](spark, SMALL).collect()
    assert len(rows) == 64 * len(told)
    assert all(abs(r[column] - told[r.img][r.y, r.x]) < 2e-5 for r in rows)


def test_canny_and_features_are_those_of_the_sql_form(spark):
    from markfield.operators.pixels import HIGH, LOW

    images = planes(spark)
    got = {(r.img, r.y, r.x) for r in catalogue.QUERIES["canny"](spark, SMALL).collect()}
    assert got == {(i, int(y), int(x)) for i, a in images.items() for y, x in np.argwhere(k.canny(a, LOW, HIGH))}
    for r in catalogue.QUERIES["stroke_features"](spark, SMALL).collect():
        rgb = np.stack([images[3 * r.img + c] for c in range(3)], -1)
        gray = k.gray_of(rgb)
        out = gray - k.blur(gray, 1.2) > 2.5
        _, s, v = k.hsv_of(rgb)
        assert abs(r.density - (out & (s < 80) & (v > 120)).mean()) < 1e-6 and abs(r.columns - out.any(0).mean()) < 1e-6


TEMPLATES = op.sample_templates()


def image_with(which, seed=0):
    a = k.resize_area(70 + 40 * np.random.default_rng(seed).uniform(-1, 1, (8, 8)), op.HEIGHT, op.WIDTH)
    return det.Image(np.repeat(k.half_up(op.stamped(a, which, TEMPLATES)).astype(np.uint8)[..., None], 3, -1))


@pytest.mark.parametrize("which", range(len(det.MARKS) + 2))
def test_planted_marks(which):
    for seed in range(4):
        image = image_with(which, seed)
        found = {n for n, f in {**det.DETECTORS, "gemini": det.gemini}.items() if n != "xiaohongshu" and f(image, TEMPLATES)["found"]}
        assert found == {*[m.name for m in det.MARKS], "gemini"} & {[*[m.name for m in det.MARKS], "gemini", "none"][which]}
    regions = det.detect(image, TEMPLATES)
    assert all(det.overlap(a, b) < det.OVERLAP for a in regions for b in regions if a is not b)


def test_doubao_and_label():
    scale = 600 / 1600
    a = k.resize_area(90 + 20 * np.random.default_rng(3).uniform(-1, 1, (8, 8)), 600, 800)
    small = k.resize_area(TEMPLATES["doubao"].astype(float), det.whole(55 * scale), det.whole(251 * scale))
    y, x = 600 - det.whole(32 * scale) - small.shape[0], 800 - det.whole(27 * scale) - small.shape[1]
    a[y : y + small.shape[0], x : x + small.shape[1]] += small * 0.4
    image = det.Image(np.repeat(k.half_up(np.clip(a, 0, 255)).astype(np.uint8)[..., None], 3, -1))
    hit = det.doubao(image, TEMPLATES)
    assert hit["found"] and hit["variant"] == "classic" and abs(hit["x"] - x) <= 1 and abs(hit["y"] - y) <= 1
    assert not det.doubao(image_with(9), TEMPLATES)["found"]
    b = np.full((960, 1280), 200.0)
    label = TEMPLATES["xiaohongshu"].astype(float)
    b[960 - 47 : 960 - 47 + 25, 1280 - 253 : 1280 - 253 + 99] -= label * 0.7
    hit = det.xiaohongshu(det.Image(np.repeat(b.astype(np.uint8)[..., None], 3, -1)), TEMPLATES)
    assert hit["found"] and hit["variant"] == "legacy" and hit["x"] == 1280 - 253 - 5


def test_failures_stay_with_their_image(spark):
    rows = catalogue.QUERIES["detect_yuanbao"](spark, SMALL).collect()
    n = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    assert len(rows) == n and {r.img % 31 == 30 for r in rows if r.error} == {True} and all(r.error for r in rows if r.img % 31 == 30)
    assert {r.img // 3 % 7 for r in rows if r.found} == {det.MARKS.index(next(m for m in det.MARKS if m.name == "yuanbao"))}
    files = catalogue.QUERIES["decode_file"](spark, SMALL).collect()
    assert all(r.same_again for r in files if not r.error) and sum(r.error is not None for r in files) == n // 31
    masks = {r.name: r for r in catalogue.QUERIES["decode_mask"](spark, SMALL).collect()}
    assert masks["short"].error and all(not r.error and r.foreground for name, r in masks.items() if name != "short")


def test_a_batch_is_handled_image_by_image(spark):
    images = op.sample_images(spark, SMALL).where("img < 100")
    own = {r.img: bytes(r.content) for r in images.collect()}
    rows = {r.img: r for r in op.run_batch(images, TEMPLATES).collect()}
    assert set(rows) == set(own)
    for i, r in rows.items():
        assert r.status == ("failed" if i % 31 == 30 else "done" if r.regions else "unchanged")
        assert (r.content is not None and bytes(r.content) == own[i]) == (r.status == "unchanged") and (r.error is None) == (r.status != "failed")
    assert {r.status for r in rows.values()} == {"done", "unchanged", "failed"}


def test_templates_have_a_bound(spark):
    with pytest.raises(ValueError):
        op.regions(op.sample_images(spark, SMALL), {"large": np.zeros(3 << 20)})


def test_canny_of_a_corner():
    for shape, low, high in (((90, 120), 40, 120), ((200, 150), 1, 900), ((64, 64), 200, 300)):
        a = k.half_up(k.resize_area(RNG.uniform(0, 255, (9, 11)), *shape)) + RNG.integers(0, 12, shape)
        a[5:-5, 5] += 250  # a long edge that comes from outside
        a[-6, 5:-5] += 120
        for y, x in ((0, 0), (40, 30), (60, 1), (63, 63)):
            got = k.canny_corner(lambda y0, x0, a=a: a[y0:, x0:], y, x, low, high, room=4)
            assert (got == k.canny(a, low, high)[y:, x:]).all()


def test_large_search_is_the_small_one():
    a, t = RNG.integers(0, 2, (80, 120)) * 255.0, RNG.integers(0, 2, (40, 60)) * 255
    a[20:60, 31:91] = np.where(RNG.uniform(size=t.shape) < 0.7, t, a[20:60, 31:91])
    score = k.slide(a, t - t.mean())
    places = [(y, x) for y in range(score.shape[0]) for x in range(score.shape[1])]
    want = max(places, key=lambda p: round(k.pearson(a[p[0] : p[0] + 40, p[1] : p[1] + 60], t), 12))
    assert score.size * t.size > 1 << 20 and k.ncc(a, t)[:0:-1] == want == (20, 31)
    assert k.ncc(np.full((80, 120), 7.0), t) == (0.0, 0, 0)


def plain_gemini(image):
    """Every layout and offset, one after another."""
    best, luma = None, k.luma_of(image.rgb)
    for size, margin, radius, step in det.LAYOUTS:
        x, y = image.width - margin - size, image.height - margin - size
        if size >= image.short or x < 0 or y < 0:
            continue
        t = TEMPLATES[f"gemini_{size}"]
        for px in range(x - radius, x + radius + 1, step):
            for py in range(y - radius, y + radius + 1, step):
                if px >= 0 and py >= 0 and px + size <= image.width and py + size <= image.height:
                    patch = luma[py : py + size, px : px + size]
                    s, g = k.pearson(patch, t), k.pearson(k.edge_magnitude(patch), k.edge_magnitude(t))
                    score = s + 0.8 * max(0.0, g)
                    rank = (det.gemini_holds(size, margin, score, s, g), score)
                    if best is None or rank > best[0]:
                        best = rank, px, py, size, s, g
    return best


def test_gemini_over_all_offsets(monkeypatch):
    noise = det.Image(RNG.integers(0, 256, (160, 200, 3)).astype(np.uint8))
    flat = det.Image(np.full((160, 170, 3), 90, np.uint8))
    for image in (image_with(5, 1), image_with(6, 2), image_with(0, 3), noise, flat):
        (holds, score), px, py, size, s, g = plain_gemini(image)
        got = det.gemini(image, TEMPLATES)
        assert (got["found"], got["x"], got["y"], got["size"], got["score"], got["spatial"], got["gradient"]) == (holds, px, py, size, score, s, g)
    calls, real = [], k.edge_magnitude
    monkeypatch.setattr(k, "edge_magnitude", lambda a: calls.append(1) or real(a))
    det.gemini(image_with(5, 1), TEMPLATES)
    assert len(calls) < 40  # two for each of 459 offsets before


def test_one_file_of_vectors_is_dealt_over_tasks(spark):
    images = op.sample_images(spark, SMALL)
    assert images.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
