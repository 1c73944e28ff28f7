"""Detection of marks over a relation of images, one image a row, in batches.

An image is (img, width, height, content): content is a PNG, or width x height x 3 bytes.  Templates are the caller's,
small and checked for their size, and travel with the task.  An image that cannot be read gives a row with the error; the
others of its batch are not touched.

The queries' images are made from `embeddings`: an 8 x 8 image as a soft background with a mark laid over some of them;
their templates are made by a rule."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.functions import detectors as det
from markfield.functions import kernels as k

#: Bytes of all templates of a call.
MOST = 16 << 20
FIELDS = {
    "provider": pa.string(), "variant": pa.string(), "found": pa.bool_(), "x": pa.int64(), "y": pa.int64(), "width": pa.int64(), "height": pa.int64(), "context": pa.int64(),
    "confidence": pa.float64(), "contrast": pa.float64(), "shape": pa.float64(), "score": pa.float64(), "mask_pixels": pa.int64(),
}
SCHEMA = "img long, at int, provider string, variant string, found boolean, x long, y long, width long, height long, context long, confidence double, contrast double, shape double, score double, mask_pixels long, error string"


def read_image(content: bytes, width: int | None, height: int | None) -> det.Image:
    if content is None:
        raise ValueError("no content")
    if content[:8] == k._SIGNATURE:
        rgb = k.decode_png(content)
        return det.Image(np.repeat(rgb[..., :1], 3, -1) if rgb.shape[-1] < 3 else rgb)
    return det.Image(np.frombuffer(content, np.uint8).reshape(height, width, 3))


def told(result: dict) -> dict:
    mask = result.get("mask")
    row = {f: result.get(f) for f in FIELDS} | {"mask_pixels": None if mask is None else int(np.count_nonzero(mask))}
    row["variant"] = result.get("variant") or result.get("name") or result.get("status")
    return {f: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for f, v in row.items()}


def each_image(images: DataFrame, templates: det.Templates, f: Callable[[det.Image, det.Templates], list[dict]]) -> DataFrame:
    """img, at (0 ..) and the fields of every result of f; one row with the error for an image that fails."""
    if sum(t.nbytes for t in templates.values()) > MOST:
        raise ValueError(f"templates of over {MOST} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for img, width, height, content in zip(*(b[c].to_pylist() for c in ("img", "width", "height", "content")), strict=True):
                try:
                    rows += [{"img": img, "at": at, **told(r), "error": None} for at, r in enumerate(f(read_image(content, width, height), templates))]
                except Exception as e:  # noqa: BLE001  an image's failure stays its own
                    rows.append({"img": img, "at": 0, "error": f"{type(e).__name__}: {e}"})
            kinds = {"img": pa.int64(), "at": pa.int32(), **FIELDS, "error": pa.string()}
            yield pa.record_batch([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], list(kinds))

    return images.select("img", "width", "height", "content").mapInArrow(run, SCHEMA)


def detected(images: DataFrame, templates: det.Templates, name: str) -> DataFrame:
    """One detector's result for every image, found or not."""
    single = {**det.DETECTORS, "gemini": det.gemini_decision}[name]
    return each_image(images, templates, lambda image, t: [single(image, t)])


def regions(images: DataFrame, templates: det.Templates) -> DataFrame:
    """The regions of all detectors and of gemini."""
    return each_image(images, templates, lambda image, t: det.detect_all(image, t))


def scores(images: DataFrame, templates: det.Templates) -> DataFrame:
    """Every detector's scores for every image, found or not."""
    return each_image(images, templates, lambda image, t: [f(image, t) for f in (*det.DETECTORS.values(), det.gemini)])


def outlined(image: det.Image, found: list[dict]) -> bytes:
    """The image as a PNG with its regions framed, for review."""
    rgb = image.rgb.copy()
    for r in found:
        x, y, x1, y1 = r["x"], r["y"], r["x"] + r["width"] - 1, r["y"] + r["height"] - 1
        rgb[[y, y1], x : x1 + 1] = (255, 0, 0)
        rgb[y : y1 + 1, [x, x1]] = (255, 0, 0)
    return k.encode_png(rgb)


def run_batch(images: DataFrame, templates: det.Templates, handle: Callable[[det.Image, list[dict]], bytes] = outlined) -> DataFrame:
    """img, status, regions, providers, content, error of every image: done with what `handle` makes of its regions, unchanged
    with its own bytes where there is none, failed with the error that the user sees.  A failure is its image's alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for img, width, height, content in zip(*(b[c].to_pylist() for c in ("img", "width", "height", "content")), strict=True):
                try:
                    image = read_image(content, width, height)
                    found = det.detect_all(image, templates)
                    names = "、".join(dict.fromkeys(r["provider"] for r in found))
                    rows.append((img, "done" if found else "unchanged", len(found), names, handle(image, found) if found else content, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((img, "failed", 0, "", None, f"{type(e).__name__}: {e}"))
            kinds = {"img": pa.int64(), "status": pa.string(), "regions": pa.int64(), "providers": pa.string(), "content": pa.binary(), "error": pa.string()}
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds.values())], list(kinds))

    return images.select("img", "width", "height", "content").mapInArrow(run, "img long, status string, regions long, providers string, content binary, error string")


# Images and templates of the queries.

WIDTH, HEIGHT = 200, 160


def sample_template(height: int, width: int, seed: int, smooth: bool = False) -> np.ndarray:
    """Glyph-like strokes by a rule: columns and bars of a few pixels, as the seed has them."""
    rng = np.random.default_rng(seed)
    a = np.zeros((height, width))
    for x in range(2, width - 6, max(6, width // 14)):
        for _ in range(3):
            y, w, h = rng.integers(1, max(2, height - 4)), rng.integers(2, max(3, width // 16)), rng.integers(2, max(3, height // 2))
            a[y : y + h, x : x + w] = 255
    return k.blur(a, 1.0) if smooth else a


def sample_templates() -> det.Templates:
    size = {m.name: m.size for m in det.MARKS} | {"jimeng_top": det.JIMENG_TOP[:2], "doubao": det.DOUBAO_SIZE[:2], "doubao_v2": det.DOUBAO_SIZE[:2], "xiaohongshu": det.LABEL_SIZE[:2], "xiaohongshu_badge": det.BADGE_SIZE[:2]}
    made = {n: sample_template(h, w, i, n in ("doubao", "xiaohongshu")).astype(np.float32) for i, (n, (w, h)) in enumerate(size.items())}
    return made | {f"gemini_{n}": (k.blur(sample_template(n, n, n), 2.0) / 510).astype(np.float32) for n in (48, 96)}


def stamped(background: np.ndarray, which: int, templates: det.Templates) -> np.ndarray:
    """A gray image with the mark of detector number `which` at its place (none beyond the fixed ones and gemini)."""
    a = background.copy()
    h, w = a.shape
    if which < len(det.MARKS):
        mark = det.MARKS[which]
        scale = min(h, w) / mark.base
        mw, mh = (max(1, det.whole(n * scale)) for n in mark.size)
        left, _, right, bottom = (None if n is None else det.whole(n * scale) for n in mark.at)
        x = left if left is not None else w - right - (mw if not mark.origin or not mark.at[2] else 0)
        y = h - bottom - (0 if mark.origin else mh)
        part = a[y : y + mh, x : x + mw]
        part += 90 * (k.resize_nearest(templates[mark.name], mh, mw)[: part.shape[0], : part.shape[1]] > 0)
    elif which == len(det.MARKS):
        size, margin, *_ = det.LAYOUTS[0]
        part = a[h - margin - size : h - margin, w - margin - size : w - margin]
        part += (255 - part) * templates[f"gemini_{size}"]
    return np.clip(a, 0, 255)


def sample_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image a vector; a soft background, every third with a mark.  PNGs, but where vec_id % 5 = 0 plain bytes, and some
    that cannot be read.  A vector is small beside the work on its image, so a file of them is dealt over several tasks for
    each core."""
    templates = sample_templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, contents = b["vec_id"].to_pylist(), []
            for i, v in zip(ids, b["embedding"].to_pylist(), strict=True):
                small = 70 + 50 * np.clip(np.array(v, np.float64).reshape(8, 8), -1, 1)
                a = k.resize_area(small, HEIGHT, WIDTH)
                if i % 3 == 0:
                    a = stamped(a, i // 3 % (len(det.MARKS) + 2), templates)
                rgb = np.repeat(k.half_up(a).astype(np.uint8)[..., None], 3, -1)
                content = rgb.tobytes() if i % 5 == 0 else k.encode_png(rgb)
                contents.append(content[:-9] if i % 31 == 30 else content)
            n = len(ids)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([WIDTH] * n, pa.int32()), pa.array([HEIGHT] * n, pa.int32()), pa.array(contents, pa.binary())], ["img", "width", "height", "content"])

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and size(embedding) = 64").select("vec_id", "embedding")
    tasks = max(vectors.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)
    return vectors.repartition(tasks, "vec_id").mapInArrow(run, "img long, width int, height int, content binary")


def query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(sample_images(spark, sf_dir), sample_templates(), name)


def all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(sample_images(spark, sf_dir), sample_templates())


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(sample_images(spark, sf_dir), sample_templates())


def decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, height, width, mean of every image that is decoded, or the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for img, width, height, content in zip(*(b[c].to_pylist() for c in ("img", "width", "height", "content")), strict=True):
                try:
                    image = read_image(content, width, height)
                    again = k.decode_png(k.encode_png(image.rgb))
                    rows.append((img, image.height, image.width, round(float(image.gray.mean()), 9), bool((again == image.rgb).all()), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((img, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = {"img": pa.int64(), "height": pa.int64(), "width": pa.int64(), "mean": pa.float64(), "same_again": pa.bool_(), "error": pa.string()}
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds.values())], list(kinds))

    return sample_images(spark, sf_dir).mapInArrow(run, "img long, height long, width long, mean double, same_again boolean, error string")


def template_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, height, width, foreground of every mask that is decoded from its bits; one whose length is wrong has an error."""
    told_ = [(n, json.dumps({"bits": k.encode_mask(t), "shape": list(t.shape)})) for n, t in sample_templates().items()]
    told_.append(("short", json.dumps({"bits": k.encode_mask(np.ones((4, 4))), "shape": [40, 40]})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, source in zip(b["name"].to_pylist(), b["source"].to_pylist(), strict=True):
                try:
                    x = json.loads(source)
                    mask = k.decode_mask(x["bits"], *x["shape"])
                    rows.append((name, *mask.shape, int(np.count_nonzero(mask)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = {"name": pa.string(), "height": pa.int64(), "width": pa.int64(), "foreground": pa.int64(), "error": pa.string()}
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds.values())], list(kinds))

    return spark.createDataFrame(told_, "name string, source string").mapInArrow(run, "name string, height long, width long, foreground long, error string")


def process_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = sample_images(spark, sf_dir)
    done = run_batch(images, sample_templates())
    own = images.select("img", F.sha2("content", 256).alias("own"))  # contents are not shuffled
    done = done.withColumn("content", F.sha2("content", 256))
    return done.join(own, "img").select("img", "status", "regions", "providers", F.coalesce(F.col("content") == F.col("own"), F.lit(False)).alias("same_bytes"), "error")


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of marks: one row a mark of a fixed place."""
    rows = [(m.name, m.provider, m.base, *m.size, *m.at, m.origin, *m.radius, *map(float, m.contrast), *map(float, m.shape), list(m.box), *m.context, m.both, m.high_pass) for m in det.MARKS]
    return spark.createDataFrame(rows, "name string, provider string, base int, width int, height int, left_ int, top_ int, right_ int, bottom_ int, origin boolean, radius_least int, radius int, contrast double, contrast_range double, shape double, shape_range double, box array<int>, context_least int, context int, both boolean, high_pass int")


PROGRAMS = {f"detect_{n}": partial(query, n) for n in (*det.DETECTORS, "gemini")} | {
    "detect_regions": all_regions, "debug_detect": all_scores, "decode_file": decode_files, "process_batch": process_batch, "decode_mask": template_masks, "detector_parameters": parameters,
}
