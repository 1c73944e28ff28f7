"""Literal cases of the rules: texts, thresholds, errors, estimates, threads, regions."""

import zlib

import pytest
from conftest import SMALL

from markfield.functions import detectors as det
from markfield.functions import marks
from markfield.functions.dialect import Spark, render
from markfield.operators import jobs
from markfield.plans import catalogue


def item(text, x, y, width, height, score=0.98):
    return {"text": text, "score": score, "poly": [[x, y], [x + width, y], [x + width, y + height], [x, y + height]]}


def test_normal_form_and_kind():
    assert marks.normal_form("ＡＩ 生 成") == "AI生成" and marks.normal_form(None) == ""
    assert marks.kind_of("豆包 AI 生 成") == "豆包" and marks.kind_of("Gemini") == "Gemini" and marks.kind_of("Ｇｅｍｉｎｉ") == "Gemini"
    for name in ("豆包", "即梦", "千问", "清言", "元宝", "文心"):
        assert marks.kind_of(name) == marks.kind_of(f"{name}AI") == name
    assert marks.kind_of("小红书号：2917353068") == "小红书"
    assert [marks.kind_of(t) for t in ("这是豆包的食谱", "千问自己", "小红书号：照片", "普通角落文字", "")] == [None] * 5


def test_regions_of_items():
    found = marks.regions_of([item("小红书", 459, 327, 63, 26), item("小红书号：2917353068", 283, 373, 252, 27), item("该多好", 0, 62, 404, 176)], 520, 995, 1084, 1422)
    assert [r["provider"] for r in found] == ["小红书"] and found[0]["y"] < 995 + 327 and found[0]["x"] <= 520 + 283
    found = marks.regions_of([item("豆包", 10, 10, 40, 18), item("AI", 55, 10, 21, 18), item("生成", 78, 10, 38, 18)], 100, 200, 1000, 1000)
    assert [(r["text"], r["provider"]) for r in found] == [("豆包AI生成", "豆包")]
    assert [r["provider"] for r in marks.regions_of([item("清言", 15, 12, 40, 18)], 0, 0, 1000, 1000)] == ["清言"]
    assert marks.regions_of([item("这是豆包的食谱", 15, 12, 120, 18)], 0, 0, 1000, 1000) == []
    assert marks.regions_of([item("AI生成", 20, 20, 90, 20, 0.2), item("小红书号：123456", 20, 120, 200, 20, 0.2)], 0, 0, 1000, 1000) == []
    assert marks.regions_of([item("豆包", float("nan"), 1, 2, 3), {"text": "豆包", "score": None, "poly": None}, item("", 1, 1, 9, 9)], 0, 0, 100, 100) == []
    bare = marks.regions_of([item("AI 生成", 500, 50, 90, 20)], 0, 0, 1000, 1000)[0]
    assert (bare["x"], bare["y"], bare["width"], bare["height"], bare["context"], bare["padding"]) == (423, 43, 174, 34, 64, 3)


def test_sql_regions_are_those_of_the_functions(spark):
    from markfield.operators import text

    rows = spark.sql(render(lambda d: f"with {text.items(d)} select img, ord, text, score, x, y, w, h from it", Spark(SMALL))).collect()
    for_image = {}
    for r in sorted(rows, key=lambda r: (r.img, r.ord)):
        for_image.setdefault(r.img, []).append(item(r.text, r.x, r.y, r.w, r.h, r.score))
    want = sorted((i, r["provider"], r["text"], r["x"], r["y"], r["width"], r["height"], r["context"], r["padding"]) for i, its in for_image.items() for r in marks.regions_of(its, text.AT_X, text.AT_Y, text.WIDTH, text.HEIGHT))
    got = sorted((r.img, r.provider, r.text, r.x, r.y, r.width, r.height, r.context, r.padding) for r in catalogue.QUERIES["ocr_regions"](spark, SMALL).collect())
    assert got == want and len(got) > 5 and len({r[1] for r in got}) > 2


def test_thresholds():
    mode = det.doubao_mode
    assert mode("classic", 8, 0.45) and not mode("classic", 8, 0.4499) and mode("v2", 18, 0.36) and not mode("v2", 17.99, 0.36) and not mode("v2", 18, 0.3599)
    assert mode("v2", 24.91039826675842, 0.24749515861683322, 0.4413572024723144) == "outline"
    assert not mode("v2", 24.91, 0.247, 0.3199) and not mode("v2", 33.67, 0.2498, -0.013)
    assert det.gemini_holds(96, 192, 0.36, 0.20, 0.10) and det.gemini_holds(48, 32, 0.56, 0.32, 0.30)
    assert not det.gemini_holds(96, 192, 0.359, 0.5, 0.5) and not det.gemini_holds(96, 64, 0.9, 0.319, 0.9) and not det.gemini_holds(48, 32, 0.9, 0.9, 0.299)
    assert det.fallback_holds(0.35) and not det.fallback_holds(0.351) and not det.fallback_holds(float("nan"))
    assert det.badge_holds(0.26812727345329185) and not det.badge_holds(0.2499) and not det.badge_holds(0.195197)
    account = {"score": 0.38010077957608857, "factor": 1, "scale": 1.1291666666666667, "dx": 1, "dy": -3, "density": 0.13471419396274886, "columns": 0.7803468208092486}
    assert det.account_holds(**account) and not det.account_holds(**account | {"factor": 1.12})
    assert not det.account_holds(**account | {"score": 0.37961791286197266, "factor": 0.78, "dy": -10, "density": 0.05801435406698564, "columns": 0.42045454545454547})


def of(spark, expression):
    return spark.sql(f"select {render(expression, Spark(SMALL))} as v").first().v


@pytest.mark.parametrize(("message", "oom"), [("WebAssembly allocation failed: out of memory", True), ("Aborted ( OOM )", True), ("cannot enlarge memory", True), ("std::bad_alloc", True), ("RangeError: invalid array length", False), ("no available backend found", False), ("图片解码失败", False), ("room is full", False)])
def test_out_of_memory(spark, message, oom):
    assert of(spark, lambda d: jobs.is_oom(d, f"'{message}'")) is oom


def test_error_texts(spark):
    assert of(spark, lambda d: jobs.friendly(d, "'Load failed'", "true")) == jobs.SELECT_AGAIN
    assert of(spark, lambda d: jobs.friendly(d, "'Load failed'", "false")) == "Load failed" and of(spark, lambda d: jobs.friendly(d, "'HTTP 500'", "true")) == "HTTP 500"


def test_estimates_follow_the_smoothed_time(spark):
    seconds = {r.model: r.seconds for r in catalogue.QUERIES["timing_ewma"](spark, SMALL).collect()}
    events = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/events.parquet").collect(), key=lambda r: r.event_id):
        events.setdefault(r.user_id, []).append(-r.value if r.event_id % 7 == 0 else r.value)
    for model, told in events.items():
        t = 16.0 if model % 2 == 0 else 40.0
        for s in told:
            t = float(f"{t * 0.65 + s * 0.35:.2f}") if s > 0 else t
        assert abs(seconds[model] - t) < 0.03
    for r in catalogue.QUERIES["batch_estimate"](spark, SMALL).collect():
        left = max(1, int(seconds[r.model] * r.n + 0.5))
        text = f"约 {-(-left // 60)} 分钟" if left >= 60 else f"约 {left} 秒"
        assert r.text == ("" if r.n <= 0 else f"{r.n} 张预计 {text}；请保持页面在前台，每完成一张会立即保存。") and r.hidden == (r.n <= 0)


def test_threads_and_retries(spark):
    assert {(r.threads, r.lowered) for r in catalogue.QUERIES["thread_policy"](spark, SMALL).collect()} >= {(4, 2), (2, 1), (1, 1)}
    runs = {}
    for r in sorted(spark.read.parquet(f"{SMALL}/events.parquet").collect(), key=lambda r: r.event_id):
        runs.setdefault(r.user_id, []).append(r.event_type)
    want = {}
    for run, kinds in runs.items():
        threads, retries, over = 4, 0, False
        for kind in kinds:
            if over or kind == "view":
                continue
            if kind == "error" and threads > 1 and retries < 2:
                threads, retries = (2 if threads > 2 else 1), retries + 1
            else:
                over = True
        want[run] = (threads, retries, over)
    assert {r.run: (r.threads, r.retries, r.ended) for r in catalogue.QUERIES["oom_retry_fold"](spark, SMALL).collect()} == want


def test_names_and_sources(spark):
    names = {r.id: r.name for r in catalogue.QUERIES["output_name"](spark, SMALL).collect()}
    entries = {r.id: r.entry for r in catalogue.QUERIES["zip_entry_names"](spark, SMALL).collect()}
    assert all(n.startswith(("去水印-", "原图-")) and n.endswith((".jpg", ".png")) for n in names.values())
    assert all(entries[i].split("-", 2)[2] == names[i].split("-", 1)[1] and len(entries[i].split("-")[1]) == 3 for i in names)
    orders = {}
    for r in sorted(catalogue.QUERIES["source_order"](spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.place):
        orders.setdefault(r.user_id, []).append(r.name)
    a, b, c = jobs.SOURCES
    assert {tuple(o) for o in orders.values()} >= {(a, b, c), (b, a, c), (c, b, a), (c, a, b)}


def test_whole_contents(spark):
    told = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.id: r.crc for r in catalogue.QUERIES["crc32"](spark, SMALL).collect()} == {i: zlib.crc32(t.encode()) for i, t in told.items()}
    got = {r.id: r.text for r in catalogue.QUERIES["normalize_text"](spark, SMALL).collect()}
    assert all(got[i] == marks.normal_form(t) for i, t in told.items()) and got[-2] == "GEMINI"
    kinds = {r.id: r.kind for r in catalogue.QUERIES["text_kind"](spark, SMALL).collect()}
    assert [kinds[-1 - i] for i in range(11)] == ["豆包", "Gemini", "小红书", None, "清言", "AI生成", "元宝", None, None, None, None]
