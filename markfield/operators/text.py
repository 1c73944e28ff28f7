"""Recognised text: normalisation, classification, line grouping and regions of OCR items.

`normalize_text` and `text_kind` run over every whole text and over MARKS, rows of their own that are marks; NFKC is in
neither engine's SQL, so they are programs.  Items of the SQL operators come from conversations, with marks written into
some of them that NFKC does not change, as the tables hold none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.functions import marks
from markfield.functions.dialect import jsround

#: Marks that are added to the documents with ids from -1 downwards.
MARKS = ("豆包 AI 生 成", "Ｇｅｍｉｎｉ", "小红书号：2917353068", "这是豆包的食谱", "清言 ai", "照片 ＡＩ 生 成 ", "元宝-生成", "小红书号：照片", "千问自己", "", None)


def each_text(spark: SparkSession, sf_dir: str, column: str, f: Callable[[str | None], str | None]) -> DataFrame:
    """id, column (f of the text) of every document and every mark."""
    told = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    made = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(MARKS)], "id long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b["id"], pa.array([f(t) for t in b["text"].to_pylist()], pa.string())], ["id", column])

    return told.unionByName(made).mapInArrow(run, f"id long, {column} string")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_text(spark, sf_dir, "text", marks.normal_form)


def text_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_text(spark, sf_dir, "kind", marks.kind_of)


def _norm(d, s: str) -> str:
    strip = r"(?U)[\s\p{P}\p{S}]" if d.name == "spark" else r"[\s\p{P}\p{S}]"
    return d.replace(f"upper({s})", strip, "")


def kind(d, t: str) -> str:
    names = " ".join(f"when {t} in ('{n}', '{n}AI', '{n}生成', '{n}AI生成') then '{marks._SHOWN.get(n, n)}'" for n in marks.NAMES)
    return f"case when {d.match(t, marks.ACCOUNT)} then '{marks.BRAND}' {names} when {t} like '%{marks.SUFFIX}%' then '{marks.SUFFIX}' end"


def items(d) -> str:
    """Boxes on a page: conv_id is the image, a turn an item."""
    said = ("豆包", "AI", "生成", "小红书号：2917353068", "小红书", "AI 生 成", "Gemini", "hello")
    text = " ".join(f"when {k} then '{t}'" for k, t in enumerate(said))
    return f"""it as (select conv_id as img, turn as ord, case (conv_id * 5 + turn) % 11 {text} else role end as text, 0.2 + ((conv_id + turn) % 9) / 10.0 as score, (conv_id * 37 + turn * 90) % 400 as x, (conv_id * 11 + {d.idiv('turn', 3)} * 60) % 300 as y, 30 + length(text) % 60 as w, 12 + length(text) % 16 as h from {d.t('conversations')})"""


def poly_bounds(d):
    """Box of an item's points; none where a point is not finite."""
    xs, ys = "array(x, x + w, x + w + far, x - 1)", "array(y - 1, y, y + h, y + h + 2)"
    odd, lo, hi = "exists(p, v -> isnan(v) or abs(v) = cast('Infinity' as double))", "array_min", "array_max"
    if d.name == "duck":
        xs, ys = (p.replace("array(", "[").replace(")", "]") for p in (xs, ys))
        odd, lo, hi = "len(list_filter(p, lambda v: not isfinite(v))) > 0", "list_min", "list_max"
    far = "case when (img + ord) % 13 = 0 then cast('NaN' as double) when (img + ord) % 17 = 0 then cast('Infinity' as double) else cast(2 as double) end as far"
    return f"with {items(d)}, q as (select img, ord, x, y, w, h, {far} from it), s as (select img, ord, {xs} as p, {ys} as q from q), b as (select img, ord, case when {odd} then null else p end as p, q from s) select img, ord, {lo}(p) as x0, {hi}(p) as x1, case when p is null then null else {lo}(q) end as y0, case when p is null then null else {hi}(q) end as y1 from b"


SAME = "abs(({a}.y + {a}.h / 2.0) - ({b}.y + {b}.h / 2.0)) <= 0.55 * greatest({a}.h, {b}.h) and greatest({a}.x, {b}.x) - least({a}.x + {a}.w, {b}.x + {b}.w) <= 2.5 * greatest({a}.h, {b}.h)"


def same_line_pairs(d):
    return f"with {items(d)} select a.img, a.ord as first, b.ord as second from it a join it b on a.img = b.img and a.ord < b.ord and {SAME.format(a='a', b='b')}"


def ocr_item_gate(d):
    return f"with {items(d)} select img, ord, text is not null and text <> '' and not isnan(score) and score >= 0.45 as ok from it"


def ocr_region_gate(d):
    return f"with {items(d)} select img, ord, w > 0 and h > 0 and w <= 0.5 * 150 and h <= 0.2 * 100 as ok from it"


def lines(d) -> str:
    """Greedy first fit in input order: an item joins the first line it is on, whose box grows."""
    if d.name == "duck":
        on = SAME.format(a="l", b="n")
        return f"""{items(d)}, o as (select *, row_number() over (partition by img order by ord) as r from it where score >= 0.45),
        walk(img, r, ls) as (select img, cast(0 as bigint), [{{'x': x, 'y': y, 'w': w, 'h': h, 'n': [ord]}}][1:0] from o where r = 1
          union all select n.img, n.r, case when len(list_filter(k.ls, lambda l: {on})) = 0 then list_append(k.ls, {{'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h, 'n': [n.ord]}})
            else list_transform(k.ls, lambda l, i: case when i = list_position(list_transform(k.ls, lambda l: {on}), true) then
              {{'x': least(l.x, n.x), 'y': least(l.y, n.y), 'w': greatest(l.x + l.w, n.x + n.w) - least(l.x, n.x), 'h': greatest(l.y + l.h, n.y + n.h) - least(l.y, n.y), 'n': list_append(l.n, n.ord)}} else l end) end
          from walk k join o n on n.img = k.img and n.r = k.r + 1),
        ln as (select img, unnest(ls) as l, unnest(range(len(ls))) as line from (select img, ls from walk qualify row_number() over (partition by img order by r desc) = 1))"""
    on = SAME.format(a="l", b="n")
    kind_ = "array<struct<x:bigint,y:bigint,w:bigint,h:bigint,n:array<bigint>>>"
    grown = "named_struct('x', least(l.x, n.x), 'y', least(l.y, n.y), 'w', greatest(l.x + l.w, n.x + n.w) - least(l.x, n.x), 'h', greatest(l.y + l.h, n.y + n.h) - least(l.y, n.y), 'n', array_append(l.n, n.ord))"
    new = "named_struct('x', n.x, 'y', n.y, 'w', n.w, 'h', n.h, 'n', array(n.ord))"
    fold = f"aggregate(array_sort(collect_list(struct(ord, x, y, w, h))), cast(array() as {kind_}), (ls, n) -> case when not exists(ls, l -> {on}) then array_append(ls, {new}) else transform(ls, (l, i) -> case when i = array_position(transform(ls, l -> {on}), true) - 1 then {grown} else l end) end)"
    typed = "select img, cast(ord as bigint) as ord, cast(x as bigint) as x, cast(y as bigint) as y, cast(w as bigint) as w, cast(h as bigint) as h from it where score >= 0.45"
    return f"{items(d)}, ln as (select img, posexplode({fold}) as (line, l) from ({typed}) s group by img)"


def _with(d) -> str:
    return "with recursive" if d.name == "duck" else "with"


def ocr_lines(d):
    return f"{_with(d)} {lines(d)} select img, cast(line as bigint) as line, l.x as x, l.y as y, l.w as w, l.h as h, cast({'len' if d.name == 'duck' else 'size'}(l.n) as bigint) as items from ln"


def ocr_line_text(d):
    members = "select img, line, unnest(l.n) as ord from ln" if d.name == "duck" else "select img, line, explode(l.n) as ord from ln"
    return f"{_with(d)} {lines(d)}, m as ({members}) select m.img, cast(line as bigint) as line, {d.join(d.gather('text', 'x * 1000 + m.ord'), '')} as text from m join it on it.img = m.img and it.ord = m.ord group by m.img, line"


#: The image that the items' corner was cut from, and where.
AT_X, AT_Y, WIDTH, HEIGHT = 300, 200, 1000, 900


def told_lines(d) -> str:
    """Lines with their box, the text in order of x, the text as read, and the kind."""
    members = "select img, line, unnest(l.n) as ord from ln" if d.name == "duck" else "select img, line, explode(l.n) as ord from ln"
    return f"""{lines(d)}, mb as ({members}),
    tx as (select mb.img, line, {d.join(d.gather('text', 'x * 1000 + mb.ord'), '')} as text, {d.join(d.gather('text', 'mb.ord'), '')} as as_read from mb join it on it.img = mb.img and it.ord = mb.ord group by mb.img, line),
    f as (select ln.img, cast(ln.line as bigint) as line, l.x as x, l.y as y, l.x + l.w as x1, l.y + l.h as y1, text, {_norm(d, 'text')} as norm, {_norm(d, 'as_read')} as norm_read from ln join tx on tx.img = ln.img and tx.line = ln.line),
    k as (select *, {kind(d, 'norm')} as kind from f)"""


def merged(d) -> str:
    """A line of the account kind takes in the first badge above it, at most two line heights away and not left of it."""
    above = f"b.img = a.img and b.line <> a.line and (case when b.line < a.line then b.norm else b.norm_read end) = '{marks.BRAND}' and b.y1 <= a.y and a.y - b.y1 <= 2 * (a.y1 - a.y) and b.x1 >= a.x - 2 * (a.y1 - a.y)"
    return f"""{told_lines(d)}, badge as (select a.img, a.line, b.x, b.y, b.x1, b.y1, row_number() over (partition by a.img, a.line order by b.line) as r from k a join k b on {above} where a.kind = '{marks.BRAND}'),
    mg as (select k.img, k.line, k.kind, k.text, k.norm, greatest(1, k.y1 - k.y) as h, least(k.x, coalesce(b.x, k.x)) as x, least(k.y, coalesce(b.y, k.y)) as y, greatest(k.x1, coalesce(b.x1, k.x1)) as x1, greatest(k.y1, coalesce(b.y1, k.y1)) as y1, b.x is not null as badge
      from k left join badge b on b.img = k.img and b.line = k.line and b.r = 1 where k.kind is not null)"""


def ocr_badge_merge(d):
    return f"{_with(d)} {merged(d)} select img, line, kind, badge, x, y, x1, y1 from mg"


def ocr_regions(d):
    """Regions of the lines that are marks: padded, with room for a name before the bare suffix, clipped, not too large."""
    before = f"case when norm = '{marks.SUFFIX}' then h * 3.5 else 0.0 end"
    return f"""{_with(d)} {merged(d)}, g as (select *, greatest(3, {jsround('h * 0.35')}) as pad, {before} as room from mg),
    e as (select *, greatest(0, cast(floor({AT_X} + x - pad - room) as bigint)) as left_, greatest(0, {AT_Y} + y - pad) as top, least({WIDTH}, {AT_X} + x1 + pad) as right_, least({HEIGHT}, {AT_Y} + y1 + pad) as bottom from g)
    select img, line, kind as provider, text, left_ as x, top as y, right_ - left_ as width, bottom - top as height, greatest(64, {jsround('h * 3')}) as context, greatest(2, {jsround('h * 0.15')}) as padding from e
    where right_ > left_ and bottom > top and right_ - left_ <= {WIDTH} * 0.5 and bottom - top <= {HEIGHT} * 0.2"""


def first_corner_hit(d):
    """Corners BR, BL, TR, TL raw, then enhanced: the first that has an accepted item."""
    return f"""with {items(d)}, c as (select img, case when x >= 200 and y >= 150 then 0 when y >= 150 then 1 when x >= 200 then 2 else 3 end as corner, case when score >= 0.45 then 0 else 1 end as enhanced from it where score >= 0.3)
    select img, min(enhanced * 4 + corner) as precedence from c group by img"""


QUERIES = {f.__name__: f for f in (
    poly_bounds, same_line_pairs, ocr_item_gate, ocr_region_gate, ocr_lines, ocr_line_text, ocr_badge_merge, ocr_regions, first_corner_hit,
)}
PROGRAMS = {"normalize_text": normalize_text, "text_kind": text_kind}
