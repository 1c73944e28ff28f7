"""Detector rules: gates and geometry as declarative expressions over candidates, boxes and regions.

Candidates are derived from the driver tables; the thresholds are data of the rules and live in this module together."""

from __future__ import annotations

from markfield.functions.dialect import clamp, clamp01, fl, jsround, overlap

# Thresholds of the detectors.
CORNER_GATES = (("qianwen", 25, 0.50), ("qingyan", 8, 0.50), ("wenxin", 35, 0.65))
POLARITY, TWO_REGION = (30, 0.60), (18, 0.42, 0.18)
SOLID_CLASSIC, SOLID_V2, OUTLINE_V2 = (8, 0.45), (18, 0.36), (20, 0.22, 0.32)
LIGHT = (0.36, 0.001, 4, 8, 0.09, 0.65)
ALPHA_FAR, ALPHA = (0.36, 0.20, 0.10), (0.32, 0.30)
ALPHA_FALLBACK, ALPHA_QUALITY = 0.35, (0.001, 0.60, 0.25)
OVERLAP = 0.60
#: Detector, limit and range of contrast, of shape, of a third score; null where it has none.
MARGINS = (
    ("qianwen", 25, 25, 0.50, 0.50, "null", "null"),
    ("qingyan", 8, 20, 0.50, 0.50, "null", "null"),
    ("doubao", 8, 18, 0.45, 0.35, "null", "null"),
    ("doubao v2", 18, 30, 0.36, 0.30, "null", "null"),
    ("doubao v2 outline", 20, 30, 0.22, 0.20, 0.32, 0.30),
    ("yuanbao", 30, 45, 0.60, 0.30, "null", "null"),
    ("wenxin", 35, 60, 0.65, 0.25, "null", "null"),
    ("jimeng", 18, 35, 0.42, 0.35, "null", "null"),
    ("xiaohongshu label", "null", "null", 0.70, 0.25, "null", "null"),
    ("xiaohongshu badge", "null", "null", 0.25, 0.35, "null", "null"),
    ("xiaohongshu account", "null", "null", 0.36, 0.20, "null", "null"),
)


def candidates(d) -> str:
    """id and a spread of candidate scores from lineitem."""
    return f"""c as (select l_orderkey * 10 + l_linenumber as id, l_orderkey as img, l_linenumber as ord, cast(l_quantity as bigint) as contrast, (l_partkey % 1000) / 1000.0 as shape, (l_suppkey % 100) / 100.0 as spatial,
      (l_partkey % 97) / 97.0 as gradient, (l_partkey % 89) / 89.0 as outline, l_discount as residual, l_tax as clipped, l_linenumber % 3 as kind, cast(floor(l_extendedprice) as bigint) % 40 - 20 as dx, cast(floor(l_extendedprice) as bigint) % 28 - 14 as dy from {d.t('lineitem')})"""


def images(d) -> str:
    return f"i as (select o_orderkey as img, 100 + o_custkey * 7 % 2900 as w, 90 + o_orderkey * 11 % 2300 as h, 8 + o_custkey % 300 as rw, 6 + o_orderkey % 200 as rh, o_custkey * 13 % 2500 - 40 as x, o_orderkey * 17 % 2000 - 40 as y, o_custkey % 5 as k from {d.t('orders')})"


def boxes(d) -> str:
    return f"b as (select l_orderkey as img, l_linenumber as ord, l_partkey % 60 as x, l_suppkey % 50 as y, 20 + cast(l_quantity as bigint) as w, 15 + l_partkey % 31 as h from {d.t('lineitem')})"


def alpha_candidate_valid(d):
    f, n = ALPHA_FAR, ALPHA
    return f"with {candidates(d)} select id, case when kind = 0 then shape >= {f[0]} and spatial >= {f[1]} and gradient >= {f[2]} else spatial >= {n[0]} and gradient >= {n[1]} end as valid from c"


def alpha_fallback_valid(d):
    return f"with {candidates(d)} select id, coalesce(r <= {ALPHA_FALLBACK} and not isnan(r), false) as valid from (select id, case when id % 11 = 0 then null when id % 13 = 0 then cast('NaN' as double) else shape end as r from c) s"


def alpha_quality(d):
    q = ALPHA_QUALITY
    return f"with {candidates(d)} select id, residual / 50.0 <= {q[0]} and clipped * 10 <= {q[1]} and gradient >= {q[2]} as valid from c"


def match_mode(d):
    a, b, o = SOLID_CLASSIC, SOLID_V2, OUTLINE_V2
    return f"""with {candidates(d)} select id, case when kind = 0 then case when contrast >= {a[0]} and shape >= {a[1]} then 'solid' end
      when contrast >= {b[0]} and shape >= {b[1]} then 'solid' when contrast >= {o[0]} and shape >= {o[1]} and outline >= {o[2]} then 'outline' end as mode from c"""


def corner_gate(d):
    gates = " union all ".join(f"select {i} as kind, '{n}' as name, {c} as least, {s} as form" for i, (n, c, s) in enumerate(CORNER_GATES))
    return f"with {candidates(d)}, gate as ({gates}) select id, name, contrast >= least and shape >= form as found from c join gate using (kind)"


def polarity_gate(d):
    return f"with {candidates(d)}, p as (select id, case when id % 2 = 0 then -contrast else contrast end as c, case when id % 2 = 0 then -shape else shape end as s from c) select id, abs(c) >= {POLARITY[0]} and abs(s) >= {POLARITY[1]} as found, case when c >= 0 then 'light' else 'dark' end as polarity from p"


def two_region_gate(d):
    t = TWO_REGION
    return f"with {candidates(d)} select id, case when contrast >= {t[0]} and shape >= {t[1]} then case when spatial >= {t[2]} then 2 else 1 end else 0 end as regions from c"


def light_label_gate(d):
    t = LIGHT
    scale = "(0.5 + kind)"
    near = f"greatest({t[2]}, {t[3]} * {scale})"
    return f"with {candidates(d)} select id, shape >= {t[0]} and abs(kind) * 0.5 <= {t[1]} and abs(dx) <= {near} and abs(dy) <= {near} and gradient >= {t[4]} and outline >= {t[5]} as valid, shape >= 0.25 as badge, shape >= 0.70 as legacy from c"


def confidence(d):
    """Least margin of a candidate's scores over a detector's limits, within 0..1, for every detector."""
    parts = " union all ".join(f"select '{n}' as name, {c} as c0, {cr} as c1, {s} as s0, {sr} as s1, {o} as o0, {orr} as o1" for n, c, cr, s, sr, o, orr in MARGINS)
    margin = lambda v, lo, by: f"(case when {by} is null then 1.0 else {clamp01(f'({v} - {lo}) / {by}')} end)"
    return f"with {candidates(d)}, mg as ({parts}) select id, name, round(least({margin('contrast', 'c0', 'c1')}, {margin('shape', 's0', 's1')}, {margin('outline', 'o0', 'o1')}), 9) as confidence from c cross join mg"


def candidate_grid(d):
    """Layouts with their offset grids; enumeration of a constant, not of data."""
    grid = lambda size, margin, r, step: f"select {size} as size, {margin} as margin, dx, dy from {d.seq(f'-{r}', r, 'dx')} a cross join {d.seq(f'-{r}', r, 'dy')} b where dx % {step} = 0 and dy % {step} = 0"
    return f"{grid(48, 32, 16, 2)} union all {grid(96, 64, 24, 4)} union all {grid(96, 192, 0, 1)}"


def detect_scores(d):
    return f"with {candidates(d)} select img, count(*) as candidates, round(max(shape), 6) as best_shape, max(contrast) as best_contrast, round(max(spatial + 0.8 * greatest(0.0, gradient)), 6) as best_score from c group by img"


def clamp_box(d):
    return f"""with {images(d)}, e as (select img, greatest(0, x) as x0, greatest(0, y) as y0, least(w, x + rw) as x1, least(h, y + rh) as y1 from i)
    select img, case when x1 > x0 and y1 > y0 then x0 end as x, case when x1 > x0 and y1 > y0 then y0 end as y, case when x1 > x0 and y1 > y0 then x1 - x0 end as w, case when x1 > x0 and y1 > y0 then y1 - y0 end as h from e"""


def anchor_position(d):
    return f"""with {images(d)}, a as (select *, case k % 4 when 0 then 'top-left' when 1 then 'top-right' when 2 then 'bottom-left' else 'bottom-right' end as anchor from i)
    select img, anchor, case when anchor like '%right' then w - rw - 26 else 26 end as x, case when anchor like 'bottom%' then h - rh - 17 else 17 end as y from a"""


def region_window(d):
    side = clamp(jsround("greatest(rw, rh) + 2.0 * greatest(48, case when k = 0 then 64 else k * 30 end)"), 32, "least(w, h)")
    at = lambda p, s, m: clamp(jsround(f"{p} + {s} / 2.0 - side / 2.0"), 0, f"{m} - side")
    return f"with {images(d)}, s as (select *, {side} as side from i) select img, side, {at('x', 'rw', 'w')} as x, {at('y', 'rh', 'h')} as y from s"


def expand_padding(d):
    return f"""with {images(d)}, p as (select *, case when k = 1 then 0 else k * 4 end as pad, k = 2 as has_mask from i), q as (select *, case when pad > 0 and not has_mask then pad else 0 end as e from p)
    select img, case when e = 0 then x else greatest(0, x - e) end as x, case when e = 0 then y else greatest(0, y - e) end as y, case when e = 0 then x + rw else least(w, x + rw + e) end as x1, case when e = 0 then y + rh else least(h, y + rh + e) end as y1 from q"""


def corner_boxes(d):
    cw, ch = f"least(w, greatest(320, {jsround('0.35 * w')}))", f"least(h, greatest(160, {jsround('0.16 * h')}))"
    return f"with {images(d)}, c as (select img, w, h, {cw} as cw, {ch} as ch from i) select img, cw, ch, r, case when r in (1, 3) then w - cw else 0 end as x, case when r in (1, 2) then h - ch else 0 end as y from c cross join {d.seq(1, 4, 'r')} s"


def box_region(d):
    """A region of a box that stands for itself: rounded, within the image's first corner, one pixel at least."""
    return f"with {images(d)}, r as (select img, {jsround('x / 3.0')} as x, {jsround('y / 3.0')} as y, {jsround('(rw - 20) / 3.0')} as w, {jsround('(rh - 20) / 3.0')} as h from i) select img, greatest(0, x) as x, greatest(0, y) as y, greatest(1, w) as w, greatest(1, h) as h, greatest(1, w) * greatest(1, h) as mask from r"


def thumb_dims(d):
    return f"with {images(d)} select img, 132 as w, greatest(1, {jsround('h * 132.0 / w')}) as h from i"


def box_overlap(d):
    return f"with {boxes(d)} select a.img, a.ord as first, c.ord as second, round({overlap('a', 'c')}, 9) as ratio from b a join b c on a.img = c.img and a.ord < c.ord where {overlap('a', 'c')} > 0"


def overlap_suppress(d):
    """Boxes in order; one that overlaps a kept one by OVERLAP of the smaller box is dropped."""
    if d.name == "duck":
        return f"""with recursive {boxes(d)}, n as (select *, row_number() over (partition by img order by ord, x, y, w, h) as r from b),
        walk(img, r, kept) as (select img, r, [{{'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}}] from n where r = 1
          union all select n.img, n.r, case when len(list_filter(k.kept, lambda q: cast(greatest(0, least(q.x + q.w, n.x + n.w) - greatest(q.x, n.x)) * greatest(0, least(q.y + q.h, n.y + n.h) - greatest(q.y, n.y)) as double) / greatest(1, least(q.w * q.h, n.w * n.h)) >= {OVERLAP})) > 0
            then k.kept else list_append(k.kept, {{'ord': n.ord, 'x': n.x, 'y': n.y, 'w': n.w, 'h': n.h}}) end from walk k join n on n.img = k.img and n.r = k.r + 1),
        last as (select img, kept from walk qualify row_number() over (partition by img order by r desc) = 1)
        select img, q.ord as ord, q.x as x, q.y as y from (select img, unnest(kept) as q from last)"""
    fold = f"aggregate(array_sort(collect_list(struct(ord, x, y, w, h))), cast(array() as array<struct<ord:int,x:bigint,y:bigint,w:bigint,h:bigint>>), (kept, n) -> case when exists(kept, q -> {overlap('q', 'n')} >= {OVERLAP}) then kept else array_append(kept, n) end)"
    return f"with {boxes(d)} select img, q.ord, q.x, q.y from (select img, explode({fold}) as q from b group by img) s"


def region_union(d):
    if d.name == "spark":  # `not in` would broadcast all found images; the same, nulls included, as a join that can be dealt out
        return f"""with {candidates(d)}, found as (select img from c where kind in (0, 1) and shape > 0.5)
        select img, ord, 'alpha' as source, contrast from c where kind = 0 and shape > 0.5 union all select img, ord, 'rule', contrast from c where kind = 1 and shape > 0.5
        union all select img, ord, 'text', contrast from (select /*+ merge(found) */ c.img, c.ord, c.contrast from c left anti join found on c.img = found.img where kind = 2) s
          where (select count(*) from found) = 0 or (img is not null and (select count(*) from found where img is null) = 0)"""
    return f"""with {candidates(d)} select img, ord, 'alpha' as source, contrast from c where kind = 0 and shape > 0.5 union all select img, ord, 'rule', contrast from c where kind = 1 and shape > 0.5
    union all select img, ord, 'text', contrast from c where kind = 2 and img not in (select img from c where kind in (0, 1) and shape > 0.5)"""


def provider_list(d):
    firsts = f"f as (select img, case kind when 0 then '豆包' when 1 then '千问' else 'Gemini' end as p, min(ord) as o from c where gradient > 0.3 group by img, kind)"
    return f"with {candidates(d)}, {firsts} select img, {d.join(d.gather('p', 'o'), '、')} as providers from f group by img"


QUERIES = {f.__name__: f for f in (
    alpha_candidate_valid, alpha_fallback_valid, alpha_quality, match_mode, corner_gate, polarity_gate, two_region_gate, light_label_gate, confidence,
    candidate_grid, detect_scores, clamp_box, anchor_position, region_window, expand_padding, corner_boxes, box_region, thumb_dims, box_overlap, overlap_suppress,
    region_union, provider_list,
)}
