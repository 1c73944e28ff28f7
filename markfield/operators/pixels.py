"""Pixel operators on the relation (image, y, x, g): projections, resampling, neighbourhoods, template matching.

An `embeddings` row is an 8 x 8 gray image; three rows in succession are one colour image.  Neighbourhood operators
join a pixel with the few neighbours of its own image only, by equi-join on (image, y, x)."""

from __future__ import annotations

import math

from markfield.functions.dialect import clamp, clamp01, fl, jsround, pearson, reflect

N = 8


def px(d) -> str:
    g = clamp(jsround("(cast(v as double) + 1) * 127.5"), 0, 255)
    return f"px as (select vec_id as img, label, {d.idiv('p', N)} as y, p % {N} as x, {g} as g from {d.each('embeddings', 'embedding', 'vec_id, label')} s)"


def rgb(d) -> str:
    ch = lambda k: f"max(case when img % 3 = {k} then g end)"
    return f"{px(d)}, rgb as (select {d.idiv('img', 3)} as img, y, x, {ch(0)} as r, {ch(1)} as g, {ch(2)} as b from px group by {d.idiv('img', 3)}, y, x having count(*) = 3)"


def template(d) -> str:
    """Mean image of each label, quantised."""
    return f"{px(d)}, tpl as (select label, y, x, {jsround('avg(g)')} as t from px group by label, y, x)"


def gray_quantize(d):
    return f"with {rgb(d)} select img, y, x, {jsround('0.299 * r + 0.587 * g + 0.114 * b')} as gray from rgb"


def luma709(d):
    return f"with {rgb(d)} select img, y, x, round((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255, 9) as luma from rgb"


def gray_fixedpoint(d):
    return f"with {rgb(d)} select img, y, x, {d.idiv('77 * r + 150 * g + 29 * b', 256)} as gray from rgb"


def rgb_to_hsv(d):
    hue = "case when mx = mn then 0.0 when mx = r then 60.0 * (cast(g - b as double) / (mx - mn)) when mx = g then 60.0 * (cast(b - r as double) / (mx - mn) + 2) else 60.0 * (cast(r - g as double) / (mx - mn) + 4) end"
    return f"""with {rgb(d)}, m as (select *, greatest(r, g, b) as mx, least(r, g, b) as mn from rgb), h as (select *, {hue} as hue from m)
    select img, y, x, {jsround('(case when hue < 0 then hue + 360 else hue end) / 2')} as h, case when mx = 0 then 0 else {jsround('cast(mx - mn as double) / greatest(mx, 1) * 255')} end as s, mx as v from h"""


def srgb_linear(d):
    lin = f"case when c <= 0.04045 then c / 12.92 else pow((c + 0.055) / 1.055, 2.4) end"
    return f"""with {px(d)}, c as (select img, y, x, g / 255.0 as c from px), l as (select *, {clamp01(lin)} as lin from c)
    select img, y, x, round(lin, 9) as linear, round({clamp01('case when lin <= 0.0031308 then lin * 12.92 else 1.055 * pow(lin, 1 / 2.4) - 0.055 end')}, 9) as back from l"""


def resize_nearest(d, to: int = 5):
    src = lambda v: f"least({N - 1}, {fl(f'{v} * {N}.0 / {to}')})"
    return f"with {px(d)}, dst as (select * from {d.seq(0, to - 1, 'dy')} a cross join {d.seq(0, to - 1, 'dx')} b) select img, dy as y, dx as x, g from dst join px on px.y = {src('dy')} and px.x = {src('dx')}"


def resize_area(d, to: int = 3):
    part = lambda v, s: f"greatest(0.0, least(({v} + 1) * {N}.0 / {to}, {s} + 1) - greatest({v} * {N}.0 / {to}, {s}))"
    area = f"({part('dy', 'y')} * {part('dx', 'x')})"
    return f"""with {px(d)}, dst as (select * from {d.seq(0, to - 1, 'dy')} a cross join {d.seq(0, to - 1, 'dx')} b),
    w as (select dy, dx, y, x, {area} as area from dst cross join (select distinct y, x from px) p where {part('dy', 'y')} > 0 and {part('dx', 'x')} > 0)
    select img, dy as y, dx as x, round(sum(g * area) / sum(area), 6) as g from px join w using (y, x) group by img, dy, dx"""


def resize_bilinear(d, to: int = 12):
    pos = lambda v: clamp(f"({v} + 0.5) * {N}.0 / {to} - 0.5", "0.0", f"{N - 1}.0")
    return f"""with {px(d)}, dst as (select dy, dx, {pos('dy')} as sy, {pos('dx')} as sx from {d.seq(0, to - 1, 'dy')} a cross join {d.seq(0, to - 1, 'dx')} b),
    w as (select dy, dx, {fl('sy')} + oy as y, {fl('sx')} + ox as x, (case when oy = 0 then 1 - (sy - floor(sy)) else sy - floor(sy) end) * (case when ox = 0 then 1 - (sx - floor(sx)) else sx - floor(sx) end) as wt
      from dst cross join {d.seq(0, 1, 'oy')} a cross join {d.seq(0, 1, 'ox')} b)
    select img, dy as y, dx as x, round(sum(g * wt), 6) as g from px join w using (y, x) where wt > 0 group by img, dy, dx"""


def crop(d):
    return f"with {px(d)} select img, y - 2 as y, x - 1 as x, g from px where x >= 1 and x < 6 and y >= 2 and y < 7"


def masked_rgb(d):
    return f"with {rgb(d)} select img, y, x, round(r / 255.0 * (1 - m), 9) as r, round(g / 255.0 * (1 - m), 9) as g, round(b / 255.0 * (1 - m), 9) as b, m from (select *, case when r > 128 then 1 else 0 end as m from rgb) s"


def raster_shapes(d):
    return f"""with boxes as (select vec_id as img, vec_id % 5 as x0, vec_id % 7 as y0, 2 + vec_id % 6 as x1, 3 + vec_id % 5 as y1, vec_id % 4 as r from {d.t('embeddings')})
    select img, y, x, case when x between x0 and x1 and y between y0 and y1 then 1 else 0 end as in_rect, case when (x - x0) * (x - x0) + (y - y0) * (y - y0) <= r * r then 1 else 0 end as in_circle
    from boxes cross join {d.seq(0, N - 1, 'y')} a cross join {d.seq(0, N - 1, 'x')} b"""


def mask_in_window(d):
    return f"""with {px(d)}, m as (select img, y + img % 5 - 2 as wy, x + img % 3 - 1 as wx, case when g > 127 then 255 else 0 end as m from px)
    select img, wy as y, wx as x, m as mask from m where wy >= 0 and wy < {N} and wx >= 0 and wx < {N}"""


def mask_unpack(d):
    bit = d.idiv("g", "cast(pow(2, 7 - k) as bigint)")
    return f"with {px(d)} select img, y, x * 8 + k as x, case when {bit} % 2 = 1 then 255 else 0 end as mask from px cross join {d.seq(0, 7, 'k')} b"


def _near(d, r: int) -> str:
    return f"near as (select a.img, a.y, a.x, dy, dx, b.g from (select img, y, x, dy, dx from px cross join {d.seq(-r, r, 'dy')} i cross join {d.seq(-r, r, 'dx')} j) a join px b on b.img = a.img and b.y = {{y}} and b.x = {{x}})"


def dilate_square(d, r: int = 1):
    """Square maximum filter; two passes along rows and columns, each a window over one image line."""
    w = lambda v, by, o: f"max({v}) over (partition by img, {by} order by {o} rows between {r} preceding and {r} following)"
    return f"with {px(d)}, a as (select img, y, x, case when g > 150 then 255 else 0 end as m from px), h as (select img, y, x, {w('m', 'y', 'x')} as m from a) select img, y, x, {w('m', 'x', 'y')} as mask from h"


def radius(sigma: float) -> int:
    """Taps on either side: the size is 8 sigma + 1 rounded, made odd upwards, 3 at least."""
    size = math.floor(8 * sigma + 1.5)
    return max(3, size | 1) // 2


def gauss_kernel(d):
    size = f"greatest(3, {fl('8 * sigma + 1.5')} + 1 - {fl('8 * sigma + 1.5')} % 2)"
    return f"""with s as (select vec_id as id, 0.5 + (vec_id % 10) * 0.25 as sigma from {d.t('embeddings')}), k as (select id, sigma, {d.idiv(size, 2)} as r from s), i as (select id, sigma, r, {d.upto('2 * r + 1', 'n')} from k),
    w as (select id, n - r as i, exp(-((n - r) * (n - r)) / (2 * sigma * sigma)) as w from i)
    select id, i, round(w / sum(w) over (partition by id), 9) as weight from w"""


def blurred(d, table: str, value: str, sigma: float, to: str) -> str:
    """CTEs for `to` (img, y, x, v): `value` of `table` (img, y, x) under a Gaussian, row by row, then column by column."""
    r, w = radius(sigma), f"exp(-(k * k) / {2 * sigma * sigma})"
    return f"""{to}_k as (select k, {w} / sum({w}) over () as w from {d.seq(-r, r, 'k')} s),
    {to}_s as (select img, y, x, {value} as v from {table}),
    {to}_h as (select a.img, a.y, a.x, sum(w * b.v) as v from (select img, y, x, w, {reflect('x + k', N)} as sx from {to}_s cross join {to}_k) a join {to}_s b on b.img = a.img and b.y = a.y and b.x = a.sx group by a.img, a.y, a.x),
    {to} as (select a.img, a.y, a.x, sum(w * b.v) as v from (select img, y, x, w, {reflect('y + k', N)} as sy from {to}_h cross join {to}_k) a join {to}_h b on b.img = a.img and b.x = a.x and b.y = a.sy group by a.img, a.y, a.x)"""


def gaussian_blur(d):
    return f"with {px(d)}, {blurred(d, 'px', 'g', 1.0, 'bl')} select img, y, x, round(v, 6) as g from bl"


def reflect_index(d):
    return f"select vec_id as n, i, {reflect('i', 'vec_id')} as at from {d.t('embeddings')} cross join {d.seq(-40, 40, 'i')} s where vec_id >= 1"


def gradients(d) -> str:
    near = _near(d, 1).format(y=reflect("a.y + a.dy", N), x=reflect("a.x + a.dx", N))
    return f"{px(d)}, {near}, grad as (select img, y, x, cast(sum(dx * (2 - abs(dy)) * g) as bigint) as gx, cast(sum(dy * (2 - abs(dx)) * g) as bigint) as gy from near group by img, y, x)"


def sobel_l1(d):
    return f"with {gradients(d)} select img, y, x, abs(gx) + abs(gy) as edge from grad"


def edge_magnitude(d):
    return f"with {gradients(d)} select img, y, x, round(sqrt(cast(gx * gx + gy * gy as double)), 6) as edge from grad"


def thin(d) -> str:
    """Non-maximum suppression in four directions; border pixels are never edges."""
    m = "abs(gx) + abs(gy)"
    direction = "case when abs(gy) <= 0.4142 * abs(gx) then 0 when abs(gy) >= 2.4142 * abs(gx) then 2 when gx * gy > 0 then 1 else 3 end"
    return f"""{gradients(d)}, mag as (select img, y, x, {m} as m, {direction} as dir from grad),
    thin as (select c.img, c.y, c.x, c.m, case when c.m > 0 and c.m >= max(n.m) then 1 else 0 end as peak
      from mag c cross join (select 1 as o union all select -1) a join mag n on n.img = c.img and n.y = c.y + a.o * (case when c.dir = 0 then 0 when c.dir = 3 then -1 else 1 end) and n.x = c.x + a.o * (case when c.dir = 2 then 0 else 1 end)
      where c.y between 1 and {N - 2} and c.x between 1 and {N - 2} group by c.img, c.y, c.x, c.m)"""


def canny_thin(d):
    return f"with {thin(d)} select img, y, x, m, peak from thin"


LOW, HIGH = 150, 260


def canny(d):
    """Seeds at HIGH grow over 8 neighbours at LOW until nothing is added (an image's pixels bound the rounds)."""
    grown = f"""select distinct b.img, b.y, b.x{{lvl}} from grown a join weak b on b.img = a.img and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1{{where}}"""
    head = f"{thin(d)}, weak as (select img, y, x from thin where peak = 1 and m >= {LOW}), seed as (select img, y, x from thin where peak = 1 and m >= {HIGH})"
    if d.name == "duck":
        return f"with recursive {head}, grown(img, y, x) as (select img, y, x from seed union {grown.format(lvl='', where='')}) select img, y, x from grown"
    # An image's edge pixels are one array, grown in place; as many rounds as it has pixels are always enough.
    grow = "aggregate(sequence(1, greatest(size(weak), 1)), seed, (acc, i) -> filter(weak, w -> exists(acc, s -> abs(w.y - s.y) <= 1 and abs(w.x - s.x) <= 1)))"
    return f"""with {thin(d)}, p as (select img, collect_list(case when m >= {LOW} then struct(y, x) end) as weak, collect_list(case when m >= {HIGH} then struct(y, x) end) as seed from thin where peak = 1 group by img)
    select img, q.y, q.x from (select img, explode({grow}) as q from p) z"""


def contrast_kernel(d):
    """+1/N inside a mask, -1/M on its ring, nothing elsewhere."""
    return f"""with {template(d)}, mask as (select label, y, x, case when t > 128 then 1 else 0 end as m from tpl),
    wide as (select label, y, x, m, max(m) over (partition by label, y order by x rows between 1 preceding and 1 following) as h from mask),
    ring as (select label, y, x, m, max(h) over (partition by label, x order by y rows between 1 preceding and 1 following) as big from wide)
    select label, y, x, round(case when m = 1 then 1.0 / sum(m) over (partition by label) else -1.0 / sum(big - m) over (partition by label) end, 9) as w from ring where big = 1"""


def _slide(d) -> str:
    """A 5 x 5 kernel (the template's middle) over all offsets of each image: one row an offset with its moments."""
    return f"""{template(d)}, ker as (select label, y - 1 as ky, x - 1 as kx, t from tpl where y between 1 and 5 and x between 1 and 5),
    offs as (select img, label, oy, ox from (select distinct img, label from px) i cross join {d.seq(0, N - 5, 'oy')} a cross join {d.seq(0, N - 5, 'ox')} b),
    m as (select o.img, oy, ox, count(*) as n, cast(sum(p.g) as bigint) as sx, cast(sum(t) as bigint) as sy, cast(sum(p.g * p.g) as bigint) as sxx, cast(sum(t * t) as bigint) as syy, cast(sum(p.g * t) as bigint) as sxy
      from offs o join ker k on k.label = o.label join px p on p.img = o.img and p.y = o.oy + k.ky and p.x = o.ox + k.kx group by o.img, oy, ox)"""


def ccorr_argmax(d):
    return f"with {_slide(d)} select img, oy, ox, score from (select img, oy, ox, sxy - 128 * sx as score, row_number() over (partition by img order by sxy - 128 * sx desc, oy, ox) as r from m) s where r = 1"


def ccorr_minmax(d):
    r = lambda o: f"row_number() over (partition by img order by sxy - 128 * sx {o}, oy, ox)"
    pick = lambda c, k: f"max(case when {k} = 1 then {c} end)"
    return f"""with {_slide(d)}, r as (select img, oy, ox, sxy - 128 * sx as s, {r('desc')} as hi, {r('asc')} as lo from m)
    select img, {pick('s', 'hi')} as best, {pick('oy', 'hi')} as best_y, {pick('ox', 'hi')} as best_x, {pick('s', 'lo')} as worst, {pick('oy', 'lo')} as worst_y, {pick('ox', 'lo')} as worst_x from r group by img"""


def ncc_argmax(d):
    """Best correlation over the offsets where both sides vary; 0 at the origin where none does."""
    return f"""with {_slide(d)}, s as (select img, oy, ox, n * sxx > sx * sx and n * syy > sy * sy as varies, {pearson('n', 'sx', 'sy', 'sxx', 'syy', 'sxy')} as score from m)
    select img, oy, ox, round(case when varies then score else 0.0 end, 6) as score from (select *, row_number() over (partition by img order by case when varies then 0 else 1 end, case when varies then score end desc, oy, ox) as r from s) z where r = 1"""


def correlated(d) -> str:
    """Correlation of every image with every label's template."""
    return f"""{template(d)}, c as (select img, p.label as own, t.label, {pearson('count(*)', 'sum(g)', 'sum(t)', 'sum(g * g)', 'sum(t * t)', 'sum(g * t)')} as score from px p join tpl t using (y, x) group by img, p.label, t.label)"""


def pearson_query(d):
    return f"with {correlated(d)} select img, label, round(score, 6) as score from c where own = label"


def argmax_first(d):
    return f"with {correlated(d)} select img, label, round(score, 6) as score from (select *, row_number() over (partition by img order by score desc, label) as r from c) s where r = 1"


TILE = 4


def _clahe(d) -> str:
    tile = f"{d.idiv('y', TILE)} as ty, {d.idiv('x', TILE)} as tx"
    return f"{px(d)}, hist as (select img, {tile.split(',')[0]}, {d.idiv('x', TILE)} as tx, g, count(*) as n from px group by img, {d.idiv('y', TILE)}, {d.idiv('x', TILE)}, g)"


def clahe_hist(d):
    return f"with {_clahe(d)} select img, ty, tx, g, n, cast(sum(n) over (partition by img, ty, tx order by g) as bigint) as cum from hist"


def clahe(d):
    """Clip at `cap`, hand the excess out evenly and at even strides, map by cumulative histograms, blended between the
    four tiles around a pixel."""
    cap, area, tiles = max(1, math.floor(2 * TILE * TILE / 256 + 0.5)), TILE * TILE, N // TILE
    at = lambda v: f"({v} + 0.5) * {tiles} / {N} - 0.5"
    near = lambda v: clamp(fl(at(v)), 0, tiles - 1)
    part = lambda v, t: f"case when {t} = 0 then 1 - {clamp01(f'{at(v)} - {near(v)}')} else {clamp01(f'{at(v)} - {near(v)}')} end"
    cumulative = f"sum(case when h.g <= c.g then least(h.n, {cap}) else 0 end) + {d.idiv('excess', 256)} * (c.g + 1) + least(excess % 256, cast(ceil((c.g + 1) * (excess % 256) / 256.0) as bigint))"
    return f"""with {_clahe(d)}, clip as (select img, ty, tx, cast(sum(greatest(0, n - {cap})) as bigint) as excess from hist group by img, ty, tx),
    c as (select img, y, x, g, least({tiles - 1}, {near('y')} + oy) as ty, least({tiles - 1}, {near('x')} + ox) as tx, oy, ox, ({part('y', 'oy')}) * ({part('x', 'ox')}) as w from px cross join {d.seq(0, 1, 'oy')} a cross join {d.seq(0, 1, 'ox')} b),
    lut as (select c.img, c.y, c.x, c.oy, c.ox, c.w, least(255, {jsround(f'({cumulative}) * 255.0 / {area}')}) as v
      from c join hist h on h.img = c.img and h.ty = c.ty and h.tx = c.tx join clip on clip.img = c.img and clip.ty = c.ty and clip.tx = c.tx group by c.img, c.y, c.x, c.oy, c.ox, c.w, c.g, excess)
    select img, y, x, {jsround('round(sum(w * v), 6)')} as g from lut group by img, y, x"""


def stroke_features(d):
    """Share of bright, pale pixels among those that stand out from their surroundings, and of columns that have any."""
    return f"""with {rgb(d)}, gray as (select img, y, x, r, g, b, {jsround('0.299 * r + 0.587 * g + 0.114 * b')} as v, greatest(r, g, b) as mx, least(r, g, b) as mn from rgb), {blurred(d, 'gray', 'v', 1.2, 'bl')},
    s as (select gray.img, gray.x, round(gray.v - bl.v, 9) > 2.5 as out_, mx > 120 and {jsround('cast(mx - mn as double) / greatest(mx, 1) * 255')} < 80 as pale from gray join bl on bl.img = gray.img and bl.y = gray.y and bl.x = gray.x)
    select img, round(avg(case when out_ and pale then 1.0 else 0.0 end), 9) as density, round(count(distinct case when out_ then x end) / {N}.0, 9) as columns from s group by img"""


def alpha_gain_search(d):
    """Gain in 0.35 .. 1.99 (steps of 0.02) at which what is left under the template correlates least with it, first wins.
    What is left: (g - a) / (1 - a) within 0..1, with a the template's share times the gain, 0.99 at most; pixels of no
    share stay.  g is linear light."""
    lin = "case when g <= 10 then g / 255.0 / 12.92 else pow((g / 255.0 + 0.055) / 1.055, 2.4) end"
    left = lambda a, g: f"case when {a} > 0.002 then {clamp01(f'({g} - {a}) / (1 - {a})')} else {g} end"
    if d.name == "spark":  # one row an image: arrays of its pixels, no row for a pixel and gain
        share = "least(z.a * (0.35 + 0.02 * i), 0.99)"
        sums = "aggregate(ps, named_struct('n', 0L, 'x', 0.0, 'y', 0.0, 'xx', 0.0, 'yy', 0.0, 'xy', 0.0), (s, z) -> transform(array({v}), v -> named_struct('n', s.n + 1, 'x', s.x + v, 'y', s.y + z.a, 'xx', s.xx + v * v, 'yy', s.yy + z.a * z.a, 'xy', s.xy + v * z.a))[0])".replace("{v}", left(share, "z.g"))
        return f"""with {template(d)}, p as (select px.img, array_sort(collect_list(struct(px.y, px.x, {lin} as g, t / 255.0 as a))) as ps from px join tpl using (label, y, x) group by px.img),
        c as (select img, transform(transform(sequence(0, 82), i -> {sums}), (s, i) -> struct(round(abs({pearson('s.n', 's.x', 's.y', 's.xx', 's.yy', 's.xy')}), 6) as residual, i as i)) as rs from p)
        select img, round(0.35 + 0.02 * array_min(rs).i, 2) as gain, array_min(rs).residual as residual from c"""
    return f"""with {template(d)}, q as (select img, {lin} as g, t / 255.0 as a from px join tpl using (label, y, x)), e as (select img, a, i, g, least(a * (0.35 + 0.02 * i), 0.99) as sa from q cross join {d.seq(0, 82, 'i')} s), f as (select img, a, i, {left('sa', 'g')} as v from e),
    m as (select img, i, count(*) as n, sum(v) as sx, sum(a) as sy, sum(v * v) as sxx, sum(a * a) as syy, sum(v * a) as sxy from f group by img, i), c as (select img, i, round(abs({pearson('n', 'sx', 'sy', 'sxx', 'syy', 'sxy')}), 6) as residual from m)
    select img, round(0.35 + 0.02 * i, 2) as gain, residual from (select *, row_number() over (partition by img order by residual, i) as r from c) z where r = 1"""


def feather_blend(d):
    """A region is blended in under its blurred mask (sigma 1.6); values of at most 1.5 are taken for shares of 255."""
    inside = "case when (x - 4) * (x - 4) + (y - 4) * (y - 4) <= 4 then 1 else 0 end"
    return f"""with {px(d)}, made as (select img - 1 as img, y, x, case when img % 2 = 0 then g / 255.0 else cast(g as double) end as v from px), scaled as (select img, y, x, {clamp(jsround("v * case when max(v) over (partition by img) <= 1.5 then 255 else 1 end"), 0, 255)} as v from made),
    {blurred(d, 'px', inside, 1.6, 'bl')}, a as (select px.img, px.y, px.x, px.g, s.v as made, round({clamp01('bl.v')}, 9) as alpha from px join bl on bl.img = px.img and bl.y = px.y and bl.x = px.x join scaled s on s.img = px.img and s.y = px.y and s.x = px.x)
    select img, y, x, case when alpha <= 0.002 then g else {jsround('round(made * alpha + g * (1 - alpha), 6)')} end as g from a"""


def build_inputs(d, to: int = 12):
    """Planes of a model's input: colours as shares, resampled between pixel centres, and a mask taken at the nearest one."""
    pos = lambda v: clamp(f"({v} + 0.5) * {N}.0 / {to} - 0.5", "0.0", f"{N - 1}.0")
    src = lambda v: f"least({N - 1}, {fl(f'({v} + 0.5) * {N}.0 / {to}')})"
    planes = " union all ".join(f"select {k} as plane, img, y, x, {c} / 255.0 as v from rgb" for k, c in enumerate("rgb"))
    return f"""with {rgb(d)}, pl as ({planes}), dst as (select dy, dx, {pos('dy')} as sy, {pos('dx')} as sx from {d.seq(0, to - 1, 'dy')} a cross join {d.seq(0, to - 1, 'dx')} b),
    w as (select dy, dx, {fl('sy')} + oy as y, {fl('sx')} + ox as x, (case when oy = 0 then 1 - (sy - floor(sy)) else sy - floor(sy) end) * (case when ox = 0 then 1 - (sx - floor(sx)) else sx - floor(sx) end) as wt from dst cross join {d.seq(0, 1, 'oy')} a cross join {d.seq(0, 1, 'ox')} b)
    select plane, img, dy as y, dx as x, round(sum(v * wt), 6) as v from pl join w using (y, x) where wt > 0 group by plane, img, dy, dx
    union all select 3, img, dy, dx, case when r > 128 then 1.0 else 0.0 end from rgb join dst on rgb.y = {src('dy')} and rgb.x = {src('dx')}"""


QUERIES = {
    **{f.__name__: f for f in (
        gray_quantize, luma709, gray_fixedpoint, rgb_to_hsv, srgb_linear, resize_nearest, resize_area, resize_bilinear, crop, masked_rgb,
        raster_shapes, mask_in_window, mask_unpack, dilate_square, gauss_kernel, gaussian_blur, sobel_l1, edge_magnitude, canny_thin, canny,
        contrast_kernel, ccorr_argmax, ccorr_minmax, ncc_argmax, argmax_first, clahe_hist, clahe, stroke_features, alpha_gain_search, feather_blend, reflect_index, build_inputs,
    )},
    "pearson": pearson_query,
}
