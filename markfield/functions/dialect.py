"""SQL text that Spark and DuckDB both run: an operator is declared once and rendered for either engine."""

from __future__ import annotations

import re
from collections.abc import Callable

_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


class Spark:
    """Renders for Catalyst; tables are read from the data folder."""

    name = "spark"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def t(self, table: str) -> str:
        return f"parquet.`{self.sf_dir}/{table}.parquet`"

    def idiv(self, a, b) -> str:
        return f"(({a}) div ({b}))"

    def each(self, table: str, array: str, keep: str, item: str = "v", place: str = "p") -> str:
        return f"(select {keep}, posexplode({array}) as ({place}, {item}) from {self.t(table)})"

    def seq(self, a, b, name: str) -> str:
        return f"(select explode(sequence(cast({a} as bigint), cast({b} as bigint))) as {name})"

    def upto(self, n, name: str) -> str:
        """A select item that makes rows 0 .. n - 1 of each row (none for n = 0)."""
        return f"explode(case when {n} > 0 then sequence(0L, cast({n} as bigint) - 1) else array() end) as {name}"

    def match(self, s: str, pattern: str) -> str:
        return f"({s} rlike r'{pattern}')"

    def replace(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, r'{pattern}', '{to}')"

    def gather(self, value: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order} as o, {value} as v))), z -> z.v)"

    def words(self, s: str) -> str:
        return f"split({s}, ' ')"

    def pick(self, array: str, i) -> str:
        return f"element_at({array}, cast({i} as int))"

    def count_if(self, c: str) -> str:
        return f"count_if({c})"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')"


class Duck(Spark):
    name = "duck"

    def __init__(self):
        super().__init__("")

    def t(self, table: str) -> str:
        return table

    def idiv(self, a, b) -> str:
        return f"(({a}) // ({b}))"

    def each(self, table: str, array: str, keep: str, item: str = "v", place: str = "p") -> str:
        return f"(select {keep}, unnest({array}) as {item}, unnest(range(len({array}))) as {place} from {table})"

    def seq(self, a, b, name: str) -> str:
        return f"(select unnest(range({a}, {b} + 1)) as {name})"

    def upto(self, n, name: str) -> str:
        return f"unnest(range(cast({n} as bigint))) as {name}"

    def match(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, '{pattern}')"

    def replace(self, s: str, pattern: str, to: str) -> str:
        return f"regexp_replace({s}, '{pattern}', '{to}', 'g')"

    def gather(self, value: str, order: str) -> str:
        return f"list({value} order by {order})"

    def words(self, s: str) -> str:
        return f"string_split({s}, ' ')"

    def pick(self, array: str, i) -> str:
        return f"{array}[{i}]"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, '{by}')"


def render(operator: Callable, dialect: Spark) -> str:
    """The operator's SQL; decimal literals are doubles in both engines."""
    return _DECIMAL.sub(r"\1e0", operator(dialect))


# Expressions with the numeric rules of the pixel domain.


def fl(x) -> str:
    return f"cast(floor({x}) as bigint)"


def jsround(x) -> str:
    """Half goes up, for negative numbers too."""
    return fl(f"({x}) + 0.5")


def clamp(x, lo, hi) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def clamp01(x) -> str:
    return clamp(x, "0.0", "1.0")


def reflect(i, n) -> str:
    """Mirror at the borders without repeating the edge, as often as it takes: a triangle wave of period 2n - 2."""
    period = f"greatest(2 * {n} - 2, 1)"
    wave = f"((({i}) % {period} + {period}) % {period})"
    return f"(case when {n} = 1 then 0 when {wave} >= {n} then {period} - {wave} else {wave} end)"


def pearson(n, sx, sy, sxx, syy, sxy) -> str:
    """Correlation from moments; 0 where a variance is not positive."""
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    return f"(case when {vx} <= 0 or {vy} <= 0 then 0.0 else ({n} * {sxy} - {sx} * {sy}) / sqrt(cast({vx} as double) * cast({vy} as double)) end)"


def overlap(a: str, b: str) -> str:
    """Intersection of two boxes (x, y, w, h) over the smaller one's area."""
    w = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(cast({w} * {h} as double) / greatest(1, least({a}.w * {a}.h, {b}.w * {b}.h)))"
