"""Operator 4: quality rules with robust multivariate outliers (DataFrame and SQL functions only).

Base rules on whole texts, then per (lang, source) a minimum-covariance-determinant estimate of five transformed
statistics; a document whose Mahalanobis distance is beyond the chi-square threshold is rejected.

Pools.  A (lang, source) with LEAST documents or more is estimated from its own documents; a smaller one is judged by the
estimate of all documents of its language, and if the language has under LEAST, of all documents.  So every document
that passes the base rules is judged, whatever the size of its group.

The statistics are whole numbers (square roots of ratios in thousandths, the fourth root of the word count in
hundredths), so all sums are exact and the estimate does not depend on how rows are dealt out.  Two deterministic
starts (median and MAD, by Euclidean and by maximum norm) are improved by concentration steps for as long as the
determinant falls; the one with the smaller determinant counts, and its estimate is reweighted once: mean and covariance
of all rows within the chi-square distribution's 0.975 quantile.  A concentration step needs a subset of the h nearest
rows: its cut is found on counts of distances in 1/64 steps, in two levels of at most 256 counts, so no group is ever
sorted or collected; rows that share the cut's step all belong.  Squared floors on the diagonal keep the determinant
positive where a statistic is constant.

Defined cases: null text has no words; null lang or source is the empty string; documents that fail a base rule do
not enter the estimates; repeated rows count each; an empty table gives an empty result; other columns pass by, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.shared import SPACE, cut, let, settled, table, text_or_empty

STATS = ("x1", "x2", "x3", "x4", "x5")
#: Least standard deviation of each statistic, in its own unit.
FLOORS = (150, 100, 90, 150, 110)
#: Share of rows in the subset, its consistency factor for 5 statistics (0.75 over the chi-square distribution with 7
#: degrees of freedom at the 0.75 quantile of that with 5); the 0.975 quantile for reweighting and its factor; the
#: quantile at 0.999999 beyond which a document is rejected.
SUBSET, CONSISTENCY, WEIGHTED, WEIGHT_FACTOR, CUTOFF = 0.75, 1.412071, 12.832502, 1.055533, 35.857276
#: Documents that a pool of its own takes; greatest step of a distance; counts of the finer level in one of the coarser.
LEAST, BINS, WIDE = 40, 65535, 256
#: Files of the tables that have a row a group.
FILES = 8


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words inside a window of `window` words that the text has twice or more."""

    def of(w: Column) -> Column:
        n = F.size(w) - (window - 1)
        keys = F.slice(w, F.lit(1), F.greatest(n, F.lit(0)))
        for k in range(1, window):  # slices beside each other cost less than indexing word by word
            keys = F.zip_with(keys, F.slice(w, F.lit(k + 1), F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.when(n < 2, F.lit(0)).otherwise(let(keys, covered))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(placed, positions))

    def positions(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        starts = F.array_distinct(F.flatten(F.array_compact(same)))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[i + k for k in range(window)])))))

    return let(words, of).cast("long")


def base_columns(text: Column) -> Column:
    """struct n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one text."""
    words = F.array_remove(F.split(text, F.lit(SPACE + "+")), "")
    lines = F.filter(F.split(text, F.lit("\n")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.char_length(F.regexp_replace(text, F.lit("[^#*$%&|<>]+"), F.lit(""))).cast("long").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
        ).alias("lines"),
    )


#: Fixed transforms, in SQL that Spark and DuckDB read alike.
TRANSFORMS = (
    "cast(floor(100 * sqrt(sqrt(cast(n_words as double)))) as bigint)",
    "cast(floor(1000 * sqrt(cast(word_chars as double) / greatest(n_words, 1))) as bigint)",
    "cast(floor(1000 * sqrt(cast(n_symbols as double) / greatest(word_chars, 1))) as bigint)",
    "cast(floor(1000 * sqrt(cast(n_dup_lines as double) / greatest(n_lines, 1))) as bigint)",
    "cast(floor(1000 * sqrt(cast(n_repeat_words as double) / greatest(n_words, 1))) as bigint)",
)
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
P = len(STATS)


def _moments() -> list[str]:
    """Exact sums of a subset: n, s1.., s11.."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    return ["count(*) as n", *(f"sum({STATS[i]}) as s{i}" for i in range(P)), *(f"sum({STATS[i]} * {STATS[j]}) as s{i}{j}" for i, j in pairs)]


def _estimate() -> list[list[str]]:
    """Projections that turn the sums into means m, the Cholesky factor l and the determinant; each level uses the
    columns of the one before."""
    mean = [f"cast(s{i} as double) / n as m{i}" for i in range(P)]
    cov = [
        f"(cast(s{i}{j} as double) - cast(s{i} as double) * cast(s{j} as double) / n) / n" + (f" + {FLOORS[i] ** 2}e0" if i == j else "") + f" as c{i}{j}"
        for i in range(P)
        for j in range(i + 1)
    ]
    levels = [[*mean, *cov]]
    for j in range(P):  # column j of the factor
        minus = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        levels.append([f"sqrt(c{j}{j}{minus(j)}) as l{j}{j}"])
        if j < P - 1:
            levels.append([f"(c{i}{j}{minus(i)}) / l{j}{j} as l{i}{j}" for i in range(j + 1, P)])
    levels.append([" * ".join(f"l{j}{j}" for j in range(P)) + " as det"])
    return levels


def _distance() -> list[str]:
    """Levels of the forward substitution z, then d2."""
    levels = []
    for i in range(P):
        levels.append(f"(({STATS[i]} - m{i})" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} as z{i}")
    return [*levels, " + ".join(f"z{i} * z{i}" for i in range(P)) + " as d2"]


_PARAMS = [*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)), "det"]
#: Pools of a row, as text, and where the two norms of the starts come from.
OWN, LANG, ALL = "concat('2', cast(length(lang) as varchar(20)), ':', lang, source)", "concat('1', lang)", "'0'"
_POOL = f"case when n >= {LEAST} then {OWN} when n_lang >= {LEAST} then {LANG} else {ALL} end"
_EUCLID = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(P)) + ")"
_MAXIMUM = "greatest(" + ", ".join(f"abs(z{i})" for i in range(P)) + ")"
_SCALED = [f"({STATS[i]} - mid{i}) / greatest(1.4826e0 * mad{i}, {FLOORS[i]}e0) as z{i}" for i in range(P)]
_bin = lambda d: f"least(cast(floor(64 * {d}) as bigint), {BINS}) as bin"
_REWEIGHTED = f"d2 <= {WEIGHTED * CONSISTENCY:.6f}e0"
_ACCEPTED = f"d2 <= {CUTOFF * WEIGHT_FACTOR:.6f}e0"


def _levels(df: DataFrame, levels: list[list[str]]) -> DataFrame:
    """df with the columns of all levels; each level uses those before it (as aliases of the same selection, so that the
    plan is analysed once and not once a level)."""
    return df.selectExpr("*", *(x for level in levels for x in level))


def _reached(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per group the least value (a whole number from 0) that `share` of its rows do not exceed, as `mid`.  Counts are
    summed in two levels, so no window has more than the coarse steps of a group or WIDE fine ones."""
    by = ", ".join(keys)
    fine = rows.groupBy(*keys, value).agg(F.count("*").alias("c")).selectExpr("*", f"{value} div {WIDE} as wide")
    coarse = fine.groupBy(*keys, "wide").agg(F.sum("c").alias("cw"))
    coarse = coarse.selectExpr("*", f"sum(cw) over (partition by {by} order by wide) as upto", f"sum(cw) over (partition by {by}) as total")
    at = coarse.where(f"upto >= ceil({share}e0 * total) and upto - cw < ceil({share}e0 * total)").selectExpr(*keys, "wide", "upto - cw as below", "total")
    near = fine.join(at, [*keys, "wide"]).selectExpr("*", f"below + sum(c) over (partition by {by} order by {value}) as cum")
    return near.where(f"cum >= ceil({share}e0 * total)").groupBy(*keys).agg(F.min(value).alias("mid"))


def pools(stats: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, pool string (whose estimate judges the group) and feeds array<string> (the pools that its documents
    enter) of every group of stats (lang, source)."""
    pool = _POOL.replace(f">= {LEAST}", f">= {least}")
    groups = cut(stats.groupBy("lang", "source").agg(F.count("*").alias("n")), FILES)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("smallest"))
    everything = bool(langs.where(F.col("n_lang") < least).limit(1).collect())
    feeds = f"array(case when n >= {least} then {OWN} end, case when n_lang >= {least} and smallest < {least} then {LANG} end, {ALL if everything else 'null'})"
    return groups.join(langs, "lang").selectExpr("lang", "source", f"{pool} as pool", f"array_compact({feeds}) as feeds")


def _subset_estimate(binned: DataFrame) -> DataFrame:
    """One concentration step: moments of the rows up to the cut, then mean and factor."""
    last = _reached(binned, ["pool", "start"], "bin", SUBSET).withColumnRenamed("mid", "last_bin")
    chosen = binned.join(last, ["pool", "start"]).where("bin <= last_bin")
    sums = chosen.groupBy("pool", "start").agg(*[F.expr(x) for x in _moments()])
    return _levels(sums, _estimate()).select("pool", "start", *_PARAMS)


def _with_distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    return _levels(rows.join(params, "pool"), [[x] for x in _distance()])


@settled(FILES)
def mcd(rows: DataFrame) -> DataFrame:
    """pool, means m0.., factor l00.. of the reweighted minimum-covariance-determinant estimate over rows of
    (pool, x1..x5 long), which are read several times."""
    long = rows.selectExpr("pool", f"stack({P}, " + ", ".join(f"{i}, {x}" for i, x in enumerate(STATS)) + ") as (k, x)")
    middle = cut(_reached(long, ["pool", "k"], "x", 0.5), FILES)
    spread = _reached(long.join(middle, ["pool", "k"]).selectExpr("pool", "k", "abs(x - mid) as away"), ["pool", "k"], "away", 0.5)
    both = middle.join(spread.withColumnRenamed("mid", "mad"), ["pool", "k"])
    at = lambda i, x: F.max(F.when(F.col("k") == i, F.col(x)))
    first = cut(both.groupBy("pool").agg(*[at(i, x).alias(f"{x}{i}") for i in range(P) for x in ("mid", "mad")]), FILES)
    starts = rows.join(first, "pool").selectExpr("*", *_SCALED)
    starts = starts.selectExpr("pool", *STATS, f"stack(2, 0, {_EUCLID}, 1, {_MAXIMUM}) as (start, d)").selectExpr("*", _bin("d"))
    best = cut(_subset_estimate(starts).withColumn("falls", F.lit(True)), FILES)
    while best.where("falls").limit(1).collect():  # estimates whose determinant fell are improved once more
        binned = _with_distance(rows, best.where("falls")).selectExpr("pool", "start", *STATS, _bin("sqrt(d2)"))
        new = _subset_estimate(binned).selectExpr("pool", "start", *(f"{c} as new_{c}" for c in _PARAMS))
        both = best.join(new, ["pool", "start"], "left").withColumn("falls", F.coalesce(F.expr("new_det < det"), F.lit(False)))
        best = cut(both.selectExpr("pool", "start", *(f"case when falls then new_{c} else {c} end as {c}" for c in _PARAMS), "falls"), FILES)
    chosen = best.groupBy("pool").agg(F.min(F.struct("det", "start", *_PARAMS[:-1])).alias("b")).selectExpr("pool", *(f"b.{c}" for c in _PARAMS))
    near = _with_distance(rows, chosen).where(_REWEIGHTED)
    return _levels(near.groupBy("pool").agg(*[F.expr(x) for x in _moments()]), _estimate()).select("pool", *_PARAMS)


def quality_statistics(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, lang, source, the base columns, base_failed and x1..x5 of every document, and more columns."""
    base = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        base_columns(text_or_empty()).alias("b"),
        *[c.alias(name) for name, c in more.items()],
    )
    base = base.selectExpr(
        "doc_id", "lang", "source", "b.w.n_words", "b.w.word_chars", "b.n_symbols", "b.lines.dup as n_dup_lines",
        "b.w.n_repeat_words", "b.lines.n as n_lines", *more,
    )
    return base.selectExpr("*", f"{BASE_FAILED} as base_failed", *(f"{t} as {x}" for t, x in zip(TRANSFORMS, STATS, strict=True)))


@settled(FILES)
def _estimates(stats: DataFrame, least: int) -> DataFrame:
    """lang, source, means and factor of the estimate that judges the group: a few numbers a group."""
    good = stats.where("not base_failed").select("lang", "source", *STATS)
    known = pools(good, least)
    params = mcd(cut(good.join(known, ["lang", "source"]).select(F.explode("feeds").alias("pool"), *STATS)))
    return known.select("lang", "source", "pool").join(params, "pool").drop("pool")


def judged(stats: DataFrame, least: int = LEAST) -> DataFrame:
    """quality_statistics with d2 (null where a base rule fails and no document of its group passes) and kept.  `stats` is
    read several times."""
    told = _estimates(stats, least)
    joined = _levels(stats.join(told, ["lang", "source"], "left"), [[x] for x in _distance()])
    return joined.selectExpr("*", f"not base_failed and coalesce({_ACCEPTED}, false) as kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(quality_statistics(table(spark, sf_dir, "documents")))
    return judged(stats).selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.  What is written on the way has no texts: a document is known by its
    doc_id, lang and source and the text's hash and length, and those that are alike in these have one verdict."""
    gone = _rejected(docs).withColumnsRenamed({c: f"gone_{c}" for c in _identity()})
    same = [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in _identity()]
    return docs.withColumns(_identity()).join(gone.hint("shuffle_hash"), same, "left_anti").select(*docs.columns)


def _identity() -> dict[str, Column]:
    """What tells documents apart."""
    group = {f"{c}__": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")}
    return {"id__": F.col("doc_id"), **group, "hash__": F.xxhash64(text_or_empty()), "bytes__": F.octet_length(text_or_empty())}


@settled()
def _rejected(docs: DataFrame) -> DataFrame:
    """The columns of _identity of the documents that go."""
    return judged(cut(quality_statistics(docs, **_identity()))).where("not kept").select(*_identity()).distinct()


def _oracle() -> str:
    """The same rules in DuckDB's SQL: base columns by unnesting, then the shared expressions level by level."""
    ctes, last = [], ""

    def add(name: str, sql: str) -> None:
        nonlocal last
        ctes.append(f"{name} as materialized ({sql})")
        last = name

    add("told", "select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents")
    add("tok", r"select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ln from told")
    add("win", "select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from tok)")
    add("twice", "select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1")
    add("rep", "select r, count(distinct i + k) as n_repeat_words from twice, (values (0), (1), (2)) as t(k) group by r")
    add("base", """select t.doc_id, t.lang, t.source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
      cast(length(regexp_replace(t.text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(ln) - len(list_distinct(ln)) as bigint) as n_dup_lines,
      cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(ln) as bigint) as n_lines from told t join tok using (r) left join rep using (r)""")
    add("stats", f"select *, {BASE_FAILED} as base_failed, " + ", ".join(f"{t} as {x}" for t, x in zip(TRANSFORMS, STATS, strict=True)) + " from base")
    add("good", "select * from stats where not base_failed")
    add("sizes", "select *, sum(n) over (partition by lang) as n_lang, min(n) over (partition by lang) as smallest, min(n_all) over () as few from (select lang, source, count(*) as n, sum(count(*)) over (partition by lang) as n_all from good group by lang, source)")
    add("told_pool", f"select lang, source, {_POOL} as pool from sizes")
    mine, lang = f"select {OWN} as pool, {', '.join(STATS)} from good join sizes using (lang, source) where n >= {LEAST}", f"select {LANG}, {', '.join(STATS)} from good join sizes using (lang, source) where n_lang >= {LEAST} and smallest < {LEAST}"
    add("fed", f"{mine} union all {lang} union all select {ALL}, {', '.join(STATS)} from good join sizes using (lang, source) where few < {LEAST}")

    def reached(rows: str, keys: str, value: str, share: float) -> str:
        each = f"select *, sum(c) over (partition by {keys} order by {value}) as cum, sum(c) over (partition by {keys}) as total from (select {keys}, {value}, count(*) as c from {rows} group by all)"
        return f"select {keys}, min({value}) as mid from ({each}) where cum >= ceil({share}e0 * total) group by {keys}"

    add("long", " union all ".join(f"select pool, {i} as k, {x} as x from fed" for i, x in enumerate(STATS)))
    add("middle", reached("long", "pool, k", "x", 0.5))
    add("off", "select pool, k, abs(x - mid) as away from long join middle using (pool, k)")
    add("spread", reached("off", "pool, k", "away", 0.5))
    add("first", "select pool, " + ", ".join(f"max(middle.mid) filter (k = {i}) as mid{i}, max(spread.mid) filter (k = {i}) as mad{i}" for i in range(P)) + " from middle join spread using (pool, k) group by pool")
    add("scaled", f"select fed.*, {', '.join(_SCALED)} from fed join first using (pool)")
    cols = ", ".join(STATS)
    add("b0", f"select pool, 0 as start, {cols}, {_bin(_EUCLID)} from scaled union all select pool, 1, {cols}, {_bin(_MAXIMUM)} from scaled")
    for t in range(ORACLE_STEPS + 1):  # an estimate that no longer falls stays as it is
        add(f"near{t}", reached(f"b{t}", "pool, start", "bin", SUBSET))
        add(f"e{t}_0", f"select pool, start, {', '.join(_moments())} from b{t} join near{t} using (pool, start) where bin <= mid group by all")
        for k, level in enumerate(_estimate(), 1):
            add(f"e{t}_{k}", f"select *, {', '.join(level)} from e{t}_{k - 1}")
        if t:
            add(f"p{t}", "select pool, start, " + ", ".join(f"case when e.det < p.det then e.{c} else p.{c} end as {c}" for c in _PARAMS) + f" from p{t - 1} p join {last} e using (pool, start)")
        else:
            add("p0", f"select pool, start, {', '.join(_PARAMS)} from {last}")
        if t < ORACLE_STEPS:
            add(f"z{t}_0", f"select fed.*, p.* exclude (pool) from fed join p{t} p using (pool)")
            for k, x in enumerate(_distance(), 1):
                add(f"z{t}_{k}", f"select *, {x} from z{t}_{k - 1}")
            add(f"b{t + 1}", f"select pool, start, {cols}, {_bin('sqrt(d2)')} from {last}")
    add("best", f"select pool, {', '.join(_PARAMS)} from p{ORACLE_STEPS} qualify row_number() over (partition by pool order by det, start) = 1")
    add("w0", "select fed.*, best.* exclude (pool) from fed join best using (pool)")
    for k, x in enumerate(_distance(), 1):
        add(f"w{k}", f"select *, {x} from w{k - 1}")
    add("r0", f"select pool, {', '.join(_moments())} from {last} where {_REWEIGHTED} group by pool")
    for k, level in enumerate(_estimate(), 1):
        add(f"r{k}", f"select *, {', '.join(level)} from r{k - 1}")
    add("f0", f"select stats.*, r.* exclude (pool) from stats left join told_pool using (lang, source) left join (select pool, {', '.join(_PARAMS)} from {last}) r using (pool)")
    for k, x in enumerate(_distance(), 1):
        add(f"f{k}", f"select *, {x} from f{k - 1}")
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({_ACCEPTED}, false) as kept from {last}"


#: Concentration steps that the SQL has written out; the estimates of the test data settle within them.
ORACLE_STEPS = 16
OP4_SQL = _oracle()
