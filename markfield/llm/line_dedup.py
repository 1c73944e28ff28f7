"""Operator 1: line dedup by a log-template tree (DataFrame functions only).

Lines are split at single spaces; tokens with a digit are variable fields and become `<*>` (a line that would be mostly
fields stays as it is).  The tree has a fixed depth: token count, then the first DEPTH tokens; a leaf holds the lines
that agree in these.  Lines of under MIN_TOKENS tokens are leaves of their own, as they are.

A leaf is divided into groups of similar lines, the components of all its links.  Lines that agree with the leaf's first
template at SIMILARITY (four fifths) of their positions or more are linked through it; the template has at each position
the token that most of the leaf's distinct lines have.  Besides, any two lines of a leaf that agree at SIMILARITY of their
positions are linked.  Two lines with at most k of n positions different share one of the k + 1 segments of the positions
after the leading ones.  A first round compares a segment's lines with its first line (by digest) only; what that joins is
one part, and the last round compares all lines of different parts that share a segment, so a large group is not paired
within itself and no link is lost.  Lines without a link are templates of their own.

A template that two documents have recurs: its lines stay in the document with the smallest doc_id and are dropped
everywhere else.  Only hashes of lines are shuffled; the texts of one line for each distinct content are fetched for leaves
with several.  Counts are aggregated before each shuffle, and frequent lines meet the small side of joins that Spark can
split.

Defined cases: null text is empty; lines of white space only are never dropped; rows with one doc_id and one text are one
document, both rows keep or lose the same lines; a null doc_id counts as larger than all; documents that lose all lines
stay with an empty text; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.components import components
from markfield.llm.shared import cut, let, settled, table, text_or_empty

DEPTH, MIN_TOKENS = 3, 5
LAST = 2**63 - 1


def masked(line: Column) -> Column:
    """The line with its variable fields generalised."""
    fields = F.regexp_replace(line, F.lit("[^ ]*[0-9][^ ]*"), F.lit("<*>"))
    return F.when(~line.rlike("[0-9]"), line).otherwise(let(fields, lambda m: F.when(2 * _count(m, "<*>") > _count(m, " ") + 1, line).otherwise(m)))


def _count(c: Column, what: str) -> Column:
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(what), F.lit("")))) / F.lit(len(what))).cast("int")


def lines_of(docs: DataFrame) -> DataFrame:
    """d long, h long (the document), at int, leaf long, m long of every line that is not white space only."""
    text = text_or_empty()
    each = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("h"), F.posexplode_outer(F.split(text, F.lit("\n"))).alias("at", "line")
    ).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    long = _count(F.col("line"), " ") + 1 >= MIN_TOKENS
    each = each.withColumn("long", long).withColumn("line", F.when(F.col("long"), masked(F.col("line"))).otherwise(F.col("line")))
    n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    m = F.xxhash64("line")
    return each.select("d", "h", "at", F.when(F.col("long"), F.xxhash64(n, F.substring_index("line", " ", DEPTH))).otherwise(m).alias("leaf"), m.alias("m"))


def contents_of(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """m long, leaf long, tokens array<string> of line contents.  contents: m, leaf, d, h, at (one place of each)."""
    wanted = contents.groupBy("d", "h").agg(F.collect_list(F.struct("at", "m", "leaf")).alias("wanted"))
    text = text_or_empty()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = texts.join(wanted, ["d", "h"])
    lines = F.split("text", F.lit("\n"))
    picked = found.select(let(lines, lambda ls: F.transform("wanted", lambda w: F.struct(w["m"].alias("m"), w["leaf"].alias("leaf"), F.split(masked(F.get(ls, w["at"])), F.lit(" ")).alias("tokens")))).alias("p"))
    return picked.select(F.explode_outer("p").alias("p")).where("p is not null").select("p.m", "p.leaf", "p.tokens").groupBy("m", "leaf").agg(F.min("tokens").alias("tokens"))


def _same(a: Column, b: Column) -> Column:
    """Positions at which two lists of tokens agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _alike(a: str, b: str) -> Column:
    """Whether two lists of tokens of one length agree at SIMILARITY of their positions."""
    return _same(F.col(a), F.col(b)) >= F.size(a) - F.floor(F.size(a) / 5)


def _segments(told: DataFrame) -> DataFrame:
    """m, o (the line's digest), part, s (a segment's hash) of the segments that several parts have."""
    n = F.size("tokens")
    k = F.floor(n / 5).cast("int")  # positions that may differ
    rest = F.slice("tokens", DEPTH + 1, n)

    def segment(i: Column) -> Column:
        a, b = (F.floor(x * (n - DEPTH) / (k + 1)).cast("int") for x in (i, i + 1))
        return F.xxhash64("leaf", i, F.array_join(F.slice(rest, a + 1, b - a), " "))

    each = told.select("m", F.md5(F.array_join("tokens", " ")).alias("o"), "part", F.explode(F.transform(F.sequence(F.lit(0), k), segment)).alias("s"))
    return _of_several(cut(each))


def _of_several(segments: DataFrame) -> DataFrame:
    return segments.join(segments.groupBy("s").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("s"), "s", "left_semi")


def _similar(told: DataFrame) -> DataFrame:
    """part long, key long (a part of its group) of the parts that are linked with some other.  told: m, leaf, tokens, part
    (lines that are known to be of one group) of the contents of leaves with several parts."""
    segments = cut(_segments(told))
    tokens = told.select("m", "tokens")
    first = segments.groupBy("s").agg(F.min(F.struct("o", "m", "part")).alias("f")).select("s", F.col("f.m").alias("head"), F.col("f.part").alias("other_part"))
    pairs = segments.join(first, "s").where("part != other_part").select("m", "head", "part", "other_part").distinct()
    both = pairs.join(tokens, "m").join(tokens.withColumnsRenamed({"m": "head", "tokens": "other"}), "head")
    found = cut(both.where(_alike("tokens", "other")).select(F.col("part").alias("u"), F.col("other_part").alias("v")).distinct())
    joined = components(found).withColumnsRenamed({"node": "part", "component": "c__"})
    rest = segments.join(joined, "part", "left").select("m", F.coalesce("c__", "part").alias("part"), "s")
    rest = cut(_of_several(cut(rest)).join(tokens, "m"))
    other = rest.select("s", F.col("m").alias("m2"), F.col("part").alias("part2"), F.col("tokens").alias("other"))
    last = rest.join(other, "s").where((F.col("part") < F.col("part2")) & _alike("tokens", "other")).select(F.col("part").alias("u"), F.col("part2").alias("v"))
    return components(found.unionByName(last.distinct())).withColumnsRenamed({"node": "part", "component": "key"})


@settled()
def templates(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """m long, key long (a line content of its group) of the line contents that share a group with others.  contents: m,
    leaf, d, h, at (one place of each) of leaves with several."""
    picked = cut(contents_of(docs, contents))
    votes = picked.select("leaf", F.posexplode("tokens").alias("i", "token")).groupBy("leaf", "i", "token").agg(F.count("*").alias("n"))
    modal = votes.groupBy("leaf", "i").agg(F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("best"))
    template = modal.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("i", F.col("best.token").alias("token")))).alias("t"))
    agree = picked.join(template.select("leaf", F.transform("t", lambda x: x["token"]).alias("t")), "leaf").select("m", "leaf", "tokens", _alike("tokens", "t").alias("g"))
    agree = cut(agree)
    hubs = agree.groupBy("leaf").agg(F.min(F.when(F.col("g"), F.col("m"))).alias("hub"), F.count_if(~F.col("g")).alias("others"))
    told = cut(agree.join(hubs, "leaf").select("m", "leaf", "tokens", "others", F.when(F.col("g"), F.col("hub")).otherwise(F.col("m")).alias("part")))
    alike = _similar(told.where("others > 0").select("m", "leaf", "tokens", "part"))
    return told.join(alike, "part", "left").select("m", F.coalesce("key", "part").alias("key"))


def recurring(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """m long, first long: line contents whose template two documents have, and the smallest of these."""
    contents = cut(
        lines.groupBy("m", "leaf").agg(F.min(F.struct("d", "h", "at")).alias("place"), F.min("d").alias("first"), F.max("d").alias("last"))
    )
    several = contents.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    shared = templates(docs, contents.join(several, "leaf").select("m", "leaf", "place.*"))
    keyed = cut(contents.join(shared, "m", "left").select("m", "first", "last", F.coalesce("key", "m").alias("key")))
    spread = keyed.groupBy("key").agg(F.min("first").alias("f"), F.max("last").alias("l")).where("f < l")
    return keyed.join(spread, "key").select("m", F.col("f").alias("first"))


@settled()
def _dropped(docs: DataFrame) -> DataFrame:
    """d, h long (a document), drop__ array<int>: the places of its lines that go, of documents that lose some."""
    lines = cut(lines_of(docs))
    return lines.join(recurring(docs, lines), "m").where("d > first").groupBy("d", "h").agg(F.collect_set("at").alias("drop__"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of docs with text reduced to the kept lines, and n_lines__, n_dropped__ long."""
    drop = _dropped(docs)
    text = text_or_empty()
    keyed = docs.withColumns({"d__": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "h__": F.xxhash64(text)})
    joined = keyed.join(drop.withColumnsRenamed({"d": "d__", "h": "h__"}), ["d__", "h__"], "left")
    places = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "drop__")
    kept = let(F.split(text, F.lit("\n")), lambda ls: F.array_join(F.transform(places(ls), lambda i: F.get(ls, i)), "\n"))
    return joined.select(
        *[(F.when(F.col("drop__").isNull(), F.col("text")).otherwise(kept)).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size(F.split(text, F.lit("\n"))).cast("long").alias("n_lines__"),
        F.coalesce(F.size("drop__"), F.lit(0)).cast("long").alias("n_dropped__"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_lines__").alias("n_lines"),
        F.col("n_dropped__").alias("n_dropped"),
        F.char_length(text_or_empty()).cast("long").alias("kept_chars"),
        F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"),
    )


OP1_SQL = rf"""
with recursive told as materialized (select row_number() over () as r, coalesce(doc_id, {LAST}) as d, doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l0 as materialized (select r, d, unnest(ls) as raw, unnest(range(len(ls))) as place from told),
l1 as (select *, len(string_split(raw, ' ')) >= {MIN_TOKENS} as long, regexp_replace(raw, '[^ ]*[0-9][^ ]*', '<*>', 'g') as f from l0 where regexp_matches(raw, '[^\x20\x09-\x0D]')),
l as materialized (select r, d, place, long, case when not long or 2 * ((length(f) - length(replace(f, '<*>', ''))) / 3) > len(string_split(f, ' ')) then raw else f end as m from l1),
c as materialized (select m, bool_or(long) as long, string_split(m, ' ') as t, min(d) as first, max(d) as last from l group by m),
leaf as materialized (select *, len(t) || ' ' || array_to_string(t[1:{DEPTH}], ' ') as leaf, len(t) - len(t) // 5 as need from c where long),
votes as (select leaf, i, token, count(*) as n from (select leaf, unnest(t) as token, unnest(range(len(t))) as i from leaf where leaf in (select leaf from leaf group by leaf having count(*) > 1)) group by all),
modal as (select leaf, i, token as best from votes qualify row_number() over (partition by leaf, i order by n desc, token) = 1),
same as (select m, count(*) filter (token = best) as n from (select m, leaf, unnest(t) as token, unnest(range(len(t))) as i from leaf) join modal using (leaf, i) group by m),
part as materialized (select leaf.*, case when same.n >= need then 'leaf ' || leaf else 'line ' || m end as part from leaf join same using (m)),
link as materialized (select distinct x.part as u, y.part as v from part x join part y on x.leaf = y.leaf and x.part < y.part and len(list_filter(list_zip(x.t, y.t), lambda z: z[1] = z[2])) >= x.need),
both_ as materialized (select u, v from link union select v, u from link),
reach(m, k) as (select u, u from both_ union select both_.v, reach.k from reach join both_ on both_.u = reach.m),
alike as (select m, min(k) as k from reach group by m),
keyed as materialized (select c.m, c.first, c.last, coalesce(alike.k, part.part, 'line ' || c.m) as key from c left join part using (m) left join alike on alike.m = part.part),
spread as (select key, min(first) as f, max(last) as z from keyed group by all having min(first) < max(last)),
rec as (select m, f from keyed join spread using (key)),
gone as materialized (select r, place from l join rec using (m) where d > f),
kept as (select r, count(*) filter (gone.r is null) as n_kept, string_agg(raw, chr(10) order by l0.place) filter (gone.r is null) as text from l0 left join gone using (r, place) group by r)
select doc_id, len(ls) as n_lines, len(ls) - n_kept as n_dropped, length(coalesce(kept.text, '')) as kept_chars, sha256(coalesce(kept.text, '')) as kept_sha256
from told join kept using (r)
"""
