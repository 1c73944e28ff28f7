"""Line dedup: groups of a leaf, short lines, odd rows as the SQL has them."""

from conftest import SMALL

from markfield.llm import line_dedup

DOCS = "doc_id long, text string"


def kept(spark, rows):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}


def test_a_leaf_has_all_its_groups(spark):
    # One leaf (ten tokens, three leading ones), three unlike groups, in each a field without digits that varies.
    a = [f"the job of {x} ended well after one long hour" for x in ("anna", "bert", "carl", "dora")]
    b = [f"the job of {x} failed early before two short days" for x in ("emil", "fred")]
    c = [f"the job of {x} waits now during some quiet weeks" for x in ("gina", "hans")]
    assert len({len(x.split(" ")) for x in a + b + c}) == 1
    got = kept(spark, list(enumerate(a + b + c + ["the job of none was ever like any of these"])))
    assert {i for i, t in got.items() if t} == {0, 4, 6, 8}


def test_short_lines_go_by_their_whole_content(spark):
    rows = [(1, "Yes.\n\nown line 1"), (2, "Yes.\n\nown line 2"), (3, " \t\nYes.\n \t"), (4, "日本語の行")]
    got = kept(spark, [*rows, (5, "日本語の行\nx")])
    assert got == {1: "Yes.\n\nown line 1", 2: "\nown line 2", 3: " \t\n \t", 4: "日本語の行", 5: "x"}


def test_fields_are_variable(spark):
    rows = [(1, "user 17 logged in at 10:30 from home"), (2, "user 4 logged in at 11:05 from home"), (None, "user x9 logged in at 0 from home"), (3, "1 2 3 4 5"), (4, "1 2 9 4 6")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, rows[0][1]), (2, ""), (None, ""), (3, "1 2 3 4 5"), (4, "1 2 9 4 6")}


def test_odd_rows_as_the_sql_has_them(spark, same_as_sql, odd_dir):
    assert same_as_sql(line_dedup.op1_line_dedup(spark, odd_dir), line_dedup.OP1_SQL, odd_dir) > 200
    out = line_dedup.dedup_lines(spark.read.parquet(f"{SMALL}/documents.parquet").limit(0))
    assert out.count() == 0


def test_no_link_of_a_leaf_is_lost(spark):
    # Lines in a chain, each like the next one only: whatever line comes first in a segment, all are one group.
    words = "it was then that".split() + [f"a{x}" for x in "bcdefghijklmnopqrs"]
    chain = [words]
    for i in range(4, 20):
        chain.append([*chain[-1][:i], "z" * (i - 2), *chain[-1][i + 1 :]])
    far = [" ".join(x) for x in chain[::4]]  # four positions differ: a fifth of 22, rounded down
    assert kept(spark, list(enumerate(far))) == {0: far[0]} | dict.fromkeys(range(1, len(far)), "")


def test_groups_are_the_components_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    lines = sorted({" ".join(["so", "it", "is", *(rng.choice("pq" if i % 2 else "rstu") for i in range(9))]) for _ in range(160)})
    tokens = [x.split(" ") for x in lines]
    modal = [min(set(c), key=lambda t: (-c.count(t), t)) for c in zip(*tokens, strict=True)]
    near = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) >= 12 - 2
    label = list(range(len(lines)))
    for i, a in enumerate(tokens):
        for j, b in enumerate(tokens[:i]):
            if label[i] != label[j] and (near(a, b) or (near(a, modal) and near(b, modal))):
                label = [label[j] if x == label[i] else x for x in label]
    want = {i for i in range(len(lines)) if label.index(label[i]) == i}
    assert 1 < len(want) < len(lines) // 2
    assert {i for i, t in kept(spark, list(enumerate(lines))).items() if t} == want
