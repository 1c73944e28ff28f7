"""License scan: notices over line breaks, shares between the threshold and 1, no scattered words, odd rows as the SQL has them."""

import textwrap

from markfield.llm import licenses

DOCS = "doc_id long, text string"
FULL = {label: text for text, label in licenses.TEMPLATES}


def scanned(spark, texts):
    return [r for r in sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect(), key=lambda r: r.doc_id)]


def brute(text, label_texts=licenses.TEMPLATES):
    import re

    labels, best = set(), 0.0
    for block in re.split(r"\n[ \t\r]*\n", text.lower()):
        w = re.findall("[a-z0-9]+", block)
        held = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}
        for t, label in label_texts:
            grams = set(licenses.grams_of(t))
            if 5 * len(grams & held) >= 4 * len(grams):
                labels.add(label)
                best = max(best, len(grams & held) / len(grams))
    return ",".join(sorted(labels)), best


def test_wrapped_and_altered_notices(spark):
    mit = max((t for t, label in licenses.TEMPLATES if label == "mit"), key=len)
    texts = [
        *("\n * ".join(textwrap.wrap(t, 40)) for t, _ in licenses.TEMPLATES),
        "before\n\n" + mit.replace("warranty", "guarantee").replace("WARRANTY", "GUARANTEE") + "\n\nafter",
        mit.replace("WHETHER IN AN ACTION OF CONTRACT", "WHETHER BY ACTION"),
        "\n\n".join(textwrap.wrap(mit, 60)),  # paragraphs that are each too little
        "the minutes were released early under the fishing license rules",
        "free software and the terms of the license: you can redistribute it or modify this program, it is under a public general license",
        "all rights\nreserved", "all rights\n\nreserved", None, "",
    ]
    got = scanned(spark, texts)
    for r, t in zip(got, texts, strict=True):
        labels, best = brute(t or "")
        assert set(labels.split(",")) - {""} <= set(r.labels.split(","))
        if not r.n_base:
            assert (r.labels, round(r.score, 9)) == (labels, round(best, 9)), t
    assert any(licenses.THRESHOLD <= r.score < 1 for r in got)
    assert [r.labels for r in got[-6:]] == ["", "", "all-rights-reserved", "", "", ""]


def test_odd_rows_as_the_sql_has_them(spark, same_as_sql, odd_dir, odd):
    assert same_as_sql(licenses.op7_license_scan(spark, odd_dir), licenses.OP7_SQL, odd_dir) > 200
    assert licenses.scan(odd.limit(0)).count() == 0
