"""Rows that operators on documents have to stand: nulls, empty and very long texts, ties, repeated rows, other columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} stop" for i in range(4000))
#: Names that operators use for columns of their own.
CLASHING = ("m", "d", "h", "b", "r", "x", "p", "kept", "fp", "node", "start", "salt", "pool", "k", "c", "line", "leaf", "at", "base_failed", "x1")


def odd_rows():
    texts = [None, "", " \n\t", "one two", LONG, LONG, "Größe Ünïcode 日本語 ▁ x" * 9, "a\x00b\x0bc", "same line of six words here\n" * 5, "Released under the MIT License."]
    rows = [(None if i == 3 else i, t, None if i == 2 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[1], (99, "same line of six words here\nsame line of 7 words here", "en", None, 1), (None, "other text without an id", "en", "s", 1)]


def odd_documents(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    for extra in CLASHING:
        df = df.withColumn(extra, df.n_chars)
    return df
