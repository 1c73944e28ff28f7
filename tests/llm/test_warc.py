"""WARC files are written and read as bytes; the audit finds what differs, whatever the rows."""

import hashlib
import itertools

from markfield.llm import warc

PAGES = "page_id long, url string, html string"


def rows():
    told = [(i, f"http://u/{i}", None if i % 5 == 0 else f"<p>hé {i}</p>" * i) for i in range(0, 2200, 7)]
    return [*told, (3, "x", "x" * 300), (3, "x", "x" * 300), (100, "two\r\nlines", "WARC/1.0\r\n\r\n"), (None, None, None), (None, "u", "null id"), (5000, "long", "y" * 400_000), (-1, "", "")]


def archive(spark, told=None):
    pages = spark.createDataFrame(rows() if told is None else told, PAGES).selectExpr("*", "1 as file", "2 as offset", "3 as record", "4 as sha")
    return warc.write_archive(pages)


def contents(spark, path):
    return {r.file: warc.unpacked(r.content) for r in warc._files(spark, path).collect()}


def test_files_are_warc(spark):
    path = archive(spark)
    data = contents(spark, path)
    assert {f for f in data if f >= 0} == {0, 1, 2, 4} and -1 in data and sum(f < -1 for f in data) >= 1
    n = 0
    for file, b in data.items():
        for a, z in warc.spans(b):
            head, body = b[a:z].split(b"\r\n\r\n", 1)
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.0\r\n") and len(body) == int(fields[b"Content-Length"]) + 4 and body.endswith(b"\r\n\r\n")
            n += 1
    assert n == len(rows())
    for r in warc.leaves(spark, path).collect():
        z = dict(warc.spans(data[r.file]))[r.node]
        assert r.hash == hashlib.sha256(b"leaf" + data[r.file][r.node : z]).hexdigest()


def test_audit_finds_what_differs(spark):
    path = archive(spark)
    a = contents(spark, path)

    def change(file, page, last, record):
        if page == 3:
            return [record.replace(b"Content-Length: 300", b"Content-Length: 301")]  # a broken header
        if last and file == 1:
            return []
        if last and file == 4:
            return [record, b"no record"]
        return [record.replace(b"null id", b"nuLl id").replace(b"8</p>", b"9</p>") if page in (None, 98, 1008) else record]

    other = warc.copy_archive(spark, path, change)
    b = contents(spark, other)
    got = {(r.file, r.offset, r.status) for r in warc.audit(warc.leaves(spark, path), warc.leaves(spark, other)).collect()}
    want = set()
    for file in {*a, *b}:
        x, y = ({p: d[p:z] for p, z in warc.spans(d)} for d in (a.get(file, b""), b.get(file, b"")))
        for p in {*x, *y}:
            if x.get(p) != y.get(p):
                want.add((file, p, "missing" if p not in y else "extra" if p not in x else "altered"))
    assert got == want and {s for *_, s in got} == {"missing", "extra", "altered"}
    assert len(got) == 7
    same = warc.copy_archive(spark, path, lambda file, page, last, record: [record])
    assert warc.audit(warc.leaves(spark, path), warc.leaves(spark, same)).count() == 0


def test_empty_archives(spark):
    full, empty = archive(spark), archive(spark, [])
    one, none = warc.leaves(spark, full), warc.leaves(spark, empty)
    assert {r.status for r in warc.audit(one, none).collect()} == {"missing"}
    assert warc.audit(none, one).where("status = 'extra'").count() == len(rows())
    assert warc.audit(none, none).count() == 0


def test_regions_without_a_header():
    good = b"WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for parts in itertools.product([good, b"junk\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab\r\n\r\n"], repeat=3):
        data = b"".join(parts)
        found = list(warc.spans(data))
        assert [a for a, _ in found] == [0, *[z for _, z in found[:-1]]] and found[-1][1] == len(data)
        assert sum(data[a:z] == good for a, z in found) == parts.count(good)
