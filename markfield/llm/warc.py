"""Operator 5: Merkle fixity audit of WARC replicas.

Pages are written as WARC files (gzipped, one record a page, FILE_PAGES page_ids a file) to the shared folder, and an
audit reads the files of each replica: records are found by their headers, a region without a valid header is one record
up to where the next begins.  Each replica gets a tree of its own bytes: leaves are SHA-256 of records, the next level
hashes the leaves of an offset range, every further level FAN neighbours, up to a root a file and, over files, one root.
Two replicas are compared from the root down: only children of nodes that differ are looked at, so work after hashing
follows the damage, not the archive.

Every group is a fixed offset range or FAN children, so none grows with the archive; a task holds one file.

Defined cases: null url or html is empty; pages without a page_id are dealt to NULL_FILES files of their own by content;
equal page_ids follow each other by content; an empty archive has no root, and all records of the other one are missing
or extra; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markfield.llm.shared import cut, delete_at_exit, importable, new_folder, table

FILE_PAGES, NULL_FILES, RANGE, FAN = 1024, 4096, 1 << 18, 64
CRLF = "\r\n"
_HEAD = re.compile(rb"WARC/1\.0\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d+)\r\n(?:[^\r\n]+\r\n)*\r\n")
_PAGE = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r\n")
_END, _NEXT = b"\r\n\r\n", b"\r\n\r\nWARC/1.0\r\n"


def records_of(pages: DataFrame) -> DataFrame:
    """file long, page_id long, record string (without the two line ends that follow it)."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.regexp_replace(url, "[\r\n]", "%0A"),
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")),
        F.lit(f">{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF),
    )
    file = F.when(page.isNotNull(), F.floor(page / FILE_PAGES)).otherwise(-1 - F.pmod(F.xxhash64(url, html), F.lit(NULL_FILES)))
    return pages.select(file.cast("long").alias("file"), page.alias("page_id"), F.concat(head, html).alias("record"))


def _write(ordered: DataFrame, path: str) -> str:
    """Files of ordered (file, record), each from one task.  The text writer ends every record with two line ends."""
    out = ordered.select("file", "record").write.partitionBy("file").option("lineSep", CRLF + CRLF)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    delete_at_exit(ordered.sparkSession, path)
    return path


def write_archive(pages: DataFrame) -> str:
    """Writes the WARC files of all pages to a new shared folder and returns it.  Equal page_ids follow by content."""
    made = records_of(pages).withColumn("h", F.xxhash64("record"))
    return _write(made.repartition("file").sortWithinPartitions("file", F.col("page_id").asc_nulls_first(), "h", "record"), new_folder(pages.sparkSession))


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return found.select(F.regexp_extract("path", r"file=(-?\d+)/", 1).cast("long").alias("file"), "content")


def spans(data: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of every record of a WARC file."""
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        end = m.end() + int(m[1]) + len(_END) if m else 0
        if not m or data[end - len(_END) : end] != _END:
            next_ = data.find(_NEXT, at)
            end = next_ + len(_END) if next_ >= 0 else len(data)
        yield at, end
        at = end


def leaves(spark: SparkSession, path: str) -> DataFrame:
    """file, node (the offset), hash, page_id of every record of an archive, from its bytes."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, blob in zip(b["file"].to_pylist(), b["content"], strict=True):
                data = memoryview(unpacked(blob.as_buffer()))
                rows = [(file, a, hashlib.sha256(b"leaf" + data[a:z]).hexdigest(), page_of(data[a:z])) for a, z in spans(data.obj)]
                yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["file", "node", "hash", "page_id"])

    return _files(spark, path).mapInArrow(run, "file long, node long, hash string, page_id long")


def unpacked(blob) -> bytes:
    """All gzip members of a file."""
    out, rest = [], bytes(blob)
    while rest:
        z = zlib.decompressobj(31)
        out.append(z.decompress(rest))
        rest = z.unused_data
    return b"".join(out)


def page_of(record: memoryview) -> int | None:
    m = _PAGE.search(record[:65536])
    return int(m[1]) if m else None


def copy_archive(spark: SparkSession, path: str, change: Callable[[int, int | None, bool, bytes], list[bytes]]) -> str:
    """Copies an archive record by record to a new shared folder and returns it.  change: what the copy has in place of a
    record, from file, page_id, whether it is the file's last, and its bytes without the line ends that follow it."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, blob in zip(b["file"].to_pylist(), b["content"], strict=True):
                data = unpacked(blob.as_buffer())
                found, rows = list(spans(data)), []
                for k, (a, z) in enumerate(found):
                    rows += change(file, page_of(memoryview(data)[a:z]), k == len(found) - 1, data[a : z - len(_END)])
                yield pa.record_batch([pa.array([file] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["file", "at", "record"])

    made = _files(spark, path).mapInArrow(run, "file long, at long, record binary").withColumn("record", F.col("record").cast("string"))
    return _write(made.sortWithinPartitions("file", "at"), new_folder(spark))


def tree(leaf: DataFrame, span: int, n_files: int) -> list[DataFrame]:
    """Levels from the leaves up, each (file, node, hash), the last with one root: offset ranges, FAN at a time until a
    file of `span` bytes is one node, then FAN files at a time until `file` is one (levels: see depth)."""
    out = [leaf.select("file", "node", "hash")]
    up = lambda df, file, node: cut(df.groupBy(file.alias("file"), node.alias("node")).agg(F.array_sort(F.collect_list(F.struct("file", F.col("node").alias("n"), "hash"))).alias("c")).select("file", "node", F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["hash"])), "|").cast("binary"), 256).alias("hash")))
    files, width = depth(span, n_files)
    out.append(up(out[-1], F.col("file"), F.floor(F.col("node") / RANGE)))
    for _ in range(width):
        out.append(up(out[-1], F.col("file"), F.floor(F.col("node") / FAN)))
    out.append(up(out[-1].select(F.lit(0).alias("file"), F.col("file").alias("node"), "hash"), F.col("file"), F.floor(F.col("node") / FAN)))
    for _ in range(files):
        out.append(up(out[-1], F.col("file"), F.floor(F.col("node") / FAN)))
    return out


def depth(span: int, files: int) -> tuple[int, int]:
    """Levels over `files` files beyond the first, and over offset ranges until `span` bytes are one node."""
    width, covered = 0, RANGE
    while covered < span:
        width, covered = width + 1, covered * FAN
    up, covered = 0, FAN
    while covered < files:
        up, covered = up + 1, covered * FAN
    return up, width


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, offset, page_id, status (altered, missing from b, extra in b) of the records that differ.  a, b: leaves."""
    a, b = cut(a), cut(b)
    most = [x.agg(F.max("node").alias("node"), F.max("file").alias("file")).first() for x in (a, b)]
    span, files = (max(1, *(r[c] or 0 for r in most)) + 1 for c in ("node", "file"))
    width = depth(span, files)[1]
    ta, tb = tree(a, span, files), tree(b, span, files)
    suspects = None  # nodes of the level above that differ
    for level in range(len(ta) - 1, -1, -1):
        x, y = ta[level], tb[level]
        if suspects is not None:
            file, node = F.col("file"), F.col("node")
            if level == width + 1:  # below: one node a file; above: files are the nodes
                parent = [F.lit(0).cast("long").alias("pf"), F.floor(file / FAN).alias("pn")]
            elif level == 0:
                parent = [file.alias("pf"), F.floor(node / RANGE).alias("pn")]
            else:
                parent = [file.cast("long").alias("pf"), F.floor(node / FAN).alias("pn")]
            s = suspects.select(F.col("file").cast("long").alias("pf"), F.col("node").alias("pn"))
            x, y = (t.select("*", *parent).join(s, ["pf", "pn"], "left_semi").select("file", "node", "hash") for t in (x, y))
        both = x.select("file", "node", F.col("hash").alias("ha")).join(y.select("file", "node", F.col("hash").alias("hb")), ["file", "node"], "full")
        suspects = cut(both.where(~F.col("ha").eqNullSafe(F.col("hb"))))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("altered")
    known = a.select("file", "node", "page_id").unionByName(b.select("file", "node", "page_id")).join(suspects.select("file", "node"), ["file", "node"], "left_semi")
    known = known.groupBy("file", "node").agg(F.max("page_id").alias("page_id"))
    return suspects.join(known, ["file", "node"]).select("file", F.col("node").alias("offset"), "page_id", status.alias("status"))


def damage(file: int, page: int | None, last: bool, record: bytes) -> list[bytes]:
    """What the audited replica has: where page_id % 97 = 3 the byte in the middle is another one; files whose number is 5
    modulo 13 have lost their last record, those at 7 have it twice."""
    if last and file % 13 == 5:
        return []
    if page is not None and page % 97 == 3:
        at = len(record) // 2
        record = record[:at] + (b"y" if record[at : at + 1] == b"x" else b"x") + record[at + 1 :]
    return [record, record] if last and file % 13 == 7 else [record]


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against its replica with `damage`; both are written as WARC files and hashed from them."""
    archive = write_archive(table(spark, sf_dir, "pages"))
    return audit(leaves(spark, archive), leaves(spark, copy_archive(spark, archive, damage)))


_LEN = "strlen('WARC/1.0~~WARC-Type: resource~~WARC-Target-URI: ~~WARC-Date: 1970-01-01T00:00:00Z~~WARC-Record-ID: <urn:page:>~~Content-Type: text/html~~Content-Length: ~~~~~~~~')"
OP5_SQL = f"""
with r as (select page_id, page_id // {FILE_PAGES} as file,
  {_LEN} + strlen(regexp_replace(coalesce(url, ''), '[\r\n]', '%0A', 'g')) + strlen(cast(page_id as varchar)) + strlen(cast(strlen(coalesce(html, '')) as varchar)) + strlen(coalesce(html, '')) as length from pages where page_id >= 0),
o as (select *, cast(coalesce(sum(length) over w, 0) as bigint) as pos, page_id = max(page_id) over (partition by file) as last from r window w as (partition by file order by page_id rows between unbounded preceding and 1 preceding))
select file, pos as "offset", page_id, case when last and file % 13 = 5 then 'missing' else 'altered' end as status from o where page_id % 97 = 3 or last and file % 13 = 5
union all select file, pos + length, page_id, 'extra' from o where last and file % 13 = 7
"""
