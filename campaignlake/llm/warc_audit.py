"""WARC archives and their Merkle fixity audit.

Records are written as gzipped WARC files by Spark's text writer; offsets count plain bytes. An audit reads every replica's files, hashes each
record (the leaves, in order of file and offset) and then ordered ranges of FAN nodes level by level up to one
root for each replica. Replicas are compared from the roots down: only the children of nodes that differ are
looked at, which ends at the records that are damaged, missing or moved.

Leaf numbers are file * FAN ** depth + place in the file, so a node's parent is its number divided by FAN on all levels,
within files and above them; a group never has more than FAN members.

Defined cases: null url or html are written as empty; pages that share a page_id are ordered by url and html;
a null page_id is archived in file 0 first; bytes that are no record (a damaged header or gzip stream) become a leaf of their own up to
the next record; an empty table gives an archive without records and an audit without rows; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlake.llm.common import staged

FAN = 16
FILE_RECORDS = 2000
END = "\r\n\r\n"

_HEAD = re.compile(rb"WARC/1\.0\r\n(.*?)\r\n\r\n", re.S)
_LENGTH = re.compile(rb"^Content-Length: *(\d+)\s*$", re.M | re.I)
_RECORD_ID = re.compile(rb"^WARC-Record-ID: *<([^>\r\n]*)>", re.M | re.I)


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC resource record, without the two line ends after its content."""
    content = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit(END),
        content,
    )


def archive_records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, page_id, url, html, record): each page's record and the file it goes to."""
    files = max(1, -(-pages.count() // file_records))
    base = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    return base.select(
        F.coalesce(F.pmod(F.col("page_id"), F.lit(files)), F.lit(0)).cast("long").alias("file"),
        "*",
        record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"),
    )


def write_archives(records: DataFrame, path: str, replicas: dict[str, Column] | None = None) -> None:
    """WARC files `<path>/replica=<name>/file=<n>/`, in order of page_id; `replicas` maps names to record columns.

    Records are shuffled once, whatever the number of replicas, and files are gzip streams.
    """
    named = [
        F.struct(F.lit(name).alias("replica"), record.alias("value"))
        for name, record in (replicas or {"archive": F.col("record")}).items()
    ]
    (
        records.repartition("file")
        .select("file", "page_id", "url", "html", F.inline(F.array(*named)))
        .sortWithinPartitions("replica", "file", "page_id", "url", "html")
        .select("replica", "file", "value")
        .write.partitionBy("replica", "file")
        .option("lineSep", END)
        .option("compression", "gzip")
        .text(path)
    )


def plain_bytes(raw: bytes) -> bytes:
    """A file's records; of a damaged gzip stream what can be read, and then the rest as it is."""
    if not raw.startswith(b"\x1f\x8b"):
        return raw
    stream, out, at = zlib.decompressobj(31), [], 0
    try:
        for at in range(0, len(raw), 1 << 16):
            out.append(stream.decompress(raw[at : at + (1 << 16)]))
    except zlib.error:
        out.append(raw[at:])
    return b"".join(out)


def split_records(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(offset, length, record id) of each record; damaged stretches have the id of what can be read, or none."""
    at = 0
    while at < len(content):
        head = _HEAD.match(content, at)
        size = head and _LENGTH.search(head[1])
        end = head.end() + int(size[1]) + len(END) if size else 0
        following = content[end : end + 9]
        if not size or end > len(content) or following not in (b"", b"WARC/1.0\r"):
            found = content.find(b"WARC/1.0\r\n", at + 1)
            end = found if found >= 0 else len(content)
        name = _RECORD_ID.search(content, at, end)
        yield at, end - at, name[1].decode("utf-8", "replace") if name else ""
        at = end


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "place", "start", "length", "record_id", "digest"]
    for batch in batches:
        for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
            raw = plain_bytes(content.as_buffer().to_pybytes())
            rows = [(file.as_py(), i, a, n, rid, hashlib.sha256(raw[a : a + n]).hexdigest()) for i, (a, n, rid) in enumerate(split_records(raw))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def archive_leaves(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, start, length, record_id, digest) of every record of the archive at `path`; an archive without
    records has no files, hence no folder, and gives no rows."""
    fields = "file long, place long, start long, length long, record_id string, digest string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], fields)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(path)
    named = files.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file"), "content")
    return named.mapInArrow(_leaves, fields)


def tree_levels(replicas: dict[str, DataFrame]) -> list[DataFrame]:
    """Levels of all replicas' trees, leaves first: (replica, node, first, last, digest)."""
    every = None
    for name, leaves in replicas.items():
        one = leaves.withColumn("replica", F.lit(name))
        every = one if every is None else every.unionByName(one)
    every = staged(every, "leaves")
    size = every.agg(F.max("place").alias("place"), F.max("file").alias("file")).first()
    depth = next(d for d in range(64) if FAN**d > (size["place"] or 0))
    height = depth + next(d for d in range(64) if FAN**d > (size["file"] or 0))
    node = F.col("file") * FAN**depth + F.col("place")
    level = every.select(
        "replica", node.alias("node"), F.col("start").alias("first"), (F.col("start") + F.col("length")).alias("last"), "digest", "file", "record_id"
    )
    levels = [level]
    for _ in range(height):
        children = F.array_sort(F.collect_list(F.struct("node", "first", "last", "digest")))
        text = F.array_join(
            F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["first"].cast("string"), c["last"].cast("string"), c["digest"])), ","
        )
        above = levels[-1].groupBy("replica", F.expr(f"node div {FAN}").alias("node")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(text, 256).alias("digest")
        )
        levels.append(staged(above, "tree-level"))
    return levels


def differing(levels: list[DataFrame], one: str, other: str) -> DataFrame:
    """Leaves in which two replicas differ, found from the roots down: (node, file, record_id, first, last, digest, other_digest)."""
    suspects = None
    for level in reversed(levels):
        seen = level if suspects is None else level.join(
            suspects.select(F.col("node").alias("parent")), F.expr(f"node div {FAN}") == F.col("parent"), "left_semi"
        )
        a, b = (seen.where(F.col("replica") == r).drop("replica").alias(n) for r, n in ((one, "a"), (other, "b")))
        both = a.join(b, F.col("a.node") == F.col("b.node"), "full")
        apart = both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest")) | ~F.col("a.last").eqNullSafe(F.col("b.last")))
        held = [c for c in level.columns if c not in ("replica", "digest")]
        suspects = staged(
            apart.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in held], F.col("a.digest").alias("digest"), F.col("b.digest").alias("other_digest")),
            "suspects",
        )
    return suspects


def audit(spark: SparkSession, path: str, replica_path: str) -> tuple[DataFrame, DataFrame]:
    """(leaves of the archive at `path`, leaves in which the replica differs)."""
    levels = tree_levels({"archive": archive_leaves(spark, path), "replica": archive_leaves(spark, replica_path)})
    return levels[0].where("replica = 'archive'").drop("replica"), differing(levels, "archive", "replica")
