"""WARC records and a Merkle fixity audit of two replicas.

A fixity tree has a leaf per record (digest of its bytes, at its offset) and above it nodes for ordered offset ranges
of a file: 64 KiB first, then sixteen ranges each, up to the file's root, then sixteen files each, up to one root of
the archive. Ranges lie at fixed offsets, so a lost record changes only its own branch. An audit compares the roots
and descends, level by level, only into branches that differ; below equal nodes nothing is read.

A node gathers the records of one range or sixteen children, never more. Building a tree moves digests and offsets,
not the records; the driver sees the largest offset and file number.

Cases. NULL url or payload is written as empty. Records of repeated rows follow each other. Rows with a NULL id are
records like others. An empty archive has no nodes and equals another empty one. A record that only one replica
has is ``missing`` or ``extra``; one whose bytes differ is ``corrupt``. Record texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeframe.llm.common import staged

FILE_BYTES = 64 << 20
SPAN = 64 << 10
FANOUT = 16
END = "\r\n\r\n"


def record_text(date: str = "2024-01-01T00:00:00Z") -> Column:
    """A response record of ``url`` and ``html``, as text; its bytes are the UTF-8 of it."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    uuid = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"),
    )
    return F.concat(head, F.lit(END), html, F.lit(END))


def warc_records(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``page_id, warc_file, record_offset, record_length, record_digest`` of each page.

    Pages are dealt over files of about ``file_bytes`` by a hash of id and url and lie in the order of their ids.
    """
    record = record_text()
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    measured = pages.select("page_id", "url", name.alias("name"), record.alias("record"))
    measured = measured.select(
        "page_id", "name", F.octet_length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_digest")
    )
    volume = measured.agg(F.sum("record_length")).first()[0] or 0
    files = max(1, math.ceil(volume / file_bytes))
    filed = measured.withColumn("warc_file", (F.conv(F.substring("name", 1, 8), 16, 10).cast("long") % files).cast("int"))
    before = Window.partitionBy("warc_file").orderBy("page_id", "name", "record_digest").rowsBetween(Window.unboundedPreceding, -1)
    return filed.withColumn("record_offset", F.coalesce(F.sum("record_length").over(before), F.lit(0)).cast("long"))


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the archive as folders ``warc_file=N`` with one file each, records in offset order."""
    placed = warc_records(pages, file_bytes).select("warc_file", "page_id", "name", "record_digest")
    name = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    record = record_text()
    whole = pages.select(name.alias("name"), record.alias("r"))
    whole = whole.select("name", F.sha2("r", 256).alias("record_digest"), F.substring("r", F.lit(1), F.length("r") - len(END)).alias("value"))
    # Repeated rows are equal records: number them on both sides, so that each place gets one text.
    same = Window.partitionBy("name", "record_digest").orderBy(F.lit(1))
    placed, whole = placed.withColumn("k", F.row_number().over(same)), whole.withColumn("k", F.row_number().over(same))
    joined = placed.join(whole, ["name", "record_digest", "k"]).repartition("warc_file")
    ordered = joined.sortWithinPartitions("warc_file", "page_id", "name", "record_digest")
    ordered.select("warc_file", "value").write.partitionBy("warc_file").option("lineSep", END).text(path)


def cut_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records of an uncompressed WARC file, by their Content-Length."""
    at, end = 0, END.encode()
    while at < len(content):
        body = content.find(end, at)
        if body < 0:
            yield at, content[at:]
            return
        length = next((int(h.split(b":")[1]) for h in content[at:body].split(b"\r\n") if h.lower().startswith(b"content-length:")), 0)
        stop = body + len(end) + length + len(end)
        yield at, content[at:stop]
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``warc_file, record_offset, record_length, record_digest`` of the files below ``path``, one file at a time in memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", r"warc_file=(\d+)", 1).cast("int").alias("warc_file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["warc_file"].to_pylist(), batch["content"]):
                rows = [(file, at, len(r), hashlib.sha256(r).hexdigest()) for at, r in cut_records(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                        names=["warc_file", "record_offset", "record_length", "record_digest"],
                    )

    return files.mapInArrow(run, "warc_file int, record_offset long, record_length long, record_digest string")


def _parents(nodes: DataFrame, level: int, file: Column, node: Column) -> DataFrame:
    child = F.sort_array(F.collect_list(F.struct("file", "node", "digest")))
    joined = F.concat_ws(";", F.transform(child, lambda c: F.concat_ws(":", c["file"], c["node"], c["digest"])))
    return nodes.groupBy(file.alias("file"), node.alias("node")).agg(F.sha2(joined, 256).alias("digest")).withColumn("level", F.lit(level))


def tree_shape(*archives: DataFrame) -> tuple[int, int]:
    """Levels of ranges and of files that hold all the given archives."""
    tops = [a.agg(F.max("record_offset"), F.max("warc_file")).first() for a in archives]
    ranges, files = max(t[0] or 0 for t in tops) // SPAN + 1, max(t[1] or 0 for t in tops) + 1

    def levels(n: int) -> int:
        return 0 if n <= 1 else 1 + levels(-(-n // FANOUT))

    return levels(ranges), levels(files)


def fixity_tree(records: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``level, file, node, digest``: level 0 the records at their offsets, the last level the root."""
    leaves = records.select(
        F.col("warc_file").cast("long").alias("file"), F.col("record_offset").alias("node"), F.col("record_digest").alias("digest"), F.lit(0).alias("level")
    )
    levels = [staged(leaves, "fixity")]
    file, node = F.col("file"), F.col("node")
    steps = [(file, F.floor(node / SPAN))] + [(file, F.floor(node / FANOUT))] * shape[0] + [(F.floor(file / FANOUT), F.lit(0).cast("long"))] * shape[1]
    for level, (up_file, up_node) in enumerate(steps, 1):
        levels.append(staged(_parents(levels[-1], level, up_file, up_node), "fixity"))
    whole = levels[0]
    for one in levels[1:]:
        whole = whole.unionByName(one)
    return whole


def audit(tree: DataFrame, replica: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``warc_file, record_offset, status`` of the records that differ: corrupt, missing (in the replica) or extra."""
    top = 1 + sum(shape)
    suspects = None
    for level in range(top, -1, -1):
        here = [t.filter(F.col("level") == level).select("file", "node", "digest") for t in (tree, replica)]
        if suspects is not None:
            if level >= 1 + shape[0]:
                up = (F.floor(F.col("file") / FANOUT), F.lit(0).cast("long"))
            else:
                up = (F.col("file"), F.floor(F.col("node") / (FANOUT if level else SPAN)))
            within = suspects.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
            here = [t.join(within, (up[0] == F.col("up_file")) & (up[1] == F.col("up_node")), "left_semi") for t in here]
        both = here[0].join(here[1].withColumnRenamed("digest", "other"), ["file", "node"], "full")
        suspects = staged(both.filter(~F.col("digest").eqNullSafe(F.col("other"))), "suspects")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return suspects.select(F.col("file").cast("int").alias("warc_file"), F.col("node").alias("record_offset"), status.alias("status"))
