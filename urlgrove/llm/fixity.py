"""Merkle fixity audit of WARC replicas.

``archive`` makes WARC records of web pages and deals them over files; in a file they stand in
the order of their keys. ``leaves`` gives each key's digest and ordered offset range. ``levels_of``
hashes them into a tree per file: a node is a prefix of keys, thus one range of offsets, and
its digest covers those of its children in order with their lengths. Nodes are written once.
``audit`` compares the roots of two replicas and reads only the children of nodes that
differ, down to the damaged records.

Keys come from WARC-Record-ID and not from the place in a file, so a record that one replica lacks
changes its own branch alone. ``write_files`` lays a replica out as files, ``read_files`` parses
stored bytes; all else are DataFrame functions.

A file holds about ``per_file`` records by a hash of their identity. Null url or html counts as empty;
a null page_id is an identity of its own; rows that repeat a page are copies of one record and
are counted before anything is gathered, so many copies are one leaf; columns of other names play no
part; empty tables give empty trees; a record missing from one replica has no digest and
no copies there. The records of a node at the lowest level are as few as the hash spreads them;
very long records travel only to be written, never to be audited.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, pick, small

#: Pages carry no time of capture; it is the same for all records unless the caller names another.
CAPTURED = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
FOUND = "file long, key string, length long, digest string, copies long"


def key_of(identity: Column) -> Column:
    """Digits that order records in a file: those that didn't choose the file first."""
    return F.concat(F.substring(identity, 9, 24), F.substring(identity, 1, 8))


def archive(pages: DataFrame, per_file: int = 1000, captured: str = CAPTURED) -> DataFrame:
    """page_id, file, key and the WARC record itself."""
    p = pick(pages, {"page_id": "long", "url": "string", "html": "string"})
    p = p.withColumns({"url": F.coalesce("url", F.lit("")), "html": F.coalesce("html", F.lit(""))})
    p = p.withColumn("identity", F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url", F.md5("html"))))
    uuid = F.concat_ws("-", *(F.substring("identity", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {captured}\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END), "html", F.lit(END),
    )
    files = pages.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_file)).alias("files"))  # one row
    file = F.pmod(F.conv(F.substring("identity", 1, 8), 16, 10).cast("long"), "files")
    return p.crossJoin(F.broadcast(files)).select("page_id", file.alias("file"), key_of(F.col("identity")).alias("key"), record.alias("record"))


def write_files(archived: DataFrame, path: str) -> None:
    """One WARC file for each ``file``, records in the order of their keys, in folders file=N below ``path``."""
    whole = archived.repartition("file").sortWithinPartitions("file", "key")
    body = F.expr(f"substring(record, 1, length(record) - {len(END)})").alias("value")  # the writer ends each record
    whole.select("file", body).write.partitionBy("file").option("lineSep", END).text(path)


def _records(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(identity, bytes) of each record; after bytes that are none, the search goes on at the next record's start."""
    end, at = END.encode(), 0
    while at < len(content):
        head = content.find(end, at)
        fields = dict(line.split(b": ", 1) for line in content[at : max(head, at)].split(b"\r\n")[1:] if b": " in line)
        size, name = fields.get(b"Content-Length", b""), fields.get(b"WARC-Record-ID", b"")
        stop = head + len(end) + int(size) + len(end) if size.isdigit() else -1
        if content.startswith(b"WARC/", at) and name.startswith(b"<urn:uuid:") and 0 < stop <= len(content) and content[stop - len(end) : stop] == end:
            yield name[10:-1].decode("latin-1").replace("-", ""), content[at:stop]
        else:
            stop = content.find(end + b"WARC/", at) + len(end)
            stop = len(content) if stop < at + len(end) else stop
            yield "", content[at:stop]
        at = stop


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the records of stored files, one row a record; bytes that are no record have an empty key."""
    import hashlib

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                file = int(path.rsplit("file=", 1)[1].split("/")[0])
                rows = [(file, name[8:] + name[:8], len(x), hashlib.sha256(x).hexdigest(), 1) for name, x in _records(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(parse, FOUND)


NAMES = ["file", "key", "length", "digest", "copies"]
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def hashed(archived: DataFrame) -> DataFrame:
    """The same rows as ``read_files`` of records that aren't written, copies counted."""
    rows = archived.select("file", "key", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    return rows.groupBy("file", "key", "length", "digest").agg(F.count("*").alias("copies"))


def leaves(found: DataFrame) -> DataFrame:
    """file, key, start, end, digest, copies: one row a key. Copies that differ are digested together."""
    kinds = found.groupBy("file", "key", "length", "digest").agg(F.sum("copies").alias("copies"))
    own = F.sha2(F.concat_ws("|", "digest", F.col("copies").cast("string")), 256)
    half = lambda at: F.bit_xor(F.conv(F.substring(own, at, 15), 16, 10).cast("long")).cast("string")
    several = F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.min(own), F.max(own), half(1), half(16), half(31), half(46)), 256)
    keys = kinds.groupBy("file", "key").agg(
        F.sum(F.col("length") * F.col("copies")).alias("length"), F.sum("copies").alias("copies"),
        F.when(F.count("*") == 1, F.min("digest")).otherwise(several).alias("digest"),
    )
    end = F.sum("length").over(W.partitionBy("file").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    return keys.select("file", "key", (end - F.col("length")).alias("start"), end.alias("end"), "digest", "copies")


def parents(nodes: DataFrame, digits: int) -> DataFrame:
    """Nodes of ``digits`` digits of the key from those below: at most 16, or at the lowest level the keys that share all digits."""
    kids = F.sort_array(F.collect_list(F.struct("key", (F.col("end") - F.col("start")).alias("length"), "digest", "copies")))
    up = nodes.groupBy("file", F.substring("key", 1, digits).alias("key")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("copies").alias("copies"), kids.alias("kids"))
    ranges = F.transform("kids", lambda k: F.concat_ws(":", k.key, k.length.cast("string"), k.copies.cast("string"), k.digest))
    return up.select("file", "key", "start", "end", F.sha2(F.array_join(ranges, "|"), 256).alias("digest"), "copies")


def levels_of(leaf: DataFrame, depth: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Written nodes of each level: leaves, nodes of ``depth`` digits, and so on up to the root of no digit."""
    out = [leaf]
    for digits in range(depth, -1, -1):
        out.append(scratch.save(parents(out[-1], digits), f"{name}{digits}"))
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records whose digest or number of copies differs between two replicas, both given by ``hashed`` or ``read_files``.

    file, key, start and end (in ``a``, or in ``b`` where ``a`` lacks the record), digest_a, digest_b, copies_a, copies_b.
    """
    scratch = Scratch(a.sparkSession, "fixity")
    a, b = scratch.save(leaves(a), "a"), scratch.save(leaves(b), "b")
    most = a.unionAll(b).groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    depth = 1
    while 16**depth < most:
        depth += 1
    left, right, suspects = levels_of(a, depth, scratch, "a"), levels_of(b, depth, scratch, "b"), None
    for k in range(depth + 1, -1, -1):
        x, y = left[k], right[k]
        if suspects is not None:
            above = F.substring("key", 1, depth - k)
            x, y = (side.withColumn("_up", above).join(suspects, ["file", "_up"], "left_semi").drop("_up") for side in (x, y))
        both = x.alias("x").join(y.alias("y"), ["file", "key"], "full_outer")
        differ = both.where(~F.col("x.digest").eqNullSafe(F.col("y.digest")) | ~F.col("x.copies").eqNullSafe(F.col("y.copies")))
        if k:
            suspects = small(scratch.save(differ.select("file", F.col("key").alias("_up")), f"level{k}"))
    pair = lambda c: F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c)
    count = lambda s: F.coalesce(F.col(f"{s}.copies"), F.lit(0)).cast("long")
    return differ.select("file", "key", pair("start"), pair("end"), F.col("x.digest").alias("digest_a"), F.col("y.digest").alias("digest_b"), count("x").alias("copies_a"), count("y").alias("copies_b"))
