"""WARC fixity audit with Merkle trees.

Every record of an archive has a digest and a place (volume, offset, length).  A leaf covers an ordered range of
``RANGE`` bytes of a volume and hashes the places and digests of the records that start in it; each inner node
hashes ``FAN`` children in order, up to one root a volume.  Two replicas are compared from the roots down: only the
children of nodes that differ are looked at, so records are compared in the differing ranges alone.

Cases: null urls or bodies count as empty; a very long record is one record of one leaf; a null id comes first; rows with the same id are records each, ordered by
their digest; a record on one side only is ``missing`` or ``extra``; an empty archive has no nodes and audits clean
against another empty one; columns other than the named ones are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

RANGE, FAN, VOLUME = 1 << 18, 16, 1 << 30
MANIFEST = "record_id long, volume long, offset long, length long, digest string"


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record as text: header lines, an empty line, the body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    name = F.coalesce(record_id.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), name, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def parse_warc(data: bytes):
    """(offset, length, headers, body, error) of every record of a file; gzip members, one a record, keep their stored offsets.

    Where a record can't be read, one row with an error covers the rest of the file, and nothing is left out in silence."""
    at = 0
    while at < len(data):
        plain, size, error = data, None, None
        if data[:2] == b"\x1f\x8b":
            plain, size, error = _member(data, at)
        inside = 0 if size else at
        while not error and inside < len(plain):
            end = plain.find(b"\r\n\r\n", inside)
            if end < 0 or not plain.startswith(b"WARC/", inside):
                error = "no record header"
                break
            lines = plain[inside:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = dict(line.split(": ", 1) for line in lines if ": " in line)
            length = headers.get("Content-Length", "")
            stop = end + 4 + int(length) if length.isdigit() else -1
            if stop < 0 or plain[stop : stop + 4] != b"\r\n\r\n":
                error = "the record's length is missing or wrong"
                break
            yield (at, size, headers, plain[end + 4 : stop], None) if size else (inside, stop + 4 - inside, headers, plain[end + 4 : stop], None)
            inside = stop + 4
        if error:
            start = at if size or error == DAMAGED else inside
            yield start, len(data) - start, {}, b"", error
            return
        at = at + size if size else len(data)


DAMAGED = "damaged gzip member"


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at a place holds, and its stored length; read piece by piece, so that long files cost no copies."""
    reader, parts, here = zlib.decompressobj(31), [], at
    try:
        while not reader.eof and here < len(data):
            parts.append(reader.decompress(data[here : here + (1 << 16)]))
            here += 1 << 16
    except zlib.error:
        return b"", 0, DAMAGED
    if not reader.eof:
        return b"", 0, DAMAGED
    return b"".join(parts), min(here, len(data)) - len(reader.unused_data) - at, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, url, digest, body, error) of the records of .warc and .warc.gz files, one task a file at most.

    Files are handed over whole; Spark bounds the bytes of what a worker gets at once by the session's Arrow settings."""
    base.small_batches(spark)
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
    names = ["file", "offset", "length", "url", "digest", "body", "error"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows = []
                for at, size, h, body, error in parse_warc(data):
                    digest = None if error else hashlib.sha256(body).hexdigest()
                    rows.append((name, at, size, h.get("WARC-Target-URI"), digest, body, error))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, length long, url string, digest string, body binary, error string")


def compressed(record: bytes) -> bytes:
    """One gzip member for a record, as .warc.gz files hold them."""
    return gzip.compress(record, mtime=0)


def laid_out(records: DataFrame, columns: list[str]) -> DataFrame:
    """Places records (record_id, length, digest, ...) in one archive in the order of id and digest: adds volume, offset.

    Ranges of ids are sorted apart; each adds up its own lengths, and the driver the ranges' totals (one number each)."""
    base.small_batches(records.sparkSession)
    ordered = records.repartitionByRange(max(1, records.rdd.getNumPartitions()), "record_id", "digest").sortWithinPartitions("record_id", "digest")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    at = records.columns.index("length")

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(at).to_pylist()
            places = []
            for n in sizes:
                places.append(before)
                before += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(sizes), pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "inside"])

    rows = base.written(ordered.mapInArrow(run, f"{fields}, part long, inside long"), "layout")
    starts, total = {}, 0
    for part, n in sorted(map(tuple, rows.groupBy("part").agg(F.sum("length")).collect())):
        starts[part], total = total, total + n
    start = rows.sparkSession.createDataFrame(list(starts.items()), "part long, start long")
    rows, place = rows.join(F.broadcast(start), "part"), F.col("start") + F.col("inside")  # a row for each range
    return rows.select(*columns, F.floor(place / VOLUME).cast("long").alias("volume"), F.pmod(place, F.lit(VOLUME)).alias("offset"))


def merkle_tree(manifest: DataFrame, span: int = RANGE, fan: int = FAN) -> tuple[DataFrame, int]:
    """(volume, level, node, hash) of all nodes, level 0 the leaves, and the level of the roots."""
    spot = F.struct("offset", "length", "digest")
    leaves = manifest.withColumn("node", F.floor(F.col("offset") / span).cast("long")).groupBy("volume", "node").agg(_hash(F.transform(F.array_sort(F.collect_list(spot)), lambda r: F.concat_ws(":", r["offset"].cast("string"), r["length"].cast("string"), r["digest"]))).alias("hash"))
    level = base.written(leaves.select("volume", F.lit(0).alias("level"), "node", "hash"), "leaves")
    levels, depth = [level], 0
    top = level.agg(F.max("node")).first()[0] or 0
    while top > 0:
        depth, top = depth + 1, top // fan
        up = level.groupBy("volume", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(_hash(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda r: F.concat_ws(":", r["node"].cast("string"), r["hash"]))).alias("hash"))
        level = base.written(up.select("volume", F.lit(depth).alias("level"), "node", "hash"), "nodes")
        levels.append(level)
    tree = levels[0]
    for other in levels[1:]:
        tree = tree.unionByName(other)
    return tree, depth


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "|"), 256)


def differing_ranges(a: tuple[DataFrame, int], b: tuple[DataFrame, int], fan: int = FAN) -> DataFrame:
    """(volume, node) of the leaves that differ, found by descending from differing roots."""
    depth = max(a[1], b[1])
    sides = [_raised(tree, have, depth, fan) for tree, have in (a, b)]
    front = None
    for level in range(depth, -1, -1):
        left, right = (s.where(F.col("level") == level).select("volume", "node", F.col("hash").alias(h)) for s, h in zip(sides, ("x", "y")))
        if front is not None:
            above = front.select("volume", F.col("node").alias("above"))
            left, right = (s.withColumn("above", F.floor(F.col("node") / fan).cast("long")).join(above, ["volume", "above"], "left_semi").drop("above") for s in (left, right))
        front = left.join(right, ["volume", "node"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("volume", "node")
        front = base.written(front, "front")  # each level reads the one above it twice
    return front


def _raised(tree: DataFrame, have: int, depth: int, fan: int) -> DataFrame:
    """A lower tree gets further levels above its root, so that levels of both replicas mean the same."""
    for level in range(have + 1, depth + 1):
        up = tree.where(F.col("level") == level - 1).groupBy("volume", F.floor(F.col("node") / fan).cast("long").alias("node")).agg(_hash(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda r: F.concat_ws(":", r["node"].cast("string"), r["hash"]))).alias("hash"))
        tree = tree.unionByName(up.select("volume", F.lit(level).alias("level"), "node", "hash"))
    return tree


def audit(a: DataFrame, b: DataFrame, span: int = RANGE, fan: int = FAN) -> DataFrame:
    """Records in which replica ``b`` departs from ``a`` (manifests as in ``MANIFEST``): volume, offset, record_id,
    length, digest_a, digest_b and kind (corrupt, missing, extra)."""
    bad = differing_ranges(merkle_tree(a, span, fan), merkle_tree(b, span, fan), fan)
    within = [m.withColumn("node", F.floor(F.col("offset") / span).cast("long")).join(bad, ["volume", "node"], "left_semi") for m in (a, b)]
    left = within[0].select("volume", "offset", F.col("record_id").alias("ra"), F.col("length").alias("la"), F.col("digest").alias("digest_a"))
    right = within[1].select("volume", "offset", F.col("record_id").alias("rb"), F.col("length").alias("lb"), F.col("digest").alias("digest_b"))
    both = left.join(right, ["volume", "offset"], "full").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    return both.select("volume", "offset", F.coalesce("ra", "rb").alias("record_id"), F.coalesce("la", "lb").alias("length"), "digest_a", "digest_b", kind.alias("kind"))
