"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct word shingles as 64-bit hashes.  Each permutation is evaluated once and gives two
signature values, the least and the greatest image, so ``BANDS * ROWS`` values need half as many evaluations.  Bands
of ``ROWS`` values make candidates: at similarity 0.8 a pair shares no band with probability (1 - 0.8^4)^32 = 5e-8.

Rows with equal sets are one class (a fingerprint of the set), and classes that share a doc_id are one node.  Each bucket
of a band names its most central class the pivot, so a group of copies costs a (class, pivot) pair for each member.  The
pairs are dealt by pivot, a pivot with many members over several parts, and sorted, so that a task holds one pivot's set
while the members' sets stream by.  Links give components by hooking and contraction.  Classes that buckets connect form a family; where a
family still has several components, every class outside its largest one is compared with the whole family, in bounded
blocks that count common shingles exactly and return links alone.  So a link between different texts is lost only if no
band has both.

Cases: null, empty or wordless texts have no shingles and link with nothing; texts of fewer words than a shingle are one
shingle; very long texts are one set each; rows with the same doc_id keep their own n_shingles and have one component id,
to which each of their texts may link others; of equally central classes the one of the greatest id is the pivot; a null
doc_id gives a null component id and is kept; an empty table gives no rows; columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .textcols import mixed, word_column, word_hashes

SHINGLE, BANDS, ROWS = 5, 32, 4
#: Shingles of the two sides of a block of family comparisons, classes of families that share a box, members of a pivot's part.
ASKED, AGAINST, SMALL, PART = 100_000, 400_000, 200, 500


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, index, at = word_column(texts)
    h = mixed(word_hashes(words))[index] if words else np.empty(0, np.uint64)
    odd = np.uint64(0xC2B2AE3D27D4EB4F)
    code = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        code = mixed(code * odd + h[k : k + len(code)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(code[a : b - width + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for x in h[a:b]:
                short = mixed(short * odd + x)
            out.append(mixed(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys [set, band] of non-empty sets: permutation p gives its minimum and its maximum."""
    n = bands * rows // 2
    times, plus = _constants(n)
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), 2 * n), np.uint64)
    lo = 0
    while lo < len(sets):  # as many sets at a time as stay in the cache
        hi = lo + 1
        while hi < len(sets) and sizes[lo : hi + 1].sum() <= 1 << 15:
            hi += 1
        x, at = np.concatenate(sets[lo:hi]), np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])
        for p in range(n):
            y = (x ^ plus[p]) * times[p]
            y ^= y >> np.uint64(32)
            out[lo:hi, 2 * p] = np.minimum.reduceat(y, at)
            out[lo:hi, 2 * p + 1] = np.maximum.reduceat(y, at)
        lo = hi
    # minimum and maximum of a permutation go to different bands
    values = np.concatenate([out[:, 0::2], out[:, 1::2]], 1).reshape(len(sets), rows, bands).transpose(0, 2, 1)
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys = mixed(keys * np.uint64(0xC2B2AE3D27D4EB4F) + values[:, :, r])
    return mixed(keys + np.arange(bands, dtype=np.uint64))


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def fingerprinted(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, print, bands): the set's size, its fingerprint and band keys; null where it is empty."""
    base.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            some = [k for k, s in enumerate(sets) if len(s)]
            keys = signatures([sets[k] for k in some]).astype(np.int64).tolist() if some else []
            bands = [None] * len(sets)
            for k, row in zip(some, keys):
                bands[k] = row
            prints = [_fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(base.lean(run), "doc_id long, n_shingles long, print binary, bands array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(id, print, items): the sets of rows (id, text) and their fingerprints."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            prints = pa.array([_fingerprint(s) for s in sets], pa.binary())
            items = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, items], names=["id", "print", "items"])

    return docs.select("id", "text").mapInArrow(base.lean(run), "id long, print binary, items array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of the nodes of some links (a, b): the least id that they reach from each node.

    Every node hooks to its least neighbour, chains of hooks are halved until they end at a root, and links are drawn anew
    between roots; those within one tree go.  So each round has fewer links, and at most half as many nodes, as the last."""
    spark = links.sparkSession
    pair = (F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    nodes = base.written(links.select(F.col("a").alias("id")).unionAll(links.select("b")).distinct(), "nodes")
    edges = base.written(links.select(*pair).where("x < y").distinct(), "edges")
    place = None
    while edges.limit(1).count():
        hook = base.written(edges.groupBy(F.col("y").alias("id")).agg(F.min("x").alias("label")), "hook")
        while True:
            up = hook.select(F.col("id").alias("up"), F.col("label").alias("jump"))
            new = hook.join(up, hook.label == up.up, "left").select("id", F.coalesce("jump", "label").alias("label"), F.col("jump").isNotNull().alias("moved"))
            new = base.written(new, "hook")
            moved = new.where("moved").limit(1).count()
            base.remove_path(spark, hook.scratch)
            hook, scratch = new.select("id", "label"), new.scratch
            hook.scratch = scratch
            if not moved:
                break
        root = hook.select(F.col("id").alias("_from"), F.col("label").alias("_to"))
        if place is None:
            place = hook
        else:
            old = place
            moved = old.join(root, old.label == root._from, "left").select("id", F.coalesce("_to", "label").alias("label"))
            place = base.written(moved.unionAll(hook), "labels")
        again = edges.join(root, edges.x == root._from, "left").select(F.coalesce("_to", "x").alias("a"), "y")
        again = again.join(root, again.y == root._from, "left").select("a", F.coalesce("_to", "y").alias("b"))
        rest = base.written(again.select(*pair).where("x < y").distinct(), "edges")
        for done in (edges, *([] if place is hook else [old, hook])):
            base.remove_path(spark, done.scratch)
        edges = rest
    if place is None:
        place = nodes.select("id", F.col("id").alias("label"))
    out = base.written(nodes.join(place, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
    base.remove_path(spark, nodes.scratch)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) whose whole sets satisfy 100 * intersection >= percent * union.

    Pairs are dealt by b in parts of about ``PART``; a part's rows are sorted, the set of b first, so a task holds that set
    and one batch of others."""
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    asked = pairs.join(crowd, "b").select("b", part.alias("part"), F.lit(1).alias("kind"), F.col("a").alias("id"))
    asked = asked.join(sets.select("id", "items"), "id").select("b", "part", "kind", "id", "items")
    held = crowd.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.join(sets.select(F.col("id").alias("b"), "items"), "b").select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("id"), "items")
    rows = asked.unionAll(held).repartition("b", "part").sortWithinPartitions("b", "part", "kind", "id")

    def run(batches):
        pivot, pivots = None, []
        for batch in batches:
            b, kinds, ids = (batch.column(k).to_pylist() for k in (0, 2, 3))
            bounds = np.asarray(batch.column(4).offsets)
            flat = np.asarray(batch.column(4).values)
            found = []
            for k in range(len(b)):
                x = flat[bounds[k] : bounds[k + 1]]  # ascending as unsigned numbers
                if kinds[k] == 0:
                    if b[k] != pivot:
                        pivot, pivots = b[k], []
                    pivots.append(x.copy())
                    continue
                for y in pivots:
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    common = _common(x.view(np.uint64), y.view(np.uint64))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append((ids[k], pivot))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(base.lean(run), "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two ascending arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def block_links(a_ids, a_labels, a_sets, b_ids, b_labels, b_sets, percent: int):
    """For each set of ``a`` and each other label, one set of ``b`` with that label that it links to, if there is one.

    All sets are taken relative to one of them, p: |x ^ y| = |(x ^ p) ^ (y ^ p)|, and copies of one text differ from p in
    few shingles, so the inverted index over the differences has short lists where the sets themselves share all."""
    p = b_sets[0]
    differ = [np.setxor1d(x, p, assume_unique=True) for x in b_sets]
    sizes = np.array([len(d) for d in differ])
    flat, owner = np.concatenate(differ), np.repeat(np.arange(len(differ)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    n_b = np.array([len(x) for x in b_sets])
    b_labels, out = np.asarray(b_labels), []
    for ident, label, x in zip(a_ids, a_labels, a_sets):
        d = np.setxor1d(x, p, assume_unique=True)
        lo, hi = np.searchsorted(flat, d, "left"), np.searchsorted(flat, d, "right")
        spans = [owner[i:j] for i, j in zip(lo.tolist(), hi.tolist()) if j > i]
        shared = np.bincount(np.concatenate(spans), minlength=len(b_sets)) if spans else np.zeros(len(b_sets), np.int64)
        common = (len(x) + n_b - (len(d) + sizes - 2 * shared)) // 2
        linked = np.flatnonzero((100 * common >= percent * (len(x) + n_b - common)) & (b_labels != label))
        out += [(ident, b_ids[k]) for k in linked[np.unique(b_labels[linked], return_index=True)[1]].tolist()]
    return out


def remaining_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a family (the classes that buckets connect).

    Every class outside its family's largest component is compared with all of the family, in blocks of ``ASKED`` by
    ``AGAINST`` classes, so no task grows with a family; small families share a block."""
    star = members.select(F.col("id").alias("a"), F.col("p").alias("b")).where("a <> b").distinct()
    found = components(star)
    family = found.withColumnRenamed("label", "family")
    sizes = members.groupBy("id").agg(F.max("n").alias("n"))
    placed = base.written(family.join(labels, "id", "left").join(sizes, "id").select("id", "n", "family", F.coalesce("label", "id").alias("label")), "families")
    base.remove_path(members.sparkSession, found.scratch)
    by = Window.partitionBy("family")  # over a row for each component of a family
    parts = placed.groupBy("family", "label").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    parts = parts.withColumn("m", F.sum("c").over(by)).withColumn("all", F.sum("n").over(by)).withColumn("top", F.max(F.struct("c", "label", "n")).over(by))
    several = parts.where("m > c").groupBy("family").agg(F.first("m").alias("m"), F.first("all").alias("all"), F.first("top.label").alias("top"), (F.first("all") - F.first("top.n")).alias("rest"))
    placed = placed.join(several, "family")
    n_i, n_j = F.ceil(F.col("rest") / ASKED).cast("int"), F.ceil(F.col("all") / AGAINST).cast("int")
    placed = placed.withColumn("box", F.when(F.col("m") > SMALL, F.xxhash64("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(1021)))).join(sets, "id")
    placed = base.written(placed.select("box", "family", "id", "label", "items", "top", n_i.alias("n_i"), n_j.alias("n_j")), "blocks")
    again = placed.sparkSession.read.schema(placed.schema).parquet(placed.scratch)  # the other side of the cogroup
    asked = placed.where("label <> top").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n_i")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)))
    against = again.withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_j")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)))
    columns = ["box", "i", "j", "family", "id", "label", "items"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            sides = []
            for t in (left, right):
                by_family: dict = {}
                t = t.sort_by([("family", "ascending"), ("id", "ascending")])
                items = [np.asarray(x.values).view(np.uint64) for x in t["items"].combine_chunks()]
                for k, f in enumerate(t["family"].to_pylist()):
                    by_family.setdefault(f, []).append(k)
                sides.append((by_family, t["id"].to_pylist(), t["label"].to_pylist(), [np.sort(x) for x in items]))
            for f, rows in sides[0][0].items():
                others = sides[1][0].get(f)
                if others:
                    found += block_links(*([side[c][k] for k in at] for side, at in ((sides[0], rows), (sides[1], others)) for c in (1, 2, 3)), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    keys = ["box", "i", "j"]
    return asked.select(*columns).groupBy(*keys).cogroup(against.select(*columns).groupBy(*keys)).applyInArrow(base.lean_pair(compare), "a long, b long").distinct()


def shared_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that share a doc_id, for rows of one doc_id with different sets."""
    several = some.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p <> q").select("doc_id")
    of = some.join(several, "doc_id").select("doc_id", "print").distinct().join(classes.select("print", "id"), "print").select("doc_id", "id").distinct()
    least = of.groupBy("doc_id").agg(F.min("id").alias("b"))
    return of.join(least, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def link(docs: DataFrame, width: int = SHINGLE, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id per row."""
    spark = docs.sparkSession
    whole = base.written(fingerprinted(docs, width), "prints")
    classes = whole.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = base.written(classes, "classes")
    # a key holds its band; one shuffle by key serves the count and the rows
    bucket = banded.select("id", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key")).repartition("key")
    crowd = bucket.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    crowded = base.written(bucket.join(crowd.hint("merge"), "key").select("key", "id", F.col("n").cast("long").alias("n"), "m"), "buckets")
    # what is needed further on has no band keys
    rows, classes = base.written(whole.drop("bands"), "rows"), base.written(banded.select("print", "id"), "classes")
    for done in (whole, banded):
        base.remove_path(spark, done.scratch)
    some = rows.where("print is not null and doc_id is not null")
    # the class that meets most others is the pivot: of edited copies, the text they were made from
    central = crowded.groupBy("id").agg(F.sum("m").alias("met"))
    crowded = crowded.join(central, "id")
    pivot = crowded.groupBy("key").agg(F.max(F.struct("met", "id", "n")).alias("p")).select("key", F.col("p.id").alias("p"), F.col("p.n").alias("pn"))
    members = base.written(crowded.join(pivot, "key").select("id", "n", "p", "pn").distinct(), "pivots")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = base.written(sets_of(texts.join(members.select("id").distinct(), "id", "left_semi"), width).dropDuplicates(["id", "print"]).drop("print"), "sets")
    pairs = members.where(f"id <> p and n * 100 >= {percent} * pn and pn * 100 >= {percent} * n").select(F.col("id").alias("a"), F.col("p").alias("b"))
    links = base.written(confirmed(pairs.distinct(), sets, percent).unionAll(shared_ids(some, classes)), "links")
    labels = components(links)
    more = base.written(remaining_links(members, labels, sets, percent), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    named = classes.select("print", "id").join(labels, "id", "left").select("print", F.coalesce("label", "id").alias("component_id"))
    named = base.written(named, "named")
    out = rows.join(named, "print", "left")
    # a row without shingles has the component of the other rows of its doc_id
    bare = rows.where("print is null and doc_id is not null").select("doc_id").distinct()
    other = some.join(bare, "doc_id", "left_semi").join(named, "print").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    full, empty = out.where("print is not null"), out.where("print is null").drop("component_id").join(other, "doc_id", "left")
    columns = ["doc_id", "n_shingles"]
    full = full.select(*columns, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return full.unionAll(empty.select(*columns, F.coalesce("other", "doc_id").alias("component_id")))
