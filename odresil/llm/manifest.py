"""A Merkle manifest of a dataset, with a membership proof for every row by fractal traversal.

A row's leaf is the sha256 of its fields, each ``-`` if null, else its byte count, a colon and its value.  Leaves of a source
ascend by doc_id; every ``FAN`` consecutive nodes become one until one is left, the source's subroot; subroots, ordered by
source, become the root in the same way.

Sources are spread over ranges of (source, doc_id), each range numbers its own leaves, and the driver adds one count a
range.  Trees are cut into aligned blocks of ``FAN ** depth`` nodes; a task reduces a block to its top node, and tops are the
nodes of the next tier, until every source has one node.  Proofs go down the same tiers: a block's own proof is appended to
those of its nodes.

Within a block, authentication paths come out leaf by leaf by fractal traversal: each level keeps one existing run, the
``FAN`` nodes around the path, and one desired run, the next one of that level, which grows by one node whenever the leaf
has moved on so far that a node of the level below is passed.  When the path leaves a run, the desired run takes its place.
So a path costs a bounded number of hashes and ``2 * FAN * depth`` digests of memory, and no level is held whole.

Cases: a null source is a source of its own and comes first; a null doc_id comes first in its source and is never tampered
with; rows with the same doc_id are leaves each, ordered by their digest, and identical rows have neighbouring places; null
and empty texts have different leaves; very long texts are hashed whole, in the JVM; the one row of a table is its own
root and has an empty proof; an empty table gives no rows; columns other than those of documents are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Children of a node, levels of a block.
FAN, DEPTH = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def group_of(source: Column) -> Column:
    """A source's name as a group without nulls, in the same order: null first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def combined(digests) -> str:
    """The digest of some digests, as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """sha256 over a row's fields."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column, damage: Column) -> DataFrame:
    """(doc_id, source, leaf, other): ``other`` is the leaf with the text ``damage`` where ``tampered`` holds, else null."""
    fields = {name: F.col(name) for name in FIELDS}
    other = F.when(tampered, leaf(fields | {"text": damage}))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(fields).alias("leaf"), other.alias("other"))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``pos``: a row's place among those of its group, in ascending order (nulls first).

    Rows are dealt by ranges of (group, order, arrival), so that neither a large group nor copies of a row meet in one task;
    each task counts its own rows, and only the group that a task starts with can have rows in tasks before it."""
    base.small_batches(rows.sparkSession)
    keys = [group, *order, "_arrival"]
    dealt = rows.withColumn("_arrival", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_arrival")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at = rows.columns.index(group)

    def run(batches):
        from pyspark import TaskContext

        part, before, last = TaskContext.get().partitionId(), 0, None
        runs, start = 0, True
        for batch in batches:
            column = batch.column(at)
            n = batch.num_rows
            if not n:
                continue
            codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
            opens = np.flatnonzero(np.diff(codes, prepend=-1) != 0)
            places, ordinal = np.arange(n), np.zeros(n, np.int64)
            ordinal[opens] = 1
            ordinal = ordinal.cumsum() - 1
            places = places - opens[ordinal]
            same = not start and column[0].as_py() == last
            places[ordinal == 0] += before if same else 0
            ordinal = ordinal + runs - (1 if same else 0)
            runs, last, start, before = int(ordinal[-1]) + 1, column[n - 1].as_py(), False, int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(ordinal), pa.array(places)], names=[*batch.schema.names, "_part", "_run", "_place"])

    placed = base.written(dealt.mapInArrow(base.lean(run), f"{fields}, _part long, _run long, _place long"), "numbered")
    ends = placed.groupBy("_part").agg(F.min(F.struct("_run", group)).alias("first"), F.max(F.struct("_run", F.col("_place") + 1, group)).alias("last"))
    offsets, held, count = [], (), 0
    for r in ends.orderBy("_part").collect():  # a row for each range
        first, (run_no, n, name) = r["first"][group], r["last"]
        offset = count if held == (first,) else 0
        offsets.append((r["_part"], offset))
        held, count = (name,), n + (offset if run_no == 0 else 0)
    starts = rows.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    place = F.col("_place") + F.when(F.col("_run") == 0, F.col("_offset")).otherwise(F.lit(0))
    return placed.join(F.broadcast(starts), "_part").withColumn("pos", place).drop("_part", "_run", "_place", "_offset")


def climbed(digests: list[str], whole: bool, depth: int = DEPTH) -> list[str]:
    """Levels are joined run by run: ``depth`` times if other blocks stand beside this one, else until one node is left."""
    level = 0
    while len(digests) > 1 or whole and level < depth:
        digests = [combined(digests[k : k + FAN]) for k in range(0, len(digests), FAN)]
        level += 1
    return digests


def _whole(block: int, size: int, depth: int) -> bool:
    """A group's first block can be its only one; all others, and a full first one, have all their levels."""
    return block > 0 or size == FAN**depth


def tops(nodes: DataFrame, depth: int) -> DataFrame:
    """(grp, pos, digest) of the next tier: the top node of each block of (grp, pos, digest)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        block = table["block"][0].as_py()
        top = climbed(table["digest"].to_pylist(), _whole(block, table.num_rows, depth), depth)
        return pa.table({"grp": table["grp"][:1], "pos": pa.array([block], pa.int64()), "digest": pa.array(top, pa.string())})

    blocks = nodes.select("grp", "pos", "digest", F.floor(F.col("pos") / FAN**depth).cast("long").alias("block"))
    return blocks.groupBy("grp", "block").applyInArrow(base.lean_group(run), "grp string, pos long, digest string")


class Level:
    """One level of a block's traversal: the existing run around the path and the desired run that follows it."""

    def __init__(self, below, size: int):
        self.below, self.size = below, size  # a function from an index to the node of this level, and how many nodes there are
        self.at, self.existing, self.desired = 0, [below(k) for k in range(min(FAN, size))], []
        self.grow()

    def move(self, index: int) -> None:
        """The path now goes through node ``index``, the next one; the desired run grows by one node."""
        if index // FAN != self.at:
            self.at, self.existing, self.desired = index // FAN, self.desired, []
        self.grow()

    def grow(self) -> None:
        ahead = (self.at + 1) * FAN + len(self.desired)
        if ahead < min(self.size, (self.at + 2) * FAN):
            self.desired.append(self.below(ahead))


def paths(digests: list[str], whole: bool, depth: int = DEPTH):
    """For each leaf of a block in turn, its path as a list of (digests to the left, digests to the right), from the leaf up.

    A node is hashed as the desired run of its level grows, and once more for each level above it."""
    sizes = [len(digests)]
    while sizes[-1] > 1 or whole and len(sizes) <= depth:
        sizes.append(-(-sizes[-1] // FAN))
    makers = [lambda k: digests[k]]
    for k in range(len(sizes) - 2):
        makers.append(_maker(makers[k], sizes[k]))
    levels = [Level(make, size) for make, size in zip(makers, sizes[:-1])]
    for leaf_at in range(len(digests)):
        path, index = [], leaf_at
        for up, level in enumerate(levels):
            if leaf_at and leaf_at % FAN**up == 0:
                level.move(index)
            here = index - level.at * FAN
            path.append((level.existing[:here], level.existing[here + 1 :]))
            index //= FAN
        yield path


def _maker(below, size: int):
    return lambda k: combined([below(c) for c in range(k * FAN, min((k + 1) * FAN, size))])


def folded(digest: str, path) -> str:
    """The top node that a digest and its path lead to."""
    for left, right in path:
        digest = combined([*left, digest, *right])
    return digest


STEPS = "array<struct<left:array<string>,right:array<string>>>"


def descended(nodes: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """(grp, pos, digest, steps): each node's path through its block, followed by its block's own path."""
    kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))

    def run(key, table: pa.Table, upper: pa.Table | None) -> pa.Table:
        table = table.sort_by("pos")
        digests = table["digest"].to_pylist()
        rest = upper["steps"][0].as_py() if upper is not None and upper.num_rows else []
        steps = [[{"left": a, "right": b} for a, b in p] + rest for p in paths(digests, _whole(key[1], len(digests), depth), depth)]
        return pa.table({"grp": table["grp"], "pos": table["pos"], "digest": table["digest"], "steps": pa.array(steps, kind)})

    return _by_block(nodes, above, depth, run, f"grp string, pos long, digest string, steps {STEPS}")


def proven(rows: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """(doc_id, leaf, grp, proof_sha256, folded_root) of the lowest tier (doc_id, grp, pos, digest, other).

    The path of each leaf is hashed and folded as it comes out, and not kept."""

    def run(key, table: pa.Table, upper: pa.Table | None) -> pa.Table:
        table = table.sort_by("pos")
        digests, others = table["digest"].to_pylist(), table["other"].to_pylist()
        rest = [(s["left"], s["right"]) for s in upper["steps"][0].as_py()] if upper is not None and upper.num_rows else []
        tail = "".join(x for left, right in rest for x in (*left, *right)).encode()
        proofs, roots = [], []
        for k, path in enumerate(paths(digests, _whole(key[1], len(digests), depth), depth)):
            proof = hashlib.sha256("".join(x for left, right in path for x in (*left, *right)).encode())
            proof.update(tail)
            proofs.append(proof.hexdigest())
            roots.append(folded(others[k] or digests[k], [*path, *rest]))
        return pa.table({"doc_id": table["doc_id"], "leaf": table["digest"], "grp": table["grp"], "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})

    return _by_block(rows, above, depth, run, "doc_id long, leaf string, grp string, proof_sha256 string, folded_root string")


def _by_block(nodes: DataFrame, above: DataFrame | None, depth: int, run, schema: str) -> DataFrame:
    """Applies ``run`` to each block and the path of its top node, if there is a tier above."""
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / FAN**depth).cast("long"))
    keys = ["grp", "block"]
    if above is None:
        return blocks.groupBy(*keys).applyInArrow(lambda key, table: base.lean_group(lambda t: run(_values(key), t, None))(table), schema)
    upper = above.select("grp", F.col("pos").alias("block"), "steps")

    def pair(key, table, other):
        return base.lean_pair(lambda a, b: run(_values(key), a, b))(table, other)

    return blocks.groupBy(*keys).cogroup(upper.groupBy(*keys)).applyInArrow(pair, schema)


def _values(key) -> tuple:
    return tuple(k.as_py() for k in key)


def tree(nodes: DataFrame, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """((grp, digest) of each group's last node, the tiers above ``nodes``)."""
    tiers = []
    while True:
        nodes = base.written(tops(nodes, depth), "tops")
        if not nodes.where("pos > 0").limit(1).count():
            return nodes.select("grp", "digest"), tiers
        tiers.append(nodes)


def proofs_of(tiers: list[DataFrame], above: DataFrame | None, depth: int) -> DataFrame | None:
    """The paths of the lowest of some tiers' nodes; ``above`` has those of what the highest tier's blocks lead to."""
    for nodes in reversed(tiers):
        above = base.written(descended(nodes, above, depth), "paths")
    return above


def manifest(docs: DataFrame, tampered: Column, damage: Column, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row."""
    rows = base.written(leaves(docs, tampered, damage), "leaves")
    lowest = numbered(rows.select("doc_id", group_of(F.col("source")).alias("grp"), F.col("leaf").alias("digest"), "other"), "grp", "doc_id", "digest")
    lowest = base.written(lowest, "places")
    subroots, tiers = tree(lowest, depth)
    # subroots are the lowest nodes of the tree above, in the order of their sources
    named = subroots.select(F.col("grp").alias("source"), "digest", F.lit("").alias("grp"))
    ranked = base.written(numbered(named, "grp", "source"), "subroots")
    upper = ranked.select("grp", "pos", "digest")
    last, upper_tiers = tree(upper, depth)
    root = next((r.digest for r in last.collect()), "")  # one group
    of_subroots = proofs_of([upper, *upper_tiers], None, depth)
    # the path above a source's last node is that of its subroot
    above = of_subroots.select("pos", "steps").join(ranked.select("pos", "source"), "pos")
    above = base.written(above.select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("pos"), "steps"), "paths")
    out = base.written(proven(lowest, proofs_of(tiers, above, depth), depth), "proofs")
    ends = base.written(subroots.withColumnRenamed("digest", "subroot"), "ends")
    columns = ["doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root"]
    return out.join(ends, "grp").select(*columns, (F.col("folded_root") == F.lit(root)).alias("verified"))
