"""The trie of conversation prefixes, rolled up by centroid decomposition of its parent edges.

A prefix is known by its depth and a sum of hashes of (place, role, text), modulo 2 ** 62 and twice, so prefixes are running sums.
Sums over subtrees: a component's centroid is its deepest node that holds half of the component's nodes below it, and those
that do are just the nodes from the centroid up to the component's top. The total of what hangs at the centroid is added to
each node on that path, the centroid has its own sum, and the component falls apart into the centroid's children and the rest, none of
them larger than half. So a path of a million turns takes twenty steps, as a bushy trie would. Components of more
than ``local`` nodes are split by joins and aggregates; the rest are rolled up in tasks, many at a time, by the same steps.
What hangs at a centroid, and at which of its children, is looked up on the path of the node's first member at the centroid's
depth. Sizes to find the first centroids by come from doubling ancestors, looked up in the same way.

Skew: turns are dealt by range over (conversation, turn), so one long conversation is spread over tasks; running
numbers and sums are made within a partition, and a table of what earlier partitions hold of the same conversation, at
most two rows a partition, completes them. A common prefix is summed before it is shuffled and met by
:func:`util.attach`. Member ids are hashed in order as packed runs, with the state carried from run to run.

Edge cases: rows without a conv_id belong to no conversation; null roles and texts are empty; null turns come first, equal
turns by role and text; repeated rows are turns of their own; other columns are ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import util

#: Nodes of the largest component that one task rolls up, and ids in a packed run.
LOCAL, RUN = 4096, 4096
MASK = (1 << 62) - 1
EMPTY = hashlib.sha256(b"").hexdigest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at: the place of a row among those of its key in this partition, from 1; s1, s2: sums of w1, w2 up to it."""
    pid, key, at, sums = TaskContext.get().partitionId(), None, 0, np.zeros(2, np.uint64)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys = b.column("c").to_numpy()
        w = np.stack([b.column(x).to_numpy().view(np.uint64) for x in ("w1", "w2")])
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        with np.errstate(over="ignore"):
            total = np.cumsum(w, axis=1, dtype=np.uint64)
            before = np.where(first > 0, total[:, first - 1], 0).astype(np.uint64)
            goes_on = keys[0] == key
            base = -before
            if goes_on:
                base[:, 0] += sums
            s = total + base[:, run]
        places = np.arange(n) - first[run] + 1
        if goes_on:
            places[run == 0] += at
        key, at, sums = keys[-1], int(places[-1]), s[:, -1].copy()
        made = [pa.array(np.full(n, pid, np.int32)), pa.array(places), *[pa.array((x & np.uint64(MASK)).astype(np.int64)) for x in s]]
        yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "pid", "at", "s1", "s2"])


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (c, w1, w2 and others) with at, s1, s2 over the rows of a key in ``order``, however they are spread over tasks."""
    dealt = rows.repartitionByRange("c", *order).sortWithinPartitions("c", *order).select(*[c for c in rows.columns if not c.startswith("_")])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    made = util.save(dealt.mapInArrow(_numbered, f"{types}, pid int, at long, s1 long, s2 long"), name)
    ends = made.groupBy("c", "pid").agg(F.max(F.struct("at", "s1", "s2")).alias("end"))
    spread = util.save(made.groupBy("c").agg(F.min("pid").alias("one"), F.max("pid").alias("other")).where("one <> other").select("c"), name + "-spread")
    ends = ends.join(util.hinted(spread, 100_000), "c", "left_semi")
    before = W.partitionBy("c").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    sums = {f"_{x}": F.coalesce(F.sum(F.col(f"end.{x}").cast("decimal(38,0)")).over(before) % F.lit(1 << 62), F.lit(0)).cast("long") for x in ("at", "s1", "s2")}
    earlier = util.save(ends.select("c", "pid", *[x.alias(k) for k, x in sums.items()]), name + "-earlier")
    both = made.join(util.hinted(earlier, 100_000), ["c", "pid"], "left")
    moved = {x: (F.col(x) + F.coalesce(F.col(f"_{x}"), F.lit(0))).bitwiseAND(F.lit(MASK)) for x in ("at", "s1", "s2")}
    return both.select(*dealt.columns, *[x.alias(k) for k, x in moved.items()])


def turns(talks: DataFrame) -> DataFrame:
    """c, at (from 1), x1, x2 (hashes of role and text), bytes of each turn."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    rows = talks.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"), F.monotonically_increasing_id().alias("_row"),
        F.xxhash64(role, text).alias("x1"), F.xxhash64(text, F.lit(1), role).alias("x2"), F.octet_length(text).cast("long").alias("bytes"),
        *[F.lit(0).cast("long").alias(w) for w in ("w1", "w2")],
    )
    found = numbered(rows, [F.asc_nulls_first("_turn"), F.col("_role"), F.col("_text"), F.col("_row")], "turns")
    return util.save(found.select("c", "at", "x1", "x2", "bytes"), "turns")


def rebuilt(found: DataFrame) -> DataFrame:
    """c, depth, x1, x2, bytes, is_end: the turns of each rebuilt conversation, and depth 0 of each."""
    sizes = util.save(found.groupBy("c").agg(F.count(F.lit(1)).alias("len")), "talks")
    talks = sizes.select("c", "len", (F.col("c") - F.col("c") % 5).alias("b"), (F.crc32(F.col("c").cast("string").cast("binary")) % 9).alias("h"))
    talks = talks.join(sizes.select(F.col("c").alias("b"), F.col("len").alias("base_len")), "b", "left")
    talks = talks.withColumn("lent", F.least("h", F.coalesce("base_len", F.lit(0))))
    talks = util.save(talks.select("c", "b", "h", "len", "lent", (F.col("lent") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")), "talks")
    own = util.attach(found, talks.drop("b"), ["c"], "len", ["at"]).where(F.col("at") > F.col("h"))
    own = own.select("c", (F.col("lent") + F.col("at") - F.col("h")).alias("depth"), "x1", "x2", "bytes", "total")
    lent = found.where(F.col("at") <= 8).withColumnRenamed("c", "b").join(talks.select("c", "b", "h", "total"), "b").where(F.col("at") <= F.col("h"))
    lent = lent.select("c", F.col("at").alias("depth"), "x1", "x2", "bytes", "total")
    zero = F.lit(0).cast("long")
    root = talks.select("c", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("bytes"), "total")
    return own.unionByName(lent).unionByName(root).select("c", "depth", "x1", "x2", "bytes", (F.col("depth") == F.col("total")).alias("is_end"))


def trie(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes: nid, depth, conv_id, n_convs, bytes, parent, parent_conv_id, n_children. Paths: c, depth, nid, conv_id (of the node), is_end."""
    weight = lambda *of: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*of).bitwiseAND(F.lit(MASK)))
    rows = rows.select("c", "depth", "bytes", "is_end", weight("depth", "x1", "x2").alias("w1"), weight("x2", "depth", "x1").alias("w2"))
    summed = numbered(rows, [F.col("depth")], "prefixes").select("c", "depth", "bytes", "is_end", "s1", "s2")
    key = ["depth", "s1", "s2"]
    nodes = summed.groupBy(*key).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = util.save(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")
    paths = util.attach(summed.drop("bytes"), nodes.drop("bytes"), key, "n_convs", ["c"])
    paths = util.save(paths.select("c", "depth", "nid", "conv_id", "is_end"), "paths")
    up = paths.select(F.col("c").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = util.save(nodes.join(up, ["conv_id", "depth"], "left"), "linked-nodes")
    children = linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("nid")).agg(F.count(F.lit(1)).alias("n_children"))
    done = linked.join(children, "nid", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return util.save(done.drop("s1", "s2"), "nodes"), paths


def ancestors(nodes: DataFrame, paths: DataFrame, depth: Column, name: str) -> DataFrame:
    """``nodes`` with the column ``name``: the ancestor (or the node itself) at ``depth``, null below zero or beyond the node."""
    asked = nodes.withColumn("_depth", F.when((depth >= 0) & (depth <= F.col("depth")), depth))
    known = paths.select(F.col("c").alias("conv_id"), F.col("depth").alias("_depth"), F.col("nid").alias(name))
    return asked.join(known, ["conv_id", "_depth"], "left").drop("_depth")


def sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nid, size: nodes of each subtree. After round k a node knows those less than 2 ** k below it."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    sized, step = nodes.select("nid", "depth", "conv_id", F.lit(1).cast("long").alias("size")), 1
    while step <= deepest:
        above = ancestors(sized, paths, F.col("depth") - step, "_up").where("_up IS NOT NULL").groupBy(F.col("_up").alias("nid")).agg(F.sum("size").alias("_more"))
        sized = sized.join(above, "nid", "left").select("nid", "depth", "conv_id", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))
        sized, step = util.save(sized, "sizes"), 2 * step
    return sized.select("nid", "size")


def led(pointer: np.ndarray) -> np.ndarray:
    """Where each row ends up by following ``pointer``."""
    while (new := pointer[pointer]).tobytes() != pointer.tobytes():
        pointer = new
    return pointer


def rolled_up(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the subtrees of a forest, by centroid decomposition of all its trees at once. parent: -1 at tops."""
    n = len(parent)
    me, top = np.arange(n), parent < 0
    size = np.ones(n, np.int64)
    for d in range(int(depth.max(initial=0)), int(depth.min(initial=0)), -1):
        at = np.flatnonzero((depth == d) & ~top)
        np.add.at(size, parent[at], size[at])
    out, alive = np.zeros_like(values), np.ones(n, bool)
    while alive.any():
        comp = led(np.where(top | ~alive, me, parent))
        heavy = alive & (2 * size >= size[comp])
        deepest = np.full(n, -1)
        np.maximum.at(deepest, comp[heavy], depth[heavy])
        centre = heavy & (depth == deepest[comp])
        of = np.zeros(n, np.int64)
        of[comp[centre]] = me[centre]
        below = alive & centre[led(np.where(top | centre | ~alive, me, parent))]
        total = np.zeros_like(values)
        np.add.at(total, comp[below], values[below])
        path = heavy & ~centre
        out[path] += total[comp[path]]
        out[centre] += total[comp[centre]]
        size[path] -= size[of[comp[path]]]
        alive &= ~centre
        top = top | (alive & (parent >= 0) & centre[np.maximum(parent, 0)])
    return out


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nid, leaves, saved of whole components in sorted rows, many components at a time."""

    def of(t: pa.Table) -> pa.RecordBatch:
        nid, comp, parent, depth = (t.column(c).to_numpy() for c in ("nid", "comp", "parent", "depth"))
        order = np.argsort(nid, kind="stable")
        at = order[np.minimum(np.searchsorted(nid[order], parent), len(nid) - 1)]
        mine = np.stack([t.column(c).to_numpy() for c in ("leaf", "own")], 1)
        sums = rolled_up(np.where(nid == comp, -1, at), depth, mine) + np.stack([t.column(c).to_numpy() for c in ("leaves", "saved")], 1)
        return pa.RecordBatch.from_arrays([pa.array(nid), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["nid", "leaves", "saved"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 4 * LOCAL:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        comp = rows.column("comp").to_numpy()
        cut = int(np.searchsorted(comp, comp[-1]))
        if cut:
            yield of(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if sum(x.num_rows for x in held):
        yield of(pa.Table.from_batches(held).combine_chunks())


def subtree_sums(nodes: DataFrame, paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """nid, leaves, saved: sums over subtrees of leaf and own. nodes: nid, parent, depth, conv_id, leaf, own."""
    zero = F.lit(0).cast("long")
    root = nodes.where("depth = 0").select("nid").first()[0]
    n = nodes.count()
    tree = nodes.select("nid", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", "conv_id", "leaf", "own", zero.alias("leaves"), zero.alias("saved"), F.lit(root).cast("long").alias("comp"), F.lit(n).cast("long").alias("total"))
    kept = ["nid", "parent", "depth", "conv_id", "leaf", "own", "leaves", "saved", "comp", "total", "size"]
    sums = ["nid", "leaves", "saved"]
    done, small, large = [], [], None
    if n > local:
        large = tree.join(sizes(nodes, paths), "nid").select(kept)
    else:
        small.append(tree)
    while large is not None:
        heavy = large.where(2 * F.col("size") >= F.col("total")).groupBy("comp").agg(F.max(F.struct("depth", "nid", "size")).alias("c"))
        centre = util.save(heavy.select("comp", F.col("c.depth").alias("c_depth"), F.col("c.nid").alias("c_nid"), F.col("c.size").alias("c_size")), "centroids")
        rows = ancestors(large.join(util.hinted(centre, 100_000), "comp"), paths, F.col("c_depth"), "_at")
        rows = rows.withColumn("_below", F.coalesce(F.col("_at") == F.col("c_nid"), F.lit(False))).drop("_at")
        rows = ancestors(rows, paths, F.when(F.col("_below"), F.col("c_depth") + 1), "_child")
        rows = util.save(rows, "split")
        hung = util.save(rows.where("_below").groupBy("comp").agg(F.sum("leaf").alias("_leaves"), F.sum("own").alias("_saved")), "hung")
        rows = rows.join(util.hinted(hung, 100_000), "comp")
        path = ~F.col("_below") & (2 * F.col("size") >= F.col("total"))
        gains = path | (F.col("nid") == F.col("c_nid"))
        rows = rows.withColumns({x: F.col(x) + F.when(gains, F.col(f"_{x}")).otherwise(0) for x in ("leaves", "saved")})
        rows = rows.withColumn("size", F.col("size") - F.when(path, F.col("c_size")).otherwise(0))
        rows = util.save(rows.withColumn("comp", F.when(F.col("_below"), F.col("_child")).otherwise(F.col("comp"))), "split")
        done.append(rows.where("nid = c_nid").select(sums))
        rows = rows.where("nid <> c_nid")
        tops = util.save(rows.where("nid = comp").select("comp", F.col("size").alias("_total")), "components")
        rows = util.save(util.attach(rows, tops, ["comp"], "_total", ["nid"]).withColumn("total", F.col("_total")).select(kept), "split")
        small.append(rows.where(F.col("total") <= local).drop("size"))
        large = rows.where(F.col("total") > local)
        if not large.limit(1).count():
            large = None
    for rows in small:
        cells = rows.select("comp", "nid", "parent", "depth", "leaf", "own", "leaves", "saved").repartition("comp").sortWithinPartitions("comp")
        done.append(cells.mapInArrow(_local, "nid long, leaves long, saved long"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return util.save(out, "subtree-sums")


def end_digests(paths: DataFrame) -> DataFrame:
    """nid, ends_sha256 of the nodes at which conversations end: SHA-256 of their ids, ascending and joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nid, ids = None, []
        made: list[tuple[int, int, str]] = []
        for b in batches:
            for k, c in zip(b.column("nid").to_pylist(), b.column("c").to_pylist()):
                if ids and (k != nid or len(ids) == RUN):
                    made.append((nid, ids[0], ",".join(map(str, ids))))
                    ids = []
                nid = k
                ids.append(c)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["nid", "first", "ids"])
                made = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([nid]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["nid", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nid, state, made = None, hashlib.sha256(), []
        for b in batches:
            for k, ids in zip(b.column("nid").to_pylist(), b.column("ids").to_pylist()):
                if k != nid:
                    if nid is not None:
                        made.append((nid, state.hexdigest()))
                    nid, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["nid", "ends_sha256"])
                made = []
        if nid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([nid]), pa.array([state.hexdigest()])], ["nid", "ends_sha256"])

    ends = paths.where("is_end").select("nid", "c").repartitionByRange("nid", "c").sortWithinPartitions("nid", "c")
    packed = ends.mapInArrow(runs, "nid long, first long, ids string")
    return packed.repartition("nid").sortWithinPartitions("nid", "first").select("nid", "ids").mapInArrow(digests, "nid long, ends_sha256 string")


def build(talks: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    found = turns(talks)
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not found.limit(1).count():
        return talks.sparkSession.createDataFrame([], schema)
    nodes, paths = trie(rebuilt(found))
    valued = nodes.select("nid", "parent", "depth", "conv_id", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"))
    sums = subtree_sums(valued, paths, local)
    done = nodes.join(sums, "nid").join(end_digests(paths), "nid", "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
