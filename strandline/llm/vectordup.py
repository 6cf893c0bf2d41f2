"""Near-duplicate vectors of one label by cosine, found through cross-polytope hashing and verified exactly.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; the nearest of the 2 * D signed axes
is its vertex, and a hash is ``k`` vertices of as many rotations. A vector is listed under its own hash of each table (its
home) and under the ``PROBES`` next likely ones, where vertices give way to their runners-up. Two vectors meet where one's
home is in the other's list. ``k`` is such that unrelated vectors of the largest label hardly meet, and the number of tables such
that a pair just at the limit is missed by all with a probability of ``MISS``, by the rate at which such pairs meet in a simulation.

Vectors that are equal as a whole are one class, so copies cost nothing. A pair is compared in every bucket in which it meets and
counted in the first of them, which both lists tell without any exchange, so link counts are exact and pairs are never written:
tasks send a count and one spanning link for each vector.

Skew: classes of a large bucket that lie within half the limit's angle of its mean are a crowd: all of them are linked, by
the triangle inequality, and are counted by their sizes without comparing. The others are compared with all members
in pairs of blocks, so no task holds a large bucket. Large buckets whose members lie at about the limit from
each other still cost a comparison for each pair; nothing is capped.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing and are their own component; vectors of unlike lengths are never linked; rows of equal vec_id are vectors of
their own; a null vec_id names a component only if no other does, and is kept only then; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, util

LEAST, PROBES, MISS, BLOCK = 0.98, 1, 1e-6, 256
#: Vectors of other hashes that a bucket's home holds by chance, at most.
STRAY = 1 / 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


class Hashes:
    """``tables`` hashes of ``k`` vertices for vectors of width ``dims``."""

    def __init__(self, dims: int, k: int, tables: int, seed: int = 42):
        self.k, self.tables, self.width = k, tables, 1 << max(0, (dims - 1).bit_length())
        rng = np.random.Generator(np.random.PCG64([seed, dims]))
        self.signs = rng.integers(0, 2, (tables, k, 3, self.width)) * 2.0 - 1
        ways = min(3, self.width)
        self.choices = np.array(list(itertools.product(range(ways), repeat=k)))

    def lists(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(n, 1 + PROBES) hashes of the rows of ``unit``, the home first; where there are too few, the rest are no row's home."""
        n, ways = len(unit), int(self.choices.max()) + 1
        x = np.zeros((n, self.width))
        x[:, : unit.shape[1]] = unit
        vertex, loss = np.zeros((n, self.k, ways), np.int64), np.zeros((n, self.k, ways))
        for j in range(self.k):
            y = x
            for signs in self.signs[table, j]:
                y = hadamard(y * signs)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :ways]
            top = np.take_along_axis(size, best, 1)
            vertex[:, j] = 2 * best + (np.take_along_axis(y, best, 1) < 0)
            loss[:, j] = (top[:, :1] - top) ** 2
        cost = sum(loss[:, j][:, self.choices[:, j]] for j in range(self.k))
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + PROBES]
        out = np.zeros(order.shape, np.uint64)
        for j in range(self.k):
            out = out * np.uint64(2 * self.width) + np.take_along_axis(vertex[:, j], self.choices[:, j][order], 1).astype(np.uint64)
        spare = [out[:, :1] + np.uint64((2 * self.width) ** self.k * (j + 1)) for j in range(1 + PROBES - out.shape[1])]
        return np.concatenate([out, *spare], 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits (the splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def design(n: int, dims: int, pairs: int = 4000) -> tuple[int, int]:
    """(k, tables) for ``n`` vectors of one label."""
    width = 1 << max(0, (dims - 1).bit_length())
    k = max(1, math.ceil(math.log(max(n, 2) / STRAY) / math.log(2 * width)))
    rng = np.random.Generator(np.random.PCG64(7))
    a, b = rng.standard_normal((pairs, dims)), rng.standard_normal((pairs, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dims > 1:
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = LEAST * a + math.sqrt(1 - LEAST**2) * b
    else:
        b = a
    trial = Hashes(dims, k, 4, seed=1)
    met = np.mean([meet(trial.lists(a, t)[:, None], trial.lists(b, t)[:, None]).mean() for t in range(4)])
    met = min(max(met - 3 * math.sqrt(met * (1 - met) / (4 * pairs)), 0.01), 1 - 1e-9)
    return k, max(2, math.ceil(math.log(MISS) / math.log(1 - met)))


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, tables): whether one's home is in the other's list; a, b: (pairs, tables, 1 + PROBES)."""
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


def packed(v: list[float], single: bool) -> bytes:
    """A vector's components as they came, singles in half the room: a mark of the kind, then they."""
    return b"4" + np.array(v, "<f4").tobytes() if single else b"8" + np.array(v, "<f8").tobytes()


def length(body: bytes) -> int:
    return (len(body) - 1) // (4 if body[:1] == b"4" else 8)


def unit(bodies: list[bytes], width: int) -> np.ndarray:
    """Unit vectors of doubles, filled up with zeros."""
    out = np.zeros((len(bodies), width))
    for k, b in enumerate(bodies):
        v = np.frombuffer(b, "<f4" if b[:1] == b"4" else "<f8", offset=1)
        out[k, : len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, and of vectors that may link g (their label and length), a, b (a key of label and vector) and v; else null."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = F.coalesce(fine & F.col("label").isNotNull(), F.lit(False))
    made = {"g": F.xxhash64("label", F.size(v)), "a": F.xxhash64("label", v), "b": F.xxhash64(v, "label", F.lit(1)), "v": v}
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *[F.when(fine, x).alias(c) for c, x in made.items()])


def listed(classes: DataFrame, hashes: dict[int, tuple[int, int]]) -> DataFrame:
    """cid, g, size, body, sig: the hashes of all tables, the home of each first."""
    single = "float" in classes.schema["v"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                bodies, g = [packed(x, single) for x in b.column("v").to_pylist()], b.column("g").to_numpy().view(np.uint64)
                sigs: list = [None] * len(bodies)
                sizes = np.array([length(x) for x in bodies])
                for dims in np.unique(sizes):
                    own = np.flatnonzero(sizes == dims)
                    h = made.setdefault(int(dims), Hashes(int(dims), *hashes[int(dims)]))
                    u = unit([bodies[i] for i in own], int(dims))
                    with np.errstate(over="ignore"):
                        found = [mixed(mixed(h.lists(u, t) ^ g[own][:, None]) + np.uint64(t + 1)) for t in range(h.tables)]
                    for i, row in zip(own, np.concatenate(found, 1).view(np.int64)):
                        sigs[i] = row
                columns = [b.column("cid"), b.column("g"), b.column("size"), pa.array(bodies, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["cid", "g", "size", "body", "sig"])

    return classes.select("cid", "g", "size", "v").mapInArrow(task, "cid long, g long, size long, body binary, sig array<bigint>")


def centres(large: DataFrame) -> DataFrame:
    """h, n, centre (array<double>): the sum of the unit vectors of each large bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
            hs = [h for h, v in sums.items() for _ in v]
            return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array([i for v in sums.values() for i in range(len(v))], pa.int32()), pa.array(np.concatenate(list(sums.values())))], ["h", "pos", "x"])

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            bodies = b.column("body").to_pylist()
            u = unit(bodies, max(map(length, bodies))) if bodies else []
            for h, x in zip(b.column("h").to_pylist(), u):
                old = sums.get(h)
                if old is None or len(old) < len(x):
                    sums[h] = x.copy() if old is None else x + np.pad(old, (0, len(x) - len(old)))
                else:
                    old[: len(x)] += x
            if len(sums) > 1000:  # what a task holds is bounded
                yield told(sums)
                sums = {}
        if sums:
            yield told(sums)

    parts = large.select("h", "body").mapInArrow(task, "h long, pos int, x double").groupBy("h", "pos").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))  # as many as a vector has components
    return sums.select("h", F.transform("c", lambda x: x["x"]).alias("centre"))


def crowds(large: DataFrame) -> DataFrame:
    """cid, crowd: of the classes of large buckets that lie within half the limit's angle of a bucket's centre. large: h, n, g, cid, body."""
    sizes = large.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    known = util.save(centres(large).join(sizes, "h"), "vector-centres")
    half = math.cos(math.acos(LEAST) / 2 - 1e-7)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, centre = b.column("body").to_pylist(), b.column("centre").to_pylist()
            if not bodies:
                continue
            width = max(*map(length, bodies), *map(len, centre))
            c = np.zeros((len(bodies), width))
            for k, x in enumerate(centre):
                c[k, : len(x)] = x
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            inside = pa.array((unit(bodies, width) * c).sum(1) >= half)
            yield pa.RecordBatch.from_arrays([b.column(x).filter(inside) for x in ("cid", "g", "h", "n")], ["cid", "g", "h", "n"])

    met = util.attach(large.drop("n"), known, ["h"], "n", ["cid"])
    inside = met.select("cid", "g", "h", "n", "body", "centre").mapInArrow(near, "cid long, g long, h long, n long")
    best = inside.groupBy("cid").agg(F.max(F.struct("n", "h", "g")).alias("best"))
    return best.select("cid", F.xxhash64("best.h", "best.g").alias("crowd"))


def _first_meeting(a: np.ndarray, b: np.ndarray, h: int) -> np.ndarray:
    """Whether bucket ``h`` is the one where pairs are counted: the lesser hash of the first table in which they meet."""
    a, b = a.reshape(len(a), -1, 1 + PROBES), b.reshape(len(b), -1, 1 + PROBES)
    at = meet(a, b).argmax(1)
    a, b = a[np.arange(len(a)), at], b[np.arange(len(b)), at]
    most = np.iinfo(np.int64).max
    own = np.where((a[:, :1] == b).any(1), a[:, 0], most)
    other = np.where((b[:, :1] == a).any(1), b[:, 0], most)
    return np.minimum(own, other) == h


def _linked(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of ``n`` rows is connected with by the links (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted runs of equal (h, cell): (cid, other, add), a count of links for each row, or a link to span what is connected.

    side 0: compared with all rows of its run; side 1: with those of side 2, which are the bucket's rows outside its crowd.
    """

    def of(t: pa.Table) -> pa.RecordBatch | None:
        h = t.column("h")[0].as_py()
        side, cid, g, size, crowd = (t.column(c).to_numpy() for c in ("side", "cid", "g", "size", "crowd"))
        home, other = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "other"))
        bodies = t.column("body").to_pylist()
        u = unit(bodies, max(map(length, bodies)))
        mine, those = (np.arange(len(u)),) * 2 if side[0] == 0 else (np.flatnonzero(side == 2), np.flatnonzero(side == 1))
        if not len(mine) or not len(those):
            return None
        hit = (u[mine] @ u[those].T >= LEAST) & (g[mine][:, None] == g[those]) & (home[mine][:, None] | home[those])
        hit &= (crowd[mine][:, None] != crowd[those]) | (crowd[mine][:, None] == 0)
        hit &= np.where(other[those], cid[mine][:, None] < cid[those], cid[mine][:, None] != cid[those])
        i, j = np.nonzero(hit)
        if not len(i):
            return None
        i, j = mine[i], those[j]
        sigs = t.column("sig").to_pylist()
        width = max(map(len, sigs))  # of other lengths are rows of other g, which are no hits
        sig = np.zeros((len(sigs), width), np.int64)
        for k in np.unique(np.concatenate([i, j])):
            sig[k, : len(sigs[k])] = sigs[k]
        first = np.concatenate([_first_meeting(sig[i[k : k + 65536]], sig[j[k : k + 65536]], h) for k in range(0, len(i), 65536)])
        add = np.zeros(len(u), np.int64)
        np.add.at(add, i[first], size[j[first]])
        np.add.at(add, j[first], size[i[first]])
        root = _linked(i, j, len(u))
        counted, led = np.flatnonzero(add), np.flatnonzero(root != np.arange(len(u)))
        a = np.concatenate([cid[counted], cid[led]])
        b = np.concatenate([cid[counted], cid[root[led]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([add[counted], np.zeros(len(led), np.int64)]))], ["cid", "other", "add"])

    held: pa.Table | None = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if not rows.num_rows:
            continue
        h, cell = rows.column("h").to_numpy(), rows.column("cell").to_numpy()
        ends = [*(np.flatnonzero((h[1:] != h[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(h)]
        for s, e in zip([0, *ends], ends[:-1]):
            if (found := of(rows.slice(s, e - s))) is not None:
                yield found
        held = rows.slice(ends[-2] if len(ends) > 1 else 0)
    if held is not None and held.num_rows and (found := of(held)) is not None:
        yield found


def compared(members: DataFrame, about: DataFrame) -> DataFrame:
    """(cid, other, add) of all buckets. members: h, n, cid, home, crowd (0: none); about: cid, g, size, body, sig."""
    small = members.where(F.col("n") <= BLOCK).select("h", "cid", "home", "crowd", F.lit(0).alias("side"), F.lit(0).alias("cell"), F.lit(True).alias("other"))
    large = members.where(F.col("n") > BLOCK)
    by_crowd = large.where("crowd <> 0").groupBy("h", "crowd").agg(F.count(F.lit(1)).alias("m"))
    top = by_crowd.groupBy("h").agg(F.max(F.struct("m", "crowd")).alias("top"))
    sizes = large.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(top, "h", "left")
    sizes = util.save(sizes.select("h", "n", F.coalesce("top.crowd", F.lit(0)).alias("top"), (F.col("n") - F.coalesce("top.m", F.lit(0))).alias("others")), "vector-buckets")
    met = util.attach(large.drop("n"), sizes, ["h"], "n", ["cid"], 100_000).where("others > 0")
    of_all, of_others = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "others"))
    mine = lambda parts: F.pmod(F.hash("cid"), parts)
    other = (F.col("top") == 0) | (F.col("crowd") != F.col("top"))
    at = lambda i, j, side: F.struct((i * of_others + j).alias("cell"), F.lit(side).alias("side"))
    cells = F.transform(F.sequence(F.lit(0), of_others - 1), lambda j: at(mine(of_all), j, 1))
    more = F.transform(F.sequence(F.lit(0), of_all - 1), lambda i: at(i, mine(of_others), 2))
    cells = F.when(other, F.concat(cells, more)).otherwise(cells)
    dealt = met.select("h", "cid", "home", "crowd", other.alias("other"), F.inline(cells))
    rows = small.unionByName(dealt).join(about, "cid")
    rows = rows.repartition("h", "cell").sortWithinPartitions("h", "cell")
    return rows.select("h", "cell", "side", "cid", "g", "size", "crowd", "home", "other", "body", "sig").mapInArrow(_compare, "cid long, other long, add long")


def groups(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    marked = prepared(vectors)
    same = marked.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("g").alias("g"), F.first("v").alias("v"))
    classes = util.save(same.select(F.monotonically_increasing_id().alias("cid"), "*"), "vector-classes")
    counts = classes.groupBy("g", F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).groupBy("dims").agg(F.max("n").alias("n")).collect()  # a row for each length
    about = util.save(listed(classes, {r["dims"]: design(r["n"], r["dims"]) for r in counts}), "vector-hashes")
    entries = about.select("cid", "g", F.posexplode("sig").alias("pos", "h")).select("cid", "h", (F.col("pos") % (1 + PROBES) == 0).alias("home"))
    buckets = entries.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 AND any").select("h", "n")
    buckets = util.save(buckets, "vector-buckets")
    members = util.save(util.attach(entries, buckets, ["h"], "n", ["cid"], 200_000).where("n IS NOT NULL"), "vector-members")
    large = members.where(F.col("n") > BLOCK).select("h", "cid", "n").distinct().join(about.select("cid", "g", "body"), "cid")
    inside = util.save(crowds(large), "vector-crowds")
    members = util.save(members.join(inside, "cid", "left").withColumn("crowd", F.coalesce("crowd", F.lit(0).cast("long"))), "vector-members")
    found = util.save(compared(members, about), "vector-links")
    crowd = util.save(inside.join(classes.select("cid", "size"), "cid").groupBy("crowd").agg(F.min("cid").alias("first"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")), "vector-crowd-sizes")
    inside = util.save(util.attach(inside, crowd, ["crowd"], "n", ["cid"], 100_000), "vector-crowds")
    edges = found.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b")).union(inside.select("cid", "first").where("cid <> first"))
    roots = util.save(simhash.components(edges), "vector-roots")
    counted = found.where("cid = other").groupBy("cid").agg(F.sum("add").alias("add"))
    known = classes.select("cid", "a", "b", "least", "size").join(counted, "cid", "left").join(inside.select("cid", "total"), "cid", "left")
    known = known.join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    n_links = F.col("size") - 1 + F.coalesce("add", F.lit(0)) + F.coalesce(F.col("total") - F.col("size"), F.lit(0))
    known = util.save(known.select("a", "b", "root", "least", F.col("size").alias("n"), n_links.alias("n_links")), "vector-class-links")
    led = util.save(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")), "vector-components")
    known = util.save(util.attach(known, led, ["root"], "classes", ["a"], 100_000).select("a", "b", "n", "n_links", "component_id"), "vector-class-links")
    done = util.attach(marked.select("vec_id", "a", "b"), known, ["a", "b"], "n", ["vec_id"])
    component = F.when(F.col("a").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
