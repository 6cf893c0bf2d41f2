"""Near copies by the Jaccard similarity of their word shingles, found through SimHash and banded MinHash, verified exactly.

Texts are sets of ``WIDTH``-word shingles (lower-cased words, 64-bit hashes). Texts of one set are one class from the start.
Classes whose SimHash fingerprints (of the set of shingles) lie within ``RADIUS`` bits are found by the generalised pigeonhole
search of :mod:`simhash`. At a similarity of 0.8 fingerprints differ in 10 bits on the average; a pigeonhole of 64 bits that
reaches so far compares a fixed share of all pairs (a radius of 6 is thousands of probes a text in a large corpus), so MinHash looks for the rest.
Classes whose minima agree in one of ``BANDS`` bands of ``ROWS`` rows share a bucket: at a similarity of 0.8 all bands of a
pair differ with probability (1 - 0.8 ** 5) ** 26, about 3 in 100,000, above it less. A link is a pair of a bucket whose
sets, compared as a whole, are at least ``LEAST`` alike; a group is what links connect, so its ends may be less alike.

Skew: a bucket's members are compared with its hub alone, which is linear. The hub is the member whose buckets are the largest, so
in a crowd of copies the text that they were made from is the hub of nearly all buckets. Buckets that this leaves in more
than one group take a second hub from outside their largest group. Only what is still apart compares on: members outside
the bucket's largest group with all of other groups, in blocks, so no task holds a large bucket. So every pair of a bucket is
either compared or already in one group. That last step compares ``SIGN`` minima before sets, and passes pairs whose share of equal
minima is ``LEAST`` less five standard deviations, so pairs that are not alike hardly reach the comparison of sets.

Edge cases: rows are known by a key of all their columns, so null and repeated ids are decided by their text; null and
wordless texts are one class; a text of fewer than ``WIDTH`` words has one shingle, the whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash, util

WIDTH, LEAST, BANDS, ROWS = 5, 0.8, 26, 5
#: Bits that fingerprints of candidates differ in at most.
RADIUS = 3
_RNG = np.random.Generator(np.random.PCG64(42))
_MULTIPLIERS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Minima of the signature that pairs are looked at by before their sets are, a byte each, and their least share of equal ones.
SIGN = 2048
_SIGNERS = _RNG.integers(0, 1 << 63, SIGN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ESTIMATE = LEAST - 5 * (LEAST * (1 - LEAST) / SIGN) ** 0.5


def row_key(docs: DataFrame) -> Column:
    """Of all columns."""
    return util.row_key(*docs.columns)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + WIDTH])) for i in range(max(1, len(words) - WIDTH + 1))], dtype=np.uint64))


def minima(hashes: np.ndarray, multipliers: np.ndarray = _MULTIPLIERS, block: int = 1024) -> np.ndarray:
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), block):
        out = np.minimum(out, (hashes[k : k + block, None] * multipliers).min(0))
    return out


def fingerprint(hashes: np.ndarray, block: int = 8192) -> np.int64:
    """SimHash of a set: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(simhash.BITS, np.int64)
    for k in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[k : k + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]


def _class(hashes: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cls, n, bands, fp = [], [], [], []
        for x in b.column("text"):
            s = shingle_set(x.as_py())
            m = minima(s).reshape(BANDS, ROWS)
            cls.append(_class(s))
            n.append(len(s))
            fp.append(fingerprint(s))
            bands.append([np.uint64(xxhash.xxh3_64_intdigest(row.tobytes(), k)).view(np.int64) for k, row in enumerate(m)] if len(s) else [])
        made = [pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(fp, pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column("least"), *made], ["least", "cls", "n", "bands", "fp"])


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            sets = [shingle_set(x.as_py()) for x in whole.column("text")[k : k + 256]]
            made = [pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            signs = pa.array([minima(s, _SIGNERS).astype(np.uint8).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*made, signs], ["cls", "hashes", "sign"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in runs of equal (h, cell) of sorted rows, one of them marked as other, of different roots, that may be alike."""

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, cell, cls, n, root = (rows.column(c).to_numpy() for c in ("h", "cell", "cls", "n", "root"))
        other = rows.column("other").to_numpy(zero_copy_only=False)
        sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint8).reshape(len(h), -1)
        ends = [*np.flatnonzero((h[1:] != h[:-1]) | (cell[1:] != cell[:-1])) + 1, len(h)]
        for s, e in zip([0, *ends], ends):
            those = s + np.flatnonzero(~other[s:e])
            for k in s + np.flatnonzero(other[s:e]):
                js = those[(root[those] != root[k]) & (np.minimum(n[those], n[k]) >= LEAST * np.maximum(n[those], n[k]))]
                js = js[(sign[js] == sign[k]).mean(1) >= ESTIMATE] if len(js) else js
                if len(js):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(js), cls[k])), pa.array(cls[js])], ["hub", "member"])

    held: pa.Table | None = None
    for b in batches:
        rows = pa.Table.from_batches([b])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if not rows.num_rows:
            continue
        h, cell = rows.column("h").to_numpy(), rows.column("cell").to_numpy()
        same = (h == h[-1]) & (cell == cell[-1])
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        held = rows.slice(cut)
        if cut:
            yield from of(rows.slice(0, cut))
    if held is not None:
        yield from of(held)


def left_pairs(apart: DataFrame, details: DataFrame, block: int = 512) -> DataFrame:
    """(hub, member) that may be alike of buckets in several groups: members outside the largest group (root is not top) with members of
    other groups. apart: h, cls, n, root, top, size, others. Both sides are dealt into blocks, and each pair of blocks is a cell."""
    of_all, of_others = (F.ceil(F.col(c) / block).cast("int") for c in ("size", "others"))
    at = lambda i, j, other: F.struct((i * of_all + j).alias("cell"), F.lit(other).alias("other"))
    mine = lambda parts: F.pmod(F.hash("cls"), parts)
    cells = F.transform(F.sequence(F.lit(0), of_others - 1), lambda i: at(i, mine(of_all), False))
    more = F.transform(F.sequence(F.lit(0), of_all - 1), lambda j: at(mine(of_others), j, True))
    cells = F.when(F.col("root") == F.col("top"), cells).otherwise(F.concat(cells, more))
    rows = apart.select("h", "cls", "n", "root", F.inline(cells)).join(details.select("cls", "sign"), "cls")
    rows = rows.select("h", "cell", "cls", "n", "root", "other", "sign").repartition("h", "cell").sortWithinPartitions("h", "cell")
    return rows.mapInArrow(_left, "hub long, member long")


def hub_pairs(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """(hub, member): each member with its bucket's hub, if their sizes are alike and they are in different groups."""
    met = util.attach(members, hubs, ["h"], "size", ["cls"], 200_000).where("hub IS NOT NULL")
    alike = F.least("hub.n", "n") >= LEAST * F.greatest("hub.n", "n")
    return met.where(alike & (F.col("hub.root") != F.col("root"))).select(F.col("hub.cls").alias("hub"), F.col("cls").alias("member"))


def verified(pairs: DataFrame, details: DataFrame, cell: int = 256) -> DataFrame:
    """(a, b): the pairs (hub, member) of classes that are alike.

    A member brings its own set, a hub's is there once for each ``cell`` of its members: a hub that a third of all texts
    resemble is many keys, and its set is not copied for each of them."""
    pairs = util.save(pairs.distinct(), "copy-asked")
    hubs = util.save(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "copy-asked-hubs")
    cells = F.ceil(F.col("n") / cell).cast("int")
    own = details.select("cls", "hashes")
    there = hubs.join(own.hint("merge"), F.col("hub") == F.col("cls")).select("hub", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), F.col("hashes").alias("h_a"))
    dealt = util.attach(pairs, hubs, ["hub"], "n", ["member"], 200_000).select("hub", F.pmod(F.hash("member"), cells).alias("cell"), "member")
    asked = dealt.join(own.hint("merge"), F.col("member") == F.col("cls")).select("hub", "cell", "member", F.col("hashes").alias("h_b"))
    both = asked.join(there.hint("merge"), ["hub", "cell"])
    shared = F.size(F.array_intersect("h_a", "h_b"))
    union = F.size("h_a") + F.size("h_b") - shared
    return both.where(shared >= F.ceil(F.round(LEAST * union, 6))).select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"))


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(hub, member) of classes (cls, n, fp) of like size whose fingerprints are within ``RADIUS`` bits: the least class of each fingerprint with the
    others of it, and the least classes of linked fingerprints."""
    first = util.save(classes.groupBy("fp").agg(F.min(F.struct("cls", "n")).alias("first")), "copy-fingerprints")
    links = simhash.links(first.select("fp"), RADIUS)
    side = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    apart = links.join(side("a"), "a").join(side("b"), "b").select(F.col("first_a").alias("x"), F.col("first_b").alias("y"))
    same = classes.join(first, "fp").select(F.col("first").alias("x"), F.struct("cls", "n").alias("y")).where("x.cls <> y.cls")
    alike = F.least("x.n", "y.n") >= LEAST * F.greatest("x.n", "y.n")
    return apart.union(same).where(alike).select(F.col("x.cls").alias("hub"), F.col("y.cls").alias("member"))


def survivors(docs: DataFrame) -> DataFrame:
    """key (of :func:`row_key`): of each group the row of the least doc_id; null ids come last, equal ones go by key."""
    key = row_key(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), key.alias("key"))
    ranked = docs.select(rank.alias("least"), "text")
    marks = ranked.mapInArrow(_marks, "least struct<none:boolean,id:bigint,key:struct<a:bigint,b:int>>, cls long, n long, bands array<bigint>, fp long")
    # n, bands and fp are functions of the class
    classes = util.save(marks.groupBy("cls").agg(F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("n", "bands", "fp")]), "text-classes")
    near = util.save(fingerprint_pairs(classes.where("n > 0").select("cls", "n", "fp")), "copy-pairs")
    entries = classes.select("cls", "n", F.explode("bands").alias("h"))
    buckets = entries.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = util.save(buckets, "copy-buckets")
    members = util.save(util.attach(entries, buckets, ["h"], "size", ["cls"], 200_000).where("size IS NOT NULL"), "copy-members")
    weights = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    members = util.save(members.join(weights, "cls").select("h", "cls", "n", "size", "weight", F.col("cls").alias("root")), "copy-members")
    asked = members.select("cls").union(near.select("hub")).union(near.select("member")).distinct()
    wanted = util.save(asked.join(classes.select("cls", "least.key"), "cls").select("key"), "copy-candidates")
    texts = docs.select(key.alias("key"), "text").join(util.hinted(wanted, 200_000), "key", "left_semi").select("text")
    details = util.save(texts.mapInArrow(_details, "cls long, hashes array<bigint>, sign binary").dropDuplicates(["cls"]), "copy-details")
    best = F.max(F.struct("weight", "cls", "n", "root")).alias("hub")
    hubs = util.save(members.groupBy("h").agg(best, F.first("size").alias("size")), "copy-hubs")
    found = util.save(verified(hub_pairs(members, hubs).unionByName(near), details), "copy-links")
    roots = util.save(simhash.components(found), "copy-roots")
    for last in (False, True):
        now = members.drop("root").where("size > 2").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
        now = util.save(now, "copy-members")
        groups = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
        split = groups.groupBy("h").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("size"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
        split = util.save(split.select("h", F.col("top.root").alias("top"), "size", (F.col("size") - F.col("top.m")).alias("others")), "copy-split")
        if not split.limit(1).count():
            break
        apart = util.save(util.attach(now.drop("size"), split, ["h"], "size", ["cls"], 200_000).where("top IS NOT NULL"), "copy-apart")
        if last:
            pairs = left_pairs(apart, details)
        else:
            hubs = util.save(apart.where("root <> top").groupBy("h").agg(best, F.first("size").alias("size")), "copy-hubs")
            pairs = hub_pairs(apart, hubs)
        found = util.save(found.unionByName(verified(pairs, details)), "copy-links")
        roots = util.save(simhash.components(found), "copy-roots")
    grouped = classes.select("cls", "least").join(roots, F.col("cls") == F.col("node"), "left").groupBy(F.coalesce("root", "cls").alias("root"))
    return grouped.agg(F.min("least").alias("least")).select("least.key")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group; of rows that repeat as a whole, one."""
    found = util.save(survivors(docs), "survivors")
    kept = docs.withColumn("_key", row_key(docs)).join(found.select(F.col("key").alias("_key")).hint("merge"), "_key", "left_semi")
    twice = util.save(kept.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"), "repeated-rows")
    if twice.limit(1).count():
        hint = util.hinted(twice, 100_000)
        kept = kept.join(hint, "_key", "left_anti").unionByName(kept.join(hint, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(docs.columns)
