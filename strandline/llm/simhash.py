"""Near-duplicate groups by SimHash, found through a generalised pigeonhole search.

The 64 bits are dealt into parts, correlated bits together. If the thresholds of the parts sum to ``most - parts + 1``,
two fingerprints within ``most`` bits differ by no more than its threshold in at least one part. A dynamic program
deals out unequal thresholds (-1: the part is not looked at) by the estimated number of candidates, from the bit
statistics of all fingerprints, and the number of parts is chosen the same way. Each fingerprint is listed under its
own value of each part and probes the values within the part's threshold; candidates are verified on all 64 bits.

Skew: equal fingerprints are one row. A bucket of more than ``block`` rows is cut into blocks and each pair of blocks
is a row group of its own, so no task holds a large bucket; groups give links that span what they found (stars), not
all pairs. Components are joined by alternating large-star and small-star rounds over written tables.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; a text of one or two words has one
shingle, the whole sequence; rows of equal doc_id each get a row; null doc_ids never name a component unless all of
its ids are null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

BITS = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42, block: int = 8192) -> int:
    """SimHash of the word shingles of a text, unsigned. Hashes are summed in blocks, so memory is bounded."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends, starts, at = [], [], 0
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    starts, ends = starts[:n], ends[width - 1 :] if n > 1 or len(words) >= width else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, block):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : k + block], ends[k : k + block])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and the 64 x 64 counts of bits that are set together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        if n:
            i, j = np.nonzero(both)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i * BITS + j, -1).astype(np.int32)), pa.array(np.append(both[i, j], n).astype(np.int64))], ["cell", "n"]
            )

    rows = fps.select("fp").mapInArrow(task, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows at most
    both = np.zeros((BITS, BITS))
    n = 0
    for cell, k in rows:
        if cell < 0:
            n = k
        else:
            both[cell // BITS, cell % BITS] = k
    return n, both


def deal_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits by part: each part starts with the free bit that is most correlated with the others and takes its nearest."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (len(free) + parts - k - 1) // (parts - k)
        own = [max(free, key=lambda b: (r[b, free].sum(), -b))]
        while len(own) < size:
            own.append(max((b for b in free if b not in own), key=lambda b: (r[b, own].sum(), -b)))
        free = [b for b in free if b not in own]
        out.append(sorted(own))
    return out


def allocate(n: int, both: np.ndarray, most: int = 3, row_cost: float = 1.0, pair_cost: float = 0.01) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part, by dynamic programming over estimated costs of probes and candidates."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, most + 2):
        dealt = deal_bits(n, both, parts)
        cost = []
        for bits in dealt:
            near = np.zeros(most + 1)
            near[0] = 1
            for b in bits:  # the number of differing bits of two random fingerprints
                q = 2 * p[b] * (1 - p[b])
                near = near * (1 - q) + np.append(0, near[:-1]) * q
            cost.append([0.0] + [row_cost * n * sum(comb(len(bits), x) for x in range(e + 1)) + pair_cost * n * n / 2 * near[: e + 1].sum() for e in range(most + 1)])
        total = most - parts + 1
        table = {0: (0.0, [])}  # by the sum of thresholds so far
        for c in cost:
            step: dict[int, tuple[float, list]] = {}
            for s, (v, es) in table.items():
                for e in range(-1, most + 1):
                    if s + e not in step or v + c[e + 1] < step[s + e][0]:
                        step[s + e] = (v + c[e + 1], [*es, e])
            table = step
        if total in table and table[total][0] < best[0]:
            best = (table[total][0], list(zip(dealt, table[total][1])))
    return best[1]


def _flips(bits: list[int], radius: int) -> list[int]:
    """Masks of up to ``radius`` of these bits, as signed longs; the first is zero."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | (1 << b) for m in masks for b in bits} | set(masks))
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def signatures(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """fp, part, value, home: each fingerprint under its own value of each part, and under those it probes."""

    def entries(own: Column, flips: Column, k: int) -> Column:
        return F.transform(flips, lambda x: F.struct(F.lit(k).alias("part"), own.bitwiseXOR(x).alias("value"), (x == 0).alias("home")))

    rows = []
    for k, (bits, e) in enumerate(parts):
        if e < 0:
            continue
        mask = sum(1 << b for b in bits)
        mask = mask - (1 << BITS) if mask >> 63 else mask
        flips = F.array(*[F.lit(x).cast("long") for x in _flips(bits, e)])
        rows.append(entries(F.col("fp").bitwiseAND(F.lit(mask)), flips, k))
    return fps.select("fp", F.inline(F.concat(*rows)))


def _stars(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join whatever is connected within ``most`` bits, one for each fingerprint at most."""
    left, out = np.unique(fp), []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for k in range(0, len(front), 256):
                hit |= (np.bitwise_count(front[k : k + 256, None] ^ left[None, :]) <= most).any(0)
            front, left = left[hit], left[~hit]
            out += [(root, x) for x in front]
    return out


def _linker(most: int, small: int = 64):
    """Links of runs of equal (part, value, cell) in sorted rows."""

    def of(part, value, cell, fp, home) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (cell[1:] != cell[:-1])
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        a, b = [], []
        keep = (size[run] > 1) & (size[run] <= small)
        f, r, h = fp[keep], run[keep], home[keep]
        for d in range(1, int(size[(size <= small)].max(initial=1))):
            near = (r[d:] == r[:-d]) & (f[d:] != f[:-d]) & (h[d:] | h[:-d])
            near &= np.bitwise_count(f[d:] ^ f[:-d]) <= most
            k = np.flatnonzero(near)
            a.append(f[:-d][k])
            b.append(f[d:][k])
        first = np.flatnonzero(new)
        for k in np.flatnonzero(size > small):
            if links := _stars(fp[first[k] : first[k] + size[k]], most):
                x = np.array(links, dtype=np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "cell", "fp", "home")]
            rows[3] = rows[3].view(np.uint64)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[cut:] for x in rows]
            if cut:
                yield of(*[x[:cut] for x in rows])
        if held is not None:
            yield of(*held)

    return task


def links(fps: DataFrame, most: int = 3, block: int = 4096) -> DataFrame:
    """(a, b) fingerprints within ``most`` bits, enough of them to connect all that are connected. fps: distinct fp."""
    n, both = bit_counts(fps)
    sigs = signatures(fps, allocate(n, both, most))
    big = util.save(sigs.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "simhash-big")
    sigs = sigs.join(util.hinted(big, 10_000), ["part", "value"], "left")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.hash("fp"), blocks)
    cells = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    )
    rows = sigs.select("part", "value", F.explode(cells).alias("cell"), "fp", "home")
    rows = rows.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell")
    return rows.mapInArrow(_linker(most), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) is connected with."""

    def star(e: DataFrame, both: bool) -> DataFrame:
        # e has u > v; both: every neighbour of u counts and the larger ones are led to the least
        near = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        rows = near.join(least, "u")
        if both:
            found = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            found = rows.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return found.where("u <> v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = util.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    old = mark(e)
    while old[0]:
        e = util.save(star(star(e, True), False), "links")
        if (new := mark(e)) == old:
            break
        old = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(docs: DataFrame, most: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    marked = util.save(fingerprints(docs, width), "fingerprints")
    distinct = util.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), most))
    known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
