"""Product codes of vectors: integer k-means whose assignments are pruned by boxes of Hilbert-sorted blocks.

Vectors become integers (``floor(SCALE * x)``) and are cut into ``PARTS`` equal parts. The parts of each position lie along
a Hilbert curve, in blocks of ``BLOCK`` that store their count, the least and the greatest of each component, and the sums.
In a round a block's box bounds its distance to each codebook entry from both sides: an entry that is farther at its
nearest than some other at its farthest is out, and what is left is the block's shortlist. A shortlist of one adds the stored
sums and never looks at the parts; a longer one is evaluated for its entries alone, in exact integers.

Scale: the curve is dealt by range over (position, place on the curve, a hash of the row), so a vector that a third of all
rows repeat is spread over tasks. A round is one scan of the blocks, and tasks send a row for each entry and component.
The driver holds the codebooks, which have ``ENTRIES`` entries of a vector's width. Codes meet their rows in one shuffle.

Edge cases: vectors that are null or hold null or non-finite components are dropped; seeds are the rows of the least vec_id
(nulls last; rows that share one go by their components), each row an entry, fewer if there are fewer rows; vectors of
unlike lengths, or of lengths that the parts do not divide, are taken as filled up with zeros; components of any finite
size are computed exactly, in wider integers where 64 bits are too few, and an error beyond a long is null, as is
a sum that holds one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

SCALE, PARTS, ENTRIES, ROUNDS, BLOCK = 4096, 8, 16, 6, 128
#: Components below it in size are computed in 64 bits: squares of differences, summed over 64 components, stay below 2 ** 63.
NARROW = 1 << 27
LIMB = 32


def whole(vector: list[float] | None, width: int) -> list[int]:
    """floor(SCALE * x) of each component, exactly; filled up with zeros."""
    made = [math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE for x in vector]
    return made + [0] * (width - len(made))


def integers(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row for each vector: int64 if all components are narrow, else Python's integers."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if not len(flat) or np.abs(scaled).max() < NARROW:
        out = np.zeros((len(vectors), width), np.int64)
        out[np.repeat(np.arange(len(vectors)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else []] = scaled
        return out
    out = np.empty((len(vectors), width), object)
    for k, v in enumerate(vectors.to_pylist()):
        out[k] = whole(v, width)
    return out


def pack(a: np.ndarray) -> bytes:
    """Integers as bytes: a mark of their width, then they."""
    if a.dtype == object:
        return b"t" + ",".join(map(str, a.ravel().tolist())).encode()
    small = not a.size or np.abs(a).max() < 1 << 31
    return (b"4" + a.astype("<i4").tobytes()) if small else b"8" + a.astype("<i8").tobytes()


def unpack(b: bytes, width: int) -> np.ndarray:
    if b[:1] == b"t":
        values = np.empty(b.count(b",") + 1, object)
        values[:] = [int(x) for x in b[1:].split(b",")]
    else:
        values = np.frombuffer(b, "<i4" if b[:1] == b"4" else "<i8", offset=1).astype(np.int64)
    return values.reshape(-1, width)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve through a grid of 2 ** bits cells a side; cells: a row of coordinates for each point.

    Skilling's transform: from the highest bit down, a coordinate whose bit is set turns the lower bits of the first over,
    another one swaps them with the first's; then Gray code, and bits of all coordinates by turns.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            is_set = (x[i] >> level) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> level) & 1)
    return place


def kept(vectors: DataFrame) -> DataFrame:
    """rid, vec_id, label, v (array<double>) of the rows that count; rid is unique."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    return util.save(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), "code-vectors")


def _bounds(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of each component: ``width`` rows reach the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
        for b in batches:
            x = integers(b.column("v"), width).astype(np.float64)
            if len(x):
                lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(lo), pa.array(hi)], ["pos", "lo", "hi"])

    found = rows.select("v").mapInArrow(task, "pos long, lo double, hi double").groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo, hi = np.zeros(width), np.zeros(width)
    for r in found.collect():
        lo[r["pos"]], hi[r["pos"]] = r["lo"], r["hi"]
    return lo, hi


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """part, n, lo, hi, sums, body, rids: runs of ``BLOCK`` parts of one position along the Hilbert curve."""
    lo, hi = _bounds(rows, width)
    m = width // PARTS
    used = min(m, 62)
    bits = min(16, 62 // used) if used else 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 1024):
                b = whole_batch.slice(k, 1024)
                x = integers(b.column("v"), width)
                for p in range(PARTS):
                    own = slice(p * m, p * m + used)
                    span = np.maximum(hi[own] - lo[own], 1)
                    cells = np.clip((x[:, own].astype(np.float64) - lo[own]) / span * (1 << bits), 0, (1 << bits) - 1)
                    place = hilbert(cells, bits) if used else np.zeros(len(x), np.int64)
                    body = [pack(row) for row in x[:, p * m : (p + 1) * m]]
                    made = [pa.array(np.full(len(x), p, np.int32)), pa.array(place), b.column("rid"), pa.array(body, pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, ["part", "place", "rid", "body"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: int, rids: list[int], bodies: list[bytes]):
            x = np.concatenate([unpack(b, m) for b in bodies]) if m else np.zeros((len(rids), 0), np.int64)
            return part, len(rids), pack(x.min(0)), pack(x.max(0)), pack(x.sum(0)), pack(x), np.array(rids, "<i8").tobytes()

        names = ["part", "n", "lo", "hi", "sums", "body", "rids"]
        part, rids, bodies, done = None, [], [], []
        for b in batches:
            for p, r, x in zip(*(b.column(c).to_pylist() for c in ("part", "rid", "body"))):
                if rids and (p != part or len(rids) == BLOCK):
                    done.append(block(part, rids, bodies))
                    rids, bodies = [], []
                part = p
                rids.append(r)
                bodies.append(x)
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*done))), BLOCKS_ARROW)
                done = []
        if rids:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(block(part, rids, bodies)))), BLOCKS_ARROW)

    dealt = rows.select("rid", "v").mapInArrow(parts, "part int, place long, rid long, body binary")
    order = ["part", "place", F.hash("rid"), "rid"]
    return util.save(dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, BLOCKS), "code-blocks")


BLOCKS = "part int, n long, lo binary, hi binary, sums binary, body binary, rids binary"
BLOCKS_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("lo", "hi", "sums", "body", "rids")]])


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in 64 bits if that is enough for distances between them, else as Python's integers."""
    narrow = all(a.dtype != object and (not a.size or np.abs(a).max() < NARROW) for a in arrays) and arrays[0].shape[-1] <= 64
    return list(arrays) if narrow else [a.astype(object) for a in arrays]


def shortlist(lo: np.ndarray, hi: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that may be the nearest of a point in the box, ascending."""
    lo, hi, book = exact(lo, hi, book)
    nearest = np.maximum(np.maximum(lo - book, book - hi), 0)
    farthest = np.maximum(np.abs(book - lo), np.abs(book - hi))
    return np.flatnonzero((nearest * nearest).sum(1) <= (farthest * farthest).sum(1).min())


def assign(x: np.ndarray, book: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the listed entries of each row, ties to the lower, and its squared distance."""
    x, book = exact(x, book[listed])
    gap = x[:, None, :] - book[None, :, :]
    far = (gap * gap).sum(2)
    at = far.argmin(1) if far.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in far.tolist()], np.int64)
    return listed[at], far[np.arange(len(x)), at]


def _limbs(value: int) -> list[int]:
    """An integer as limbs that add up without carrying: value = sum of limb * 2 ** (LIMB * k)."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return out


def _round(found: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one assignment of all parts."""
    m = books[0].shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(part: int, entry: int, total: np.ndarray, n: int):
            row = sums.setdefault((part, entry), np.zeros(m + 1, object))
            row[:m] += total.astype(object)
            row[m] += n

        for b in batches:
            for part, n, lo, hi, total, body in zip(*(b.column(c).to_pylist() for c in ("part", "n", "lo", "hi", "sums", "body"))):
                listed = shortlist(unpack(lo, m)[0], unpack(hi, m)[0], books[part]) if m else np.zeros(1, np.int64)
                if len(listed) == 1:
                    add(part, int(listed[0]), unpack(total, m)[0] if m else np.zeros(0, np.int64), n)
                    continue
                x = unpack(body, m)
                entry, _ = assign(x, books[part], listed)
                for e in np.unique(entry):
                    add(part, int(e), x[entry == e].sum(0), int((entry == e).sum()))
        rows = [(p, e, k, j, v) for (p, e), row in sums.items() for k, total in enumerate(row) for j, v in enumerate(_limbs(int(total)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["part", "entry", "pos", "limb", "v"])

    rows = found.select("part", "n", "lo", "hi", "sums", "body").mapInArrow(task, "part long, entry long, pos long, limb long, v long")
    totals: dict[tuple[int, int], list[int]] = {}
    for part, entry, pos, limb, v in rows.groupBy("part", "entry", "pos", "limb").agg(F.sum("v")).collect():  # a few values for each component of the codebooks
        totals.setdefault((part, entry), [0] * (m + 1))[pos] += v << (LIMB * limb)
    out = [b.astype(object) for b in books]
    for (part, entry), row in totals.items():
        out[part][entry] = [s // row[m] for s in row[:m]]
    return [_narrowed(b) for b in out]


def _narrowed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) if all(abs(v) < 1 << 62 for v in a.ravel().tolist()) else a


def train(rows: DataFrame, found: DataFrame, width: int) -> list[np.ndarray]:
    """The codebook of each part position."""
    m = width // PARTS
    seeds = [whole(r["v"], width) for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()]
    first = np.empty((len(seeds), width), object)
    first[:] = seeds
    books = [_narrowed(first[:, p * m : (p + 1) * m]) for p in range(PARTS)]
    for _ in range(ROUNDS):
        books = _round(found, books)
    return books


def codes(found: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rid, code (hex), error of each row."""
    m = books[0].shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rids, lo, hi, body in zip(*(b.column(c).to_pylist() for c in ("part", "rids", "lo", "hi", "body"))):
                ids = np.frombuffer(rids, "<i8")
                if m:
                    entry, far = assign(unpack(body, m), books[part], shortlist(unpack(lo, m)[0], unpack(hi, m)[0], books[part]))
                else:
                    entry, far = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                far = pa.array([int(v) if v < 1 << 63 else None for v in far.tolist()], pa.int64())
                made = [pa.array(ids), pa.array(np.full(len(ids), part, np.int32)), pa.array(entry.astype(np.int32)), far]
                yield pa.RecordBatch.from_arrays(made, ["rid", "part", "entry", "far"])

    parts = found.select("part", "rids", "lo", "hi", "body").mapInArrow(task, "rid long, part int, entry int, far long")
    listed = F.array_sort(F.collect_list(F.struct("part", "entry")))  # a row's own parts
    digits = F.array_join(F.transform(listed, lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0"))), "")
    return parts.groupBy("rid").agg(digits.alias("code"), F.when(F.count("far") == PARTS, F.try_sum("far")).alias("error"))


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    rows = kept(vectors)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = -(-width // PARTS) * PARTS
    found = blocks(rows, width)
    books = train(rows, found, width)
    said = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    made = rows.select("rid", "vec_id", F.col("label").isNull().alias("l_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("l_name")).join(codes(found, books), "rid")
    made = util.save(made, "codes")
    whole_sum = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    by_label = util.save(made.groupBy("l_none", "l_name").agg(whole_sum.alias("label_error"), F.count(F.lit(1)).alias("n")), "code-labels")
    done = util.attach(made, by_label, ["l_none", "l_name"], "n", ["rid"], 100_000)
    return done.select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
