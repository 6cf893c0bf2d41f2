"""Benchmark passages inside documents: a containment search by size-partitioned MinHash sketches.

Shingles are five lower-cased words (runs of letters and digits). An item is found in a document that holds at least
``least`` (0.8) of the item's distinct shingles, however long the document. Items are dealt into partitions by size, each
bound ``GROWTH`` times the one before. The MinHash sketch of an item is the ``k`` shingles of least hash, and its
partition's bound ``u`` sets k to ``floor((1 - least) * u) + 1``: whoever holds that share of the item holds one of these
shingles at least, so unlike banded signatures the search loses nothing.

A document's sketch is the set of its shingles whose hash is no greater than the greatest in any item's sketch, a MinHash sketch by
threshold: it keeps its share of a short passage however long the document is, which a sketch of fixed size would not. A short item's
greatest is high, so one threshold would let half of all shingles through; a map of ``2 ** MAP_BITS`` bits, one for each leading part of a
hash that some sketch has, stops nearly all of them before they are joined (and none that a sketch has). Sketches meet on equal hashes; candidates are verified by counting the shared shingles themselves, as text.

All is DataFrame expressions. Words are hashed once and shingles by their words' hashes. Documents are exploded to their sketches inside the probing join and never grouped as a whole;
the sketch table is broadcast only below a counted size. A shingle that a third of the documents share gives one
candidate for each document and item, which verification then decides.

Edge cases: null texts have no shingles and match nothing; an item of fewer than five words has one shingle, its whole
word sequence, and matches a document that has the same sequence as a whole; repeated item ids are searched as the
union of their shingles; rows that repeat, and rows without a doc_id, are one document each doc_id, found as the union of their
shingles; items without an item_id are left out; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

WIDTH = 5
#: Ratio of the size bounds of neighbouring partitions.
GROWTH = 1.25
#: Bits of a hash that the map of sketches goes by: the map is a literal of 64 kB, whatever the number of items.
MAP_BITS = 18


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(make) -> Column:
    """``make`` of the words of each window of column ``_w``; of the whole sequence if it is shorter."""
    whole = F.when(F.size("_w") > 0, F.array(make([F.array_join("_w", " ")])))
    every = F.transform(F.sequence(F.lit(0), F.size("_w") - WIDTH), lambda i: make([F.get(F.col("_w"), i + k) for k in range(WIDTH)]))
    return F.when(F.size("_w") >= WIDTH, every).otherwise(whole)


def shingles(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, shingle (text): a row for each window of the words."""
    return rows.select(*key, _words(F.col(text)).alias("_w")).select(*key, F.explode(_windows(lambda w: F.concat_ws(" ", *w))).alias("shingle"))


def hashes(text: Column) -> Column:
    """The hashes of a text's shingles, repeats included, made of the hashes of its words."""
    w = F.transform(_words(text), lambda x: F.xxhash64(x))
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))
    whole = lambda w: F.array(F.aggregate(w, F.lit(0).cast("long"), lambda s, x: F.xxhash64(s, x)))
    made = lambda w: F.when(F.size(w) >= WIDTH, windows(w)).when(F.size(w) > 0, whole(w))
    return F.flatten(F.transform(F.array(w), made))  # the words are hashed once, though named often


def sketches(benchmark: DataFrame, least: float) -> DataFrame:
    """item_id, h: the least hashes of each item, as many as its size partition asks for."""
    rows = benchmark.select("item_id", F.explode(hashes(F.col("text"))).alias("h"))
    sized = rows.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))  # an item's own shingles
    bound = F.pow(F.lit(GROWTH), F.ceil(F.round(F.log(F.size("hs")) / F.log(F.lit(GROWTH)), 9)))
    depth = (F.floor(F.round((1 - least) * F.floor(bound), 6)) + 1).cast("int")
    return sized.select("item_id", F.explode(F.slice("hs", F.lit(1), depth)).alias("h"))


def mapped(sketch: DataFrame) -> Callable[[Column], Column]:
    """A test of hashes: whether their leading bits are those of some hash of a sketch. What is collected is a row for each 32 places."""
    place = lambda h: F.shiftrightunsigned(h, 64 - MAP_BITS)
    at = sketch.select(F.shiftright(place(F.col("h")), 5).alias("cell"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - MAP_BITS}) & 31 AS INT))").alias("bit"))
    bits = [0] * (1 << MAP_BITS - 5)
    for cell, bit in at.groupBy("cell").agg(F.bit_or("bit")).collect():
        bits[cell] = bit
    known = F.expr(f"array({','.join(f'{b}L' for b in bits)})")
    return lambda h: F.getbit(F.get(known, F.shiftright(place(h), 5).cast("int")), place(h).bitwiseAND(F.lit(31)).cast("int")) == 1


def search(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment, for each item that a document holds."""
    items = util.save(shingles(benchmark, ["item_id"], "text").distinct(), "item-shingles")
    sketch = util.save(sketches(benchmark, least), "item-sketches")
    limit = sketch.agg(F.max("h")).first()[0]
    known = mapped(sketch)
    own = F.filter(hashes(F.col("text")), lambda h: (h <= F.lit(limit).cast("long")) & known(h))
    probe = docs.select("doc_id", F.explode(own).alias("h"))
    candidates = util.save(probe.join(util.hinted(sketch, 500_000), "h").select("doc_id", "item_id").distinct(), "leak-candidates")
    suspects = candidates.select("doc_id").distinct()
    suspects = util.hinted(suspects.select(F.col("doc_id").alias("_id")), 100_000)
    held = shingles(docs.join(suspects, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"), ["doc_id"], "text")
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item_shingles"))
    shared = held.join(util.hinted(items, 500_000), "shingle").groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_shared"))
    known = candidates.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item"))
    verified = shared.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("item_id") == F.col("_item")), "left_semi").join(sizes, "item_id")
    verified = verified.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
    return verified.where(F.col("containment") >= least).select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")
