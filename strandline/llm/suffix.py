"""Removal of repeated byte strings: suffix arrays by induced sorting over shards in which equal windows meet.

A byte goes if a window of ``width`` bytes that covers it also starts anywhere else, in the same text or another.

1. Texts are cut into segments of windows by their least gram (:mod:`anchors`), so equal windows are at equal places of
   segments of one name. A name that occurs once has no repeated window.
2. Segments of one name with equal bytes are counted by a digest, before any shuffle of bytes: all windows of a
   segment that occurs twice are repeated. A group of copies, however large, is one row from here on.
3. The different segments of a name that has several are fetched once each and packed into shards of bounded size by whole names.
   The shard's suffix array is induced (classify, sort the leftmost-smaller substrings recursively, induce)
   and its permuted longest common prefixes computed. A window is repeated if its suffix agrees with a neighbour's on
   ``width`` bytes.
4. A name whose different segments exceed two shards is not sorted in one task: its windows are counted by digest, each
   on its own, which gives the same windows.
5. Repeated windows are joined back to where their segments stand, and each text drops their union.

Skew: names and contents are counted before they meet rows again; the fewer than a thousand that have more than a
thousandth of the rows are broadcast (:func:`util.attach`), so no task gets the segments of a common passage.

Edge cases: a null text is an empty one; texts shorter than ``width`` bytes keep everything; rows that repeat are two
texts that repeat each other; texts are compared as the bytes stored; an empty table gives an empty result; extra
columns are ignored. Segments are told apart by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util
from .anchors import segments
from .sais import permuted_lcp, suffix_array

WIDTH, GRAM = 400, 160
_KEY = "key struct<a:bigint,b:int>"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and where each row starts (one more: the end)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def cut(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """key, first, n, name, d1, d2: the segments of ``texts`` (key, body binary)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, starts = _bytes_of(b.column("body"))
            raw, keys = memoryview(data), b.column("key")
            for text, first, n, name in segments(data, starts, width, gram):
                at = starts[text] + first
                digests = b"".join(hashlib.blake2b(raw[p:q], digest_size=16).digest() for p, q in zip(at.tolist(), (at + n + width - 1).tolist()))
                d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(text)), pa.array(first), pa.array(n.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1])],
                    ["key", "first", "n", "name", "d1", "d2"],
                )

    return texts.select("key", "body").mapInArrow(task, f"{_KEY}, first bigint, n int, name bigint, d1 bigint, d2 bigint")


def fetch(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """name, d1, d2, n, k, large, bytes of the segments in ``wanted`` (key, first and these), each a slice of its text."""
    made = ["name", "d1", "d2", "n", "k", "large"]
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct(*made, "first")).alias("own"))
    rows = texts.join(lists.hint("merge"), "key").select("body", F.explode("own").alias("s"))
    piece = F.substring(F.col("body"), (F.col("s.first") + 1).cast("int"), F.col("s.n") + width - 1)
    return rows.select(*[f"s.{c}" for c in made], piece.alias("bytes")).dropDuplicates(["name", "d1", "d2"])


_FOUND = "name bigint, d1 bigint, d2 bigint, k bigint, runs array<struct<s:int,e:int>>"
_RUNS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _repeated(contents: list[bytes], width: int) -> list[list[dict]]:
    """Runs of windows of each content that stand somewhere else among them too."""
    size = np.array([len(c) for c in contents])
    starts = np.concatenate(([0], np.cumsum(size + 1)))
    t = np.ones(starts[-1] + 1, np.uint16)
    t[-1] = 0
    for c, a in zip(contents, starts.tolist()):
        t[a : a + len(c)] = np.frombuffer(c, np.uint8).astype(np.uint16) + 2
    sa = suffix_array(t, 258)
    plcp, phi = permuted_lcp(t, sa)
    hit = np.zeros(len(t), bool)
    long = np.flatnonzero(plcp >= width)
    hit[long] = True
    hit[phi[long]] = True
    out = []
    for a, n in zip(starts.tolist(), size.tolist()):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[a : a + n - width + 1].astype(np.int8), [0]))))
        out.append([{"s": int(s), "e": int(e)} for s, e in edges.reshape(-1, 2)])
    return out


def sort_shards(contents: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Repeated windows of ``contents`` (name, d1, d2, k, bytes), found in shards of whole names."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        runs = _repeated([r[4] for r in rows], width)
        some = [(r, x) for r, x in zip(rows, runs) if x]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([r[k] for r, _ in some], pa.int64()) for k in range(4)], pa.array([x for _, x in some], _RUNS)],
            ["name", "d1", "d2", "k", "runs"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("name", "d1", "d2", "k", "bytes")]):
                if size >= shard_bytes and row[0] != held[-1][0]:
                    yield batch(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield batch(held)

    total = contents.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parts = int(total // shard_bytes) + 1
    rows = contents.drop("n", "large").repartition(parts, "name").sortWithinPartitions("name", "d1", "d2")
    return rows.mapInArrow(task, _FOUND)


def count_windows(contents: DataFrame, width: int) -> DataFrame:
    """The same for names that are too large to sort in one task: each window is counted by its digest, in how many places it stands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, d1, d2, n, k, data in zip(*[b.column(c).to_pylist() for c in ("name", "d1", "d2", "n", "k", "bytes")]):
                w = [hashlib.blake2b(data[i : i + width], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([x] * n, pa.int64()) for x in (name, d1, d2, k)], pa.array(range(n), pa.int32()), pa.array(w, pa.binary())],
                    ["name", "d1", "d2", "k", "i", "w"],
                )

    windows = contents.mapInArrow(task, "name bigint, d1 bigint, d2 bigint, k bigint, i int, w binary")
    windows = util.save(windows, "windows")
    twice = util.save(windows.groupBy("name", "w").agg(F.count(F.lit(1)).alias("m"), F.sum("k").alias("places")).where("places > 1"), "windows-twice")
    found = util.attach(windows, twice, ["name", "w"], "m", ["d1", "i"]).where("places > 1").groupBy("name", "d1", "d2", "k")
    return found.agg(F.collect_list(F.struct(F.col("i").alias("s"), (F.col("i") + 1).alias("e"))).alias("runs"))


def repeats(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = 1 << 21) -> DataFrame:
    """key, runs: for each text (key, body) with repeated windows, the runs of their starts."""
    seg = util.save(cut(texts, width, gram), "segments")
    at = F.min(F.struct("key", "first")).alias("at")
    same = util.save(seg.groupBy("name", "d1", "d2").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), at), "segments-different")
    size = F.sum(F.col("n") + width - 1)
    names = same.groupBy("name").agg(F.count(F.lit(1)).alias("different"), (size > 2 * shard_bytes).alias("large"))
    names = util.save(names.where("different > 1"), "names-several")
    # a segment with copies is fetched too, once: windows of others may repeat its windows
    wanted = util.attach(same, names, ["name"], "different", ["d1"]).where("different > 1")
    contents = util.save(fetch(texts, wanted.select("at.key", "at.first", "n", "name", "d1", "d2", "k", "large"), width), "segment-bytes")
    found = sort_shards(contents.where("NOT large"), width, shard_bytes)
    if names.where("large").limit(1).count():
        found = found.unionByName(count_windows(contents.where("large"), width))
    # a segment with copies is repeated as a whole, whatever else repeats it
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("n").alias("e"))).alias("runs")
    copies = same.where("k > 1").select("name", "d1", "d2", "k", whole)
    found = util.save(found.where("k = 1").unionByName(copies), "repeated-runs")
    placed = util.attach(seg.drop("n"), found, ["name", "d1", "d2"], "k", ["key", "first"]).where("runs IS NOT NULL")
    run = F.transform("runs", lambda r: F.struct((F.col("first") + r["s"]).alias("s"), (F.col("first") + r["e"]).alias("e")))
    return placed.groupBy("key").agg(F.flatten(F.collect_list(run)).alias("runs"))


def remove(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = 1 << 21) -> DataFrame:
    """doc_id, n_bytes, spans (of removed bytes, end exclusive) and kept (the bytes left) of every row of ``docs``."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), util.row_key("doc_id", "text").alias("key"), body.alias("body"))
    found = util.save(repeats(texts, width, gram, shard_bytes), "repeats")
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept = [], []
            for data, runs in zip(b.column("body"), b.column("runs")):
                data, own = data.as_buffer(), []
                if runs.is_valid:
                    x = runs.values
                    s, e = x.field("s").to_numpy(), x.field("e").to_numpy() + width - 1
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.append(True, s[1:] > e[:-1])
                    own = list(zip(s[new].tolist(), e[np.append(new[1:], True)].tolist()))
                at, parts, view = 0, [], memoryview(data)
                for a, z in own:
                    parts.append(view[at:a])
                    at = z
                parts.append(view[at:])
                kept.append(b"".join(parts))
                spans.append([{"s": a, "e": z} for a, z in own])
            size = pa.array([x.as_buffer().size for x in b.column("body")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    rows = texts.join(found.hint("merge"), "key", "left").select("doc_id", "body", "runs")
    return rows.mapInArrow(task, "doc_id bigint, n_bytes bigint, spans array<struct<s:bigint,e:bigint>>, kept binary")
