"""Operators 11 to 13 against brute force, on fixtures with nulls, ties, copies, odd widths and crowds."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import prefixtrie, queries, queries_vectors, vectorcode, vectordup, util

from ..test_queries import ordered, plain

VEC = "vec_id long, embedding array<double>, label int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, VEC)
    for c in ("rid", "part", "cid", "h", "g", "v", "size", "code", "n_links", "component_id", "crowd"):
        df = df.withColumn(c, F.lit("x"))
    return df


def codes_by_force(rows):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in rows) // 8) * 8
    m = width // 8
    whole = [[math.floor(x * 4096) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:16]
    books = [[whole[i][p * m : (p + 1) * m] for i in first] for p in range(8)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(6):
        for p in range(8):
            of = {}
            for x in whole:
                of.setdefault(nearest(x[p * m : (p + 1) * m], books[p])[0], []).append(x[p * m : (p + 1) * m])
            for k, v in of.items():
                books[p][k] = [sum(c) // len(v) for c in zip(*v)]
    said = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = [(r, [nearest(x[p * m : (p + 1) * m], books[p]) for p in range(8)]) for r, x in zip(rows, whole)]
    out = [(r[0], "".join(f"{k:02x}" for k, _ in a), sum(d for _, d in a), r[2]) for r, a in out]
    labels = {}
    for _, _, e, label in out:
        labels[label] = labels.get(label, 0) + e
    long = lambda v: v if v < 1 << 63 else None
    return sorted(((i, c, long(e), long(labels[k]), said) for i, c, e, k in out), key=str)


def test_hilbert_curve_takes_single_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = vectorcode.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shortlists_hold_the_nearest_and_leave_out_others():
    rng = np.random.default_rng(1)
    sizes = []
    for _ in range(300):
        book = rng.integers(-50, 50, (16, 4))
        x = rng.integers(-50, 50, 4) + rng.integers(0, rng.choice([1, 4, 30]), (20, 4))
        listed = vectorcode.shortlist(x.min(0), x.max(0), book)
        want = ((x[:, None] - book) ** 2).sum(2).argmin(1)
        entry, far = vectorcode.assign(x, book, listed)
        assert entry.tolist() == want.tolist() and far.tolist() == ((x - book[want]) ** 2).sum(1).tolist()
        sizes.append(len(listed))
    assert min(sizes) == 1 and np.mean(sizes) < 12


def test_codes(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 5) for i in range(200)] + [(7, rows[5][1], 1), (7, rows[5][1], 1), (None, centres[0], None)]
    rows += [(500, None, 1), (501, [None] * 24, 1), (502, [float("nan")] * 24, 1), (503, [float("inf")] * 24, 1), (504, [], 1), (505, [0.5] * 3, 2), (506, [-0.0] * 24, 1)]
    assert rows_of(vectorcode.encode(vectors(spark, rows))) == codes_by_force(rows)
    assert rows_of(vectorcode.encode(vectors(spark, rows[:5]))) == codes_by_force(rows[:5])
    assert vectorcode.encode(vectors(spark, rows).limit(0)).count() == 0
    assert vectorcode.encode(vectors(spark, [(1, None, None)])).count() == 0
    assert rows_of(vectorcode.encode(vectors(spark, [(1, [], 3), (2, [], 3)]))) == [(1, "00" * 8, 0, 0, codes_by_force([(1, [0.0] * 0, 3)] * 2)[0][4])] + [(2, "00" * 8, 0, 0, codes_by_force([(1, [], 3)] * 2)[0][4])]


def test_codes_of_huge_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.choice([0, 5, 8, 30]) for _ in range(20)], i % 3 or None) for i in range(60)]
    assert rows_of(vectorcode.encode(vectors(spark, rows))) == codes_by_force(rows)


def links_by_force(rows):
    groups = {}
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            groups.setdefault((label, len(v)), []).append(k)
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for ks in groups.values():
        u = np.array([rows[k][1] for k in ks], float)
        u /= np.abs(u).max(1, keepdims=True)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        near = u @ u.T >= 0.98
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            n[ks[a]] += 1
            root[top(ks[a])] = top(ks[b])
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)] = min(least.get(top(k), r[0]), r[0])
    return sorted(((r[0], n[k], least.get(top(k)), r[0] == least.get(top(k))) for k, r in enumerate(rows)), key=str)


def test_near_vectors(spark, monkeypatch):
    """Crowds around one vector, pairs at about the limit, and copies; small blocks, so that large buckets are cut."""
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(30)]
    rows = []
    for i in range(700):
        of, spread = base[0] if i < 400 else rng.choice(base), rng.choice([0, 0.02, 0.1, 0.15, 0.2])
        rows.append((i if i % 50 else None, [x + rng.gauss(0, spread) for x in of], rng.choice([1, 1, 1, 2, None])))
    rows += [(2000 + k, base[0], 1) for k in range(300)]
    rows += [(1000, None, 1), (1001, [0.0] * 20, 1), (1002, [], 1), (1003, [1.0, None], 1), (1004, [float("inf")] * 20, 1), (1005, [1.0] * 3, 1), (1006, [2.0] * 3, 1)]
    rows += [(1006, [1e300] * 3, 1), (1007, [1e-300] * 3, 1), (1008, [5.0], 2), (1009, [7.0], 2), (1010, [-7.0], 2), (1011, [-1.0] * 3, 1)]
    monkeypatch.setattr(vectordup, "BLOCK", 64)
    assert rows_of(vectordup.groups(vectors(spark, rows))) == links_by_force(rows)
    assert vectordup.groups(vectors(spark, rows).limit(0)).count() == 0


def test_tables_of_hashes_are_enough():
    rng = np.random.default_rng(8)
    k, tables = vectordup.design(50_000, 64)
    a, b = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    h = vectordup.Hashes(64, k, tables)
    lists = [np.stack([h.lists(x, t) for t in range(tables)], 1) for x in (a, b)]
    assert vectordup.meet(*lists).any(1).all()
    assert vectordup.meet(lists[0], np.roll(lists[1], 1, 0)).mean() < 1e-3


def trie_by_force(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if k in kids else 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = {k: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(k)))).encode()).hexdigest() for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], ends[k]) for k, m in members.items()), key=str)


def test_forests_are_rolled_up():
    rng = np.random.default_rng(6)
    for _ in range(150):
        n, back = int(rng.integers(1, 60)), int(rng.choice([1, 3, 60]))
        parent = np.array([-1 if i == 0 or rng.random() < 0.1 else int(rng.integers(max(0, i - back), i)) for i in range(n)])
        depth = np.zeros(n, int)
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        values = rng.integers(0, 9, (n, 2))
        want = values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        assert (prefixtrie.rolled_up(parent, depth, values) == want).all()


@pytest.mark.parametrize("local", [40, 4096])
def test_trie(spark, local):
    """Small components are split by joins; one conversation is a long path that several tasks share."""
    rng = random.Random(3)
    rows = [(c, rng.choice([t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["", "a", "bé", "hello", None])) for c in [*range(-12, 40), None] for t in range(rng.choice([0, 1, 3, 9, 12]))]
    rows += [(c, t, "u", f"x{t}") for c in (70, 71) for t in range(300)] + rows[:9]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("c", "at", "h", "depth", "nid", "bytes", "w1"):
        talks = talks.withColumn(c, F.lit("x"))
    assert rows_of(prefixtrie.build(talks, local)) == trie_by_force(rows)
    if local > 40:
        assert prefixtrie.build(talks.limit(0)).count() == 0 and prefixtrie.build(talks.where("conv_id IS NULL")).count() == 0


def test_sql_twins_of_vectors(spark):
    import duckdb

    con, where = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    for name, sql in queries_vectors.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, where)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        cols = sorted(df.columns)
        assert cols == sorted(names)
        want = ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
        assert ordered(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
    assert util.table(spark, where, "embeddings").count() > 0
