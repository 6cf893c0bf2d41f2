"""The stages keep their contracts on a small corpus with planted cases."""


import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import DOC, prose


def test_stages(spark, tmp_path):
    item = prose(40, 900)
    clean = [(i, prose(80 + i % 60, 1000 + i), "en", f"s{i % 15}", 1) for i in range(200)]
    bad = [(500, prose(200, 5) + " " + item + " " + prose(100, 6), "en", "s1", 1), (501, "too short", "en", "s1", 1), (502, None, None, None, None), (503, clean[7][1], "en", "s2", 1), (504, "", "en", "s2", 0)]
    docs = spark.createDataFrame(clean + bad, DOC).withColumn("q_kept", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("rate", F.lit(0.5))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 9 > 0), int(i % 11 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        left.append({r[0] for r in now.select("doc_id").collect()})
        if k < 4:
            assert now.columns == docs.columns, name
    ids = {r[0] for r in clean}
    assert left[0] == ids | {500, 503} and left[2] == ids | {500} and left[3] == ids
    assert {"doc_id", "rate", "n_tokens"} <= set(now.columns) and left[4] == ids
    assert now.where("rate < 0 OR rate IS NULL").count() == 0


def test_near_copies_go_and_no_others(spark):
    """Held against the similarity of all pairs: copies with a few words changed go, texts that share less stay."""

    def changed(i, n):
        words = prose(300, 7000 + i).split(" ")
        for k in range(n):
            words[20 + 14 * k] = f"x{i}y{k}"
        return " ".join(words)

    own = [(i, prose(300, 7000 + i)) for i in range(30)]
    rows = own + [(100 + i, changed(i, 1 + i % 8)) for i in range(30)] + [(200 + k, " ".join(["same", "five", "words", "of", "old"] * 10 + [f"n{k}"])) for k in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    left = sorted(r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    assert left == sorted(set(group.values()))
    assert 30 < len(left) < 60


def test_null_and_repeated_ids_are_decided_by_their_text(spark, tmp_path):
    item, a, b, c, d = (prose(60, 9000 + k) for k in range(5))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (7, c, "en", "s", 1), (7, d, "en", "s", 1), (8, d, "en", "s", 1)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(left.select("doc_id", "text").collect(), key=str) == sorted([(None, a), (None, b), (7, c), (7, d)], key=str)
    rows = [(None, a, "en", "s", 1), (None, b + " " + item, "en", "s", 1), (7, c, "en", "s", 1), (7, d + " " + item, "en", "s", 1)]
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, DOC), str(tmp_path))
    assert sorted(left.select("doc_id", "text").collect(), key=str) == sorted([(None, a), (7, c)], key=str)


def test_empty_tables_give_an_empty_corpus(spark, tmp_path):
    for name, schema in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "rate", "n_tokens"} <= set(out.columns)


def test_a_hub_of_many_near_copies_is_dealt(spark):
    """Pairs of one hub go into several cells and give the links that brute force gives."""
    from strandline.llm import neardup

    base = prose(200, 77).split(" ")
    texts = [" ".join(base)] + [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(5, 185, 6)] + [" ".join([*base[:60], *[f"y{k}w{j}" for j in range(120)]]) for k in range(3)]
    sets = [set(neardup.shingle_set(t).tolist()) for t in texts]
    details = spark.createDataFrame([(k, [x - (1 << 64) if x >> 63 else x for x in sorted(s)]) for k, s in enumerate(sets)], "cls long, hashes array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, len(sets))] * 2, "hub long, member long")
    got = sorted(tuple(r) for r in neardup.verified(pairs, details, cell=4).select("a", "b").collect())
    assert got == [(0, k) for k in range(1, len(sets)) if len(sets[0] & sets[k]) >= 0.8 * len(sets[0] | sets[k])]
    assert 20 < len(got) < len(sets) - 1
