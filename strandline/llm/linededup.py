"""Cross-site boilerplate: lines that stand on many distinct sites are taken out of every document.

A line's spread is the number of distinct sites (``source``) that have it. Lines seen fewer than ``min_sites`` times
cannot spread so far and go first. The places of the others (document, position, line hash, site) are written once; a
HyperLogLog sketch of the sites is built per line hash straight from them and merged by aggregation. A line whose
estimate is clearly above or below the limit is decided by it; only lines that the sketch's error leaves open get an
exact distinct count.

All is DataFrame expressions. Lines are compared with white space at both ends removed, by SHA-256; lines of fewer than
``min_words`` words are never boilerplate. Texts are split twice to find boilerplate and shuffled once, to the positions
of their own removed lines.

Skew: counts and sketches are aggregated before they are shuffled, so a line that a third of all rows share is one row
of each task; places meet decisions by :func:`util.attach`, which broadcasts the few lines that are common.

Edge cases: a null text stays null and has no lines; a null source is one site of its own; a document all of whose lines
go keeps an empty text; rows that repeat are treated alike; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

STRIP = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def lines(docs: DataFrame, min_words: int, *more: str) -> DataFrame:
    """site, line (hash), pos and the columns ``more``, a row for each line that may be boilerplate."""
    text = F.regexp_replace(F.col("line"), STRIP, "")
    has = F.col("line").rlike(rf"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{min_words - 1}}}[^\x20\x09-\x0D]")
    rows = docs.select(*more, F.coalesce("source", F.lit("\x00")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(has).select(*more, "site", "pos", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("line"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("_row"), "text", "source", util.row_key("doc_id", "text", "source").alias("_key"))


def places(rows: DataFrame, min_sites: int, min_words: int) -> DataFrame:
    """_key, site, pos, line and n (how often it is seen) of each line of ``rows`` (:func:`keyed`) seen ``min_sites`` times or more."""
    found = lines(rows, min_words, "_key")
    often = util.save(found.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites), "often-lines")
    return util.save(util.attach(found, often, ["line"], "n", ["_key", "pos"], 200_000).where("n IS NOT NULL"), "line-places")


def boilerplate(placed: DataFrame, min_sites: int = 10, lg_k: int = 10, sigmas: float = 5.0) -> DataFrame:
    """(line, sites, n): the hashes of lines on at least ``min_sites`` distinct sites. sites is exact near the limit."""
    spread = placed.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.max("n").alias("n"))
    margin = sigmas * 1.04 / 2 ** (lg_k / 2) * min_sites + 1
    spread = util.save(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("line")
    exact = placed.join(util.hinted(near, 200_000), "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("exact"))
    found = spread.join(exact, "line", "left").select("line", F.coalesce("exact", "sites").alias("sites"), "n")
    return util.save(found.where(F.col("sites") >= min_sites), "boilerplate")


def remove(docs: DataFrame, placed: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the lines in ``found``, with n_lines and n_removed_lines (null text: zero)."""
    hits = util.attach(placed.select("_key", "pos", "line"), found, ["line"], "n", ["_key", "pos"]).where("sites IS NOT NULL")
    gone = util.save(hits.groupBy("_key").agg(F.collect_set("pos").alias("_gone")), "removed-lines")
    parts = F.split("text", "\n")
    # what stands between removed positions, so the work is linear in the lines however many go
    edges = F.concat(F.array(F.lit(-1)), F.array_sort("_gone"), F.array(F.size(parts)))
    between = lambda i: F.slice(parts, F.get(F.col("_edges"), i - 1) + 2, F.get(F.col("_edges"), i) - F.get(F.col("_edges"), i - 1) - 1)
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_edges") - 1), between))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rows = keyed(docs).join(gone.hint("merge"), "_key", "left").withColumn("_edges", edges)  # the same plan at every size
    made = {
        "n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long"),
        "n_removed_lines": F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long"),
    }
    return rows.select(
        *[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c not in made],
        *[x.alias(c) for c, x in made.items()],
    )


def dedup(docs: DataFrame, min_sites: int = 10, min_words: int = 4) -> DataFrame:
    placed = places(keyed(docs), min_sites, min_words)
    return remove(docs, placed, boilerplate(placed, min_sites))
