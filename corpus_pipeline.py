"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
Near dedup is operator 9's fingerprints and pigeonhole search over five-word shingles with exact verification at a similarity
of 0.8; what lies beyond its radius is found by MinHash (see :mod:`strandline.llm.neardup`).
All but the last return the columns of ``documents``; the last adds n_tokens, the domain probabilities and the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, linededup, mixing, neardup, quality, util


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    cuts = quality.calibrate(quality.narrow(docs), util.table(spark, sf_dir, "labels"))
    return quality.keep(docs, cuts)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text."""
    done = linededup.dedup(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word similarity of 0.8 at least): the row of the group's least
    doc_id. Rows are told apart by all their columns, so null and repeated ids are decided by their text."""
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. The search knows rows by all their columns: null ids go as others do, and
    rows that share an id are judged one by one."""
    keyed = docs.select(neardup.row_key(docs).alias("doc_id"), "text")
    found = util.save(decontam.search(keyed, util.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct(), "leaks")
    return docs.withColumn("_key", neardup.row_key(docs)).join(util.hinted(found, 1_000_000), "_key", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays and gets its rate; a rate of zero says that the mix draws nothing from it."""
    done = mixing.rated(docs, util.table(spark, sf_dir, "labels"))
    made = {"n_tokens": F.col("m_n"), **{f"p_{d}": F.col("m_p")[k] for k, d in enumerate(mixing.DOMAINS)}, "rate": F.col("m_rate")}
    return done.select(*[F.col("m_row").getField(c).alias(c) for c in docs.columns if c not in made], *[c.alias(name) for name, c in made.items()])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]
#: SimHash components, exact binomial bounds and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = util.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = util.save(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
