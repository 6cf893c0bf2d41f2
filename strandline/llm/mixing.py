"""Document rates that mix a corpus to target shares of its domains, with soft membership.

A classifier fitted on the table of labels (hashed words and a few marks of form, multinomial logistic regression)
gives each document's probabilities of the domains: ``high`` and ``low`` quality, and ``toxic``. Rates r >= 0 are fitted
by projected gradient on least squares: the expected tokens of each domain, sum of r * tokens * probability, shall equal
its target. The gradient of a document depends on its probabilities alone, so documents are first added up by their
probabilities (rounded to ``digits`` decimals, so their number is bounded whatever the corpus) and each step is one
small distributed aggregation; a document's rate is a function of its probabilities and the few residuals of the steps.

The error of a domain is weighed by 1 / its tokens, which makes 1 a safe step of the plain gradient. Each aggregation
tries that step, longer ones, and steps whose gradient is scaled by the domains' Gram matrix; the one of least error is
taken, so no step does worse than the plain gradient. Targets that rates can meet are met in a few steps; where they
cannot, ``most_steps`` bounds the work and the error stays a few per cent above the least. A rate of zero means that a document is not drawn; its row stays.

The classifier is fitted on at most ``most_fitted`` labelled documents, those of least hash of their id; everything else
covers all rows. Domains without tokens are left out of the fit. With labels of one domain only, all documents are of
that domain; without labels all are ``high``.

Edge cases: null or empty texts have no tokens and keep the rate that their probabilities give; labels that repeat
count once, the least quality and the greatest toxicity win; an empty table gives an empty result; extra columns stay in
:func:`rated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

DOMAINS = ("high", "low", "toxic")
#: Target shares of the tokens.
TARGETS = {"high": 0.9, "low": 0.09, "toxic": 0.01}


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2.0).when(quality == 0, 1.0).otherwise(0.0)


def featured(docs: DataFrame, buckets: int = 1 << 14) -> DataFrame:
    """``docs`` with m_n (tokens) and m_x (hashed words and marks of form)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    share = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")) * 20 / F.greatest(F.lit(1), F.length(text))
    # one mark for each twentieth that a share reaches, so that greater shares have the marks of lesser ones
    reached = lambda k, c: F.transform(F.sequence(F.lit(0), F.floor(share(c)).cast("int")), lambda i: F.concat(F.lit(f"\x01{k}"), i.cast("string")))
    marks = F.concat(*[reached(k, c) for k, c in (("s", "#*$%&|<>"), ("u", r"\p{Lu}"), ("b", "!?"))])
    made = docs.withColumn("m_w", util.words(F.regexp_replace(F.lower(text), r"[.,;:!?#*$%&|<>]+", " "))).withColumn("m_marks", marks)
    made = made.withColumn("m_n", F.size("m_w").cast("long")).withColumn("m_t", F.concat("m_w", "m_marks"))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="m_t", outputCol="m_x").transform(made).drop("m_w", "m_t", "m_marks")


class Classifier:
    """Domain probabilities by a fitted model; one-hot where the labels know a single domain."""

    def __init__(self, docs: DataFrame, labels: DataFrame, most_fitted: int = 20_000):
        known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(domain(F.min("quality"), F.max("toxic")).alias("label"))
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_fitted)
        known = util.save(known, "mixing-labels")
        rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # most_fitted rows at most
        rows = util.save(featured(rows).select("label", "m_x"), "mixing-sample")
        found = sorted(r[0] for r in rows.select("label").distinct().collect())
        self.only = int(found[0]) if len(found) == 1 else 0 if not found else None
        if self.only is None:
            self.model = LogisticRegression(
                featuresCol="m_x", labelCol="label", probabilityCol="m_p", rawPredictionCol="m_raw", predictionCol="m_y", family="multinomial", regParam=0.0005, maxIter=40, standardization=False
            ).fit(rows)

    def probabilities(self, docs: DataFrame, digits: int = 3) -> DataFrame:
        """``docs`` with m_n and m_p, probabilities by DOMAINS, rounded."""
        made = featured(docs)
        if self.only is not None:
            p = F.array(*[F.lit(float(k == self.only)) for k in range(len(DOMAINS))])
        else:
            made = self.model.transform(made).withColumn("m_p", vector_to_array("m_p"))
            p = [F.round(F.coalesce(F.get("m_p", k), F.lit(0.0)), digits) for k in range(len(DOMAINS))]
            p = F.array(F.round(1 - sum(p[1:]), digits), *p[1:])
        # a generator: what is built on its output (rates, filters) does not repeat the text work and the model for each use
        return made.select(*docs.columns, F.inline(F.array(F.struct("m_n", p.alias("m_p")))))


def rate(steps: list[list[float]], p: Column) -> Column:
    """The rate after these steps of the projected gradient, from 1."""
    if not steps:
        return F.lit(1.0)
    given = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    moved = lambda r, s: F.greatest(F.lit(0.0), r - sum(s[k] * p[k] for k in range(len(DOMAINS))))
    return F.aggregate(given, F.lit(1.0), moved)


def fit(scored: DataFrame, targets: dict[str, float] = TARGETS, most_steps: int = 40, close: float = 1e-5) -> list[list[float]]:
    """The steps. scored: m_n, m_p. The targets are shares of all tokens of ``scored``."""
    alike = util.save(scored.groupBy("m_p").agg(F.sum("m_n").alias("m_n")).where("m_n > 0"), "mixing-alike")
    n, p, k = F.col("m_n"), F.col("m_p"), len(DOMAINS)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def tried(steps: list[list[float]], moves: list[np.ndarray]) -> list[np.ndarray]:
        """For each move: expected tokens by domain, and the Gram matrix of the documents whose rate is not zero.

        Steps go to the tasks as numbers, so all rounds have one plan, whatever has been done before."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(moves), k + len(pairs)))
            for b in batches:
                m = b.column("m_n").to_numpy().astype(float)
                q = b.column("m_p").flatten().to_numpy().reshape(-1, k)
                r = np.ones(len(m))
                for s in steps:
                    r = np.maximum(0.0, r - q @ np.array(s))
                both = np.stack([q[:, i] * q[:, j] for i, j in pairs], 1)
                for c, move in enumerate(moves):
                    now = np.maximum(0.0, r - q @ move)
                    sums[c] += np.append((now * m) @ q, np.where(now > 0, m, 0.0) @ both)
            at = np.indices(sums.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(sums.ravel())], ["move", "cell", "v"])

        out = np.zeros((len(moves), k + len(pairs)))
        for c, cell, v in alike.mapInArrow(task, "move int, cell int, v double").groupBy("move", "cell").agg(F.sum("v")).collect():  # nine cells a move
            out[c, cell] = v
        return list(out)

    mass = np.array(alike.agg(*[F.sum(n * p[i]) for i in range(k)]).first()[:])
    if mass[0] is None:
        return []
    mass = mass.astype(float)
    goal = np.where(mass > 0, [targets[d] for d in DOMAINS], 0) * mass.sum()
    off = lambda s: np.where(mass > 0, s[:k] - goal, 0.0)
    error = lambda s: float((off(s) ** 2 / np.maximum(mass, 1)).sum())
    steps: list[list[float]] = []
    now = tried(steps, [np.zeros(k)])[0]
    for _ in range(most_steps):
        if np.abs(off(now)).max() <= close * goal.sum():
            break
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, now[k:]):
            gram[i, j] = gram[j, i] = x
        plain = off(now) / np.maximum(mass, 1)
        scaled = np.linalg.solve(gram + np.diag(np.where(mass > 0, 1e-6 * mass, 1.0)), off(now))
        moves = [*[plain * s for s in (1, 4, 16, 64, 256)], *[scaled * s for s in (1, 0.5, 0.125)]]
        found = tried(steps, moves)
        best = min(range(len(moves)), key=lambda i: error(found[i]))
        if error(found[best]) >= error(now):
            break
        steps.append(moves[best].tolist())
        now = found[best]
    return steps


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """m_row (a row of ``docs``), m_n, m_p and m_rate. Texts are read twice, to fit and to apply, and never shuffled."""
    model = Classifier(docs, labels)
    steps = fit(model.probabilities(docs.select("text")).select("m_n", "m_p"), targets)
    rows = docs.select(F.struct("*").alias("m_row"), "text")
    return model.probabilities(rows).withColumn("m_rate", F.round(rate(steps, F.col("m_p")), 6))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, m_n, m_p, m_rate: the same without the texts, which are read once."""
    model = Classifier(docs, labels)
    scored = util.save(model.probabilities(docs.select("doc_id", "text")).select("doc_id", "m_n", "m_p"), "mixing-scored")
    return scored.withColumn("m_rate", F.round(rate(fit(scored, targets), F.col("m_p")), 6))
