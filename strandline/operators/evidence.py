"""Evidence as rows: checks with a status, verdicts folded from them, certificates by hash, logs chained by hash."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A failure in these categories rejects outright. Fixed values.
HARD = ("integrity", "lookahead", "economics")


def check(name: str, category: str, value: Column, fail: Column | None = None, warn: Column | None = None) -> Column:
    """struct(id, category, status, value): skip for a null value, else the first condition that holds, else pass."""
    status = F.when(value.isNull(), "skip")
    for cond, word in ((fail, "fail"), (warn, "warn")):
        if cond is not None:
            status = status.when(cond, word)
    return F.struct(F.lit(name).alias("id"), F.lit(category).alias("category"), status.otherwise("pass").alias("status"), value.cast("double").alias("value"))


def rows(subjects: DataFrame, keys: list[str], checks: list[Column]) -> DataFrame:
    """keys, id, category, status, value: one row for each check of each subject."""
    return subjects.select(*keys, F.inline(F.array(*checks)))


def verdicts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, verdict and counts: hard failure, other failure, warning, pass, in that order."""
    n = lambda c: F.sum(c.cast("long"))
    failed = F.col("status") == "fail"
    one = checks.groupBy(*keys).agg(n(failed & F.col("category").isin(*HARD)).alias("hard"), n(failed).alias("failed"), n(F.col("status") == "warn").alias("warned"), F.count(F.lit(1)).alias("checks"))
    verdict = F.when(F.col("hard") > 0, "REJECT").when(F.col("failed") > 0, "NEEDS_MORE_EVIDENCE").when(F.col("warned") > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return one.withColumn("verdict", verdict)


def certificates(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, verdict, certificate: 16 digits of the SHA-256 of the subject's checks in the order of their ids."""
    body = checks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.concat_ws("=", "id", "status"))).alias("_b"))  # a subject has a few dozen checks
    out = verdicts(checks, keys).join(body, keys)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], "verdict", F.array_join("_b", ","))
    return out.select(*keys, "verdict", F.substring(F.sha2(text, 256), 1, 16).alias("certificate"))


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, before, after of checks whose status differs or that only one side has."""
    a, b = old.select(*keys, "id", F.col("status").alias("before")), new.select(*keys, "id", F.col("status").alias("after"))
    return a.join(b, [*keys, "id"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def claims(claimed: DataFrame, verified: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, claimed, verified, status: fail where a claim is off by more than ``tolerance`` of its size."""
    rows = claimed.select(*keys, F.col(value).alias("claimed")).join(verified.select(*keys, F.col(value).alias("verified")), keys, "left")
    off = F.abs(F.col("claimed") - F.col("verified")) > tolerance * F.greatest(F.abs("claimed"), F.lit(1e-12))
    return rows.withColumn("status", F.when(F.col("verified").isNull(), "skip").when(off, "fail").otherwise("pass"))


def chain(entries: DataFrame, log: str, seq: str, payload: list[str], hash_: str = "hash") -> DataFrame:
    """``entries`` with the hash of each: of the hash before and its payload, as :func:`chained` checks it.

    A log's entries go past in order and only the last hash is kept, so a log of any length takes one pass and no memory."""
    names, texts = entries.columns, [f"_p{k}" for k in range(len(payload))]
    rows = entries.select("*", *[F.col(c).cast("string").alias(t) for c, t in zip(payload, texts)]).repartition(log).sortWithinPartitions(log, seq)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema] + [f"`{hash_}` string"])

    def run(batches):
        own, last = None, ""
        for batch in batches:
            made = []
            for one in zip(batch.column(batch.schema.get_field_index(log)).to_pylist(), *[batch.column(batch.schema.get_field_index(t)).to_pylist() for t in texts]):
                if one[0] != own:
                    own, last = one[0], ""
                last = hashlib.sha256("|".join([last, *[x for x in one[1:] if x is not None]]).encode()).hexdigest()
                made.append(last)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(made, pa.string())], [*names, hash_])

    return rows.mapInArrow(run, schema)


def chained(entries: DataFrame, log: str, seq: str, payload: list[str], hash_: str = "hash") -> DataFrame:
    """log, entries, broken (first seq whose hash is not that of the hash before and its payload; null if all hold).

    Each entry is checked against the stored hash of the one before it, so the check is one window and needs no fold."""
    w = W.partitionBy(log).orderBy(seq)
    want = F.sha2(F.concat_ws("|", F.coalesce(F.lag(hash_).over(w), F.lit("")), *[F.col(c).cast("string") for c in payload]), 256)
    rows = entries.withColumn("_ok", want == F.col(hash_))
    return rows.groupBy(log).agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(~F.col("_ok"), F.col(seq))).alias("broken"))


def latest(entries: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """keys and the value of each key's last entry."""
    return entries.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def ledger(entries: DataFrame, data: str, variant: str) -> DataFrame:
    """data, runs, variants: how often a data set was tried, and by how many distinct variants."""
    return entries.groupBy(data).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(variant).alias("variants"))


def encode_flags(flags: dict[str, tuple[Column, int]]) -> Column:
    """Fields of fixed width packed from the lowest bit up, as hexadecimal digits."""
    value, at = F.lit(0).cast("long"), 0
    for column, width in flags.values():
        value = value.bitwiseOR(F.shiftleft(column.cast("long").bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
        at += width
    if at > 62:
        raise ValueError("fields exceed 62 bits")
    return F.lower(F.hex(value))


def decode_flags(text: Column, widths: dict[str, int]) -> list[Column]:
    value, at, out = F.conv(text, 16, 10).cast("long"), 0, []
    for name, width in widths.items():
        out.append(F.shiftright(value, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias(name))
        at += width
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of values; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cusum(rows_: DataFrame, keys: list[str], x: str, mu: Column, sigma: Column, h: float = 4.0, k: float = 0.5) -> DataFrame:
    """keys, alarm (first idx above ``h``), last: a one-sided sum of shortfalls floored at zero, as a running sum less its
    running minimum. The level is in units of log-likelihood, so each shortfall is scaled by the shift."""
    w = W.partitionBy(*keys).orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    shift = mu / sigma
    d = rows_.where(F.col(x).isNotNull()).withColumn("_x", shift * ((mu - F.col(x)) / sigma - k * shift))
    d = d.withColumn("_c", F.sum("_x").over(w)).withColumn("_s", F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w)))
    return d.groupBy(*keys).agg(F.min(F.when(F.round("_s", 9) > h, F.col("idx"))).alias("alarm"), F.max_by("_s", "idx").alias("last"))
