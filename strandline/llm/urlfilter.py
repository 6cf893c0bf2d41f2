"""URL verdicts: host and path rules first, then a likelihood ratio of two character models.

Two variable-order Markov models of characters, one of accepted and one of rejected URLs, are smoothed by
Witten-Bell interpolation. A context is extended to a longer one only where the longer one was seen
``min_context`` times. The URLs that a rule decides are the training data; a fifth of them, chosen by a checksum,
is held out to calibrate the cut-off of the length-normalised log-likelihood difference. Rules look at host and path;
the models see the whole URL, its host in lower case, with scheme, query and fragment.

Everything is DataFrame expressions. Counts and probabilities are kept by distinct n-gram, so the one large
shuffle has a row for each character position of the URLs that no rule decides. N-grams and URLs that are more common
than one row in a thousand are broadcast, as there are fewer than a thousand (:func:`util.attach`).

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed unless the
models say otherwise (of a null one they see an empty text, of the other its text as it is); with no accepted or no rejected training URL every such URL is allowed; an empty table gives
an empty result; repeated rows each get the same verdict; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import util

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "org", "/es/"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
]
START, END = "\x02", "\x03"
#: Characters that the base model spreads its mass over.
ALPHABET = 1024


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return util.ascii_lower(part(1)), part(2)


def whole(url: Column) -> Column:
    """The URL as the models see it: as it is, but for the host's case."""
    url = F.coalesce(url, F.lit(""))
    head = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(util.ascii_lower(head), F.substr(url, F.length(head) + 1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` text and its verdict; null where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    none = F.lit(None).cast("string")
    return (
        F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ranked)], none),
        F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ranked)], none),
    )


def grams(order: int, chars: str = "chars") -> Column:
    """For each character and the end mark: the ``order`` characters before it and the character, as one string."""
    padded = F.concat(F.array_repeat(F.lit(START), order), F.col(chars), F.array(F.lit(END)))
    return F.transform(
        F.sequence(F.lit(1), F.size(chars) + 1),
        lambda i: F.concat(*[F.element_at(F.col("padded"), i + k) for k in range(order + 1)]),
    ), padded


def exploded(strings: DataFrame, order: int) -> DataFrame:
    """Rows (what ``strings`` has beside ``s``, gram) for each position of ``s``."""
    rest = [c for c in strings.columns if c != "s"]
    make, padded = grams(order)
    return (
        strings.withColumn("chars", F.filter(F.split("s", ""), lambda c: c != ""))
        .withColumn("padded", padded)
        .select(*rest, F.explode(make).alias("gram"))
    )


def log_ratios(train: DataFrame, wanted: DataFrame, order: int, min_context: int) -> DataFrame:
    """(gram, ratio): log P(last | rest) of the accepted model less that of the rejected one.

    train: s, accepted boolean, n. wanted: gram.
    """
    full = (
        exploded(train, order)
        .groupBy("gram")
        .agg(*[F.sum(F.when(F.col("accepted") == F.lit(y), F.col("n")).otherwise(0)).alias(a) for a, y in (("na", True), ("nr", False))])
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(order)))
    tail = lambda n: F.expr(f"right(gram, {n})")
    lower = (
        full.select("*", levels.alias("k"))
        .groupBy(tail("k + 1").alias("g"))
        .agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    )
    lower = util.save(lower, "url-grams")
    context = lower.groupBy(F.expr("left(g, length(g) - 1)").alias("h")).agg(
        F.sum("na").alias("ta"),
        F.sum("nr").alias("tr"),
        F.sum(F.when(F.col("na") > 0, 1).otherwise(0)).alias("da"),
        F.sum(F.when(F.col("nr") > 0, 1).otherwise(0)).alias("dr"),
    )
    context = context.where(((F.col("ta") + F.col("tr")) >= min_context) | (F.col("h") == ""))
    return _interpolated(lower, context, wanted, order)


def _interpolated(lower: DataFrame, context: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """From the shortest context to the longest. What a level joins on is shared by the grams that differ in one
    character, so a key has no more rows than there are characters, however common it is."""
    below = None
    for k in range(order + 1):
        asked = wanted.select(F.expr(f"right(gram, {k + 1})").alias("g")).distinct()
        asked = asked.select("g", F.expr(f"left(g, {k})").alias("h"), F.expr(f"right(g, {k})").alias("s"))
        seen = asked.join(lower, "g", "left").join(context, "h", "left")
        seen = seen.withColumns({"_pa": F.lit(1.0 / ALPHABET), "_pr": F.lit(1.0 / ALPHABET)}) if below is None else seen.join(below, "s")

        def model(n: str, t: str, d: str, p: str) -> Column:
            mass = F.col(t) + F.col(d)
            return F.when(mass > 0, (F.coalesce(F.col(n), F.lit(0)) + F.col(d) * F.col(p)) / mass).otherwise(F.col(p))

        below = seen.select(F.col("g").alias("s"), model("na", "ta", "da", "_pa").alias("_pa"), model("nr", "tr", "dr", "_pr").alias("_pr"))
    return below.select(F.col("s").alias("gram"), (F.log("_pa") - F.log("_pr")).alias("ratio"))


def cutoff(scored: DataFrame, most_false_blocks: float) -> float | None:
    """The cut-off that rejects most of the held-out rejected URLs, with at most this share of the accepted ones.

    Of all that do, the greatest below zero, as the models are indifferent there; above zero the least. Where fewer accepted URLs are held out than such a share could be told from (with none of n blocked, a share of 3 / n is
    still possible at 95 %), no URL is blocked that the models rate likelier accepted: the cut-off is below zero then.
    scored: ratio, accepted, n. Ratios are counted in steps of 0.001, so the table of counts is bounded.
    """
    bins = (
        scored.groupBy(F.round(F.col("ratio") * 1000).cast("int").alias("bin"))
        .agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("accepted"), F.col("n")).otherwise(0)).alias("r"))
    )
    up, all_ = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = bins.select("bin", F.sum("a").over(up).alias("ca"), F.sum("r").over(up).alias("cr"), F.sum("a").over(all_).alias("ta"))
    fine = F.col("ca") <= most_false_blocks * F.col("ta")
    ok = rows.agg(
        F.min(F.when(fine & (F.col("cr") > 0), F.struct(-F.col("cr"), "bin"))).getField("bin").alias("bin"), F.min(F.when(~fine, F.col("bin"))).alias("over"), F.max("ta").alias("ta")
    ).first()
    if ok["bin"] is None:
        return None
    told = ok["ta"] * most_false_blocks >= 3
    cut = ok["bin"] if ok["bin"] >= 0 else -1 if ok["over"] is None else min(ok["over"] - 1, -1)
    return (cut if told else min(cut, -1)) / 1000


def judge(pages: DataFrame, rules=RULES, order: int = 4, min_context: int = 2, most_false_blocks: float = 0.01) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (of the URLs that no rule decides), cutoff."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), whole(F.col("url")).alias("s"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    distinct = rows.groupBy("s", "by_rule").agg(F.count(F.lit(1)).alias("n"))
    distinct = util.save(distinct.withColumn("held", F.crc32(F.encode("s", "UTF-8")) % 5 == 0), "urls")
    train = distinct.where(F.col("by_rule").isNotNull() & ~F.col("held")).select("s", "n", (F.col("by_rule") == "allow").alias("accepted"))
    asked = distinct.where(F.col("by_rule").isNull() | F.col("held"))
    at = exploded(asked.select("s", util.row_key("s").alias("key")), order)
    per = at.groupBy("key", "gram").agg(F.count(F.lit(1)).alias("m"))
    wanted = util.save(at.groupBy("gram").agg(F.count(F.lit(1)).alias("places")), "url-wanted")
    ratios = util.save(log_ratios(train, wanted, order, min_context).join(wanted, "gram"), "url-ratios")
    sums = util.attach(per, ratios, ["gram"], "places", ["key"]).groupBy("key").agg((F.sum(F.round(F.col("ratio") * F.col("m"), 9).cast("decimal(24,9)")) / F.sum("m")).cast("double").alias("ratio"))
    scored = util.save(
        asked.withColumn("key", util.row_key("s")).join(sums, "key").select("s", "by_rule", "n", "ratio"), "url-scores"
    )
    held = scored.where(F.col("by_rule").isNotNull()).select("ratio", "n", (F.col("by_rule") == "allow").alias("accepted"))
    both = train.agg(F.max("accepted").alias("a"), F.min("accepted").alias("r")).first()
    cut = cutoff(held, most_false_blocks) if both["a"] and both["r"] is False else None
    method = F.when(F.col("ratio") <= (F.lit(None) if cut is None else F.lit(cut)), "block").otherwise("allow")
    open_ = util.save(scored.where(F.col("by_rule").isNull()).select(util.row_key("s").alias("key"), "ratio", "n"), "url-open")
    # a row that a rule decides has no ratio to look up: its key is its own, so a common URL among them is no common key
    keyed = rows.withColumn("key", F.when(F.col("by_rule").isNull(), util.row_key("s")).otherwise(util.row_key("page_id", "s", "rule")))
    return util.attach(keyed, open_, ["key"], "n", ["page_id"]).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("ratio")).alias("ratio"),
        F.lit(cut).cast("double").alias("cutoff"),
    )
