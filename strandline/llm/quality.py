"""Quality rules whose cut-offs carry a guarantee on how many good documents they reject.

Each rule compares one statistic of a text with a cut-off. The labelled documents of a stratum (language) are halved by a
hash of their id. On one half, the tuning half, the cut-offs of each rule are quantiles of the statistic over good documents, from
the loosest to the strictest of ``LEVELS``; a step to a stricter one is taken only if it rejects documents labelled low at
``GAIN`` times the rate of good ones at least. That fixes a path of rule sets. On the other half, the holdout, the path is
walked from its loose end: the good documents that the whole rule set rejects are counted and the exact binomial upper
bound of their rate is tested against ``most_rejected``; the last rule set before the first failure is taken. Testing in
a fixed order needs no correction within a stratum, and whole rule sets none over rules; the error level is shared over
strata (Bonferroni). Strata with too few labels to pass whatever happens, which their number alone tells, take no share:
they are pooled and tested as one, at a level of their own.

So with probability 1 - ``error``, each stratum with enough labels loses no more than ``most_rejected`` of its good
documents, whatever rules fire together, and so does the pool as a whole. A stratum without any label has no cut-off.

All is DataFrame expressions; texts are never shuffled, labels meet the statistics alone. Windows of five words meet by a
64-bit hash and count as equal if their words are.

Edge cases: a null text has no words and fails the base rule; a null language is a stratum of its own; labels that
repeat count once, documents without label are only judged; an empty table gives an empty result; extra columns stay
in :func:`keep`, whatever their names, and are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import util

#: rule: (statistic, rejects if above (1) or below (-1))
RULES: dict[str, tuple[str, int]] = {
    "symbols": ("symbol_rate", 1),
    "upper": ("upper_rate", 1),
    "bangs": ("bang_rate", 1),
    "dup_lines": ("dup_line_rate", 1),
    "repeats": ("repeat_rate", 1),
    "long_words": ("mean_word", 1),
    "short_words": ("mean_word", -1),
}
#: Shares of good tuning documents beyond a rule's cut-off, from the loosest to the strictest.
LEVELS = [0.0, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.03, 0.05]
#: Rule sets on a path: one for each level, and a looser one before them.
STEPS = len(LEVELS) + 1
#: A stricter cut-off must reject low documents at this many times the rate of good ones.
GAIN = 5.0
WINDOW = 5


def _only(text: str, kept: str) -> Column:
    """How many characters of a text a class keeps."""
    return F.length(F.regexp_replace(F.col(text), f"[^{kept}]+", "")).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the rates that the rules use, prefixed by ``q_``."""
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", util.words(F.col("_t")))
    item = lambda i, k: F.get(F.col("_w"), i + k)
    window = lambda i: F.xxhash64(*[item(i, k) for k in range(WINDOW)])
    d = d.withColumn(
        "_h",
        F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")),
    )
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_d", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    like = lambda x, j: F.coalesce(F.get(F.col("_d"), j)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_d", F.filter(F.transform("_d", lambda x, j: F.when(like(x, j - 1) | like(x, j + 1), x)), lambda x: x.isNotNull()))
    spelt = lambda x: F.struct(x["h"].alias("h"), F.array_join(F.slice("_w", x["i"] + 1, WINDOW), " ").alias("w"), x["i"].alias("i"))
    d = d.withColumn("_s", F.sort_array(F.transform("_d", spelt)))
    same = lambda x, j: F.coalesce((F.get(F.col("_s"), j)["h"] == x["h"]) & (F.get(F.col("_s"), j)["w"] == x["w"]), F.lit(False))
    d = d.withColumn(
        "_starts",
        F.sort_array(F.filter(F.transform("_s", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())),
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + (i + WINDOW - F.greatest(i, a["end"]))).cast("bigint").alias("n")),
        lambda a: a["n"],
    )
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = {
        "q_n_words": F.size("_w").cast("long"),
        "q_word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "q_n_symbols": _only("_t", "#*$%&|<>"),
        "q_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "q_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "q_upper": _only("_t", r"\p{Lu}"),
        "q_bangs": _only("_t", "!?"),
        "q_lines": F.size("_lines").cast("long"),
    }
    # a generator, as filters on its output are not pushed below it, where they would repeat all of the above
    d = d.select(*docs.columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in counts.items()]))))
    rate = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return d.withColumns(
        {
            "q_symbol_rate": rate("q_n_symbols", "q_word_chars"),
            "q_upper_rate": rate("q_upper", "q_word_chars"),
            "q_bang_rate": rate("q_bangs", "q_n_words"),
            "q_dup_line_rate": rate("q_n_dup_lines", "q_lines"),
            "q_repeat_rate": rate("q_n_repeat_words", "q_n_words"),
            "q_mean_word": rate("q_word_chars", "q_n_words"),
            "q_base_failed": (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words")),
        }
    )


def violates(statistic: str, side: int, cut: Column | float) -> Column:
    x = F.col(f"q_{statistic}")
    return x > cut if side > 0 else x < cut


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X binomial(n, p), summed in logarithms; exact up to rounding."""
    odds = F.log(p / (1 - p))
    first = n * F.log1p(-p)
    step = lambda s, j: F.struct(
        (s["t"] + F.log((n - j + 1) / j) + odds).alias("t"),
        _log_add(s["s"], s["t"] + F.log((n - j + 1) / j) + odds).alias("s"),
    )
    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.exp(F.aggregate(terms, F.struct(first.alias("t"), first.alias("s")), step, lambda s: s["s"]))


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def narrow(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The statistics without the texts, written once: doc_id, the stratum and the ``q_`` columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(stratum).alias(stratum))
    return util.save(statistics(rows).drop("text"), "quality-statistics")


def labelled(seen: DataFrame, labels: DataFrame, stratum: str, rules: dict) -> DataFrame:
    """stratum, good, tuning and x (the statistics by rule, negated where a rule rejects below) of the documents that have a
    quality label and pass the base rule."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    rows = seen.where(~F.col("q_base_failed")).join(known, "doc_id").withColumn("stratum", F.coalesce(F.col(stratum), F.lit("")))
    x = F.array(*[F.col(f"q_{s}") * side for s, side in rules.values()])
    return rows.select("stratum", "good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("tuning"), x.alias("x"))


def _units(rows: DataFrame, most_rejected: float, error: float) -> DataFrame:
    """stratum, unit (the stratum, or null: the pool) and level, the error level of the unit's test. One row a stratum."""
    n = rows.groupBy("stratum").agg(F.count(F.when(F.col("good") & ~F.col("tuning"), 1)).alias("n"))
    n = util.save(n, "quality-strata")
    strata = max(1, n.count())
    able = F.pow(F.lit(1 - most_rejected), F.col("n")) <= error / 2 / strata
    own = max(1, n.where(able).count())
    return n.select("stratum", F.when(able, F.col("stratum")).alias("unit"), F.when(able, error / 2 / own).otherwise(error / 2).alias("level"))


def _path(tuning: DataFrame, rules: int) -> DataFrame:
    """unit, path: for each of STEPS the cut-offs of x (by rule, null where the rule is not used), from good and low documents."""
    rows = tuning.select("unit", "good", F.posexplode("x").alias("rule", "x"))
    quantiles = F.percentile_approx(F.when(F.col("good"), F.col("x")), F.array(*[F.lit(1 - q) for q in LEVELS]), F.lit(10_000))
    cuts = util.save(rows.groupBy("unit", "rule").agg(quantiles.alias("cuts")).where("cuts IS NOT NULL"), "quality-candidates")

    def beside(cuts: DataFrame) -> DataFrame:
        met = rows["unit"].eqNullSafe(cuts["unit"]) & (rows["rule"] == cuts["rule"])
        return rows.join(util.hinted(cuts, 100_000), met).drop(cuts["unit"], cuts["rule"])

    # before the quantiles, a cut-off that leaves room above the good documents: the median of the low ones beyond them
    far = F.percentile_approx(F.when(~F.col("good") & (F.col("x") > F.col("cuts")[0]), F.col("x")), F.lit(0.5), F.lit(10_000))
    far = beside(cuts).groupBy("unit", "rule").agg(F.first("cuts").alias("cuts"), far.alias("far"))
    cuts = util.save(far.select("unit", "rule", F.concat(F.array(F.coalesce("far", F.col("cuts")[0])), "cuts").alias("cuts")), "quality-candidates")
    rows = beside(cuts)
    beyond = [F.col("x") > F.col("cuts")[j] for j in range(STEPS)]
    count = lambda kept: F.array(*[F.sum((v & kept).cast("long")) for v in beyond])
    sums = rows.groupBy("unit", "rule").agg(F.first("cuts").alias("cuts"), count(F.col("good")).alias("g"), count(~F.col("good")).alias("b"), F.sum(F.col("good").cast("long")).alias("goods"), F.count(F.lit(1)).alias("n"))
    more = lambda c, j: F.col(c)[j] - F.col(c)[j - 1] if j else F.col(c)[j]
    worth = [F.when((more("b", j) > 0) & (more("b", j) * F.col("goods") >= GAIN * more("g", j) * (F.col("n") - F.col("goods"))), F.col("cuts")[j]) for j in range(STEPS)]
    # of each level the strictest cut-off up to it that was worth its step
    used = F.array(*[F.coalesce(*worth[j::-1]) for j in range(STEPS)])
    lists = sums.select("unit", "rule", used.alias("used")).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("rule", "used"))).alias("used"))  # a map of as many entries as rules
    path = F.array(*[F.array(*[F.col("used")[r][j] for r in range(rules)]) for j in range(STEPS)])
    return util.save(lists.select("unit", path.alias("path")), "quality-path")


def calibrate(seen: DataFrame, labels: DataFrame, most_rejected: float = 0.05, error: float = 0.05, rules=RULES, stratum: str = "lang") -> DataFrame:
    """(stratum, cuts map<rule, cut-off>) from the documents of ``seen`` (:func:`narrow`) that ``labels`` know."""
    rows = util.save(labelled(seen, labels, stratum, rules), "quality-labelled")
    units = util.save(_units(rows, most_rejected, error), "quality-units")
    rows = rows.join(util.hinted(units, 10_000), "stratum")
    path = _path(rows.where("tuning"), len(rules))
    goods = rows.where("good AND NOT tuning")
    goods = goods.join(util.hinted(path, 10_000), goods["unit"].eqNullSafe(path["unit"])).drop(path["unit"])
    # rule sets only grow along the path, so the first that rejects a document tells all
    passes = lambda cuts: ~F.exists(F.zip_with("x", cuts, lambda x, c: F.coalesce(x > c, F.lit(False))), lambda v: v)
    goods = goods.withColumn("first", F.size(F.filter("path", passes)))
    k = F.array(*[F.sum((F.col("first") <= j).cast("long")) for j in range(STEPS)])
    counted = util.save(goods.groupBy("unit").agg(F.first("level").alias("level"), F.first("path").alias("path"), F.count(F.lit(1)).alias("n"), k.alias("k")), "quality-counts")
    tests, share = counted.select("unit", "level", "path", "n", F.posexplode("k").alias("j", "k")), F.lit(most_rejected)
    passed = F.when(F.col("k") < F.col("n") * share, binomial_cdf(F.col("k"), F.col("n"), share) <= F.col("level")).otherwise(False)
    chain = W.partitionBy("unit").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    last = tests.withColumn("so_far", F.min(passed.cast("int")).over(chain)).where("so_far = 1").groupBy("unit").agg(F.max_by(F.col("path")[F.col("j")], "j").alias("cut"))
    cuts = F.array(*[F.struct(F.lit(r).alias("rule"), (F.col("cut")[i] * side).alias("cut")) for i, (r, (_, side)) in enumerate(rules.items())])
    found = units.join(last, units["unit"].eqNullSafe(last["unit"])).select("stratum", F.map_from_entries(F.filter(cuts, lambda x: x["cut"].isNotNull())).alias("cuts"))
    return util.save(found, "quality-cuts")


def judge(seen: DataFrame, cuts: DataFrame, rules=RULES, stratum: str = "lang") -> DataFrame:
    """Rows that have the statistics, with ``q_kept``. The table of cut-offs has a row for each stratum: it is
    broadcast up to 10,000 strata and joined by a shuffle beyond."""
    seen = seen.withColumn("q_stratum", F.coalesce(F.col(stratum), F.lit("")))
    cuts = util.hinted(cuts.select(F.col("stratum").alias("q_stratum"), F.col("cuts").alias("q_cuts")), 10_000)
    seen = seen.join(cuts, "q_stratum", "left")
    bad = F.lit(False)
    for r, (s, side) in rules.items():
        bad = bad | F.coalesce(violates(s, side, F.col("q_cuts")[r]), F.lit(False))
    return seen.withColumn("q_kept", ~F.col("q_base_failed") & ~bad)


def keep(docs: DataFrame, cuts: DataFrame, rules=RULES, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever these are called."""
    rows = docs.select(F.struct("*").alias("q_row"), "text", F.col(stratum).alias(stratum))
    return judge(statistics(rows), cuts, rules, stratum).where("q_kept").select("q_row.*")
