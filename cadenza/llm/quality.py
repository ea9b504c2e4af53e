"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

All of it is DataFrame and SQL expressions. One scan takes the statistics of every whole text; everything after works on
those short rows. Estimates of centre and spread are minimum-covariance-determinant estimates: starting from the rows
nearest the medians, concentration steps re-estimate mean and covariance from the nearest ``SUPPORT`` share of rows. Each
step is a single pass: rows are binned by squared distance, sums are taken per group and bin (partial sums before the
shuffle, so a hot source is no hot task), and running totals over the bins give mean and covariance of the share.

Defined cases: a null text has no words and fails the base rules. Null lang or source are values of their own. Groups of
under ``LEAST`` rows are pooled within their language, then over all languages; a pool that stays smaller rejects nothing.
Spreads have floors, so that a statistic that never varies in a group makes no small difference an outlier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SPACE = r"[\x20\x09-\x0D]"
SUPPORT = 0.75
LEAST = 40
STEPS = 3
TAIL = 1e-5
#: Transformed statistics and the least standard deviation of each.
VECTOR = {
    "word_length": ("ln(word_chars / n_words)", 0.12),
    "signs": ("sqrt((n_symbols + n_marks) / n_words)", 0.13),
    "repeats": ("sqrt(greatest(n_repeat_words / n_words, n_dup_lines / n_lines))", 0.1),
    "capitals": ("sqrt(n_capitals / word_chars)", 0.09),
}
D = len(VECTOR)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ESTIMATES = [f"m{i}" for i in range(D)] + [f"c{i}{j}" for i in range(D) for j in range(i + 1)]


def text_stats(docs: DataFrame) -> DataFrame:
    """Adds the statistics of every whole text: STATS, n_lines, n_capitals, n_marks (exclamation and question marks)."""
    text = F.coalesce("text", F.lit(""))
    count = lambda kind: F.char_length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": F.array_remove(F.split(text, SPACE + "+", -1), ""), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": count("#*$%&|<>"),
            "n_capitals": count(r"\p{Lu}"),
            "n_marks": count("!?"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            # hashes of the 3-word windows by start
            "_windows": F.expr("if(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))))"),
        }
    ).drop("_words", "_lines")
    # equal windows stand side by side in sorted order; most texts have none
    out = out.withColumn("_sorted", F.expr("if(size(array_distinct(_windows)) = size(_windows), null, sort_array(transform(_windows, (h, i) -> struct(h, i))))"))
    out = out.withColumn("_starts", F.expr("sort_array(filter(transform(_sorted, (x, k) -> if(x.h = get(_sorted, k - 1).h or x.h = get(_sorted, k + 1).h, x.i, null)), i -> i is not null))"))
    covered = F.expr("aggregate(transform(_starts, (x, k) -> least(3, coalesce(get(_starts, k + 1) - x, 3))), 0, (a, b) -> a + b)")
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_sorted", "_starts")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def chi2_cdf(x: float, d: int) -> float:
    """Distribution function of chi squared for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def chi2_quantile(tail: float, d: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        upper = math.exp(-middle / 2) * sum((middle / 2) ** k / math.factorial(k) for k in range(d // 2))
        low, high = (middle, high) if upper > tail else (low, middle)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest share of normal data that of all data."""
    return share / chi2_cdf(chi2_quantile(1 - share, D), D + 2)


def _factor(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l{i}{j} of each group's covariance."""
    for j in range(D):
        minus = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))  # noqa: B023, E731
        estimates = estimates.withColumn(f"l{j}{j}", F.expr(f"sqrt(greatest(c{j}{j}{minus(j)}, 1e-12))"))
        if j + 1 < D:
            estimates = estimates.withColumns({f"l{i}{j}": F.expr(f"(c{i}{j}{minus(i)}) / l{j}{j}") for i in range(j + 1, D)})
    return estimates.select("cell", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)])


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the row's group; null without an estimate."""
    out = rows.join(_factor(estimates), "cell", "left")
    for i in range(D):
        out = out.withColumn(f"y{i}", F.expr(f"(x{i} - m{i}{''.join(f' - l{i}{k} * y{k}' for k in range(i))}) / l{i}{i}"))
    return out.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in range(D)))).select(*rows.columns, "d2")


def _concentrate(rows: DataFrame, share: float | None, most: float | None = None) -> DataFrame:
    """Mean and covariance per group, of the nearest share of its rows, or of the rows within a distance."""
    sums = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(D) for j in range(i + 1)]
    names = [f"s{i}" for i in range(D)] + [f"p{i}{j}" for i in range(D) for j in range(i + 1)]
    if most is not None:
        total = rows.where(F.col("d2") <= most).groupBy("cell").agg(*sums)
        scale = consistency(chi2_cdf(most, D))
    else:
        # sixteen bins to each doubling of the squared distance
        binned = rows.withColumn("bin", F.expr("cast(floor(16 * log2(d2 + 1e-6)) as int)")).groupBy("cell", "bin").agg(*sums)
        upto = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("cell")
        run = binned.select("cell", "bin", F.sum("n").over(whole).alias("all"), *[F.sum(c).over(upto).alias(c) for c in ["n", *names]])
        # the first bin that completes the share
        picked = F.min(F.when(F.expr(f"n >= {share} * `all`"), F.col("bin"))).over(whole)
        total = run.withColumn("at", picked).where("bin = at")
        scale = consistency(share)
    floors = [floor for _, floor in VECTOR.values()]
    means = total.withColumns({f"m{i}": F.expr(f"s{i} / n") for i in range(D)})
    cov = {f"c{i}{j}": F.expr(f"{scale!r}D * (p{i}{j} / n - m{i} * m{j}) + {floors[i] ** 2 if i == j else 0.0!r}D") for i in range(D) for j in range(i + 1)}
    return means.withColumns(cov).select("cell", *_ESTIMATES)


def judge(docs: DataFrame) -> DataFrame:
    """All columns of docs with the statistics, base_failed, distance (null without an estimate) and kept."""
    scratch = Scratch(docs.sparkSession)
    clash = [c for c in docs.columns if c in {*STATS, "n_lines", "n_capitals", "n_marks", "base_failed", "distance", "kept", "cell", "d2"} or c[:1] == "_" or (c[:1] in "xylmc" and c[1:].isdigit())]
    rows = text_stats(docs.withColumnsRenamed({c: f"in:{c}" for c in clash})).withColumn("base_failed", base_failed())
    rows = rows.withColumns({f"x{i}": F.expr(f"if(base_failed, null, {x})") for i, (x, _) in enumerate(VECTOR.values())})
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    rows = scratch.stage(rows.withColumns({"_lang": key("lang"), "_source": key("source")}), "stats")
    # the group of each language and source, pooled where rows are few
    sizes = rows.where("not base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)
    sizes = sizes.withColumn("pool", F.sum(small).over(Window.partitionBy("_lang")))
    cells = scratch.stage(sizes.select("_lang", "_source", F.expr(f"case when n >= {LEAST} then concat(_lang, ' ', _source) when pool >= {LEAST} then concat(_lang, ' *') else '*' end").alias("cell")), "cells")
    slim = rows.where("not base_failed").join(cells, ["_lang", "_source"]).select("cell", *[f"x{i}" for i in range(D)])
    medians = slim.groupBy("cell").agg(F.count("*").alias("n"), *[F.round(F.percentile_approx(f"x{i}", 0.5, 10_000), 3).alias(f"m{i}") for i in range(D)])
    floors = [floor for _, floor in VECTOR.values()]
    start = {f"c{i}{j}": F.lit(floors[i] ** 2 if i == j else 0.0) for i in range(D) for j in range(i + 1)}
    estimates = scratch.stage(medians.where(f"n >= {LEAST}").withColumns(start).select("cell", *_ESTIMATES), "mcd")
    for step in range(STEPS + 1):
        near = _with_distance(slim.join(estimates.select("cell"), "cell", "left_semi"), estimates)
        kept = _concentrate(near, SUPPORT) if step < STEPS else _concentrate(near, None, chi2_quantile(0.025, D))
        estimates = scratch.stage(kept, "mcd")  # one short row per group
    judged = _with_distance(rows.join(cells, ["_lang", "_source"], "left"), estimates)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2_quantile(TAIL, D))
    return judged.select(*[F.col(f"`in:{c}`").alias(f"in:{c}") if c in clash else F.col(f"`{c}`") for c in docs.columns], *STATS, "base_failed", F.col("d2").alias("distance"), kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    judged = judge(docs).where("kept")
    return judged.select(*[F.col(f"`{'in:' + c if 'in:' + c in judged.columns else c}`").alias(c) for c in docs.columns])
