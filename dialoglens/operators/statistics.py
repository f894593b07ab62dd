"""SLA summaries, diagnosis, resampling, agreement and regression over long tables of scores.

Resampling draws for every row (``delta_ci`` alone for binned values), quantiles and ranks go over ranges of values:
no task holds all values of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglens.config import DIAGNOSES, SLA
from dialoglens.functions.numbers import exact_mean, five_bins, threshold, token_cost
from dialoglens.operators.ordered import mid_ranks, within_budget
from dialoglens.operators.quantiles import exact_quantiles
from dialoglens.operators.resampling import binned, interval, replicates
from dialoglens.operators.row_draws import bootstrap_replicates, poisson_replicates, shuffled_sums
from dialoglens.sources.storage import kept


def below_sla() -> Column:
    return F.col("score") < threshold(F.col("metric"))


def sla_summary(scores: DataFrame, *keys: str) -> DataFrame:
    """``keys, mean, median, p10, p90, below_sla_count, total_count, sla_pass_rate``; metrics by default.

    Quantiles come from repeated selection, so the scores are read a few times when this is called; a table
    that is dear to make should be written first.
    """
    by = list(keys or ("metric",))
    sums = scores.groupBy(*by).agg(
        F.avg("score").alias("mean"),
        F.count_if(below_sla()).alias("below_sla_count"),
        F.count(F.lit(1)).alias("total_count"),
        (1 - F.count_if(below_sla()) / F.count(F.lit(1))).alias("sla_pass_rate"),
    )
    found = exact_quantiles(scores, by, "score", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in by]
    return sums.alias("s").join(found.alias("q"), same, "left").select(*(f"s.{k}" for k in by), "mean", "median", "p10", "p90", "below_sla_count", "total_count", "sla_pass_rate")


def flagged_calls(scores: DataFrame, evaluations: DataFrame) -> DataFrame:
    """``call_id`` of the calls with any score below its SLA."""
    return evaluations.join(scores.where(below_sla()).select("eval_id"), "eval_id", "left_semi").select("call_id").distinct()


def flagged_pairs(scores: DataFrame, key: str = "qa_id") -> DataFrame:
    """``key`` of what has any score below its SLA."""
    return scores.where(below_sla()).select(key).distinct()


def by_group(scores: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Means and SLA passes by call, by tenant, by day and overall, in one pass (``grouping`` names the level)."""
    rows = scores.join(evaluations.select("eval_id", "call_id", "tenant_id", F.to_date("evaluated_at").alias("day")), "eval_id")
    rows = rows.withColumn("below", below_sla().cast("long"))
    sets = rows.groupingSets([["call_id"], ["tenant_id"], ["day"], []], "call_id", "tenant_id", "day")
    out = sets.agg(F.grouping_id().alias("gid"), exact_mean(F.col("score")).alias("mean"), F.count(F.lit(1)).alias("n"), F.sum("below").alias("below"))
    level = F.when(F.col("gid") == 3, "call").when(F.col("gid") == 5, "tenant").when(F.col("gid") == 6, "day").otherwise("all")
    return out.select(level.alias("grouping"), "call_id", "tenant_id", "day", "mean", "n", "below")


def diagnosed(scores: DataFrame, faithful_from: float = SLA["faithfulness"], recalled_from: float = SLA["context_recall"]) -> DataFrame:
    """``eval_id, category``: which of retrieval and generation failed; a metric without a score counts as good."""
    pivot = scores.groupBy("eval_id").agg(*(F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in ("faithfulness", "context_recall")))
    faithful = F.coalesce(F.col("faithfulness") >= faithful_from, F.lit(True))
    recalled = F.coalesce(F.col("context_recall") >= recalled_from, F.lit(True))
    kind = F.when(faithful & recalled, DIAGNOSES[0]).when(faithful, DIAGNOSES[1]).when(recalled, DIAGNOSES[2]).otherwise(DIAGNOSES[3])
    return pivot.select("eval_id", kind.alias("category"))


def diagnosis_counts(scores: DataFrame, **limits: float) -> DataFrame:
    """``category, n`` with all four categories."""
    every = scores.sparkSession.createDataFrame([(d,) for d in DIAGNOSES], "category string")
    found = diagnosed(scores, **limits).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def review_priority(scores: DataFrame, margin: float = 0.1) -> DataFrame:
    """``eval_id, priority``: doubt plus nearness to the SLA, a mean over the evaluation's metrics."""
    off = F.abs(F.col("score") - threshold(F.col("metric"), None))
    near = F.when(off < margin, (margin - off) * 10).otherwise(0.0)
    doubt = 1 - F.col("confidence") + F.when(F.col("is_low_confidence"), 0.5).otherwise(0.0)
    return scores.groupBy("eval_id").agg((F.sum(doubt + near) / F.count(F.lit(1))).alias("priority"))


def review_selection(scores: DataFrame, evaluations: DataFrame, quota: int = 20) -> DataFrame:
    """Evaluations with ``needs_human_review``: the ``quota`` of largest priority, equal ones by id.

    Each task keeps ``quota`` rows, and so many ids are broadcast to mark the rest.
    """
    best = review_priority(scores).select("eval_id", F.round("priority", 9).alias("priority")).orderBy(F.desc("priority"), "eval_id").limit(quota)
    marked = F.broadcast(best.select("eval_id", F.lit(True).alias("needs_human_review")))
    return evaluations.join(marked, "eval_id", "left").withColumn("needs_human_review", F.coalesce("needs_human_review", F.lit(False)))


def bootstrap_ci(values: DataFrame, key: str = "metric", samples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """``key, mean, low, high, n``: percentile intervals of the mean from ``samples`` resamples of n out of n.

    One row has its own value as bounds. Rows are drawn one by one; ``eval_id`` tells a key's rows apart.
    """
    return resampled(values, key, bootstrap_replicates, samples, level, seed)


def poisson_ci(values: DataFrame, key: str = "metric", samples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """As ``bootstrap_ci``, but each row has a Poisson(1) weight, so a replicate's size varies, too."""
    return resampled(values, key, poisson_replicates, samples, level, seed)


def resampled(values: DataFrame, key: str, drawn, samples: int, level: float, seed: int) -> DataFrame:
    rows = kept(values.select(key, "eval_id", F.col("score").cast("double").alias("score")).where(F.col("score").isNotNull() & F.col(key).isNotNull()), "values")
    bounds = interval(drawn(rows, key, samples, seed), key, samples, level)
    sizes = rows.groupBy(key).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    return sizes.join(bounds, key).select(key, "mean", "low", "high", "n")


def binned_ci(values: DataFrame, key: str, samples: int, level: float, seed: int) -> DataFrame:
    """As ``bootstrap_ci`` by multinomial counts of at most 128 bins of values, whose means stand for them."""
    rows = values.select(key, "score").where(F.col("score").isNotNull())
    return interval(replicates(binned(rows, key), key, "multinomial", samples, seed), key, samples, level)


def permutation_test(current: DataFrame, previous: DataFrame, key: str = "metric", permutations: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """``key, delta, p_value, significant`` for keys that both samples have, by shuffling who belongs to which.

    A shuffle draws for every row; ``eval_id`` tells the rows of a key and sample apart.
    """
    both = current.select(key, "eval_id", "score", F.lit(1).alias("now")).unionByName(previous.select(key, "eval_id", "score", F.lit(0).alias("now"))).where(F.col("score").isNotNull() & F.col(key).isNotNull())
    both = kept(both.withColumn("score", F.col("score").cast("double")), "both")
    size = both.groupBy(key).agg(F.count_if(F.col("now") == 1).alias("nc"), F.count_if(F.col("now") == 0).alias("np"), F.sum("score").alias("total"), F.sum(F.when(F.col("now") == 1, F.col("score")).otherwise(0.0)).alias("sc"))
    size = kept(size.where("nc > 0 and np > 0").withColumn("delta", F.col("sc") / F.col("nc") - (F.col("total") - F.col("sc")) / F.col("np")), "sizes")
    shuffled = shuffled_sums(both, size.select(key, "nc", "np").collect(), key, permutations, seed)  # a row for each key
    tried = shuffled.join(size, key).withColumn("d", F.col("s") / F.col("nc") - (F.col("total") - F.col("s")) / F.col("np"))
    out = tried.groupBy(key).agg(F.first("delta").alias("delta"), ((F.count_if(F.abs("d") >= F.abs("delta") - 1e-12) + 1) / (permutations + 1)).alias("p_value"))
    return out.withColumn("significant", F.col("p_value") < alpha)


def delta_ci(current: DataFrame, previous: DataFrame, key: str = "metric", samples: int = 500, level: float = 0.95, seed: int = 42) -> DataFrame:
    """``key, ci_low, ci_high`` of the difference of means: the current bounds less the opposite previous ones."""
    c, p = binned_ci(current, key, samples, level, seed), binned_ci(previous, key, samples, level, seed)
    p = p.select(key, F.col("low").alias("plow"), F.col("high").alias("phigh"))
    return c.join(p, key).select(key, (F.col("low") - F.col("phigh")).alias("ci_low"), (F.col("high") - F.col("plow")).alias("ci_high"))


def significant_regressions(current: DataFrame, previous: DataFrame, permutations: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The permutation test with ``is_regression``: significant and downwards."""
    tested = permutation_test(current, previous, "metric", permutations, alpha, seed)
    return tested.withColumn("is_regression", F.col("significant") & (F.col("delta") < 0))


def regressions(current: DataFrame, previous: DataFrame, limit: float = 0.05) -> DataFrame:
    """``metric, current, previous, delta, is_regression`` of two tables of means (``metric, mean``)."""
    both = current.select("metric", F.col("mean").alias("current")).join(previous.select("metric", F.col("mean").alias("previous")), "metric")
    return both.withColumn("delta", F.col("current") - F.col("previous")).withColumn("is_regression", F.col("delta") < -limit)


def ppi_mean(everything: DataFrame, labelled: DataFrame, samples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """``point, ci_low, ci_high, n_labelled, n_total, naive``: the classifier's mean, moved by the labelled rows' bias.

    ``everything`` is ``eval_id, classifier``; ``labelled`` is ``eval_id, classifier, judge``.
    """
    bias = labelled.select(F.lit("all").alias("metric"), "eval_id", (F.col("judge") - F.col("classifier")).alias("score"))
    naive = everything.agg(F.avg("classifier").alias("naive"), F.count(F.lit(1)).alias("n_total")).withColumn("metric", F.lit("all"))
    both = naive.join(bootstrap_ci(bias, "metric", samples, level, seed), "metric")
    return both.select((F.col("naive") + F.col("mean")).alias("point"), (F.col("naive") + F.col("low")).alias("ci_low"), (F.col("naive") + F.col("high")).alias("ci_high"), F.col("n").alias("n_labelled"), "n_total", "naive")


def golden_pairs(scores: DataFrame, golden: DataFrame) -> DataFrame:
    """``metric, judge, human`` of scores (``qa_id, metric, score``) that a golden set (``qa_id, metric, human_score``) has."""
    both = scores.select("qa_id", "metric", F.col("score").alias("judge")).join(golden.select("qa_id", "metric", F.col("human_score").alias("human")), ["qa_id", "metric"])
    return both.select("metric", "judge", "human")


def meta_evaluation(pairs: DataFrame, key: str | None = None) -> DataFrame:
    """``n, mae, spearman, kappa`` of ``judge`` and ``human`` scores, for each ``key`` if given.

    Spearman's coefficient is 0 without variance; kappa over five bins is 1 where chance agrees fully.
    """
    by = [key] if key else []
    both = mid_ranks(mid_ranks(pairs.select(*by, "judge", "human"), "judge", "rj", key), "human", "rh", key)
    both = both.withColumn("bj", five_bins(F.col("judge"))).withColumn("bh", five_bins(F.col("human")))
    bins = range(5)
    sums = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("judge") - F.col("human"))).alias("mae"),
        F.when((F.stddev_pop("rj") > 0) & (F.stddev_pop("rh") > 0), F.corr("rj", "rh")).otherwise(0.0).alias("spearman"),
        F.avg((F.col("bj") == F.col("bh")).cast("double")).alias("po"),
        sum((F.avg((F.col("bj") == b).cast("double")) * F.avg((F.col("bh") == b).cast("double")) for b in bins), F.lit(0.0)).alias("pe"),
    )
    kappa = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0)
    return sums.select(*by, "n", "mae", F.coalesce("spearman", F.lit(0.0)).alias("spearman"), kappa.alias("kappa"))


def total_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``model, cost`` of judge calls (``model, tokens_in, tokens_out``)."""
    return calls.join(prices, "model", "left").groupBy("model").agg(F.sum(call_cost()).alias("cost"))


def call_cost():
    return token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))


def budgeted(calls: DataFrame, prices: DataFrame, order: list[str], budget: float) -> DataFrame:
    """Judge calls with ``cost``, ``spent`` before them and ``kept``: the breaker trips once for all tasks.

    Calls run in the order of columns until the budget is spent; the call that crosses it still runs. ``order``
    must tell calls apart.
    """
    priced = calls.join(prices, "model", "left").withColumn("cost", call_cost()).drop("price_in", "price_out")
    return within_budget(priced, order, F.col("cost"), budget)
