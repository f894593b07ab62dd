"""Which evaluator scores which pair and metric, the evaluators over recorded judgements, and a second pass over doubtful scores.

Work is ``qa_id, metric, plan_id, has_retrieval``; a plan is a row of switches. Each evaluator reads the
judgements of its own rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglens.operators.scoring import claim_faithfulness, claim_list, collapsed, ensembles, escalated, expected_score, in_order, mean_of, nugget_recall

KEYS = ["qa_id", "metric"]
OUT = [*KEYS, "evaluator", "score", "confidence", "is_low_confidence"]
#: A plan's switches.
SWITCHES = ("nugget", "claims", "ensemble", "calibration", "routing")
# The named methods and the switches that they turn on.
METHODS = {"quick": (), "high_trust": ("calibration", "ensemble", "claims"), "retrieval_diagnosis": ("nugget",), "safety_audit": ("claims",)}


@dataclass(frozen=True)
class Judgements:
    """What judges said, by ``qa_id`` (and ``metric``): ``claims``: claims; ``verdicts``: claim, verdict, place;
    ``nuggets``: nuggets; ``matches``: nugget, found, place; ``providers``: provider, score; ``tokens``: token, prob
    (both with a place, if sums should follow it);
    ``samples`` and ``extra``: sample, score, reasoning (with a place, if deviations should follow it)."""

    claims: DataFrame
    verdicts: DataFrame
    nuggets: DataFrame
    matches: DataFrame
    providers: DataFrame
    tokens: DataFrame
    samples: DataFrame
    extra: DataFrame


def method_plans(spark: SparkSession) -> DataFrame:
    """A plan for each named method, by its name."""
    rows = [(name, *(s in on for s in SWITCHES)) for name, on in METHODS.items()]
    return spark.createDataFrame(rows, "plan_id string, " + ", ".join(f"{s} boolean" for s in SWITCHES))


def active(plans: DataFrame) -> DataFrame:
    """``plan_id, active``: the names of the switches that are on."""
    return plans.select("plan_id", F.array_compact(F.array(*(F.when(F.col(s), F.lit(s)) for s in SWITCHES))).alias("active"))


def routed(work: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds ``evaluator`` and ``routing``: nuggets for recall with a retrieval, claims for faithfulness, then the plan's
    ensemble or calibration, else repeated samples. Work without a plan is sampled."""
    on = lambda name: F.coalesce(F.col(name), F.lit(False))
    kind = F.when((F.col("metric") == "context_recall") & on("nugget") & on("has_retrieval"), "nugget").when((F.col("metric") == "faithfulness") & on("claims"), "claims")
    kind = kind.when(on("ensemble"), "ensemble").when(on("calibration"), "calibration").otherwise("samples")
    return work.join(plans, "plan_id", "left").select(*KEYS, kind.alias("evaluator"), on("routing").alias("routing"))


def sure(score: Column) -> list[Column]:
    return [score.alias("score"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_low_confidence")]


def calibrated(rows: DataFrame, tokens: DataFrame, samples: DataFrame) -> DataFrame:
    """Expected scores of tokens; where no token is a score, the mean of the samples that could be read, or 0."""
    by = rows.join(expected_score(tokens, *KEYS).withColumnRenamed("score", "expected"), KEYS, "left")
    read = samples.where(F.col("reasoning").isNotNull() & (F.col("reasoning") != "") & ~F.col("reasoning").startswith("Parse error"))
    means = read.groupBy(*KEYS).agg(in_order("score", "sample").alias("scores")).select(*KEYS, mean_of(F.col("scores")).alias("mean"))
    return by.join(means, KEYS, "left").select(*KEYS, *sure(F.coalesce("expected", "mean", F.lit(0.0))))


def first_pass(work: DataFrame, said: Judgements) -> DataFrame:
    """Routed work with ``score, confidence, is_low_confidence``; null where nothing was recorded."""

    def mine(kind: str, table: DataFrame, keys: list[str]) -> DataFrame:
        return table.join(work.where(F.col("evaluator") == kind).select(*keys).distinct(), keys, "left_semi")

    claims = mine("claims", said.claims, ["qa_id"]).withColumn("claims", claim_list(F.col("claims")))
    by_claim = claim_faithfulness(claims, mine("claims", said.verdicts, ["qa_id"]), "qa_id").select("qa_id", F.lit("faithfulness").alias("metric"), *sure(F.col("score")))
    by_nugget = nugget_recall(mine("nugget", said.nuggets, ["qa_id"]), mine("nugget", said.matches, ["qa_id"]), "qa_id").select("qa_id", F.lit("context_recall").alias("metric"), *sure(F.col("score")))
    scores = ["score", "confidence", "is_low_confidence"]
    by_provider = ensembles(mine("ensemble", said.providers, KEYS), *KEYS).select(*KEYS, *scores)
    rows = work.where("evaluator = 'calibration'").select(*KEYS)
    by_token = calibrated(rows, mine("calibration", said.tokens, KEYS), mine("calibration", said.samples, KEYS))
    by_sample = collapsed(mine("samples", said.samples, KEYS), *KEYS).select(*KEYS, *scores)
    found = {"claims": by_claim, "nugget": by_nugget, "ensemble": by_provider, "calibration": by_token, "samples": by_sample}
    every = None
    for kind, table in found.items():
        named = table.withColumn("evaluator", F.lit(kind))
        every = named if every is None else every.unionByName(named)
    return work.join(every, [*KEYS, "evaluator"], "left").select(*OUT, "routing")


def dispatched(work: DataFrame, plans: DataFrame, said: Judgements) -> DataFrame:
    """``qa_id, metric, evaluator, score, confidence, is_low_confidence, escalated`` of all work.

    Doubtful scores of plans with routing are judged again from ``extra`` samples, which replace what was said
    first; an ensemble has settled its doubts itself.
    """
    first = first_pass(routed(work, plans), said)
    again = first.where(F.col("routing") & F.col("is_low_confidence") & (F.col("evaluator") != "ensemble")).select(*KEYS)
    second = collapsed(said.extra.join(again, KEYS, "left_semi"), *KEYS).select(*KEYS, "score", "confidence", "is_low_confidence")
    second = second.join(first.select(*KEYS, "evaluator"), KEYS)
    kept = first.where(F.col("routing") & (F.col("evaluator") != "ensemble")).select(*OUT)
    rest = first.where(~F.col("routing") | (F.col("evaluator") == "ensemble")).select(*OUT).withColumn("escalated", F.lit(False))
    return escalated(kept, second, *KEYS).unionByName(rest)
