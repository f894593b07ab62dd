"""The boundary to judges: prompts go out, raw answers come back, and Spark reads the scores.

Answers may be recorded in a table (``qa_id, metric, sample, raw``) or come from a provider, any picklable object
with ``complete(prompts) -> list[str]`` that is called inside tasks. Whatever can't be read as a score becomes a
row with score 0 and a parse error as its reasoning.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglens.operators.ordered import within_budget

ANCHORS = "Scale: 1.0 fully right and grounded, 0.5 partly, 0.0 wrong, off the point or made up.\n"
PLAIN = "\nJudge content and grounds alone; length and style earn nothing."
PARTS = ("Metric", "Question", "Contexts", "Answer")
# What in an error's name, or which status, says that the call may succeed when tried again.
TRANSIENT = ("ratelimit", "timeout", "apiconnection", "internalserver", "serviceunavailable")
STATUSES = (408, 409, 429, 500, 502, 503, 504)


class Provider(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str]: ...

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def transient(error: BaseException) -> bool:
    status = getattr(error, "status_code", None) or getattr(error, "status", None)
    return status in STATUSES or any(x in type(error).__name__.lower() for x in TRANSIENT)


def read_scores(answers: DataFrame, failed: str = "zero") -> DataFrame:
    """Replaces ``raw`` by ``score, reasoning``: those of a JSON object.

    What can't be read has score 0 and a parse error (``zero``), has no row (``drop``, as calibration wants it),
    or has neither score nor reasoning (``null``, for judges with defaults of their own).
    """
    if failed not in ("zero", "drop", "null"):
        raise ValueError(f"unknown rule: {failed}")
    found = F.from_json("raw", "score string, reasoning string, bad string", {"columnNameOfCorruptRecord": "bad"})
    rows = answers.withColumn("found", found)
    score = F.when(F.col("found.bad").isNull(), F.expr("try_cast(found.score as double)"))
    said = F.coalesce("found.reasoning", F.lit(""))
    if failed != "zero":
        read = rows.withColumns({"score": score, "reasoning": F.when(score.isNotNull(), said)}).drop("found", "raw")
        return read.where("score is not null") if failed == "drop" else read
    error = F.concat(F.lit("Parse error: "), F.substring(F.coalesce("raw", F.lit("no answer")), 1, 80))
    return rows.withColumns({"score": F.coalesce(score, F.lit(0.0)), "reasoning": F.when(score.isNull(), error).otherwise(said)}).drop("found", "raw")


def requests(pairs: DataFrame, metrics: Sequence[str], samples: int = 1) -> DataFrame:
    """``qa_id, metric, sample`` for each pair."""
    each = pairs.select("qa_id", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    return each.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def recorded(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """``qa_id, metric, sample, score, reasoning`` of requests, from a table of answers."""
    return read_scores(asked.select("qa_id", "metric", "sample").join(answers.select("qa_id", "metric", "sample", "raw"), ["qa_id", "metric", "sample"], "left"))


def part(name: str, text: Column) -> Column:
    """A marked part; marks within the text lose their bracket, so that it ends no part early."""
    marks = "|".join(PARTS)
    return F.concat(F.lit(f"<{name}>"), F.regexp_replace(F.coalesce(text, F.lit("")), f"<(/?(?:{marks})>)", "&lt;$1"), F.lit(f"</{name}>"))


def prompt_for(pairs: DataFrame, anchors: bool = True, length_note: bool = True) -> Column:
    """A prompt column: metric, question, contexts (empty if the pairs have none) and answer in marked parts,
    anchors of the scale ahead and the note on length behind."""
    contexts = F.col("contexts_text") if "contexts_text" in pairs.columns else F.lit("")
    body = F.concat_ws("\n", *(part(n, x) for n, x in zip(PARTS, (F.col("metric"), F.col("question"), contexts, F.col("answer")), strict=True)))
    return F.concat(*([F.lit(ANCHORS)] if anchors else []), body, *([F.lit(PLAIN)] if length_note else []))


def with_opinions(prompt: Column, opinions: Column, most: int = 120) -> Column:
    """The prompt for a final verdict: ``opinions`` (structs ``provider, score, reasoning``) are listed behind it."""
    line = lambda o: F.concat(F.lit("- "), o["provider"], F.lit(": "), F.format_number(o["score"], 2), F.lit(" ("), F.substring(F.coalesce(o["reasoning"], F.lit("")), 1, most), F.lit(")"))
    return F.concat(prompt, F.lit("\n\nOther judges disagree. Weigh their opinions and give the final verdict.\n"), F.array_join(F.transform(opinions, line), "\n"))


def tried(call, items: list, retries: int, wait: float) -> list:
    """The call's results; None for each item where it fails for good. Passing errors are tried again with growing waits."""
    for turn in range(retries + 1):
        try:
            return list(call(items))
        except Exception as error:  # noqa: BLE001 - a provider may fail in any way
            if not transient(error):
                break
            if turn < retries:
                time.sleep(wait * 2**turn)
    return [None] * len(items)


def embedded(texts: DataFrame, id_col: str, text_col: str, provider: Provider, batch: int = 64, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """``id_col, v``: a provider's vectors of texts, a batch at a time within tasks; null where it failed."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                rows = frame.iloc[at : at + batch]
                found = tried(provider.embed, rows["text"].tolist(), retries, wait)
                yield pd.DataFrame({id_col: rows[id_col].tolist(), "v": found})

    return texts.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, f"{id_col} {kind}, v array<double>")


def judged(pairs: DataFrame, provider: Provider, metrics: Sequence[str], samples: int = 1, batch: int = 64, retries: int = 3, wait: float = 1.0, budget: int | None = None) -> DataFrame:
    """``qa_id, metric, sample, score, reasoning, tokens`` for each pair, metric and sample.

    A batch that fails for a passing reason is tried again with growing waits, then recorded as failed; other
    errors are recorded at once. ``budget`` bounds the prompts' words over all tasks, in order of pair, metric
    and sample; what lies beyond is recorded as skipped, so that no row is lost.
    """
    each = requests(pairs, metrics, samples).join(pairs, "qa_id").withColumn("prompt", prompt_for(pairs))
    each = each.select("qa_id", "metric", "sample", "prompt", F.size(F.split(F.trim("prompt"), r"\s+")).cast("long").alias("tokens"))
    skipped = None
    if budget is not None:
        cut = within_budget(each, ["qa_id", "metric", "sample"], F.col("tokens"), budget, scale=1)
        each, skipped = cut.where("kept").drop("spent", "kept"), cut.where("not kept").select("qa_id", "metric", "sample")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                rows = frame.iloc[at : at + batch]
                yield rows.assign(raw=tried(provider.complete, rows["prompt"].tolist(), retries, wait)).drop(columns="prompt")

    kind = pairs.schema["qa_id"].dataType.simpleString()
    out = read_scores(each.mapInPandas(run, f"qa_id {kind}, metric string, sample int, tokens long, raw string"))
    if skipped is not None:
        out = out.unionByName(skipped.withColumns({"tokens": F.lit(0).cast("long"), "score": F.lit(0.0), "reasoning": F.lit("Parse error: over budget")}))
    return out.select("qa_id", "metric", "sample", "score", "reasoning", "tokens")
