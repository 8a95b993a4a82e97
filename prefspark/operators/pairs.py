"""AI-feedback scoring and preference-pair synthesis."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.plans.scan import Running, row_index, running
from prefspark.session import tune
from prefspark.functions.text import (feedback_prompt, first_int_score, multi_objective_reward,
                                      quality_metrics)

# Fixed default objective weights of the multi-objective setting.
DEFAULT_WEIGHTS = {"helpfulness": 0.7, "harmlessness": 0.3}


def score_responses(df: DataFrame, response: str = "response", weights: dict | None = None,
                    harmlessness: str | None = None, truthfulness: str | None = None,
                    out: str = "score") -> DataFrame:
    """Attach the quality-metric map and the weighted multi-objective score."""
    w = DEFAULT_WEIGHTS if weights is None else weights
    return (df.withColumn("quality_metrics", quality_metrics(response, harmlessness, truthfulness))
              .withColumn(out, multi_objective_reward("quality_metrics", w)))


def preference_pairs(df: DataFrame, prompt: str = "prompt", idx: str = "resp_idx",
                     response: str = "response", score: str = "score") -> DataFrame:
    """Per prompt with at least two responses: chosen = highest score, rejected =
    lowest score.  Ties follow a stable descending sort: the chosen one is the
    lowest index among the best, the rejected one the highest index among the
    worst.

    One ``groupBy`` with ``max_by``/``min_by`` (partial aggregation map-side;
    no ranking of the responses and no window), so a prompt with a huge
    fan-out is not one task.
    """
    order_key = F.struct(F.col(score).alias("s"), (-F.col(idx)).alias("i"))
    payload = F.struct(F.col(response).alias("r"), F.col(score).alias("s"))
    # (64-bit hash, prompt): prompts are long texts; the sort-based aggregate
    # then orders by the hash and compares whole prompts only on equal hashes
    g = df.groupBy(F.xxhash64(prompt).alias("__h"), prompt).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max_by(payload, order_key).alias("__best"),
        F.min_by(payload, order_key).alias("__worst"))
    return g.filter(F.col("__n") >= 2).select(
        prompt, F.col("__best.r").alias("chosen"), F.col("__worst.r").alias("rejected"),
        F.col("__best.s").alias("chosen_score"), F.col("__worst.s").alias("rejected_score"))


def rank_feedback(df: DataFrame, prompt: str = "prompt", idx: str = "resp_idx",
                  score: str = "score", out: str = "rank") -> DataFrame:
    """Full stable descending rank of the responses of each prompt (1 = best,
    ties by response index); scores must be non-NULL.

    rank = 1 + (responses with a higher score) + (position among equal scores
    by index).  The first term runs over counts per distinct score, the
    second over indexes within one score, both with the skew-safe scan, so
    neither a prompt with a huge fan-out nor a score shared by most of its
    responses is one task.
    """
    counts = df.groupBy(prompt, score).agg(F.count(F.lit(1)).alias("__c"))
    above = running(counts.withColumn("__neg", -F.col(score)), [prompt], ["__neg"],
                    {"__above": Running("sum", "__c", inclusive=False)})
    within = row_index(df, [prompt, score], [idx], "__w")
    r = within.join(above.select(prompt, score, "__above"), [prompt, score])
    return (r.withColumn(out, (F.coalesce("__above", F.lit(0)) + F.col("__w") + 1).cast("int"))
             .drop("__above", "__w"))


def objective_balance(weights: DataFrame, group: list[str], weight: str = "weight") -> DataFrame:
    """``clamp(1 - std_pop(w)/mean(w), 0, 1)`` per group; 1.0 when a group has
    no weights (all NULL)."""
    bal = F.lit(1.0) - F.try_divide(F.stddev_pop(weight), F.avg(weight))
    # greatest/least skip NULLs, so test for "no weights" before clamping
    return weights.groupBy(*group).agg(
        F.when(bal.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), bal)))
        .alias("balance"))


def attach_feedback(responses: DataFrame, feedback: DataFrame,
                    keys=("prompt", "resp_idx")) -> DataFrame:
    """Join judge feedback to its response on ``(prompt, resp_idx)``."""
    return responses.join(feedback, on=list(keys), how="inner")


# ------------------------------------------------------------ judge hooks
def release() -> None:
    """Give freed memory of this Python worker back to the system; workers
    live on from batch to batch and task to task and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back by hand


JudgeFn = Callable[[pd.Series], pd.Series]


def stub_judge(prompts: pd.Series) -> pd.Series:
    """Deterministic test judge: replies with a score derived from length."""
    return prompts.str.len().mod(10).add(1).map(lambda s: f"Score: {s}/10. Brief feedback.")


def ai_feedback(df: DataFrame, judge: JudgeFn = stub_judge, response: str = "response",
                clamp: bool = False) -> DataFrame:
    """Run a caller-supplied batch judge over every response (``mapInPandas``:
    one Arrow batch of at most some megabytes at a time, the judge is loaded
    once per task) and parse its score; the metric map and score parsing stay
    JVM-side, and prompts aren't sent back."""
    tune(df.sparkSession)
    with_prompt = df.withColumn("__judge_prompt", feedback_prompt(response))
    schema = T.StructType(df.schema.fields + [T.StructField("feedback", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["feedback"] = judge(b.pop("__judge_prompt")).astype(object)
            yield b
            del b  # before the next batch comes
            release()

    judged = with_prompt.mapInPandas(run, schema)
    return (judged.withColumn("ai_score", first_int_score("feedback", clamp=clamp))
                  .withColumn("quality_metrics", quality_metrics(response)))


def fan_out(prompts: DataFrame, n: int, out: str = "resp_idx") -> DataFrame:
    """``n`` generation slots per prompt (the caller's model fills them)."""
    return prompts.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
