"""Caller-supplied model hooks as Arrow-batched pandas UDFs.

The model is loaded once per task (iterator form) and scores a whole Arrow
batch at a time; everything around it stays in Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ModelLoader = Callable[[], Callable[[pd.Series], pd.Series]]


def length_reward_model() -> Callable[[pd.Series], pd.Series]:
    """Deterministic stand-in reward model: words / 100 (for tests)."""
    return lambda s: s.fillna("").str.split().str.len().astype("float64") / 100.0


def reward_model_udf(load: ModelLoader = length_reward_model):
    """Iterator ``pandas_udf`` (string -> double) around a model loader."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()                      # once per task
        for b in batches:
            yield model(b).astype("float64")

    return score


def model_reward(text: str | Column, load: ModelLoader = length_reward_model) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return reward_model_udf(load)(c)
