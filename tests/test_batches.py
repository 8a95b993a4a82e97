"""Arrow batches to Python workers are bounded by bytes."""

import pandas as pd
from pyspark.sql import functions as F

from prefspark.operators import pairs

ROWS, WORDS = 4_000, 1_000


def long_texts(spark):
    """One task with 20 MB of texts."""
    return spark.range(0, ROWS, 1, 1).select(F.col("id"), F.expr(f"repeat('word ', {WORDS})").alias("response"))


def batch_chars():
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([f"Score: 7/10, {texts.str.len().sum()}"] * len(texts))
    return judge


def test_judge_gets_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    out = pairs.ai_feedback(long_texts(spark), judge=batch_chars())
    assert out.columns == ["id", "response", "feedback", "ai_score", "quality_metrics"]
    rows = out.select("id", F.length("response").alias("n"), "feedback", "ai_score").collect()
    assert sorted(r["id"] for r in rows) == list(range(ROWS))
    assert {r["n"] for r in rows} == {5 * WORDS} and {r["ai_score"] for r in rows} == {0.7}
    assert max(int(r["feedback"].split(", ")[1]) for r in rows) <= 2 << 20


def test_caller_keeps_its_own_limit(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    try:
        out = pairs.ai_feedback(long_texts(spark), judge=batch_chars()).select("feedback").distinct().collect()
        assert max(int(r["feedback"].split(", ")[1]) for r in out) <= 1 << 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
