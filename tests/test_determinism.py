"""Chunked operators give the same rows whatever the partitioning (the chunk
count follows spark.sql.shuffle.partitions)."""

import pytest

import __spark_entry__ as E
from oracle_check import rows_of  # tools/ is on sys.path (conftest)

SF = "/root/testdata/sf0.001"
CHUNKED = ["w1_best_so_far", "w2_early_stop", "a10_records_by_algorithm", "k1_rank_feedback",
           "a24_quartiles", "k4_pareto_front", "s9_batches", "w7_discounted_returns", "w8_gae",
           "w14_curriculum_stage", "w9_moving_baseline", "f29_adaptive_kl"]


@pytest.mark.parametrize("name", CHUNKED)
def test_same_rows_for_any_partition_count(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows_of(E.queries()[name](spark, SF).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
