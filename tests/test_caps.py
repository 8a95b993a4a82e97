"""The caps of the preparation queries on tables larger than they are."""

import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

ROWS = 12_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of 12 words; every 40th repeats the text of the one before."""
    out = str(tmp_path_factory.mktemp("caps"))
    spark.range(ROWS).selectExpr(
        "id AS doc_id", "concat_ws(' ', array_repeat('w', 11), id - int(id % 40 = 39)) AS text", "'en' AS lang",
        "concat('s', id % 3) AS source", "0L AS n_chars").write.parquet(f"{out}/documents.parquet")
    return out


def ids(spark, folder, name):
    return sorted(r["id"] for r in E.queries()[name](spark, folder).collect())


def test_prepare_samples_keeps_5000(spark, folder):
    assert ids(spark, folder, "p2_prepare_samples") == [i for i in range(ROWS) if i % 40 != 39][:5000]


def test_cap_first_keeps_5000(spark, folder):
    assert ids(spark, folder, "k2_cap_first") == list(range(5000))


def test_eval_subset_keeps_1000(spark, folder):
    held = [i for i in range(ROWS) if hashlib.md5(str(i).encode()).hexdigest()[:2] < "1a"]
    assert len(held) > 1000
    assert ids(spark, folder, "k6_eval_subset") == held[:1000]
