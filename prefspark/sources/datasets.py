"""Preference-dataset registry (short name -> location, format, columns) and
the mock sample source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetSpec:
    path: str                       # relative to the caller's data root, glob allowed
    fmt: str = "parquet"            # parquet | json | csv
    columns: dict = field(default_factory=dict)   # source column -> our name
    schema: str | None = None       # DDL; required for json/csv (no inference)


# Fixed names of the three preference datasets; files are read from a local
# or shared root (no network access).
REGISTRY: dict[str, DatasetSpec] = {
    "hh": DatasetSpec("hh/*.parquet", columns={"chosen": "chosen", "rejected": "rejected"}),
    "oasst": DatasetSpec("oasst/*.parquet", columns={"message_id": "id", "text": "text",
                                                     "parent_id": "parent_id", "role": "role"}),
    "ultrafeedback": DatasetSpec("ultrafeedback/*.parquet",
                                 columns={"prompt": "prompt", "chosen": "chosen", "rejected": "rejected"}),
}


def register_dataset(name: str, spec: DatasetSpec) -> None:
    REGISTRY[name] = spec


def load_dataset(spark: SparkSession, name: str, root: str) -> DataFrame:
    """Load a dataset by short name; an unknown name is an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(REGISTRY)}")
    spec = REGISTRY[name]
    path = f"{root.rstrip('/')}/{spec.path}"
    reader = spark.read
    if spec.schema:
        reader = reader.schema(spec.schema)
    if spec.fmt == "parquet":
        df = reader.parquet(path)
    elif spec.fmt == "json":
        df = reader.json(path)
    elif spec.fmt == "csv":
        df = reader.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {spec.fmt!r}")
    if spec.columns:
        df = df.select(*[F.col(src).alias(dst) for src, dst in spec.columns.items()])
    return df


def mock_samples(spark: SparkSession, n: int = 5) -> DataFrame:
    """Mock sample source: ``n`` short conversations with ``length`` = words
    and ``quality_score = 0.8 + 0.05 * i``."""
    base = spark.range(n).select(F.col("id").cast("int").alias("id"))
    text = F.concat(F.lit("Human: Sample question "), F.col("id").cast("string"),
                    F.lit("? Assistant: Sample answer "), F.col("id").cast("string"), F.lit("."))
    return base.select("id", text.alias("text"),
                       F.regexp_count(text, F.lit(r"\S+")).cast("int").alias("length"),
                       (F.lit(0.8) + F.lit(0.05) * F.col("id")).alias("quality_score"))
