"""The first ``n`` rows of every group, however large a group is.

``row_number() <= n`` alone sends the ``n`` best rows of every map task to the
one task of a hot group.  Here a uniform sample of the keys proposes a few
bounds per group, each expected to leave a little more than ``n`` rows; one
pass counts exactly how many rows each bound leaves; the tightest bound that
leaves ``n`` rows or more filters the rows where they are read, and only the
rest is ranked.  A group without such a bound is ranked whole, so the result
is exact whatever the sample holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.plans.scan import sampled_rows

#: keys in the sample: also the most groups that can get a bound, which bounds
#: the size of the broadcasts below
SAMPLE = 1 << 16
#: by how many standard deviations a bound's expected rows exceed ``n``
MARGINS = (0, 1, 3, 6)


def _bounds(rows: DataFrame, n: int, largest: bool, sample: int) -> DataFrame:
    """(__g, __t0 ...): the proposed bounds of the groups in the sample."""
    few = sampled_rows(rows, ["__g", "__k"], sample)
    # a sample that isn't full holds all rows
    whole = few.agg(F.collect_list(F.struct("__g", "__k")).alias("rows"),
                    F.when(F.count("*") < sample, F.lit(1.0)).otherwise(F.max("__u")).alias("rate"))
    keys = whole.select(F.explode("rows").alias("r"), "rate").groupBy(F.col("r.__g").alias("__g")).agg(
        F.sort_array(F.collect_list("r.__k"), asc=not largest).alias("keys"), F.first("rate").alias("rate"))
    mean = F.col("rate") * F.lit(float(n))
    place = [F.ceil(mean + c * F.sqrt(mean) * (F.col("rate") < 1).cast("int") + c * c * (F.col("rate") < 1).cast("int")).cast("int") for c in MARGINS]
    return keys.select("__g", *[F.get("keys", F.greatest(p, F.lit(1)) - 1).alias(f"__t{i}") for i, p in enumerate(place)])


def top_n(df: DataFrame, by: list[str], key: Column, n: int, largest: bool = False, sample: int = SAMPLE) -> DataFrame:
    """The ``n`` rows of each group (columns ``by``; nulls are a group) with
    the smallest or ``largest`` ``key``, a struct that tells the rows of a
    group apart; nulls order first, as in a sort."""
    if n <= 0:
        return df.limit(0)
    rows = df.withColumns({"__g": F.struct(*by) if by else F.lit(0), "__k": key})
    proposed = F.broadcast(_bounds(rows.select("__g", "__k"), n, largest, sample))

    def within(bound):
        return F.col("__k") >= F.col(bound) if largest else F.col("__k") <= F.col(bound)
    names = [f"__t{i}" for i in range(len(MARGINS))]
    counted = rows.select("__g", "__k").join(proposed, "__g").groupBy("__g", *names).agg(
        *[F.count(F.when(within(t), 1)).alias(f"__n{t}") for t in names])
    tight = F.coalesce(*[F.when(F.col(f"__n{t}") >= n, F.col(t)) for t in names])
    chosen = counted.select("__g", tight.alias("__bound")).where("__bound is not null")
    left = rows.join(F.broadcast(chosen), "__g", "left").where(F.col("__bound").isNull() | within("__bound"))
    order = F.col("__k").desc() if largest else F.col("__k")
    ranked = left.withColumn("__rank", F.row_number().over(Window.partitionBy("__g").orderBy(order)))
    return ranked.where(F.col("__rank") <= n).select(*[F.col(f"`{c}`") for c in df.columns])
