"""Sharding by extendible hashing.

A directory indexed by the first bits of a row's hash points to shards; only a
shard over its byte limit is split on its next bit, until each shard fits (or
is a single row).  Bits come from the md5 of the key; behind its 60 bits
follow 60 bits of a hash of the row, so rows with equal keys, however many,
split as well.  The directory grows by ``ROUND_BITS`` bits at a time: one
aggregate by cell gives the sizes of all prefixes, and only cells that still
overflow go to the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import saved

SHARD_BYTES = 1 << 20
KEY_BITS = 60
ROUND_BITS = 12


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, key_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, shard, depth) and the columns ``carry`` for every row: ``shard`` is the bit
    prefix of the shard, ``depth`` its length (0: one shard holds all).

    ``n_bytes`` are the UTF-8 bytes of the text (0 if null).  A row over the
    limit is a shard of its own.  Equal or null keys are spread by row.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    code = F.lpad(F.bin(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")), KEY_BITS, "0")
    more = F.lpad(F.bin(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << KEY_BITS) - 1))), KEY_BITS, "0")
    rows = saved(docs.select(F.col(key_col).alias("doc_id"),
                             F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
                             F.concat(code, more).alias("code"), *carry), "shard-rows")
    done, start = None, 0
    while True:
        end = start + ROUND_BITS
        rows = rows.withColumn("cell", F.substring("code", 1, end))
        cells = saved(rows.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")), "shard-cells")
        low = 0 if start == 0 else start + 1
        walk = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(end))))
        walk = walk.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
        fits = walk.groupBy("prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).where(
            (F.col("b") <= limit) | (F.col("n") == 1)).select("prefix")
        directory = saved(walk.join(fits, "prefix").groupBy("cell").agg(F.min("depth").alias("depth")), "shard-directory")
        placed = rows.join(directory, "cell").select("doc_id", "n_bytes", F.expr("substring(cell, 1, depth)").alias("shard"), "depth", *carry)
        done = placed if done is None else done.union(placed)
        left = cells.join(directory, "cell", "left_anti")
        if end >= 2 * KEY_BITS or left.isEmpty():
            return done
        rows = saved(rows.join(left.select("cell"), "cell", "left_semi").drop("cell"), "shard-rows")
        start = end


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one folder per shard (``shard=<bits>``).  Every row
    goes to its own shard, so equal keys keep the limit as well."""
    rows = saved(docs.drop("shard").withColumn("_row", F.monotonically_increasing_id()), "shard-docs")  # the folder takes the name
    place = assign_shards(rows, limit, key_col, text_col, ("_row",)).select("_row", F.concat(F.lit("b"), "shard").alias("shard"))
    rows.join(place, "_row").drop("_row").repartition("shard").write.partitionBy("shard").parquet(path)
