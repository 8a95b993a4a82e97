"""Fixity audit of WARC replicas with Merkle trees, in DataFrame functions.

Pages become WARC records, numbered and dealt to files in order; each replica
lays them out by its own record lengths.  The leaves of a replica's tree are
the hashes of its records; a node covers 16 ordered neighbours and hashes the
offset range of each within the node, and its hash, through the file's root up
to one root of the collection.  Ranges are relative to the node, so a record
that grew or shrank changes its own branch only.  An audit compares the roots
and descends only into branches that differ, down to the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from prefspark.llm.common import saved
from prefspark.llm.manifest import numbered

FANOUT_BITS = 4
#: records of a file, at most, and bits of a place in it (a whole number of levels)
FILE_RECORDS, FILE_BITS = 2048, 12


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes (as text) of a WARC response record; null reads as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def place_records(records: DataFrame) -> DataFrame:
    """Number rows by a hash of their columns and deal them to files of
    FILE_RECORDS: adds ``file``, ``slot`` (order in the file) and ``ordinal``.
    The numbers have no gaps, so no file takes more."""
    placed = numbered(records, [F.xxhash64(*records.columns)], "_place", "warc-places")
    file, slot = F.floor(F.col("_place") / FILE_RECORDS), F.pmod("_place", F.lit(FILE_RECORDS))
    placed = placed.withColumns({"file": file, "slot": slot, "ordinal": F.shiftleft(file, FILE_BITS) + slot})
    return saved(placed.drop("_place"), "warc-placed")


def with_offset(placed: DataFrame, length: str, name: str) -> DataFrame:
    """Add the byte offset of each record in its file, which holds
    FILE_RECORDS at most."""
    behind = F.sum(length).over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, behind - F.col(length))


def merkle_tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Levels 0 (the leaves) to ``levels`` (one root) as (node, bytes, hash)
    of rows (ordinal, length, hash).  A group has 16 rows at most."""
    level = leaves.select(F.col("ordinal").alias("node"), F.col("length").cast("long").alias("bytes"), "hash")
    out = [level]
    for k in range(levels):
        parts = F.array_sort(F.collect_list(F.struct("node", "bytes", "hash")))
        start = "aggregate(slice(parts, 1, i), 0L, (s, y) -> s + y.bytes)"
        text = F.expr(f"array_join(transform(parts, (x, i) -> concat_ws(':', {start}, {start} + x.bytes, x.hash)), '|')")
        level = level.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(F.sum("bytes").alias("bytes"), parts.alias("parts"))
        level = saved(level.select("node", "bytes", F.sha2(text, 256).alias("hash")), f"warc-level-{k + 1}")
        out.append(level)
    return out


def tree_levels(files: int) -> int:
    """Levels above the records for one root over ``files`` files."""
    levels, span = FILE_BITS // FANOUT_BITS, 1
    while span < files:
        levels, span = levels + 1, span << FANOUT_BITS
    return levels


def audit(a: DataFrame, b: DataFrame, files: int) -> DataFrame:
    """(ordinal) of the records that differ between two replicas or miss in
    one, each a table of its own records (ordinal, length, hash)."""
    levels = tree_levels(files)
    tree_a, tree_b = merkle_tree(a, levels), merkle_tree(b, levels)
    bad = None
    for x, y in zip(reversed(tree_a), reversed(tree_b)):
        if bad is not None:  # children of differing branches only
            x, y = (t.withColumn("parent", F.shiftright("node", FANOUT_BITS)).join(
                bad.withColumnRenamed("node", "parent"), "parent", "left_semi").drop("parent") for t in (x, y))
        y = y.select("node", *(F.col(c).alias(f"{c}_b") for c in ("bytes", "hash")))
        differ = ~(F.col("hash").eqNullSafe(F.col("hash_b")) & F.col("bytes").eqNullSafe(F.col("bytes_b")))
        bad = saved(x.join(y, "node", "full").where(differ).select("node"), "warc-differ")
    return bad.select(F.col("node").alias("ordinal"))


def fixity_audit(pages: DataFrame, replica_html: Column) -> DataFrame:
    """Audit a replica of ``pages`` (page_id, url, html) whose bodies are
    ``replica_html``: (page_id, n_bytes, record_sha256, damaged, file, offset,
    replica_bytes, replica_offset), one row per page, with each replica's own
    lengths and offsets.  Null pages and bodies are empty records; rows that
    share an id are records of their own.  An empty table gives no rows."""
    one = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    two = warc_record(F.col("page_id"), F.col("url"), replica_html)
    records = saved(pages.select("page_id", F.octet_length(one).cast("long").alias("length_a"), F.sha2(one, 256).alias("sha_a"),
                                 F.octet_length(two).cast("long").alias("length_b"), F.sha2(two, 256).alias("sha_b")), "warc-records")
    placed = place_records(records)
    files = placed.agg(F.coalesce(F.max("file"), F.lit(0)) + 1).first()[0]
    a, b = (placed.select("ordinal", F.col(f"length_{x}").alias("length"), F.col(f"sha_{x}").alias("hash")) for x in "ab")
    bad = audit(a, b, files).withColumn("damaged", F.lit(True))
    out = with_offset(with_offset(placed, "length_a", "offset"), "length_b", "replica_offset").join(bad, "ordinal", "left")
    return out.select("page_id", F.col("length_a").alias("n_bytes"), F.col("sha_a").alias("record_sha256"),
                      F.coalesce("damaged", F.lit(False)).alias("damaged"), "file", "offset", F.col("length_b").alias("replica_bytes"), "replica_offset")
