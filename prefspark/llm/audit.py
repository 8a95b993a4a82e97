"""Filter interaction audit: what each of several filters removes, alone, after
others and on average over all orders.

Exact constrained least squares.  One pass gives every row the set of filters
that it fails; rows are counted per (part, set).  From at most ``2^k`` counts
per part follow the removals of all ``2^k`` coalitions of filters, and

* the removal of a filter after others is a difference of two coalitions;
* its Shapley value is the solution of the kernel-weighted least squares
  ``min sum_S w(S) (v(S) - sum_{i in S} phi_i)^2`` under the efficiency
  constraint ``sum phi = v(all)``, ``w(S) = (k-1) / (C(k,|S|) |S| (k-|S|))``.
  The normal equations with their multiplier are solved once in rationals; a
  part's values are one exact product with its coalition counts.

Only the counts are ever gathered, one small row per part.  Texts are read
once, in pieces of bounded size; equal texts meet by their SHA-256 through a
partial aggregate, so a hot group of copies never gathers in one task.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import SLICE_BYTES, column, record_batch, saved, task

FILTERS = "ABCDE"
#: fixed values of the filters' conditions
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
_CAPITALS = bytes(range(0x41, 0x5B))
_FOLLOWING = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point
_MARK = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_FLAGS = pa.schema([("flags", pa.int32()), ("digest", pa.binary())])


def _word_counts(text: bytes, size: int = SLICE_BYTES) -> tuple[int, int]:
    """(words, distinct words); a text over ``size`` bytes goes piece by piece,
    cut at white space, and keeps 8 bytes per distinct word."""
    if len(text) <= size:
        words = text.split()  # of bytes: exactly 0x20 and 0x09-0x0D separate
        return len(words), len(set(words))
    n, seen, at = 0, np.zeros(0, np.uint64), 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, set(words)), np.uint64)
        seen = np.union1d(seen, hashes)
        at = end
    return n, len(seen)


def text_flags(text: bytes) -> int:
    """Bits 0 to 3: the text fails filter A, B, C, D."""
    words, distinct = _word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _FOLLOWING))
    return ((words < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * words) << 1
            | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (_MARK.search(text) is not None) << 3)


@task
def _flag(batches):
    for batch in batches:
        out = []
        for text in batch.column(batch.schema.get_field_index("text")):
            data = text.as_buffer().to_pybytes()
            out.append((text_flags(data), hashlib.sha256(data).digest()))
        made = record_batch(_FLAGS, out)
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part")]
        yield pa.RecordBatch.from_arrays([*kept, *made.columns], names=["doc_id", "part", *_FLAGS.names])


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the rows of each part by the set of
    filters that they fail (bit i of ``mask``: filter i of A to E), and how
    many of them are labelled good or toxic.

    A null text reads as empty, a null part as the empty string.  E (the text
    of a smaller id) compares ids, so rows with one id don't fail by each
    other, and rows without an id neither fail E nor make others fail.  A row
    counts as good or toxic when any row of ``labels`` with its id says
    quality 1 or toxic 1.

    Equal texts are counted per (text, part, other failures, labels) before
    they meet, so the rows that meet at one text are few however often it is
    copied."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    flagged = saved(base.mapInArrow(_flag, "doc_id long, part string, flags int, digest binary"), "audit-flags")
    said = (labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id")
            .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                 F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")))
    kind = ["digest", "part", "flags"]
    named = flagged.where("doc_id is not null").groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    named = named.join(said, "doc_id", "left").select(*kind, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
                                                      "doc_id", "n")
    nameless = flagged.where("doc_id is null").groupBy("part", "flags").agg(F.count("*").alias("n"))
    # per kind of row of a text: all of them, and those of the smallest id
    kinds = named.groupBy(*kind, "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("firsts", F.when(F.col("low.doc_id") == first, F.col("low.n")).otherwise(0))
    split = kinds.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("flags").alias("mask"), F.col("firsts").alias("n")),
        F.struct(F.col("flags").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("c"))
    rows = split.select("part", "c.mask", "c.n", "good", "toxic").union(nameless.select("part", "flags", "n", F.lit(0), F.lit(0)))
    return rows.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                                           F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _kernel(k: int) -> tuple[list[int], list[Fraction]]:
    """The proper coalitions and their weights."""
    sets = [s for s in range(1, (1 << k) - 1)]
    return sets, [Fraction(k - 1, math.comb(k, s.bit_count()) * s.bit_count() * (k - s.bit_count())) for s in sets]


def _inverse(m: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan in rationals."""
    n = len(m)
    a = [row + [Fraction(i == j) for j in range(n)] for i, row in enumerate(m)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if a[r][i])
        a[i], a[pivot] = a[pivot], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i and a[r][i]:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i])]
    return [row[n:] for row in a]


def shapley_solver(k: int):
    """A function from the ``2^k`` coalition values to the ``k`` Shapley
    values, by the constrained normal equations (solved here, once)."""
    if k == 1:
        return lambda v: [Fraction(v[1])]
    sets, weight = _kernel(k)
    kkt = [[2 * sum((w for s, w in zip(sets, weight) if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(k)] + [Fraction(1)]
           for i in range(k)] + [[Fraction(1)] * k + [Fraction(0)]]
    inverse = _inverse(kkt)

    def solve(v) -> list[Fraction]:
        right = [2 * sum((w * v[s] for s, w in zip(sets, weight) if s >> i & 1), Fraction(0)) for i in range(k)] + [Fraction(v[-1])]
        return [sum((x * y for x, y in zip(row, right)), Fraction(0)) for row in inverse[:k]]
    return solve


def coalitions(counts: dict[int, int], k: int) -> list[int]:
    """Rows removed by each set of filters: those failing any of them."""
    return [sum(c for mask, c in counts.items() if mask & s) for s in range(1 << k)]


def audit_rows(total: int, counts: dict[int, int], good: dict[int, int], toxic: dict[int, int], letters: str, solve) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of every order of the filters and every step."""
    k = len(letters)
    v, vg, vt = (coalitions(c, k) for c in (counts, good, toxic))
    orders = math.factorial(k)
    shapley = [phi * orders for phi in solve(v)]
    out = []
    for order in itertools.permutations(range(k)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after, full = before | 1 << i, len(v) - 1
            out.append((name, step, total - v[after], v[after] - v[before], v[1 << i] + v[before] - v[after], v[full] - v[full & ~(1 << i)],
                        vg[after] - vg[before], vt[after] - vt[before], int(shapley[i])))
            before = after
    return out


_AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
                   + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])
_AUDIT_SQL = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
              "good_lost long, toxic_lost long, shapley long")


def _orders(batches, letters: str):
    solve = shapley_solver(len(letters))
    for batch in batches:
        for part, cells in zip(column(batch, "part"), column(batch, "cells")):
            n, good, toxic = ({c["mask"]: c[x] for c in cells} for x in ("n", "good", "toxic"))
            rows = audit_rows(sum(n.values()), n, good, toxic, letters, solve)
            yield record_batch(_AUDIT, [(part, *r) for r in rows])


def interaction_audit(counted: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The audit of counts (part, mask, n, good, toxic), see :func:`cells`:
    per part, order of the filters and step the rows ``kept`` after it and
    ``removed`` by it, those failing its filter but removed before
    (``redundant``) or failing its filter only (``unique_fails``), the
    labelled rows it removes, and the sum over all orders of what its filter
    removes (``shapley``).  An empty table has no parts and gives no rows."""
    # at most 2^k cells a part
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(lambda it: _orders(it, letters), _AUDIT_SQL)
