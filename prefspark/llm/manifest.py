"""Merkle dataset manifest in Van Emde Boas layout.

Every row is a leaf; the leaves of a group, in order, are folded three by
three (the last run may be shorter, even one node) until one node, the
group's subroot, remains; the subroots of all groups are folded alike into
the root.

Layout.  A tree is cut into aligned subtrees of ``HEIGHT`` levels.  A subtree
is one row of the manifest: its digests lie in one byte string in Van Emde
Boas order, that is, the levels are split at half height, the upper tree is
stored first and each lower tree after it, all of them recursively in the same
way.  The place of a node follows from its depth and position alone
(:func:`address`), which serves both construction and the look-up of siblings;
whatever the size of a cache line, a path crosses few of them.  The roots of
the subtrees are the leaves of the next round, until every tree has one root:
``log(n) / (HEIGHT log 3)`` rounds.

Leaves are numbered by a range partitioning on (group, id, digest), so a hot
group spreads over tasks; a task holds one subtree (at most ``3^HEIGHT``
leaves) at a time.  Proofs go from the root down: a subtree's own siblings
are followed by the proof of its root, which came with the round above.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import column, record_batch, saved, shuffle_parts, task

ARITY = 3
#: levels of a stored subtree: at most 3^7 = 2187 leaves, 105 kB
HEIGHT = 7
#: number of the tree over the subroots of all groups
TOP = -1


def _nodes(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(depth: int, position: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``position`` at ``depth`` (root: 0) in the Van Emde
    Boas order of a complete tree of ``levels`` levels."""
    at = np.zeros(len(position), np.int64)
    position = position.astype(np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = ARITY ** (depth - upper)
        at += _nodes(upper) + position // below * _nodes(levels - upper)
        position, depth, levels = position % below, depth - upper, levels - upper
    return at


@functools.lru_cache(maxsize=64)
def _places(depth: int, levels: int) -> np.ndarray:
    return address(depth, np.arange(ARITY ** depth), levels)


def rounds_up(n: int) -> int:
    """Folds until one of ``n`` nodes remains."""
    folds = 0
    while n > 1:
        n, folds = -(-n // ARITY), folds + 1
    return folds


def _folds(n: int, height: int) -> int:
    """Folds within a subtree of a round of ``n`` nodes: all that remain if
    one subtree holds them, else its whole height (a subtree with fewer leaves
    too, as single nodes are folded on as well)."""
    return rounds_up(n) if n <= ARITY ** height else height


def _digest(parts) -> bytes:
    return hashlib.sha256("".join(parts).encode()).digest()


def build(leaves: list[bytes], n: int, height: int) -> bytes:
    """A subtree in its layout, from its leaves in a round of ``n`` nodes.
    Places of nodes that don't exist stay zero."""
    folds = _folds(n, height)
    store = np.zeros((_nodes(folds + 1), 32), np.uint8)
    level = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
    for depth in range(folds, -1, -1):
        places = _places(depth, folds + 1)[:len(level)]
        store[places] = level
        if depth:
            text = store[places].tobytes().hex()
            step = 64 * ARITY
            level = np.frombuffer(b"".join(hashlib.sha256(text[i:i + step].encode()).digest() for i in range(0, len(text), step)),
                                  np.uint8).reshape(-1, 32)
    return store.tobytes()


def siblings(store: bytes, count: int, n: int, height: int) -> list[list[tuple[str, str]]]:
    """Per level from the leaves up: for every node there its siblings' text
    to the left and to the right in its run."""
    folds, text, out = _folds(n, height), store.hex(), []
    for depth in range(folds, 0, -1):
        names = [text[64 * a:64 * a + 64] for a in _places(depth, folds + 1)[:count].tolist()]
        level = []
        for i in range(0, count, ARITY):
            run = names[i:i + ARITY]
            level += [("".join(run[:k]), "".join(run[k + 1:])) for k in range(len(run))]
        out.append(level)
        count = -(-count // ARITY)
    return out


def path(levels, place: int) -> list[tuple[str, str]]:
    """The siblings on the way from leaf ``place`` to the subtree's root."""
    out = []
    for level in levels:
        out.append(level[place])
        place //= ARITY
    return out


def fold(leaf: str, steps) -> str:
    """The root that a leaf and the siblings on its way give."""
    for left, right in steps:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def numbered(rows: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Add ``name``: the 0-based place of each row in the whole order (nulls
    first).  Rows are range-partitioned and counted per task; the offsets are
    one row per task.  Rows equal in ``order`` are dealt over several tasks
    and numbered in any order."""
    tie = F.monotonically_increasing_id()
    parts = shuffle_parts(rows.sparkSession)
    keyed = rows.withColumn("_tie", tie)
    keys = [*order, F.col("_tie")]
    placed = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    counted = saved(placed.mapInArrow(_count_rows, f"{fields}, _part int, _at long"), label)
    # one row per task, so one window and a broadcast of bounded size
    ends = counted.groupBy("_part").agg((F.max("_at") + 1).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ends.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = counted.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


@task
def _count_rows(batches):
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
        at += n
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_part", "_at"])


_TREE = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("count", pa.int32()), ("store", pa.binary())])
_TREE_SQL = "tree long, block long, n long, count int, store binary"


@task
def _build(batches, height: int):
    """Subtrees of rows (tree, block, n, digest) in order."""
    at, leaves = None, []
    for batch in batches:
        for tree, block, n, digest in zip(*(column(batch, c) for c in ("tree", "block", "n", "digest"))):
            if at != (tree, block, n):
                if leaves:
                    yield record_batch(_TREE, [(*at, len(leaves), build(leaves, at[2], height))])
                at, leaves = (tree, block, n), []
            leaves.append(digest)
    if leaves:
        yield record_batch(_TREE, [(*at, len(leaves), build(leaves, at[2], height))])


def subtrees(nodes: DataFrame, height: int) -> DataFrame:
    """One round: rows (tree, pos, n, digest) of trees of ``n`` nodes ->
    subtrees (tree, block, n, count, store)."""
    block = F.floor(F.col("pos") / F.lit(ARITY ** height))
    rows = nodes.select("tree", block.alias("block"), "n", "pos", "digest")
    dealt = rows.repartition(shuffle_parts(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(lambda it: _build(it, height), _TREE_SQL)


_PROOF = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("way", pa.list_(pa.string()))])
_PROOF_SQL = "tree long, block long, way array<string>"


@task
def _ways(batches, height: int):
    """Subtrees (with the way from their root up) -> for each of their leaves
    the whole way, as (left, right) per level."""
    for batch in batches:
        for tree, n, block, count, store, way in zip(*(column(batch, c) for c in ("tree", "n", "block", "count", "store", "way"))):
            levels = siblings(store, count, n, height)
            base = block * ARITY ** height
            for lo in range(0, count, 512):
                yield record_batch(_PROOF, [(tree, base + i, [x for step in path(levels, i) for x in step] + way)
                                            for i in range(lo, min(count, lo + 512))])


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (the rows with group number ``tree`` and ``pos`` in it),
    ``groups`` (tree, group column, n, subroot) and the subtrees of all
    rounds: of the groups' trees and of the tree over their subroots."""

    leaves: DataFrame
    groups: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    height: int


def _rounds(nodes: DataFrame, largest: int, height: int, label: str) -> list[DataFrame]:
    """Subtrees of all rounds; trees that have their root drop out."""
    out = []
    while True:
        out.append(saved(subtrees(nodes, height), f"{label}-{len(out)}"))
        if largest <= ARITY ** height:
            return out
        largest = -(-largest // ARITY ** height)
        nodes = _next(out[-1], height)


def _next(trees: DataFrame, height: int) -> DataFrame:
    size = ARITY ** height
    up = F.floor((F.col("n") + (size - 1)) / F.lit(size))
    return trees.where(F.col("n") > size).select("tree", F.col("block").alias("pos"), up.alias("n"),
                                                 F.substring("store", 1, 32).alias("digest"))


def _finished(rounds: list[DataFrame], height: int) -> DataFrame:
    """(tree, digest) of every tree's root."""
    out = None
    for trees in rounds:
        done = trees.where(F.col("n") <= ARITY ** height).select("tree", F.substring("store", 1, 32).alias("digest"))
        out = done if out is None else out.union(done)
    return out


def manifest(leaves: DataFrame, group_col: str, order: list[str], height: int = HEIGHT) -> Manifest:
    """The manifest of ``leaves``, rows with a binary ``digest``; a group's
    leaves are ordered by ``order`` and digest, groups by their value (nulls
    first, bytewise)."""
    ordered = numbered(leaves, [F.col(group_col), *[F.col(c) for c in order], F.col("digest")], "place", "manifest-leaves")
    sizes = ordered.groupBy(group_col).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    groups = saved(numbered(sizes, [F.col("first")], "tree", "manifest-sizes"), "manifest-groups")
    g = groups.select(F.col(group_col).alias("_group"), "first", "n", "tree")
    rows = ordered.join(g, ordered[group_col].eqNullSafe(g["_group"]))
    rows = saved(rows.withColumn("pos", F.col("place") - F.col("first")).drop("_group", "first", "place"), "manifest-rows")
    size = groups.agg(F.count("*"), F.max("n")).first()
    if not size[0]:
        empty = rows.select("tree", F.lit(0).cast("long").alias("block"), "n", F.lit(0).alias("count"), F.col("digest").alias("store"))
        return Manifest(rows, groups.select("tree", group_col, "n", F.lit(None).cast("binary").alias("subroot")), [empty], [empty], height)
    rounds = _rounds(rows.select("tree", "pos", "n", "digest"), size[1], height, "manifest-tree")
    subroots = saved(_finished(rounds, height), "manifest-subroots")
    top = _rounds(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(size[0]).alias("n"), "digest"),
                  size[0], height, "manifest-top")
    named = groups.join(subroots.withColumnRenamed("digest", "subroot"), "tree").select("tree", group_col, "n", "subroot")
    return Manifest(rows, named, rounds, top, height)


def _descend(rounds: list[DataFrame], ways: DataFrame, height: int, label: str, leaves: bool) -> DataFrame:
    """Ways from the last round down; ``ways`` holds (tree, way) of the trees'
    roots.  Ends with the ways of all leaves, or with the first round's
    subtrees and the ways of their roots."""
    size = ARITY ** height
    above = None
    for i in range(len(rounds) - 1, -1, -1):
        top = rounds[i].where(F.col("n") <= size).join(ways, "tree")
        if above is not None:
            below = rounds[i].where(F.col("n") > size).join(above, ["tree", "block"])
            top = top.unionByName(below)
        if i == 0 and not leaves:
            return top
        above = saved(top.mapInArrow(lambda it: _ways(it, height), _PROOF_SQL), f"{label}-{i}")
    return above


def group_ways(m: Manifest) -> DataFrame:
    """(tree, way): from each group's subroot to the root."""
    start = m.top[-1].select("tree").distinct().withColumn("way", F.array().cast("array<string>"))
    ways = _descend(m.top, start, m.height, "manifest-top-ways", True)
    return ways.select(F.col("block").alias("tree"), "way")


_FOLDED = pa.schema([("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


@task
def _prove(batches, height: int, carried: list[str]):
    """Rows in order of (tree, block, place): a subtree, then its leaves."""
    levels = way = subroot = None
    for batch in batches:
        c = {x: column(batch, x) for x in ("store", "way", "n", "count", "place", "given", "subroot")}
        out, keep = [], []
        for i, store in enumerate(c["store"]):
            if store is not None:
                levels, subroot, up = siblings(store, c["count"][i], c["n"][i], height), c["subroot"][i], c["way"][i]
                way = list(zip(up[::2], up[1::2]))
                continue
            steps = path(levels, c["place"][i]) + way
            proof = hashlib.sha256("".join(x for step in steps for x in step).encode()).hexdigest()
            keep.append(i)
            out.append((subroot, proof, fold(c["given"][i], steps)))
        made, rows = record_batch(_FOLDED, out), batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(x)) for x in carried], *made.columns],
                                         names=[*carried, *_FOLDED.names])


def proofs(m: Manifest, carried: list[str], given: Column) -> DataFrame:
    """For each leaf (columns ``carried`` of the manifest's leaves): subroot,
    root, the digest of the siblings on its way to the root (level by level,
    left to right), the root that the hex digest ``given`` folds to along
    them, and whether that is the root."""
    first = m.top[-1].select("store").first()
    root = None if first is None else bytes(first[0][:32]).hex()
    height = m.height
    size = ARITY ** height
    blocks = _descend(m.rounds, group_ways(m), height, "manifest-ways", False)
    blocks = blocks.join(m.groups.select("tree", F.lower(F.hex("subroot")).alias("subroot")), "tree").withColumn("place", F.lit(-1))
    rows = m.leaves.select("tree", F.floor(F.col("pos") / F.lit(size)).alias("block"), F.pmod("pos", F.lit(size)).cast("int").alias("place"),
                           given.alias("given"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(carried)])
    both = blocks.unionByName(rows, allowMissingColumns=True)
    dealt = both.repartition(shuffle_parts(m.leaves.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "place")
    kept = [f"_{i}" for i in range(len(carried))]
    fields = ", ".join(f"`{k}` {m.leaves.schema[c].dataType.simpleString()}" for k, c in zip(kept, carried))
    out = dealt.mapInArrow(lambda it: _prove(it, height, kept), f"{fields}, subroot string, proof_sha256 string, folded_root string")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, carried)], "subroot", F.lit(root).cast("string").alias("root"),
                      "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"))


def _field(c: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, ``:``, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Hex digest of a row's fields in order."""
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def verify(docs: DataFrame, given_text: Column, height: int = HEIGHT) -> DataFrame:
    """Builds the manifest of ``docs`` (columns doc_id, source, lang, n_chars,
    text) by source and verifies rows whose text is now ``given_text``:
    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    Leaves of a source ascend by doc_id (nulls first), rows of one id by their
    digest; repeated rows are leaves of their own.  A null source is a source
    of its own, before all others.  Other columns are ignored; an empty table
    gives no rows."""
    def digest(text):
        return leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    leaf = digest(F.col("text"))
    now = F.when(~F.col("text").eqNullSafe(given_text), F.unhex(digest(given_text)))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.unhex(leaf).alias("digest"), now.alias("now"))
    m = manifest(saved(leaves, "manifest-digests"), "source", ["doc_id"], height)
    # digests travel in binary, half the size of their hex text
    out = proofs(m, ["doc_id", "digest"], F.lower(F.hex(F.coalesce("now", "digest"))))
    return out.select("doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")
