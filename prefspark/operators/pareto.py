"""Pareto fronts over any number of objectives, with epsilon boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import checkpoint_dir

#: rows that a task holds while it looks for those not dominated; beyond it
#: they are passed on as they are
HELD_ROWS = 1 << 16
#: points compared with one another at once in the final step
BLOCK_POINTS = 1024


def not_dominated(group: np.ndarray, box: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indexes of the rows that no row of their group dominates: by its box
    (at least as good in all objectives, better in one) or, in the same box,
    by its values.  Both parts together are a strict partial order, so rows
    dropped here could not have dropped any that their dominators don't."""
    d = box.shape[1]
    order = np.lexsort([*(-value[:, k] for k in range(d - 1, -1, -1)), *(-box[:, k] for k in range(d - 1, -1, -1)), group])
    group, box, value = group[order], box[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    kept = []
    for lo, hi in zip(starts, [*starts[1:], len(group)]):
        left, at = np.arange(lo, hi), 0
        while at < len(left):  # in this order no row is dominated by a later one
            p, rest = left[at], left[at + 1:]
            b, v = box[rest], value[rest]
            same = (b == box[p]).all(1)
            gone = ((b <= box[p]).all(1) & ~same) | (same & (v <= value[p]).all(1) & (v < value[p]).any(1))
            left = np.concatenate([left[:at + 1], rest[~gone]])
            at += 1
        kept.append(left)
    return np.sort(order[np.concatenate(kept)]) if kept else np.zeros(0, np.int64)


def _local(batches, n: int):
    """Rows that no row of the same task dominates, in bounded memory."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        keys = held.column("__key").combine_chunks().dictionary_encode()
        point = held.column("__point").combine_chunks()
        parts = [np.column_stack([point.field(f"{x}{i}").to_numpy(zero_copy_only=False) for i in range(n)]) for x in "bv"]
        held = held.take(pa.array(not_dominated(keys.indices.to_numpy(), *parts))).combine_chunks()
        if held.num_rows > HELD_ROWS:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def pareto_front(df: DataFrame, by: str | list[str], maximize: str | list[str], minimize: str | list[str] = (),
                 epsilon: float | dict[str, float] = 0.0) -> DataFrame:
    """Rows of each group that no other row dominates, over all objectives
    (columns to ``maximize`` and to ``minimize``).

    With ``epsilon`` (one for all objectives or one each, 0: exact) the values
    are first dealt to boxes ``floor(x / epsilon)`` (of ``-x`` when minimised).  A row
    goes when another box dominates its box, or a row of its own box its values;
    so what is left is within ``epsilon`` of all that was dropped.  Rows with
    equal values stay or go together.  Rows with a null or NaN objective or a
    null group are in no front.

    Each task first drops what its own rows dominate.  The points left are cut into blocks
    by hash; a block's points are held against every block of their group, and
    the rows of those that fell are removed."""
    by, maximize, minimize = ([x] if isinstance(x, str) else list(x) for x in (by, maximize, minimize))
    eps = epsilon if isinstance(epsilon, dict) else dict.fromkeys([*maximize, *minimize], epsilon)
    fields, usable = [], F.lit(True)
    for i, c in enumerate([*maximize, *minimize]):
        v = F.col(c).cast("double") * F.lit(1.0 if i < len(maximize) else -1.0)
        size = float(eps.get(c, 0.0))
        fields += [(F.floor(v / F.lit(size)).cast("double") if size else v).alias(f"b{i}"), v.alias(f"v{i}")]
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    for c in by:
        usable = usable & F.col(c).isNotNull()
    n = len(maximize) + len(minimize)
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = df.where(usable).withColumns({"__key": key, "__point": F.struct(*fields)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = rows.mapInArrow(lambda it: _local(it, n), schema)
    # few rows as a rule; used several times below
    checkpoint_dir(df.sparkSession)
    local = local.checkpoint()

    def all_of(*tests):
        return " AND ".join(tests)
    same = all_of(*[f"q.b{i} = p.b{i}" for i in range(n)])
    box = all_of(*[f"q.b{i} >= p.b{i}" for i in range(n)], f"NOT ({same})")
    inside = all_of(same, *[f"q.v{i} >= p.v{i}" for i in range(n)], "(" + " OR ".join(f"q.v{i} > p.v{i}" for i in range(n)) + ")")
    out = df.sparkSession.sql(f"""
        WITH p AS (SELECT DISTINCT __key, __point FROM {{local}}),
        n AS (SELECT __key, ceil(count(*) / {BLOCK_POINTS}) AS blocks FROM p GROUP BY __key),
        b AS (SELECT __key, collect_list(__point) AS pts FROM p JOIN n USING (__key) GROUP BY __key, pmod(xxhash64(__point), blocks)),
        gone AS (SELECT __key, explode(filter(x.pts, p -> exists(y.pts, q -> ({box}) OR ({inside})))) AS __point
                 FROM b x JOIN b y USING (__key))
        SELECT s.* FROM {{local}} s LEFT ANTI JOIN gone g ON s.__key = g.__key AND s.__point = g.__point""", local=local)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
