"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors of a label form one node.  Nodes are dealt to cells around
centroids sampled from all nodes of a larger cell.  A node has one home and is
copied to the cells whose home nodes may be in range of it: by the triangle
inequality it can't be in range of any in the other cells, so a home node meets
all its neighbours in its cell.  A split counts only if it saves a quarter of
the comparisons.  Cells of up to ``SHARD`` nodes get a graph: each node links to
near neighbours, robustly pruned (a neighbour is left out if one already kept
is much nearer to it).  The lists of a node from all its cells are united, and
each cell searches its part of the united graph, whose parts without a link
between them are linked by their medoids.  A greedy search walks from the
medoids towards each home node
and then expands everything in range of it, from what was met and from the node
itself.  Larger cells, which no split makes smaller (a tight group), are cut by
hash and their blocks compared exactly; so is a cell whose audit (some home
rows against all its rows) shows that the search missed a pair.  Pairs are verified in double
precision, so none below the threshold is linked.  A cell returns counts and
one link a node to its component, not the pairs, whose number grows with the
square of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import sample_rows, saved
from prefspark.llm.components import components

COSINE = 0.93
SHARD, OVERLAP, CENTROIDS = 2000, 3, 128
#: largest angle between a centroid and a home node of its cell
REACH, RANGE = np.deg2rad(52), np.arccos(COSINE)
#: audited rows of a cell: each AUDIT-th id, and about as many spread over it
AUDIT, AUDIT_ROWS = 100, 32
#: nodes of one side of an exactly compared block
SIDE = 8192
NEAR, DEGREE, ALPHA = 64, 24, 1.2
MEDOIDS, PATIENCE, SLACK = 4, 12, 0.08
BLOCK = 512


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors.tolist() if hasattr(vectors, "tolist") else vectors, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _count(n, size: int):
    return F.ceil(n / F.lit(float(size))).cast("int")


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(node, label, vec, ids): distinct usable vectors with their number of
    rows; ``node`` is the smallest id."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                       F.col(vec_col).cast("array<double>").alias("vec"))
    # near 1 by the largest magnitude, so that no square overflows or vanishes
    v = v.withColumn("most", F.expr("aggregate(vec, 0D, (s, x) -> greatest(s, abs(x)))"))
    good = (F.col("label").isNotNull() & F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
            & (F.col("most") > 0) & F.col("vec_id").isNotNull())
    # a power of two, which changes no digit, in two steps that stay in range
    v = v.where(good).withColumn("_k", F.expr("-floor(log2(most))")).withColumn(
        "vec", F.expr("transform(vec, x -> x * pow(2D, floor(_k / 2)) * pow(2D, _k - floor(_k / 2)))"))
    v = v.withColumn("norm", F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + x * x))"))
    return v.withColumn("vec", F.expr("transform(vec, x -> x / norm)")).select("vec_id", "label", "vec")


def _split(key, rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    """Deal a part of a cell's rows to its sub-cells, one for each centroid
    and one for the rows out of reach of all centroids."""
    empty = pd.DataFrame({"node": [], "parent": [], "cell": [], "home": []})
    if not len(rows):
        return empty
    x, c = _unit(rows["vec"]), _unit(seeds.sort_values("node")["centre"])
    sim = x @ c.T
    best, every = sim.argmax(1), np.arange(len(x))
    angle = np.arccos(np.clip(sim, -1, 1))
    # rows of cell i are on its side of the plane between i and the nearest centroid
    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[best]
    near = sim[every, best][:, None] - sim <= gap * np.sin(RANGE) + 1e-9
    member = np.column_stack([near & (angle <= REACH + RANGE + 1e-6), angle[every, best] >= REACH - RANGE - 1e-6])
    own = np.where(angle[every, best] <= REACH, best, len(c))
    member[every, own] = True
    r, k = np.nonzero(member)
    return pd.DataFrame({"node": rows["node"].to_numpy()[r], "parent": key[0], "cell": [f"{key[0]}.{i}" for i in k],
                         "home": rows["home"].to_numpy(bool)[r] & (own[r] == k)})


def _shards(nodes: DataFrame) -> DataFrame:
    """(node, cell, home, n, homes) with the number of rows and of home rows
    of the cell: every node is home in one cell, which holds all nodes in
    range of it.  A split is taken only if it leaves three quarters of the
    products of rows and home rows or less, so the loop ends."""
    cells = saved(nodes.select("node", F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("/"),
                                                F.size("vec").cast("string")).alias("cell"), F.lit(True).alias("home")), "graph-cells")
    done = []
    while True:
        size = saved(cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")), "graph-sizes")
        sized = cells.join(size.where("homes > 0"), "cell")
        fits = (F.col("n") <= SHARD) | (F.col("n") * F.col("homes") <= SHARD * SHARD)
        done.append(sized.where(fits).select("node", "cell", "home", "n", "homes"))
        over = sized.where(~fits)
        if size.where("homes > 0").where(~fits).isEmpty():
            break
        seeds = sample_rows(over.select("node", "cell"), "cell", CENTROIDS, key="node").join(
            nodes.select("node", F.col("vec").alias("centre")), "node")
        parts = size.where("homes > 0").where(~fits).select("cell", F.explode(F.sequence(F.lit(0), _count(F.col("n"), SIDE) - 1)).alias("part"))
        dealt = over.join(nodes.select("node", "vec"), "node").withColumn("part", F.expr("pmod(xxhash64(node, 1), ceil(n / double(%d)))" % SIDE).cast("int"))
        tried = dealt.select("cell", "part", "node", "home", "vec").groupBy("cell", "part").cogroup(
            seeds.join(parts, "cell").groupBy("cell", "part")).applyInPandas(_split, "node long, parent string, cell string, home boolean")
        tried = saved(tried, "graph-cells")
        sub = tried.groupBy("parent", "cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
        after = sub.where("homes > 0").groupBy(F.col("parent").alias("cell")).agg(
            F.sum(F.col("n") * F.col("homes")).alias("work"), F.sum("n").alias("rows"))
        better = after.join(size, "cell").where((F.col("work") <= 0.75 * F.col("n") * F.col("homes")) & (F.col("rows") <= OVERLAP * F.col("n")))
        better = saved(better.select("cell"), "graph-better")
        done.append(over.join(better, "cell", "left_anti").select("node", "cell", "home", "n", "homes"))
        cells = tried.join(better.withColumnRenamed("cell", "parent"), "parent", "left_semi").select("node", "cell", "home")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return saved(out, "graph-shards")


def _prune(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of ``x`` within it."""
    n, out = len(x), []
    y = x.astype(np.float32)
    for lo in range(0, n, BLOCK):
        sim = y[lo:lo + BLOCK] @ y.T
        sim[np.arange(len(sim)), np.arange(lo, min(lo + BLOCK, n))] = -2
        k = min(NEAR, n - 1)
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(sim), 0), int)
        for i in range(len(sim)):
            cand = top[i][np.argsort(-sim[i, top[i]], kind="stable")]
            far = 1 - sim[i, cand]  # distances, nearest first
            between = 1 - y[cand] @ y[cand].T
            alive, kept = np.ones(len(cand), bool), []
            for j in range(len(cand)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == DEGREE:
                        break
                    alive &= ALPHA * between[j] > far
            out.append(cand[kept])
    return out


def _spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each row's component under the links (a, b)."""
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _connect(x: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Links between the medoids of the parts that the links (a, b) leave
    apart; a part of 65 or more near copies keeps no neighbour outside it."""
    part = _spread(np.arange(len(x)), a, b)
    mids = []
    for k in np.unique(part):
        mine = np.flatnonzero(part == k)
        mids.append(mine[(x[mine] @ x[mine].mean(0)).argmax()])
    i, j = np.triu_indices(len(mids), 1)
    return np.array(mids)[i], np.array(mids)[j]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` with the components that the links (a, b) join made one."""
    a, b = label[a], label[b]
    pair = np.unique((np.minimum(a, b) * len(label) + np.maximum(a, b))[a != b])
    return _spread(np.arange(len(label)), pair // len(label), pair % len(label))[label]


def _link_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, near): robust-pruned neighbours of each node within a cell."""
    rows = rows.sort_values("node")
    ids = rows["node"].to_numpy()
    return pd.DataFrame({"node": ids, "near": [ids[v] for v in _prune(_unit(rows["vec"]))]})


def _united(cells: DataFrame) -> DataFrame:
    """(node, near): adjacency lists of all cells (cell, node, vec), one list
    a node."""
    lists = cells.select("cell", "node", "vec").groupBy("cell").applyInPandas(_link_shard, "node long, near array<long>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _graph(x: np.ndarray, ids: np.ndarray, near) -> list[np.ndarray]:
    """Neighbours of each row of a cell in the united graph, in both
    directions, so that a row can be reached from whom it keeps."""
    a, b = np.repeat(np.arange(len(x)), [len(v) for v in near]), np.concatenate([*near, np.zeros(0, int)]).astype(int)
    at = np.minimum(np.searchsorted(ids, b), len(ids) - 1)
    here = (ids[at] == b) & (at != a)  # neighbours in other cells only are met there
    a, b = a[here], at[here]
    more_a, more_b = _connect(x, a, b)
    a, b = np.concatenate([a, more_a]), np.concatenate([b, more_b])
    both = np.unique(np.concatenate([a * len(x) + b, b * len(x) + a]))
    return np.split(both % len(x), np.searchsorted(both // len(x), np.arange(1, len(x))))


def _exact(x: np.ndarray, y: np.ndarray):
    """All (row of x, row of y) pairs in range, a block of x at a time."""
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    for lo in range(0, len(x), BLOCK):
        sim = fx[lo:lo + BLOCK] @ fy.T
        q, node = np.nonzero(sim >= COSINE - 1e-4)
        unsure = np.flatnonzero(sim[q, node] < COSINE + 1e-4)
        ok = np.ones(len(q), bool)
        ok[unsure] = np.einsum("ij,ij->i", x[lo + q[unsure]], y[node[unsure]]) >= COSINE
        yield lo + q[ok], node[ok]


def _search(x: np.ndarray, links: list[np.ndarray], start: np.ndarray, queries: np.ndarray):
    """Range-expanding greedy search; yields (query row, row) pairs."""
    y, n = x.astype(np.float32), len(x)
    degree = np.array([len(v) for v in links])
    flat, first = np.concatenate([*links, np.zeros(0, int)]).astype(int), np.concatenate([[0], np.cumsum(degree)])

    def around(q, node, known):
        """New (query, neighbour) pairs of some (query, node) pairs."""
        d = degree[node]
        at = np.repeat(first[node] - np.concatenate([[0], np.cumsum(d)[:-1]]), d) + np.arange(d.sum())
        pair = np.unique(np.repeat(q, d) * n + flat[at])
        pair = pair[~known.reshape(-1)[pair]]
        known.reshape(-1)[pair] = True
        return pair // n, pair % n

    def sims(qrow, node):
        return np.concatenate([np.einsum("ij,ij->i", y[qrow[i:i + 20000]], y[node[i:i + 20000]])
                               for i in range(0, len(node), 20000)] or [np.zeros(0, np.float32)])

    for lo in range(0, len(queries), 128):
        mine = queries[lo:lo + 128]
        m = len(mine)
        known, sim = np.zeros((m, n), bool), np.full((m, n), -2, np.float32)
        opened = np.zeros((m, n), bool)
        known[:, start] = True
        sim[:, start] = y[mine] @ y[start].T
        best, idle, active = sim.max(1), np.zeros(m, int), np.arange(m)
        while len(active):  # greedy: open the most similar node of each query
            masked = np.where(opened[active], -3, sim[active])
            node = masked.argmax(1)
            ok = masked[np.arange(len(active)), node] > -2
            q, node = active[ok], node[ok]
            opened[q, node] = True
            nq, nn = around(q, node, known)
            sim[nq, nn] = sims(mine[nq], nn)
            now = sim[q].max(1)
            idle[q] = np.where(now > best[q] + 1e-6, 0, idle[q] + 1)
            best[q] = now
            active = q[(idle[q] < PATIENCE) & (best[q] < 0.99999)]
        known[np.arange(m), mine], sim[np.arange(m), mine] = True, 1  # whatever was met, the own row is in reach
        while True:  # range: open all nodes in reach of the threshold
            q, node = np.nonzero((sim >= COSINE - SLACK) & ~opened)
            if not len(q):
                break
            opened[q, node] = True
            nq, nn = around(q, node, known)
            sim[nq, nn] = sims(mine[nq], nn)
        q, node = np.nonzero(sim >= COSINE - 1e-4)
        yield mine[q], node


def _medoids(x: np.ndarray) -> np.ndarray:
    start = np.argsort(-(x @ x.mean(0)), kind="stable")[:1]
    if MEDOIDS > 1 and len(x) > 1:  # further medoids: middles of the parts around far nodes
        far = [start[0]]
        while len(far) < MEDOIDS:
            far.append(int((x @ x[far].T).max(1).argmin()))
        part = (x @ x[far].T).argmax(1)
        start = np.unique([np.flatnonzero(part == k)[(x[part == k] @ x[part == k].mean(0)).argmax()] for k in range(len(far)) if (part == k).any()])
    return np.asarray(start)


def _missed(x: np.ndarray, ids: np.ndarray, home: np.ndarray, found: np.ndarray) -> bool:
    """Audit of a cell: whether the search found too few rows in range of any
    home row whose id is divisible by AUDIT, or of AUDIT_ROWS spread ones."""
    some = np.unique(np.concatenate([home[ids[home] % AUDIT == 0], home[::max(1, len(home) // AUDIT_ROWS)]]))
    want = np.zeros(len(x), int)
    for q, _ in _exact(x[some], x):
        want += np.bincount(some[q], minlength=len(x))
    return bool((want[some] - 1 > found[some]).any())


def _search_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, peer, linked): rows in range of each home node, and a node of
    its component.  Without united lists (``near``) the cell's own are used."""
    rows = rows.sort_values("node")
    near = rows["near"] if "near" in rows else _link_shard(rows)["near"]
    ids, home, copies, x = rows["node"].to_numpy(), rows["home"].to_numpy(bool), rows["copies"].to_numpy(), _unit(rows["vec"])
    n, pairs = len(x), [np.zeros(0, int)]
    for q, node in _search(x, _graph(x, ids, near), _medoids(x), np.flatnonzero(home)):
        ok = (q != node) & (np.einsum("ij,ij->i", x[q], x[node]) >= COSINE)
        pairs += [q[ok] * n + node[ok], node[ok] * n + q[ok]]
    pairs = np.unique(np.concatenate(pairs))
    a, b = pairs // n, pairs % n
    if _missed(x, ids, np.flatnonzero(home), np.bincount(a, minlength=n)):
        both = [(q[q != node], node[q != node]) for q, node in _exact(x, x)]
        a, b = np.concatenate([q for q, _ in both]), np.concatenate([node for _, node in both])
    linked = np.bincount(a, copies[b], n).astype(np.int64)
    return pd.DataFrame({"node": ids, "peer": ids[_merge(np.arange(n), a, b)], "linked": np.where(home, linked, 0)})


def _compare_block(rows: pd.DataFrame) -> pd.DataFrame:
    """As _search_shard, of the home nodes of one block with the nodes of
    another, all compared."""
    left, right = rows[rows["left"]], rows[~rows["left"]]
    lid, rid = left["node"].to_numpy(), right["node"].to_numpy()
    ids = np.unique(np.concatenate([lid, rid]))
    at_l, at_r, copies = np.searchsorted(ids, lid), np.searchsorted(ids, rid), right["copies"].to_numpy()
    label, linked = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    if len(left) and len(right):
        for q, node in _exact(_unit(left["vec"]), _unit(right["vec"])):
            other = at_l[q] != at_r[node]
            q, node = at_l[q[other]], node[other]
            linked += np.bincount(q, copies[node], len(ids)).astype(np.int64)
            label = _merge(label, q, at_r[node])
    return pd.DataFrame({"node": ids, "peer": ids[label], "linked": linked})


def near_links(nodes: DataFrame) -> DataFrame:
    """(node, peer, linked) of saved nodes (node, label, vec, copies), several
    rows a node: the sum of ``linked`` is the number of rows in range, and the
    links (node, peer) have the components of all pairs in range."""
    placed = _shards(nodes).join(nodes.select("node", "vec", "copies"), "node")
    out = "node long, peer long, linked long"
    small = placed.where(F.col("n") <= SHARD).select("cell", "node", "home", "copies", "vec")
    united = saved(_united(small), "graph-united")
    found = small.join(united, "node").groupBy("cell").applyInPandas(_search_shard, out)
    large = placed.where(F.col("n") > SHARD).withColumn("l", _count(F.col("homes"), SIDE)).withColumn("r", _count(F.col("n"), SIDE))
    left = large.where("home").select("cell", F.expr("cast(pmod(xxhash64(node, 2), l) as int)").alias("i"),
                                      F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("j"), F.lit(True).alias("left"), "node", "copies", "vec")
    right = large.select("cell", F.explode(F.sequence(F.lit(0), F.col("l") - 1)).alias("i"),
                         F.expr("cast(pmod(xxhash64(node, 3), r) as int)").alias("j"), F.lit(False).alias("left"), "node", "copies", "vec")
    blocks = left.unionByName(right).groupBy("cell", "i", "j").applyInPandas(_compare_block, out)
    return saved(found.union(blocks).where("linked > 0 or node <> peer"), "graph-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and not null and their cosine (in
    double precision) is at least COSINE.  Vectors that are null, zero, of
    other lengths or hold null or non-finite components link with nothing; a
    null id stays alone.  Rows with equal ids count as rows.
    """
    good = saved(_nodes(vectors, id_col, vec_col, label_col), "graph-vectors")
    nodes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = saved(nodes, "graph-nodes")
    links = near_links(nodes)
    ways = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    pairs = links.where("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")).distinct()
    comp = components(pairs, "graph-comp").withColumnRenamed("vertex", "node")
    found = nodes.join(ways, "node", "left").join(comp, "node", "left").select(
        "label", "vec", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("comp", "node").alias("component_id"))
    placed = good.join(found, ["label", "vec"]).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    return ids.join(placed, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, every: int = 100, **cols) -> float:
    """Share of the links of each ``every``-th id (by brute force against all
    rows) that ``result`` counts."""
    good = saved(_nodes(vectors, cols.get("id_col", "vec_id"), cols.get("vec_col", "embedding"), cols.get("label_col", "label")), "audit")
    few = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "label", F.col("vec").alias("qv"))
    true = few.join(good, "label").where((F.col("q") != F.col("vec_id")) & (F.expr(_dot("qv", "vec")) >= COSINE))
    true = true.groupBy(F.col("q").alias("vec_id")).agg(F.count("*").alias("want"))
    want, have = true.join(result, "vec_id").agg(F.sum("want"), F.sum(F.least("want", "n_links"))).first()
    return 1.0 if not want else have / want
