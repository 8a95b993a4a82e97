"""N-gram Jaccard join: exact links between texts whose sets of word shingles
overlap by at least a given share, and their connected components.

Rare-first prefix filtering.  Texts with equal sets form one class.  Shingle
counts come from one shuffle by shingle, in which those of a single class end
(they are the rarest and can't match).  The others return to their class,
which orders them by (count, shingle); only the shingles among the first
``n - ceil(t n) + 1`` are joined.  Inside that join pairs must pass the length,
the positional and a suffix filter (a lower bound of the difference of both
sets from parity sketches of 256 shingle classes); each pair left is verified
once on the whole sets.

Groups of any size.  A shingle found in a large share of the texts skips the
count shuffle.  Before any pairs are listed, each class is verified against
one common pivot of its candidate groups (the one with the fewest shingles of
its own); what that links needs no pairs within it, so thousands of near
copies cost one check each.  The last round
lists all pairs that share a prefix shingle and are in different components,
so no link that joins two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import (by_bucket, column, joined, record_batch, saved, shuffle_parts, slices, task,
                                  text_buffers)
from prefspark.llm.components import components
from prefspark.llm.wordhash import U, constants, hash_words, mix

WORDS = 5
PERCENT = 80
#: a shingle is hot when it is in this share of the texts; so there are at
#: most (mean set size / share) hot ones, whatever the input's size
HOT_SHARE = 0.002
PIVOT_ROUNDS = 2
#: text whose words are hashed at once, in bytes (one longer text goes alone)
HASH_BYTES = 1 << 19
#: bits of the parity sketch of a set, four longs
CLASSES = 256

_BLOB = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("tok", pa.binary()), ("df", pa.binary()),
                   ("own", pa.binary()), ("cnt", pa.binary()), ("n", pa.binary())])
_BLOB_SQL = "bucket int, hot boolean, tok binary, df binary, own binary, cnt binary, n binary"
_SET = pa.schema([("owner", pa.int64()), ("n", pa.int32()), ("singles", pa.int32()),
                  ("prefix", pa.list_(pa.int64())), ("toks", pa.binary()),
                  *((f"p{i}", pa.int64()) for i in range(4))])
_SET_SQL = "owner long, n int, singles int, prefix array<long>, toks binary, p0 long, p1 long, p2 long, p3 long"


def shingle_sets(data, off, k: int):
    """For each text: the sorted distinct hashes of its k-word shingles (of
    the whole sequence if it has fewer words; empty without words).  Texts are
    hashed in slices, so a batch's word columns are never held at once."""
    for lo, hi in slices(off, HASH_BYTES):
        yield from _shingle_sets(data, off[lo:hi + 1], k)


def _shingle_sets(data, off, k: int):
    h, wo = hash_words(data, off)
    mult = constants(7, k)
    words = np.diff(wo)
    size = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    so = np.concatenate([[0], np.cumsum(size)])
    if len(h) >= k:
        full = np.zeros(len(h) - k + 1, U)
        for j in range(k):
            full += h[j:len(h) - k + 1 + j] * mult[j]
        full = mix(full)
    else:
        full = np.zeros(1, U)
    for d in range(len(words)):
        if words[d] >= k:
            yield np.unique(full[wo[d]:wo[d + 1] - k + 1])
        elif words[d]:
            own = h[wo[d]:wo[d + 1]]
            yield mix((own * mult[:len(own)]).sum(dtype=U, keepdims=True) ^ U(0xA5A5 + len(own)))
        else:
            yield np.zeros(0, U)


def _digest(s: np.ndarray) -> int:
    """Class id of a set: a signed 64-bit hash of its sorted members."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@task
def _catalogue(batches, k: int, share: float):
    """Rows (doc_id, text_hash, n, owner) of all texts, and per slice the shingles of at
    least ``share`` of its texts with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("owner", pa.int64()),
                        ("tok", pa.int64()), ("cnt", pa.int64())])
    for batch in batches:
        ids, hashes = column(batch, "doc_id"), column(batch, "text_hash")
        data, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in slices(off):
            rows, sets, seen = [], [], set()
            for doc, text, s in zip(ids[lo:hi], hashes[lo:hi], shingle_sets(data, off[lo:hi + 1], k)):
                owner = _digest(s) if len(s) else None
                rows.append((doc, text, len(s), owner, None, None))
                if len(s) and owner not in seen:
                    seen.add(owner)
                    sets.append(s)
            if sets:
                tok = np.sort(np.concatenate(sets))
                first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
                cnt = np.diff(np.append(first, len(tok)))
                top = cnt >= max(4, share * len(rows))
                rows += [(None, None, None, None, t, c) for t, c in
                         zip(tok[first[top]].view(np.int64).tolist(), cnt[top].tolist())]
            yield record_batch(schema, rows)


def _pack(tok, own, n, df, parts_of, hot):
    """One row per bucket; owners as runs."""
    rows = []
    for bucket, at in by_bucket(parts_of):
        o = own[at]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        cnt = np.diff(np.append(first, len(o)))
        rows.append((bucket, hot, tok[at].tobytes(), None if df is None else df[at].astype(np.int32).tobytes(),
                     o[first].tobytes(), cnt.astype(np.int32).tobytes(), n[at][first].astype(np.int32).tobytes()))
    return record_batch(_BLOB, rows)


@task
def _scatter(batches, k: int, parts: int, hot_tok, hot_df):
    """Shingles of all texts, dealt by shingle; hot ones straight by owner."""
    for batch in batches:
        data, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in slices(off):
            sets = {}
            for s in shingle_sets(data, off[lo:hi + 1], k):
                if len(s):
                    sets.setdefault(_digest(s), s)
            if not sets:
                continue
            size = np.array([len(s) for s in sets.values()], np.int32)
            tok = np.concatenate(list(sets.values()))
            own, n = np.repeat(np.array(list(sets), np.int64), size), np.repeat(size, size)
            del sets
            if len(hot_tok):
                at = np.minimum(np.searchsorted(hot_tok, tok), len(hot_tok) - 1)
                hot = hot_tok[at] == tok
                if hot.any():
                    yield _pack(tok[hot], own[hot], n[hot], hot_df[at[hot]], own[hot] % parts, True)
                    cold = ~hot
                    tok, own, n = tok[cold], own[cold], n[cold]
                    del cold
                del at, hot
            yield _pack(tok, own, n, None, (tok % U(parts)).astype(np.int32), False)
            del tok, own, n


def _by_task(blobs: DataFrame, parts: int) -> DataFrame:
    """One bucket a task.  Dealt by the hash of their number several buckets
    would meet in one task, which holds all it gets."""
    return blobs.repartitionById(parts, F.col("bucket"))


def _gather(blobs):
    tok, own, cnt, n = (joined(blobs[c], t) for c, t in (("tok", U), ("own", np.int64), ("cnt", np.int32), ("n", np.int32)))
    return tok, np.repeat(own, cnt), np.repeat(n, cnt)


def _several(tok, own):
    """Entries of the shingles that more than one class has, with their count."""
    order = np.lexsort((own, tok))
    tok, own = tok[order], own[order]
    new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])])
    tok, own = tok[new], own[new]
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    df = np.diff(np.append(first, len(tok)))
    df = np.repeat(df, df)
    many = df > 1
    return tok[many], own[many], df[many]


@task
def _count(batches, parts: int):
    """Shingles of one bucket: those of several classes go to their owners."""
    blobs = {c: [] for c in ("tok", "own", "cnt", "n")}
    for batch in batches:
        hot = np.array(column(batch, "hot"), bool)
        if hot.any():
            yield batch.filter(pa.array(hot))
        for c in blobs:
            blobs[c] += [x for x, is_hot in zip(column(batch, c), hot) if not is_hot]
    tok, own, cnt, n = (joined(blobs.pop(c), t) for c, t in (("tok", U), ("own", np.int64), ("cnt", np.int32), ("n", np.int32)))
    if not len(tok):
        return
    # owners by number: half the memory of their ids on every shingle
    names, at, number = np.unique(own, return_index=True, return_inverse=True)
    size, own = n[at], np.repeat(number.astype(np.int32), cnt)
    turn = (tok >> U(62)).astype(np.int8)
    kept = []
    for k in range(4):  # a quarter of the shingles at a time, to bound memory
        mine = np.flatnonzero(turn == k)
        if len(mine):
            kept.append(_several(tok[mine], own[mine]))
    del tok, own, turn
    tok, own, df = (np.concatenate(x) for x in zip(*kept))
    own, n = names[own], size[own]
    order = np.argsort(own, kind="stable")
    if len(order):
        yield _pack(tok[order], own[order], n[order], df[order], own[order] % parts, False)


def _parity(tok) -> list[int]:
    """Parity of the number of shingles in each class, packed in longs; each
    class with unequal parity holds a shingle that only one of two sets has."""
    odd = np.bincount((tok >> U(56)).astype(np.int64), minlength=CLASSES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


@task
def _order(batches, percent: int):
    """Shared shingles of the owners of one bucket, rarest first; owners
    whose prefix holds a shared shingle."""
    blobs = {c: [] for c in ("tok", "df", "own", "cnt", "n")}
    for batch in batches:
        for c in blobs:
            blobs[c] += column(batch, c)
    df = joined(blobs["df"], np.int32)
    tok, own, n = _gather(blobs)
    del blobs
    if not len(tok):
        return
    order = np.lexsort((tok, df, own))
    tok, own, n, df = tok[order], own[order], n[order], df[order]
    new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])])
    tok, own, n = tok[new], own[new], n[new]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    shared = np.diff(np.append(first, len(own)))
    size = n[first].astype(np.int64)
    singles = size - shared
    prefix = size - (percent * size + 99) // 100 + 1 - singles
    rows = []
    for i in np.flatnonzero(prefix > 0):
        t = tok[first[i]:first[i] + shared[i]]
        rows.append((int(own[first[i]]), int(size[i]), int(singles[i]), t[:prefix[i]].view(np.int64),
                     np.sort(t).tobytes(), *_parity(t)))
        if len(rows) == 2000:
            yield record_batch(_SET, rows)
            rows = []
    if rows:
        yield record_batch(_SET, rows)


@task
def _verify(batches, percent: int):
    """Pairs whose whole sets reach the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        c = {x: column(batch, x) for x in batch.schema.names}
        rows = []
        for a, b, na, nb, ta, tb in zip(c["a"], c["b"], c["na"], c["nb"], c["ta"], c["tb"]):
            both = np.sort(np.concatenate([np.frombuffer(ta, U), np.frombuffer(tb, U)]))
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= percent * (na + nb - inter):
                rows.append((a, b))
        yield record_batch(schema, rows)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole shared parts reach the threshold."""
    toks = sets.select("owner", "n", "toks")
    full = (pairs.join(toks.toDF("b", "nb", "tb"), "b").join(toks.toDF("a", "na", "ta"), "a")
            .select("a", "b", "na", "nb", "ta", "tb"))
    return full.mapInArrow(lambda it: _verify(it, percent), "a long, b long")


#: of a set, what the filters of a join need
_ENTRY = ["owner", "n", "singles", "pos", "comp", "p0", "p1", "p2", "p3"]


def _close(a: str, b: str, percent: int):
    """Length, positional and suffix filter for two entries of one shingle."""
    def c(x, name):
        return F.col(f"{x}.{name}")
    both = c(a, "n") + c(b, "n")
    length = F.least(c(a, "n"), c(b, "n")) * 100 >= F.greatest(c(a, "n"), c(b, "n")) * percent
    rest = F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos"))
    apart = c(a, "singles") + c(b, "singles")
    for i in range(4):
        apart = apart + F.bit_count(c(a, f"p{i}").bitwiseXOR(c(b, f"p{i}")))
    # |A & B| >= p/100 |A | B|  <=>  |A ^ B| <= (100 - p) / (100 + p) (|A| + |B|)
    return length & (rest * (100 + percent) >= both * percent) & (apart * (100 + percent) <= both * (100 - percent))


def _labelled(posts: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return posts.withColumn("comp", F.col("owner"))
    c = comp.select(F.col("vertex").alias("owner"), "comp")
    return posts.join(c, "owner", "left").withColumn("comp", F.coalesce("comp", "owner"))


def _pivots(posts: DataFrame, salt: int, percent: int) -> DataFrame:
    """One pair per class: with the pivot that most of its shingles propose.
    A shingle's first pivot is the set with the fewest shingles of its own
    (the middle of a group of copies), later ones are random."""
    entry = F.struct(*_ENTRY)
    own = F.col("singles") / F.col("n") if salt == 0 else F.lit(0.0)
    piv = posts.groupBy("token").agg(F.min(F.struct(own.alias("own"), F.xxhash64("owner", F.lit(salt)).alias("h"),
                                                    entry.alias("p"))).alias("m"))
    j = posts.withColumn("e", entry).join(piv.select("token", F.col("m.p").alias("p")), "token")
    j = j.where((F.col("e.comp") != F.col("p.comp")) & _close("e", "p", percent))
    votes = j.groupBy(F.col("e.owner").alias("own"), F.col("p.owner").alias("piv")).count()
    best = votes.groupBy("own").agg(F.max_by("piv", F.struct("count", "piv")).alias("piv"))
    return best.select(F.least("own", "piv").alias("a"), F.greatest("own", "piv").alias("b")).distinct()


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs in different components that share a prefix shingle: each
    entry outside the largest component of its shingle meets all entries."""
    sizes = posts.groupBy("token", "comp").count()
    top = sizes.groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"))
    entry = F.struct(*_ENTRY)
    p = posts.join(top.where("comps > 1"), "token").select("token", "top", entry.alias("e"))
    minor = p.where(F.col("e.comp") != F.col("top")).select("token", F.col("e").alias("m"))
    j = minor.join(p, "token").where(F.col("e.comp") != F.col("m.comp"))
    j = j.where(((F.col("e.comp") == F.col("top")) | (F.col("e.owner") < F.col("m.owner"))) & _close("e", "m", percent))
    return j.select(F.least("e.owner", "m.owner").alias("a"), F.greatest("e.owner", "m.owner").alias("b")).distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, group_key) for every row
    of ``docs``; ``text_hash`` is xxhash64 of the text, ``group_key`` is the
    same for all rows of a group and for no others (null without shingles).

    Texts link when ``100 |A & B| >= percent |A | B|`` for their sets of
    ``words``-word shingles (A-Z lower-cased, words are runs without white
    space; a text with fewer words is one shingle).  ``component_id`` is the
    smallest id reachable by links.  Null or wordless texts have no shingles
    and link with nothing.  Rows with equal ids each get a row; a null id
    stays null and never is a component's id unless all its ids are null.
    Members of a class are compared by 64-bit hashes of shingles and sets.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = base.withColumn("text_hash", F.xxhash64("text"))
    found = saved(hashed.mapInArrow(lambda it: _catalogue(it, words, HOT_SHARE),
                                    "doc_id long, text_hash long, n int, owner long, tok long, cnt long"), "jaccard-docs")
    ids = found.where("n is not null").select("doc_id", "text_hash", "n", "owner")
    total = ids.count()
    # bounded by mean set size / HOT_SHARE entries, see HOT_SHARE
    hot = (found.where("n is null").groupBy("tok").agg(F.sum("cnt").alias("cnt"))
           .where(F.col("cnt") >= max(500, HOT_SHARE * total)).toPandas())
    tok, df = hot["tok"].to_numpy(np.int64).view(U), hot["cnt"].to_numpy(np.int64)
    order = np.argsort(tok)
    tok, df = tok[order], df[order]

    dealt = _by_task(base.mapInArrow(lambda it: _scatter(it, words, parts, tok, df), _BLOB_SQL), parts)
    shared = _by_task(dealt.mapInArrow(lambda it: _count(it, parts), _BLOB_SQL), parts)
    sets = saved(shared.mapInArrow(lambda it: _order(it, percent), _SET_SQL), "jaccard-sets")

    sketch = ["owner", "n", "singles", "p0", "p1", "p2", "p3"]
    entries = sets.select(*sketch, F.posexplode("prefix").alias("i", "token"))
    entries = entries.withColumn("pos", F.col("i") + F.col("singles")).drop("i")
    twice = entries.groupBy("token").count().where("count > 1").select("token")
    posts = saved(entries.join(twice, "token", "left_semi"), "jaccard-prefixes")
    tried, links, comp = None, None, None
    for step in range(PIVOT_ROUNDS + 1):
        labelled = _labelled(posts, comp)
        pairs = _pivots(labelled, step, percent) if step < PIVOT_ROUNDS else _across(labelled, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "jaccard-pairs")
        fresh = saved(_links(pairs, sets, percent), "jaccard-links")
        tried = pairs if tried is None else tried.union(pairs)
        links = fresh if links is None else links.union(fresh)
        comp = components(links, "jaccard-comp")

    groups = ids.where("owner is not null").groupBy("owner").agg(F.min("doc_id").alias("low"))
    groups = groups.join(comp.select(F.col("vertex").alias("owner"), "comp"), "owner", "left")
    groups = groups.select("owner", "low", F.coalesce("comp", "owner").alias("comp"))
    least = groups.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = groups.join(least, "comp").select("owner", "component_id", F.col("comp").alias("group_key"))
    return ids.join(named, "owner", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("owner").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash", "group_key")
