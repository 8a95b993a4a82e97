"""Scoring texts with a smoothed n-gram model as a weighted backoff automaton.

States are the contexts of up to ``ORDER - 1`` words that the training texts
hold (a text begins in the state of its start); the root is the empty context.
Behind a context of ``c`` occurrences, ``T = kappa * c ** BETA`` is the number
of successors that a power law expects.  The arc of a word seen ``k`` times
there carries ``log10 (k + T * p) / (c + T)``, where ``p`` is the word's
probability in the next shorter context; the failure arc carries
``log10 T / (c + T)`` and leads to that context.  The root's arcs are the
unigrams ``(c(w) + 1/2) / (N + (V + 1) / 2)``.  All words together have
probability one in every state: what unseen words leave is not lost.

A text is traversed once from left to right.  The carried state is the longest
known context; as each suffix of a state is a state too, it is the longest
suffix of the text read so far that the model holds, and a word without an arc
there goes down the chain of failure arcs, to the root at most.

The automaton grows with the corpus and is never gathered.  Texts are packed
into units; a unit sends each of its distinct n-grams once (with its count in
the unit's training texts) to the n-gram's bucket, and gets the counts of the
whole corpus back: the arcs and states that its texts can meet.  A frequent
n-gram reaches its bucket once a unit, so no word is hot.  Buckets and units
are read one after another from sorted partitions, in the memory of one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import column, record_batch, saved, shuffle_parts, slices, task, text_buffers
from prefspark.llm.wordhash import U, hash_words, mix

ORDER = 3
#: expected successors of a context of one word, of two words, ...
KAPPA, BETA = (8.0, 4.0), 0.8
#: text of a unit and of a bucket, in bytes (one longer text goes alone)
UNIT_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: n-grams are compared by hashes of this many bits more than the corpus' bytes
#: need (64 at most), so about one in a million n-grams takes another's count
HASH_BITS = 20
START, END = U(0), U(1)

_UNIT = pa.schema([("size", pa.int64()), *((c, pa.binary()) for c in ("ids", "flags", "lengths", "text"))])
_UNIT_SQL = "size long, ids binary, flags binary, lengths binary, text binary"
_GRAMS = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("grams", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())),
                    ("tokens", pa.int64()), ("types", pa.int64())])
_GRAMS_SQL = "unit long, bucket long, grams array<binary>, counts array<binary>, tokens long, types long"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _zip(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _zip_ints(x: np.ndarray) -> bytes:
    """64-bit integers, bytes of the same place together."""
    return _zip(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T))


def _unzip_ints(blob: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(blob), np.uint8).reshape(8, -1).T).view(dtype).reshape(-1)


@task
def _units(batches):
    """Texts packed into units."""
    for batch in batches:
        ids, held = column(batch, "doc_id"), np.array(column(batch, "held"), bool)
        data, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in slices(off, UNIT_BYTES):
            doc = np.array([0 if x is None else x for x in ids[lo:hi]], np.int64)
            flags = held[lo:hi] + 2 * np.array([x is None for x in ids[lo:hi]], np.int8)
            yield record_batch(_UNIT, [(int(off[hi] - off[lo]), doc.tobytes(), flags.astype(np.int8).tobytes(),
                                        np.diff(off[lo:hi + 1]).tobytes(), _zip(data[off[lo]:off[hi]]))])


def _steps(row):
    """(words of all steps, first step of each text, ids, flags) of a unit; a
    step is a word or the end of a text."""
    off = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int64))])
    h, wo = hash_words(np.frombuffer(_unzip(row["text"]), np.uint8), off)
    n = len(off) - 1
    w, last = np.empty(len(h) + n, U), wo[1:] + np.arange(n)
    inner = np.ones(len(w), bool)
    inner[last] = False
    w[last], w[inner] = END, h
    return w, wo[:-1] + np.arange(n), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["flags"], np.int8)


def _before(x: np.ndarray, first: np.ndarray, at_start) -> np.ndarray:
    """The previous step's value; ``at_start`` for the first step of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = at_start
    return out


def _grams(w: np.ndarray, first: np.ndarray, shift: int):
    """For each order: (distinct n-grams, index of each step's n-gram among
    them, -1 for a step with too few words before it)."""
    gram, there = w, np.ones(len(w), bool)
    for order in range(1, ORDER + 1):
        if order > 1:
            gram = mix(mix(_before(gram, first, START) + U(order)) ^ w)
            there = _before(there, first, order == 2)
        distinct, at = np.unique(gram[there] >> U(shift), return_inverse=True)
        index = np.full(len(w), -1, np.int32)
        index[there] = at
        yield distinct, index


@task
def _ask(batches, buckets: int, shift: int):
    """The distinct n-grams of each unit with their training counts."""
    none = _zip_ints(np.zeros(0, np.int64))
    for row in (row for batch in batches for row in batch.to_pylist()):
        w, first, _, flags = _steps(row)
        train, rows = np.repeat(flags % 2 == 0, np.diff(np.append(first, len(w)))), {}
        for order, (grams, index) in enumerate(_grams(w, first, shift)):
            count = np.bincount(index[train & (index >= 0)], minlength=len(grams)).astype(np.int64)
            # the bucket ascends with the n-gram
            bucket = (((grams << U(shift)) >> U(32)) * U(buckets)) >> U(32)
            there, at = np.unique(bucket, return_index=True)
            for b, lo, hi in zip(there.tolist(), at.tolist(), [*at[1:].tolist(), len(grams)]):
                grams_of, counts_of = rows.setdefault(b, ([none] * ORDER, [none] * ORDER))
                grams_of[order] = _zip_ints(np.diff(grams[lo:hi], prepend=U(0)))
                counts_of[order] = _zip_ints(count[lo:hi])
        yield record_batch(_GRAMS, [(row["unit"], b, *rows[b], None, None) for b in sorted(rows)])


def _groups(batches, by: str):
    """Rows of equal ``by`` of a sorted partition, one list at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, group in itertools.groupby(rows, lambda row: row[by]):
        yield list(group)


@task
def _answer(batches):
    """Counts over all units, sent back to each unit in its own order; the
    first row of a bucket has its training tokens and distinct words."""
    for rows in _groups(batches, "bucket"):
        counts, tokens, types = [[] for _ in rows], 0, 0
        for order in range(ORDER):
            grams = [np.cumsum(_unzip_ints(r["grams"][order], U), dtype=U) for r in rows]
            ends = np.cumsum([len(x) for x in grams])
            distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at, np.concatenate([_unzip_ints(r["counts"][order]) for r in rows]))
            for out, back in zip(counts, np.split(total[at], ends[:-1])):
                out.append(_zip_ints(back))
            if order == 0:
                tokens, types = int(total.sum()), int((total > 0).sum())
        for i, (row, count) in enumerate(zip(rows, counts)):
            yield record_batch(_GRAMS, [(row["unit"], row["bucket"], None, count, tokens if i == 0 else None, types if i == 0 else None)])


def _automaton(grams, counts, first, root):
    """Per order the counts of the steps' n-grams, the weights of their arcs,
    and the weights of the failure arcs of the states before the steps (with
    the states' occurrences)."""
    seen = [np.where(index >= 0, c[index] if len(c) else 0, 0) for (_, index), c in zip(grams, counts)]
    # a start for each end; the last step is an end
    texts = int(counts[0][grams[0][1][-1]])
    arcs, states = [root(seen[0])], [np.ones(len(seen[0]), np.int64)]
    fails = [np.zeros(len(seen[0]))]
    for length in range(1, ORDER):
        c = _before(seen[length - 1], first, texts if length == 1 else 0)
        t = KAPPA[length - 1] * np.maximum(c, 1) ** BETA
        fails.append(np.log10(t / (c + t)))
        known = np.log10((seen[length] + t * 10 ** arcs[-1]) / (c + t))
        arcs.append(np.where(c > 0, known, arcs[-1]))
        states.append(c)
    return seen, arcs, fails, states


def _walk(seen, arcs, fails, states) -> np.ndarray:
    """log10 probability of each step: from the longest known state down the
    failure arcs to the first state with an arc for the word."""
    out, open_ = np.zeros(len(seen[0])), np.ones(len(seen[0]), bool)
    for length in range(ORDER - 1, -1, -1):
        here = open_ & (states[length] > 0)
        arc = here & ((seen[length] > 0) | (length == 0))
        out[arc] += arcs[length][arc]
        out[here & ~arc] += fails[length][here & ~arc]
        open_ &= ~arc
    return out


@task
def _score(batches, tokens: int, types: int, shift: int):
    """Scores of the texts of each unit, from its answers."""
    # without training texts every word has weight 1/2 of 1/2
    root_total = np.log10(tokens + 0.5 * (types + 1))
    for unit, *answers in _groups(batches, "unit"):
        w, first, ids, flags = _steps(unit)
        grams = list(_grams(w, first, shift))
        counts = [np.concatenate([_unzip_ints(r["counts"][k]) for r in answers]) for k in range(ORDER)]
        model = _automaton(grams, counts, first, lambda c: np.log10(c + 0.5) - root_total)
        seen, base = model[0][0], model[1][0]
        cols = [pa.array(ids, mask=flags >= 2), flags % 2 == 1, np.diff(np.append(first, len(w))),
                np.add.reduceat((seen > 0).astype(np.int64), first), np.full(len(ids), tokens),
                np.add.reduceat(base, first), np.add.reduceat(_walk(*model), first)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def score_texts(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for every row.  ``held`` is a boolean column; the model learns from the
    rows where it isn't true.

    Tokens: words without white space, A-Z lower-cased, then one end.  A null
    or empty text is its end alone.  ``base_score`` is the log10 probability
    under the unigrams of the root, ``score`` that of the automaton.  Without
    training rows the counts are 0.  Rows with equal or null ids stay apart.
    """
    parts = shuffle_parts(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"),
                       F.col(text_col).cast("string").alias("text"))
    units = saved(base.mapInArrow(_units, _UNIT_SQL).withColumn("unit", F.monotonically_increasing_id()), "lm-units")
    size = units.agg(F.sum("size")).first()[0] or 0
    buckets, shift = max(4 * parts, size // BUCKET_BYTES), max(0, 64 - HASH_BITS - size.bit_length())
    asked = units.mapInArrow(lambda it: _ask(it, buckets, shift), _GRAMS_SQL).repartition(parts, "bucket").sortWithinPartitions("bucket")
    answers = saved(asked.mapInArrow(_answer, _GRAMS_SQL), "lm-counts")
    tokens, types = answers.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = tokens or 0, types or 0
    both = units.withColumn("bucket", F.lit(-1).cast("long")).unionByName(answers.select("unit", "bucket", "counts"), allowMissingColumns=True)
    return both.repartition(parts, "unit").sortWithinPartitions("unit", "bucket").mapInArrow(
        lambda it: _score(it, tokens, types, shift), _OUT_SQL)
