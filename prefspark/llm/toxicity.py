"""Toxicity severity by cumulative-link ordinal regression on sparse words.

``P(grade > k) = sigmoid(w x - theta_k)``: all ordered thresholds share the
weights ``w``.  ``x`` holds log2(1 + count) of the selected features of a text
(its words of letters and digits, A-Z folded, and their first 4, 6 and 8
bytes, so that inflected and compound forms count) and of its length; features
are selected by the z-score of their log-odds between toxic and clean texts.
The prediction is the expected grade.  The fit reads a bounded sample of
labelled rows; scoring hashes all words of whole texts and keeps the few
features that have a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import column, one_text, record_batch, sample_rows, slices, task, text_buffers
from prefspark.llm.wordhash import U, hash_words

#: the fit reads at most this many labelled rows of each label value
TRAIN_PER_LABEL = 3000
MIN_Z, MIN_TEXTS, MAX_FEATURES = 4.0, 5, 1000
PREFIXES = (4, 6, 8)
DECAY, STEPS, RATE = 1e-3, 600, 0.1

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _features(data, off):
    """For each text its distinct feature hashes and their counts."""
    h, wo, heads = hash_words(data, off, _WORD, PREFIXES)
    for a, b in zip(wo[:-1], wo[1:]):
        f, c = np.unique(np.concatenate([h[a:b], *(x[a:b] for x in heads)]), return_counts=True)
        some = f > 0
        yield f[some], c[some], b - a


@task
def _collect(batches):
    schema = pa.schema([("label", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("size", pa.int64())])
    for batch in batches:
        data, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        label = column(batch, "label")
        for lo, hi in slices(off):
            yield record_batch(schema, [(y, f.tobytes(), c.astype(np.uint32).tobytes(), int(n))
                                        for y, (f, c, n) in zip(label[lo:hi], _features(data, off[lo:hi + 1]))])


def select_features(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Hashes of the features most unevenly spread between both classes."""
    flat, size = np.concatenate([*words, np.zeros(0, U)]), np.array([len(w) for w in words], int)
    vocab, inv = np.unique(flat, return_inverse=True)
    on = np.repeat(toxic, size)
    n1, n0 = np.bincount(inv[on], minlength=len(vocab)), np.bincount(inv[~on], minlength=len(vocab))
    a1, a0 = n1 + 0.5, n0 + 0.5
    b1, b0 = toxic.sum() - n1 + 0.5, (~toxic).sum() - n0 + 0.5
    z = (np.log(a1 / b1) - np.log(a0 / b0)) / np.sqrt(1 / a1 + 1 / a0 + 1 / b1 + 1 / b0)
    good = np.flatnonzero((np.abs(z) >= MIN_Z) & (n1 + n0 >= MIN_TEXTS))
    good = good[np.argsort(-np.abs(z[good]), kind="stable")][:MAX_FEATURES]
    return np.sort(vocab[good])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """Cumulative-link model: word hashes, shared weights, thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, theta: np.ndarray):
        self.words, self.weights, self.theta = words, weights, theta

    @classmethod
    def fit(cls, words: np.ndarray, x: np.ndarray, grade: np.ndarray):
        """Full-batch Adam on the likelihood of grades 0 to K-1; thresholds
        stay ordered as a start and positive gaps."""
        k = int(grade.max(initial=0))
        if k == 0:
            return cls(words, np.zeros(x.shape[1]), np.full(1, 35.0))
        share = np.array([(grade > i).mean() for i in range(k)])
        theta = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
        p = np.concatenate([np.zeros(x.shape[1]), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        d, rows = x.shape[1], np.arange(len(grade))
        for step in range(1, STEPS + 1):
            gaps = np.exp(p[d + 1:])
            theta = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
            above = _sigmoid((x @ p[:d])[:, None] - theta)  # P(grade > k)
            full = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
            prob = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-12)
            slope = np.hstack([np.zeros((len(x), 1)), above * (1 - above), np.zeros((len(x), 1))])
            by_eta = -(slope[rows, grade] - slope[rows, grade + 1]) / prob
            by_theta = np.zeros((len(x), k + 2))
            by_theta[rows, grade] += slope[rows, grade] / prob
            by_theta[rows, grade + 1] -= slope[rows, grade + 1] / prob
            t = by_theta[:, 1:-1].mean(0)
            tail = np.cumsum(t[::-1])[::-1]
            grad = np.concatenate([x.T @ by_eta / len(x) + DECAY * p[:d], tail[:1], tail[1:] * gaps])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
            p = p - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        theta = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1:]))])
        return cls(words, p[:d], theta)

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return _sigmoid(eta[:, None] - self.theta)


def _table(words, counts, sizes, chosen: np.ndarray) -> np.ndarray:
    """log2(1 + count) of the chosen features and, last, of the words."""
    x = np.zeros((len(words), len(chosen) + 1))
    for i, (w, c) in enumerate(zip(words, counts)):
        _, at, of = np.intersect1d(chosen, w, assume_unique=True, return_indices=True)
        x[i, at] = c[of]
    x[:, -1] = sizes
    return np.log2(1 + x)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text") -> OrdinalModel:
    """Fit on at most TRAIN_PER_LABEL ids of each label (0 or 1), one text
    each: of rows that share an id the text with the smallest hash.  An id with
    both labels counts as toxic.

    Grades: 0 for clean rows; toxic rows are 1 or, with a larger share of
    words of the selected toxic kind than the middle toxic row, 2.  Without toxic or
    clean rows everything is predicted clean.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = sample_rows(rows, "label", TRAIN_PER_LABEL)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = one_text(texts.join(chosen, "doc_id"), ["doc_id", "label"]).select("label", "text").mapInArrow(
        _collect, "label int, words binary, counts binary, size long").toPandas()
    got = got.sort_values(["label", "words", "counts"])
    words = [np.frombuffer(w, U) for w in got["words"]]
    counts = [np.frombuffer(c, np.uint32) for c in got["counts"]]
    toxic = got["label"].to_numpy(int) == 1
    if not toxic.any() or toxic.all():
        return OrdinalModel(np.zeros(0, U), np.zeros(1), np.full(1, 35.0))
    picked = select_features(words, toxic)
    x = _table(words, counts, got["size"].to_numpy(), picked)
    kind = x[toxic].mean(0) > x[~toxic].mean(0)
    kind[-1] = False
    share = x[:, kind].sum(1) / np.maximum(x[:, -1], 1)
    grade = np.where(toxic, 1 + (share > np.median(share[toxic])), 0)
    return OrdinalModel.fit(picked, x, grade.astype(int))


@task
def _score(batches, model: OrdinalModel):
    schema = pa.schema([("expected_severity", pa.float64()), ("severity", pa.int32()), ("p_toxic", pa.float64()),
                        ("toxic", pa.bool_())])
    last = max(len(model.words) - 1, 0)
    for batch in batches:
        data, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        rest = batch.drop_columns(["text"])
        for lo, hi in slices(off):
            h, wo, heads = hash_words(data, off[lo:hi + 1], _WORD, PREFIXES)
            eta = np.log2(1 + np.diff(wo)) * model.weights[-1]
            if len(model.words):
                pairs = []
                for x in (h, *heads):
                    at = np.minimum(np.searchsorted(model.words, x), last)
                    hit = np.flatnonzero(model.words[at] == x)
                    pairs.append((np.searchsorted(wo, hit, "right") - 1) * (last + 1) + at[hit])
                pair, count = np.unique(np.concatenate(pairs), return_counts=True)
                value = model.weights[pair % (last + 1)] * np.log2(1 + count)
                eta = eta + np.bincount(pair // (last + 1), value, minlength=hi - lo)
            above = model.above(eta)
            full = np.hstack([np.ones((hi - lo, 1)), above, np.zeros((hi - lo, 1))])
            grade = (full[:, :-1] - full[:, 1:]).argmax(1)
            cols = [above.sum(1), grade.astype(np.int32), above[:, 0], above[:, 0] >= 0.5]
            yield pa.RecordBatch.from_arrays(
                [*rest.slice(lo, hi - lo).columns, *(pa.array(c, f.type) for c, f in zip(cols, schema))],
                names=[*rest.schema.names, *schema.names])


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, severity, p_toxic, toxic) for every row.
    A null or empty text holds no words and gets the model's prior."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(lambda it: _score(it, model), f"doc_id {kind}, expected_severity double, severity int, "
                           "p_toxic double, toxic boolean")
