"""Language identification with string kernels.

Kernel: the blended-spectrum presence kernel, the cosine of the sets of byte
n-grams (1 to 3, letters only, A-Z folded) of two texts.  Nystroem landmarks
give every text a short vector of kernel values; one-versus-rest kernel ridge
regression on it is one more matrix product.  So a batch of texts is scored by
presence table (texts x grams) @ landmarks @ coefficients.  The sets are
hashed into ``DIM`` places; whole texts are read, in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import column, one_text, record_batch, sample_rows, slices, task, text_buffers

DIM = 1 << 14
#: the fit reads at most this many labelled texts of each language
TRAIN_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-3
#: likeness below this share of the labelled sample's first percentile is foreign
FOREIGN = 0.5
BATCH_TEXTS, BATCH_BYTES = 256, 2 << 20
#: bytes whose n-grams are hashed at once
PIECE_BYTES = 1 << 18

_CODE = np.zeros(256, np.uint32)  # 0: no letter
_CODE[0x80:] = np.arange(0x80, 0x100)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(0x61, 0x7B)


def _hash(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - 14)


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts x DIM) table of the n-grams that each text holds."""
    table = np.zeros((len(off) - 1, DIM), np.bool_)
    flat = table.reshape(-1)
    # in pieces that overlap by two bytes, to bound memory
    for lo in range(int(off[0]), int(off[-1]), PIECE_BYTES):
        hi = min(lo + PIECE_BYTES + 2, int(off[-1]))
        c = _CODE[data[lo:hi]]
        row = (np.searchsorted(off, np.arange(lo, hi), "right") - 1).astype(np.int32)
        place = row.astype(np.int64) * DIM
        flat[(place + _hash(c + np.uint32(1)))[c > 0]] = True
        if len(c) > 1:
            two = c[:-1] * np.uint32(256) + c[1:]
            ok = (row[:-1] == row[1:]) & (two > 0)
            flat[(place[:-1] + _hash(two + np.uint32(1 << 20)))[ok]] = True
            if len(c) > 2:
                three = two[:-1] * np.uint32(256) + c[2:]
                ok = ok[:-1] & (row[1:-1] == row[2:])
                flat[(place[:-2] + _hash(three + np.uint32(1 << 27)))[ok]] = True
    return table


def kernel(table: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Cosines of gram sets: (texts x landmarks), 0 for an empty set."""
    x = table.astype(np.float32)
    size = np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    return (x @ landmarks.T) / size


def letter_share(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of letter bytes in the bytes above the space, of each text."""
    out = np.zeros(len(off) - 1)
    for i in range(len(out)):
        text = data[off[i]:off[i + 1]]
        out[i] = np.count_nonzero(_CODE[text]) / max(1, np.count_nonzero(text > 0x20))
    return out


def _spread(table: np.ndarray) -> np.ndarray:
    x = table.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class KernelRidge:
    """One-versus-rest ridge regression on Nystroem features."""

    def __init__(self, tables: np.ndarray, labels: list[str], letters: np.ndarray):
        self.classes = sorted(set(labels))
        y = np.array([self.classes.index(x) for x in labels], int)
        first = [np.flatnonzero(y == k)[:LANDMARKS_PER_LANGUAGE] for k in range(len(self.classes))]
        z = _spread(tables[np.concatenate(first)]) if self.classes else np.zeros((0, DIM), np.float32)
        self.landmarks = z
        self.floor = 0.0
        if not self.classes:
            return
        value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = kernel(tables, z).astype(np.float64) @ root
        mean = phi.mean(0)
        target = np.where(y[:, None] == np.arange(len(self.classes)), 1.0, -1.0)
        base = target.mean(0)
        gram = (phi - mean).T @ (phi - mean) + RIDGE * len(y) * np.eye(phi.shape[1])
        beta = np.linalg.solve(gram, (phi - mean).T @ (target - base))
        self.coef = (root @ beta).astype(np.float32)
        self.bias = base - mean @ beta
        near = kernel(tables, z)
        near[np.concatenate(first), np.arange(len(z))] = 0  # a landmark is no witness for itself
        size = tables.sum(1)
        self.size = float(np.median(size))
        if (letters > 0).any():
            self.floor = FOREIGN * float(np.percentile(self._like(near, size, letters)[letters > 0], 1))

    def _like(self, near, size, letters) -> np.ndarray:
        return near.max(1) / np.sqrt(np.clip(size / self.size, 1e-9, 1)) * letters

    def likeness(self, table: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Largest kernel value against a landmark, relative to what a text
        of so few grams can reach, times the share of letters; however many
        classes there are, it falls for other scripts and for gibberish."""
        return self._like(kernel(table, self.landmarks), table.sum(1), letters)

    def decide(self, table: np.ndarray) -> np.ndarray:
        """(texts x classes) regression values, near 1 for the own class."""
        return kernel(table, self.landmarks) @ self.coef + self.bias


@task
def _grams(batches):
    schema = pa.schema([("label", pa.string()), ("grams", pa.binary()), ("letters", pa.float64())])
    for batch in batches:
        data, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        label = column(batch, "label")
        for lo, hi in _batches(off):
            bits = np.packbits(presence(data, off[lo:hi + 1]), axis=1)
            yield record_batch(schema, list(zip(label[lo:hi], [b.tobytes() for b in bits], letter_share(data, off[lo:hi + 1]).tolist())))


def _batches(off):
    for lo, hi in slices(off, BATCH_BYTES):
        for k in range(lo, hi, BATCH_TEXTS):
            yield k, min(k + BATCH_TEXTS, hi)


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> KernelRidge:
    """Fit on at most TRAIN_PER_LANGUAGE ids of each non-null label (those
    with the smallest hashes), one text each: of the rows that share id and
    label the text with the smallest hash.  Null ids are not sampled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    chosen = sample_rows(rows, "label", TRAIN_PER_LANGUAGE)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    texts = one_text(texts.join(chosen, ["doc_id", "label"], "left_semi"), ["doc_id", "label"]).select("label", "text")
    got = texts.mapInArrow(_grams, "label string, grams binary, letters double").toPandas().sort_values(["label", "grams"])
    table = np.array([np.unpackbits(np.frombuffer(g, np.uint8)) for g in got["grams"]], bool).reshape(-1, DIM)
    return KernelRidge(table, got["label"].tolist(), got["letters"].to_numpy(float))


@task
def _predict(batches, model: KernelRidge, keep_text: bool):
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("likeness", pa.float64())])
    for batch in batches:
        data, off = text_buffers(batch.column(batch.schema.get_field_index("text")))
        letters = np.array(column(batch, "has_letter"), bool)
        rest = batch.drop_columns(["has_letter"] if keep_text else ["text", "has_letter"])
        for lo, hi in _batches(off):
            if model.classes:
                grams = presence(data, off[lo:hi + 1])
                value, like = model.decide(grams), model.likeness(grams, letter_share(data, off[lo:hi + 1]))
                best = value.argmax(1)
                score = np.clip((value[np.arange(hi - lo), best] + 1) / 2, 0, 1)
                rows = [(model.classes[b], float(s), float(k)) if ok else ("und", 0.0, 0.0)
                        for b, s, k, ok in zip(best, score, like, letters[lo:hi])]
            else:
                rows = [("und", 0.0, 0.0)] * (hi - lo)
            out = record_batch(schema, rows)
            yield pa.RecordBatch.from_arrays([*rest.slice(lo, hi - lo).columns, *out.columns],
                                             names=[*rest.schema.names, "lang_pred", "score", "likeness"])


def predict(docs: DataFrame, model: KernelRidge, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text, null as empty, only if
    ``keep_text``) with (lang_pred, score, likeness) for every row; ``und`` with zeros
    if the text is null or has no letter, or if the model saw no labels.
    Columns of ``docs`` called lang_pred, score, likeness or has_letter are left out."""
    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "likeness", "has_letter")]
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(*keep, t.alias("text"), t.rlike(r"\p{L}").alias("has_letter"))
    kept = base.drop("has_letter") if keep_text else base.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return base.mapInArrow(lambda it: _predict(it, model, keep_text), f"{fields}, lang_pred string, score double, likeness double")
