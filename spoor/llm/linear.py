"""Linear text classifiers: which words a text has, and a few proportions of its characters.

A classifier is fitted on a bounded sample of labelled rows (``max_rows``, drawn evenly by a hash of the id), so each
fit is one task; fits for different folds or classes are tasks of their own. Texts become sparse features where they
lie, and only these move. A model is ``DIMS`` weights at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, distinct, doc_of, slices, text_bytes, words

DIMS = 1 << 18
MAX_ROWS = 20_000
#: Words that differ less than this many standard deviations between the classes are left out, as are rare ones.
LEAST_Z, LEAST_DF = 4.0, 3
PLAIN = 8

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[:48] = _TABLE[58:65] = _TABLE[91:97] = _TABLE[123:128] = 32
_MARKS = np.zeros(256, bool)
_MARKS[np.frombuffer(b"#*$%&<>", np.uint8)] = True


def features(texts: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word slot) pairs, in order, and ``PLAIN`` proportions of each text.

    ``used`` tells for each slot whether its pairs are wanted, as ``used_slots`` does for models.
    """
    n = len(texts)
    w = words(texts, table=_TABLE)
    doc, slot = doc_of(w.offsets), (w.hash >> np.uint64(46)).astype(np.int64)
    if used is not None:
        at = np.flatnonzero(used[slot])
        doc, slot = doc[at], slot[at]
    pairs = distinct(doc * DIMS + slot)
    data, off = text_bytes(texts)
    size = np.maximum(np.diff(off), 1)
    share = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), off)) / size
    count = np.diff(w.offsets)
    plain = [np.log1p(count), share((data - np.uint8(65)) < 26), share(_MARKS[data]), share((data - np.uint8(48)) < 10), share(data == 33), share(data == 124), share(data == 10), size / np.maximum(count, 1) / 10]
    return pairs // DIMS, pairs % DIMS, np.stack(plain, 1) if n else np.zeros((0, PLAIN))


@dataclass
class Linear:
    slots: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    bias: float

    def logits(self, row: np.ndarray, slot: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if len(self.slots):
            at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            hit = self.slots[at] == slot
            z = np.bincount(row[hit], weights=self.weights[at[hit]], minlength=len(dense))
        else:
            z = np.zeros(len(dense))
        return z + np.clip((dense - self.mean) / self.scale, -5, 5) @ self.dense + self.bias


def blank(width: int) -> Linear:
    """The model that knows nothing: every probability is a half."""
    return Linear(np.empty(0, np.int64), np.empty(0), np.zeros(width), np.ones(width), np.zeros(width), 0.0)


def used_slots(models: list[Linear]) -> np.ndarray:
    """For each slot, whether any of the models weighs it."""
    used = np.zeros(DIMS, bool)
    for m in models:
        used[m.slots] = True
    return used


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(row: np.ndarray, slot: np.ndarray, dense: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.1, penalty: float = 3e-5) -> Linear:
    """Logistic regression by full-batch Adam on the words that tell the classes apart, and ``dense``."""
    n = len(y)
    pi = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if n else 0.5
    df = np.bincount(slot, minlength=DIMS).astype(float)
    of = np.bincount(slot, weights=y[row], minlength=DIMS)
    z = (of - df * pi) / np.sqrt(df * pi * (1 - pi) + 1e-9)
    slots = np.flatnonzero((np.abs(z) >= LEAST_Z) & (df >= LEAST_DF))
    place = np.full(DIMS, -1)
    place[slots] = np.arange(len(slots))
    use = place[slot] >= 0
    r, c = row[use], place[slot[use]]
    mean, scale = (dense.mean(0), dense.std(0) + 1e-6) if n else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    d = np.clip((dense - mean) / scale, -5, 5)
    k = len(slots)
    w = np.zeros(k + d.shape[1] + 1)
    w[-1] = np.log(pi / (1 - pi))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1 if n else 1):
        out = sigmoid(np.bincount(r, weights=w[:k][c], minlength=n) + d @ w[k:-1] + w[-1]) - y
        g = np.concatenate([np.bincount(c, weights=out[r], minlength=k), out @ d, [out.sum()]]) / n
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(slots, w[:k], mean, scale, w[k:-1], float(w[-1]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        row, slot, plain = features(part.column("text"))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32)))
        dense = pa.ListArray.from_arrays(pa.array(np.arange(0, plain.size + 1, PLAIN, dtype=np.int32)), pa.array(plain.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), lists, dense], names=["id", "h", "slots", "plain"])


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (as text), ``slots, plain`` and the target columns of about ``max_rows`` labelled ids at most, a row each.

    Of labels that contradict each other the greatest counts; of texts that share an id the one with the least hash.
    The sample of labels is bounded by ``max_rows`` rows of a few numbers, so it is broadcast; the texts stay in place.
    """
    named = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), *[c.alias(k) for k, c in targets.items()]).dropna()
    known = named.groupBy("id").agg(*[F.max(k).alias(k) for k in targets])
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    text = clean_text(text_col)
    there = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).join(F.broadcast(known.select("id")), "id", "left_semi")
    found = there.mapInArrow(_featured, "id string, h long, slots array<int>, plain array<double>").groupBy("id").agg(F.min(F.struct("h", "slots", "plain")).alias("x"))
    return found.join(F.broadcast(known), "id").select("id", "x.slots", "x.plain", *targets)


def table_features(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of a group of ``labelled_sample`` rows."""
    table = table.combine_chunks()
    n = table.num_rows
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros((0, PLAIN))
    slots, plain = (table[c].combine_chunks() for c in ("slots", "plain"))
    slots, plain = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (slots, plain))
    sizes = np.diff(slots.offsets.to_numpy())
    return np.repeat(np.arange(n), sizes), slots.flatten().to_numpy().astype(np.int64), plain.flatten().to_numpy().reshape(n, PLAIN)
