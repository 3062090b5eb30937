"""Mixing to target weights with soft domain membership.

A classifier learnt from the labelled table gives each document a posterior over the domains. Each document gets a
nonnegative rate (its expected number of uses), found by least squares: the expected tokens of each domain, the sum of
rate x tokens x posterior, should match the targets. Rates begin at 1 and move along the posteriors alone, so what the
targets leave free stays near 1.

The fit is projected gradient descent, distributed. The gradient of a document's rate is its posterior times the
mismatch of the domains' totals. A step takes it in the metric of the Gram matrix of the free documents (k x k numbers for
k domains), so that without a rate at its bound one step lands on the targets; rates at or near their bound that the
gradient pushes down are held at 0. Since a projected step in that metric need not descend, each step is chosen among
candidates that one pass measures together: metrics from the Gram matrix to the plain Euclidean one, several lengths,
and several widths of what counts as near the bound. The short Euclidean ones lower the mismatch wherever it can be lowered.
No rate is stored or moved: a document's rate is replayed from the history of steps, and a step is two sums over the
documents. The descent ends when every domain is within ``tolerance`` of its own target, or when the projected gradient
vanishes or no candidate lowers the mismatch: the targets then can't be reached, which ``Fit.converged`` tells and a
warning says; ``strict`` makes it an error.

Bound: about ``max_rows`` labelled ids fit the classifier; the history has one number a domain and step. Defined
results: a null text has no tokens and weighs nothing, but has a rate; without labels all domains are equally likely;
labels that contradict each other count as the domain that sorts last; repeated rows get equal rates; an empty table
gives an empty result. Extra columns stay.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, drop_written, slices, word_counts, written
from .linear import MAX_ROWS, Linear, features, fit, labelled_sample, sigmoid, table_features, used_slots

#: Largest mismatch of a domain in parts of its own target.
TOLERANCE = 1e-4
#: Candidates of a step: rates that count as at their bound, shares of the Euclidean metric, and lengths.
NEAR, EUCLIDEAN, LENGTHS = (0.0, 1e-3, 3e-2), (0.0, 1e-6, 1e-4, 1e-3, 1e-2, 1e-1, 1.0), (1.0, 0.25, 1 / 16, 4.0, 16.0)


def default_domain() -> Column:
    """The domain that a row of ``labels`` tells; null where it tells none."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "rough").when(F.col("quality") == 1, "good")


@dataclass
class Domains:
    """One-against-rest models; their probabilities are normalised."""

    names: list[str]
    models: list[Linear]

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        row, slot, dense = features(texts, used_slots([m for m in self.models if m is not None]))
        p = np.stack([sigmoid(m.logits(row, slot, dense)) for m in self.models], 1) if any(m is not None for m in self.models) else np.ones((len(texts), len(self.names)))
        return p / p.sum(1, keepdims=True)


def learn_domains(docs: DataFrame, labels: DataFrame, names: list[str], domain: Column | None = None, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Domains:
    domain = default_domain() if domain is None else domain
    sample = written(labelled_sample(docs, labels, {"domain": domain}, max_rows, id_col, text_col), "labelled")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        name = table["class"][0].as_py()
        row, slot, dense = table_features(table)
        y = np.array([d == name for d in table["domain"].to_pylist()], float)
        return pa.table({"class": [name], "model": pa.array([pickle.dumps(vars(fit(row, slot, dense, y)))], pa.binary())})

    each = sample.withColumn("class", F.explode(F.array(*[F.lit(n) for n in names])))
    found = {r["class"]: Linear(**pickle.loads(r["model"])) for r in each.groupBy("class").applyInArrow(one, "class string, model binary").collect()}
    drop_written(sample)
    return Domains(names, [found.get(n) for n in names])


@dataclass
class Step:
    """``mismatch`` says which rates up to ``near`` are held at 0; the others move by their posterior times ``move``."""

    mismatch: np.ndarray
    move: np.ndarray
    near: float

    def apply(self, r: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.where((r <= self.near) & (p @ self.mismatch > 0), 0.0, np.maximum(0.0, r - p @ self.move))


@dataclass
class Descent:
    """A document's rate after the steps so far, from its posterior and the history of steps."""

    history: list[Step] = field(default_factory=list)

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for step in self.history:
            r = step.apply(r, p)
        return r


@dataclass
class Fit:
    """``target`` and ``reached`` tokens by domain; whether each is within the tolerance of its own target."""

    descent: Descent
    target: dict[str, float]
    reached: dict[str, float]
    converged: bool


def totals(r: np.ndarray, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected tokens by domain."""
    return (w * r) @ p


def grams(r: np.ndarray, w: np.ndarray, p: np.ndarray, mismatch: np.ndarray) -> np.ndarray:
    """Rows of the Gram matrices of all documents and of the free ones for each width, then the projected gradient's square (first entry)."""
    k = p.shape[1]
    g = p @ mismatch
    out = [p.T @ (p * (w * free)[:, None]) for free in (np.ones(len(r)), *(~((r <= near) & (g > 0)) for near in NEAR))]
    still = np.zeros((1, k))
    still[0, 0] = np.sum(w * (r - np.maximum(0, r - g)) ** 2)
    return np.concatenate([*out, still])


def candidates(gram: np.ndarray, mismatch: np.ndarray) -> list[Step]:
    """Steps to be measured, from what ``grams`` tells (in shares)."""
    k = len(mismatch)
    whole, free = gram[:k], gram[k:-1].reshape(len(NEAR), k, k)
    top = max(float(np.linalg.eigvalsh(whole)[-1]), 1e-300)
    out = []
    for near, g in zip(NEAR, free, strict=True):
        for part in EUCLIDEAN:
            move = np.linalg.lstsq(g + part * top * np.eye(k), mismatch, rcond=1e-12)[0]
            out += [Step(mismatch, length * move, near) for length in LENGTHS]
    return out


def descend(measure, share: np.ndarray, tolerance: float = TOLERANCE) -> tuple[Descent, np.ndarray, bool]:
    """The descent, the shares it reached, and whether each is within the tolerance of its target.

    ``measure(descent, function)`` is the sum over all documents of ``function(rates, weights, posteriors)``, an array, in
    parts of all tokens.
    """
    least = 1e-9 / len(share)
    off = lambda t: float((np.abs(t - share) / np.maximum(share, least)).max())
    descent = Descent()
    reached = measure(descent, lambda r, w, p: totals(r, w, p)[None])[0]
    while off(reached) > tolerance:
        mismatch = reached - share
        size = float(np.linalg.norm(mismatch))
        gram = measure(descent, lambda r, w, p, m=mismatch: grams(r, w, p, m))
        if gram[-1, 0] <= 1e-13 * size**2:  # nothing that is allowed lowers the mismatch
            return descent, reached, False
        steps = candidates(gram, mismatch)
        got = measure(descent, lambda r, w, p, s=steps: np.stack([totals(x.apply(r, p), w, p) for x in s]))
        left = np.linalg.norm(got - share, axis=1)
        best = int(left.argmin())
        if left[best] >= size * (1 - 1e-9):
            return descent, reached, False
        descent, reached = Descent([*descent.history, steps[best]]), got[best]
    return descent, reached, True


def fit_rates(docs: DataFrame, domains: Domains, targets: dict[str, float], tolerance: float = TOLERANCE, text_col: str = "text", strict: bool = False) -> Fit:
    """The descent and what it reached. Targets are shares of the corpus's tokens."""
    k = len(domains.names)
    schema = "w double, " + ", ".join(f"p{i} double" for i in range(k))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text = part.column("text")
            p = domains.posteriors(text)
            yield pa.RecordBatch.from_arrays([pa.array(word_counts(text).astype(float)), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(k))], names=["w", *(f"p{i}" for i in range(k))])

    small = written(docs.select(clean_text(text_col).alias("text")).mapInArrow(weigh, schema), "weights")
    total = small.agg(F.sum("w")).first()[0] or 0.0
    share = np.array([targets[n] for n in domains.names], float)
    share /= share.sum()

    def measure(descent: Descent, function) -> np.ndarray:
        """Each task sums over its documents; a row of k numbers at each place comes out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    w = batch.column(0).to_numpy(zero_copy_only=False)
                    p = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)], 1)
                    part = function(descent.rates(p), w, p)
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(k))], names=["d", *(f"c{i}" for i in range(k))])

        rows = small.mapInArrow(run, "d int, " + ", ".join(f"c{i} double" for i in range(k))).groupBy("d").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).collect()
        return np.array([list(r)[1:] for r in sorted(rows)]) / total

    descent, reached, converged = descend(measure, share, tolerance) if total else (Descent(), np.zeros(k), True)
    drop_written(small)
    if not converged:
        said = f"domain targets aren't reached: {dict(zip(domains.names, share.tolist(), strict=True))} wanted, {dict(zip(domains.names, reached.tolist(), strict=True))} reached"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    told = lambda t: {n: float(x * total) for n, x in zip(domains.names, t, strict=True)}
    return Fit(descent, told(share), told(reached), converged)


def with_rates(docs: DataFrame, domains: Domains, descent: Descent, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, a posterior ``p_<domain>`` for each domain, and ``rate``; columns of these names are replaced."""
    docs = docs.drop("n_tokens", "rate", *[f"p_{n}" for n in domains.names])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), clean_text(text_col).alias("_text"))
    names = [f"p_{n}" for n in domains.names]
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_tokens long, " + ", ".join(f"`{c}` double" for c in names) + ", rate double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            text = part.column("_text")
            p = domains.posteriors(text)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(word_counts(text).astype(np.int64)), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names))), pa.array(descent.rates(p))], names=["_row", "n_tokens", *names, "rate"])

    return rows.mapInArrow(run, schema).select("_row.*", "n_tokens", *names, "rate")


@dataclass
class Mixed:
    rows: DataFrame
    fit: Fit


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", **options) -> Mixed:
    """Learns the domains from ``labels`` and fits the rates to ``targets``: ``with_rates``, and what the fit reached."""
    domains = learn_domains(docs, labels, list(targets), id_col=id_col, text_col=text_col)
    found = fit_rates(docs, domains, targets, text_col=text_col, **options)
    return Mixed(with_rates(docs, domains, found.descent, text_col), found)
