"""HTML extraction: a bidirectional LSTM labels every leaf block of a page as main text or not, from the whole page.

A block is the mean vector of the hashed names on its path of elements, the mean vector of its hashed words, and a
few numbers (length, share of links, kinds of characters). Both directions of the LSTM read all blocks of the page, and
an output of both says how likely the block is main text. Blocks of 0.5 and more are joined in page order.

No page has labels, so the labeller learns from layouts that are made around texts of real pages (``html_layouts``), whose
blocks are labelled by construction. Bound: texts of at most ``sample`` pages of at most ``page_bytes`` bytes, drawn by
hash, fill ``layouts`` training pages; equal tables give equal models.

Defined results: a null or empty page has an empty text and no blocks. Repeated rows get equal results. An empty table gives an
empty result, and a model fitted on one still labels pages. Extra columns are kept; those with names of results are replaced.
A page goes through whole, whatever its length, in memory proportional to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, clean_text, slices, words
from .html_blocks import PATH_BINS, blocks
from .html_layouts import MARK, Layouts, marked

WORD_BINS, EMBED, HIDDEN = 1024, 16, 20
NUMBERS = 8
#: Html bytes that a task labels at once, and blocks padded to one length at most in one pass.
SLICE, PADDED = 1_000_000, 40_000


@dataclass
class Features:
    """Blocks of some pages: hashed names and words with the range of each block, numbers, and each page's range of blocks."""

    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    numbers: np.ndarray
    pages: np.ndarray


def features(found: list[list[tuple[str, tuple[int, ...], float]]]) -> Features:
    flat = [b for page in found for b in page]
    w: Words = words(pa.array([b[0] for b in flat], pa.large_string()), lower=True)
    sizes = np.array([len(b[1]) for b in flat], np.int64)
    path = np.fromiter((x for b in flat for x in b[1]), np.int64, int(sizes.sum()))
    off = np.append(0, np.cumsum([len(b[0].encode("utf-8", "replace")) for b in flat])).astype(np.int64)

    def share(kind: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(kind))
        return (c[off[1:]] - c[off[:-1]]) / np.maximum(1, np.diff(off))

    d = w.data
    n_words = np.diff(w.offsets)
    size = np.diff(off)
    letter = ((d | 32) - np.uint8(97)) < 26
    last = d[off[1:] - 1] if len(flat) else d
    numbers = np.stack(
        [
            np.log1p(size) / 6,
            np.log1p(n_words) / 5,
            np.array([b[2] for b in flat]),
            share((d - np.uint8(48)) < 10),
            share((d < 48) & (d > 32)),
            share(letter),
            np.isin(last, np.frombuffer(b".!?:", np.uint8)).astype(float),
            np.minimum(1, n_words / 40),
        ],
        1,
    ) if len(flat) else np.zeros((0, NUMBERS))
    return Features(path, np.append(0, np.cumsum(sizes)), (w.hash % np.uint64(WORD_BINS)).astype(np.int64), w.offsets, numbers, np.append(0, np.cumsum([len(p) for p in found])).astype(np.int64))


def _means(table: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each range of ``which``; zero for an empty one."""
    out = np.zeros((len(at) - 1, table.shape[1]), table.dtype)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(table[which], at[some]) / np.diff(at)[some, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Labeller:
    """Weights by name: path and word vectors, an LSTM each way, and the output."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        g = np.random.default_rng(seed)
        wide = 2 * EMBED + NUMBERS
        w = {"path": g.normal(0, 0.5, (PATH_BINS, EMBED)), "word": g.normal(0, 0.3, (WORD_BINS, EMBED)), "out": g.normal(0, 0.3, (2 * HIDDEN,)), "bias": np.zeros(1)}
        for way in ("ahead", "back"):
            w[f"{way}_x"] = g.normal(0, wide**-0.5, (wide, 4 * HIDDEN))
            w[f"{way}_h"] = g.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w[f"{way}_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def inputs(self, f: Features) -> np.ndarray:
        return np.concatenate([_means(self.weights["path"], f.path, f.path_at), _means(self.weights["word"], f.word, f.word_at), f.numbers.astype(np.float32)], 1)

    def _run(self, way: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step of x (steps, pages, inputs), and what going back through them needs."""
        w_h = self.weights[f"{way}_h"]
        drive = x @ self.weights[f"{way}_x"] + self.weights[f"{way}_b"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        states, trace = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            z = drive[t] + h @ w_h
            gate = _sigmoid(z[:, : 3 * HIDDEN])  # input, forget, output
            new = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * new
            bent = np.tanh(c)
            if keep:
                trace.append((h, before, gate, new, bent))
            h = gate[:, 2 * HIDDEN :] * bent
            states[t] = h
        return states, trace

    def logits(self, x: np.ndarray, flip: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Of padded pages x (steps, pages, inputs); ``flip`` has for each step and page the step it is when read backwards."""
        page = np.arange(x.shape[1])
        ahead, trace_a = self._run("ahead", x, keep)
        back, trace_b = self._run("back", x[flip, page], keep)
        both = np.concatenate([ahead, back[flip, page]], 2)
        return both @ self.weights["out"] + self.weights["bias"][0], (both, trace_a, trace_b)

    def probabilities(self, f: Features) -> np.ndarray:
        """How likely each block is main text; pages of like length are read side by side."""
        x = self.inputs(f)
        size = np.diff(f.pages)
        out = np.zeros(len(x))
        order = np.argsort(size, kind="stable")[::-1]
        order = order[size[order] > 0]
        while len(order):
            some = order[: max(1, PADDED // int(size[order[0]]))]
            order = order[len(some) :]
            where, flip, real = padded(f.pages[some], size[some])
            z, _ = self.logits(x[where], flip)
            out[where[real]] = _sigmoid(z[real].astype(float))
        return out


def padded(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For steps x pages: the block read, the step when read backwards, and whether there is one (else a page's first is repeated)."""
    step = np.arange(int(size.max()))[:, None]
    real = step < size
    flip = np.where(real, size - 1 - step, step)
    return start + np.where(real, step, 0), flip, real


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, slope: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in slope.values()))
        for k, g in slope.items():
            g = g * min(1.0, 5 / max(norm, 1e-9))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.005 * (g * g - self.v[k])
            self.weights[k] -= rate * (self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.995**self.t)) + 1e-8)).astype(np.float32)


def _back_run(model: Labeller, way: str, x: np.ndarray, trace: list, d_states: np.ndarray, slope: dict[str, np.ndarray]) -> np.ndarray:
    """Slopes of one direction's weights, added to ``slope``, and of its inputs."""
    w_h = model.weights[f"{way}_h"]
    d_h, d_c = np.zeros(d_states.shape[1:], np.float32), np.zeros(d_states.shape[1:], np.float32)
    d_z = np.empty((*d_states.shape[:2], 4 * HIDDEN), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, before, gate, new, bent = trace[t]
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        d_h = d_h + d_states[t]
        d_c = d_c + d_h * o * (1 - bent**2)
        z = d_z[t]
        z[:, :HIDDEN] = d_c * new * i * (1 - i)
        z[:, HIDDEN : 2 * HIDDEN] = d_c * before * f * (1 - f)
        z[:, 2 * HIDDEN : 3 * HIDDEN] = d_h * bent * o * (1 - o)
        z[:, 3 * HIDDEN :] = d_c * i * (1 - new**2)
        slope[f"{way}_h"] += h.T @ z
        d_h, d_c = z @ w_h.T, d_c * f
    flat = d_z.reshape(-1, 4 * HIDDEN)
    slope[f"{way}_x"] += x.reshape(len(flat), -1).T @ flat
    slope[f"{way}_b"] += flat.sum(0)
    return d_z @ model.weights[f"{way}_x"].T


def slopes(model: Labeller, f: Features, labels: np.ndarray, some: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the blocks of some pages, and its slope for every weight."""
    x = model.inputs(f)
    where, flip, real = padded(f.pages[some], np.diff(f.pages)[some])
    page = np.arange(len(some))
    inside = x[where]
    z, (both, trace_a, trace_b) = model.logits(inside, flip, keep=True)
    y = labels[where]
    n = max(1, int(real.sum()))
    loss = float(np.where(real, np.logaddexp(0, z) - y * z, 0).sum() / n)
    d = (np.where(real, _sigmoid(z) - y, 0) / n).astype(np.float32)
    slope = {k: np.zeros_like(v) for k, v in model.weights.items()}
    slope["out"] += np.tensordot(d, both, ([0, 1], [0, 1]))
    slope["bias"] += d.sum()
    d_both = d[..., None] * model.weights["out"]
    d_x = _back_run(model, "ahead", inside, trace_a, d_both[..., :HIDDEN], slope)
    d_back = _back_run(model, "back", inside[flip, page], trace_b, d_both[..., HIDDEN:][flip, page], slope)
    d_x = d_x + d_back[flip, page]
    d_block = np.zeros((len(x), x.shape[1]), np.float32)
    d_block[where[real]] = d_x[real]
    for name, which, at, cols in (("path", f.path, f.path_at, slice(0, EMBED)), ("word", f.word, f.word_at, slice(EMBED, 2 * EMBED))):
        count = np.diff(at)
        each = d_block[:, cols] / np.maximum(1, count)[:, None]
        for k in range(EMBED):
            slope[name][:, k] += np.bincount(which, weights=np.repeat(each[:, k], count), minlength=len(slope[name]))
    return loss, slope


def train(pages: list[str], epochs: int = 8, batch: int = 32, rate: float = 0.012, seed: int = 0) -> Labeller:
    """A labeller learnt from pages whose article texts are marked."""
    found = [blocks(p) for p in pages]
    labels = np.array([float(MARK in b[0]) for page in found for b in page])
    f = features([[(b[0].replace(MARK, ""), *b[1:]) for b in page] for page in found])
    model = Labeller.fresh(seed)
    adam = _Adam(model.weights, rate)
    g = np.random.default_rng(seed)
    size = np.diff(f.pages)
    usable = np.flatnonzero(size)
    steps = epochs * -(-len(usable) // batch)
    for _ in range(epochs):
        # pages of like length side by side, batches in random order
        order = usable[np.argsort(size[usable] + g.random(len(usable)) * 8, kind="stable")]
        for first in g.permutation(np.arange(0, len(order), batch)):
            some = order[first : first + batch]
            _, slope = slopes(model, _part(f, some), _labels_of(f, labels, some), np.arange(len(some)))
            adam.step(slope, rate * (1 - adam.t / (steps + 1)))
    return model


def _rows(at: np.ndarray, some: np.ndarray) -> np.ndarray:
    size = np.diff(at)[some]
    return np.repeat(at[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))


def _part(f: Features, some: np.ndarray) -> Features:
    """Features of some pages alone."""
    b = _rows(f.pages, some)
    ends = lambda at, which: np.append(0, np.cumsum(np.diff(at)[which]))
    return Features(f.path[_rows(f.path_at, b)], ends(f.path_at, b), f.word[_rows(f.word_at, b)], ends(f.word_at, b), f.numbers[b], ends(f.pages, some))


def _labels_of(f: Features, labels: np.ndarray, some: np.ndarray) -> np.ndarray:
    return labels[_rows(f.pages, some)]


def fit(pages: DataFrame, sample: int = 200, page_bytes: int = 50_000, layouts: int = 1500, seed: int = 0, html_col: str = "html") -> Labeller:
    """A labeller for pages like those of the table: its texts fill the training layouts."""
    text = clean_text(html_col)
    drawn = pages.select(text.alias("html")).where((F.octet_length(text) <= page_bytes) & (F.octet_length(text) > 0)).withColumn("h", F.xxhash64("html"))
    # about four times the sample by hash, each text once, before any row leaves its task
    rate = min(1.0, 4 * sample / max(1, pages.count()))
    drawn = drawn.where(F.pmod("h", F.lit(1_000_000)) < math.ceil(1_000_000 * rate)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(sample)
    texts = [b[0] for r in drawn.collect() for b in blocks(r["html"])]
    make = Layouts([t for t in texts if " " in t], [w for t in texts for w in t.split()[:3]], seed)
    return train([marked(make.page()) for _ in range(layouts)], seed=seed)


def label_blocks(model: Labeller, pages: list[str | None]) -> list[list[tuple[str, float]]]:
    """Text and probability of every block of each page."""
    found = [blocks(p) for p in pages]
    p = model.probabilities(features(found)) if any(found) else np.empty(0)
    ends = np.cumsum([len(x) for x in found])
    return [[(b[0], float(v)) for b, v in zip(x, p[end - len(x) : end], strict=True)] for x, end in zip(found, ends, strict=True)]


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main-text blocks, one a line), ``n_blocks`` and ``n_kept`` of every row."""
    pages = pages.drop("text", "n_blocks", "n_kept") if html_col not in ("text", "n_blocks", "n_kept") else pages
    # a fixed number of weights, whatever the tables
    shared = pages.sparkSession.sparkContext.broadcast(model.weights)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), clean_text(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for part in slices(batches, "_html", SLICE):
            labelled = label_blocks(labeller, part.column("_html").to_pylist())
            kept = [[t for t, p in page if p >= 0.5] for page in labelled]
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(["\n".join(k) for k in kept], pa.string()), pa.array([len(x) for x in labelled], pa.int64()), pa.array([len(k) for k in kept], pa.int64())], names=["_row", "text", "n_blocks", "n_kept"])

    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])
    return rows.mapInArrow(run, schema).select("_row.*", "text", "n_blocks", "n_kept")
