"""Toxicity by a classifier chain over the labelled categories.

The categories are taken in order. Each has a linear model over a text's words; from the second on, the probabilities
of the earlier categories are features too. While learning, these come from models that have not seen the row
(``FOLDS`` folds), so the chain does not lean on what earlier models remember. When predicting, the chain runs forward.
The last category's model is fitted once, since nothing comes after it.

Bound: about ``max_rows`` labelled ids fit the models. Defined results: a null text is the empty text and gets the
chain's prior for it; rows without labels, or with null ones, aren't learnt from; of labels that contradict each other
the positive one counts, and an id is learnt from once, however often its row repeats; without labels every probability
is 0.5 and nothing is toxic. Ids may be of any type. Extra columns are passed over.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, drop_written, slices, written
from .linear import MAX_ROWS, PLAIN, Linear, blank, features, fit, labelled_sample, sigmoid, table_features, used_slots

FOLDS = 4


def default_chain() -> dict[str, Column]:
    return {"low_quality": (F.col("quality") == 0).cast("int"), "toxic": (F.col("toxic") == 1).cast("int")}


def _fit_fold(name: str, before: tuple[str, ...]):
    """Fits ``name`` without the fold ``leave``, and gives that fold's probabilities; or the model, where no row is in it."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        out = table["leave"][0].as_py()
        row, slot, plain = table_features(table)
        dense = np.concatenate([plain, np.stack([table[f"p_{b}"].to_numpy() for b in before], 1)], 1) if before else plain
        y = table[name].to_numpy().astype(float)
        learn = table["fold"].to_numpy() != out
        back = np.cumsum(learn) - 1
        use = learn[row]
        model = fit(back[row[use]], slot[use], dense[learn], y[learn])
        if out == FOLDS:
            return pa.table({"id": pa.array([None], pa.string()), "p": pa.array([None], pa.float64()), "model": pa.array([pickle.dumps(vars(model))], pa.binary())})
        p = sigmoid(model.logits(row, slot, dense)[~learn])
        return pa.table({"id": table["id"].filter(pa.array(~learn)).cast(pa.string()), "p": pa.array(p), "model": pa.array([None] * len(p), pa.binary())})

    return one


def train(docs: DataFrame, labels: DataFrame, chain: dict[str, Column] | None = None, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Linear]:
    """A model for each category, in order."""
    chain = chain or default_chain()
    rows = written(labelled_sample(docs, labels, chain, max_rows, id_col, text_col).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(FOLDS)).cast("int")), "labelled")
    models: dict[str, Linear] = {}
    before: list[str] = []
    for name in chain:
        last = len(models) + 1 == len(chain)
        # each fold's model leaves that fold out; the one that stays leaves none
        each = rows.withColumn("leave", F.lit(FOLDS) if last else F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        got = written(each.groupBy("leave").applyInArrow(_fit_fold(name, tuple(before)), "id string, p double, model binary"), "fits")
        found = got.where("model IS NOT NULL").select("model").collect()
        models[name] = Linear(**pickle.loads(found[0]["model"])) if found else blank(PLAIN + len(before))
        if not last:
            more = written(rows.join(got.where("model IS NULL").select("id", F.col("p").alias(f"p_{name}")), "id"), "labelled")
            drop_written(rows)
            rows = more
        drop_written(got)
        before.append(name)
    drop_written(rows)
    return models


def predict(docs: DataFrame, models: dict[str, Linear], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep``, ``p_<category>`` for each, and ``toxic`` (the last category's probability is over the threshold)."""
    names = [f"p_{c}" for c in models]
    # numbered names inside, so that none of ``keep`` can clash with the results
    source = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], clean_text(text_col).alias("_text"))
    kept = source.drop("_text").schema
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + ", ".join(f"_p{i} double" for i in range(len(names))) + ", _toxic boolean"
    chain = list(models.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = used_slots(chain)
        for part in slices(batches, "_text"):
            row, slot, dense = features(part.column("_text"), used)
            p = []
            for m in chain:
                p.append(sigmoid(m.logits(row, slot, dense)))
                dense = np.concatenate([dense, p[-1][:, None]], 1)
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *map(pa.array, p), pa.array(p[-1] > threshold)], names=[*kept.names, *(f"_p{i}" for i in range(len(p))), "_toxic"])

    found = source.mapInArrow(run, schema)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"_p{i}").alias(c) for i, c in enumerate(names)], F.col("_toxic").alias("toxic"))
