"""Language identification by the nearest of several centroids a language.

A text becomes a vector of hashed byte n-grams of its lower-cased letters: 1 + log(count), weighted by inverse document
frequency over all learning texts, of unit length. Spherical k-means on a bounded, even sample of each language's texts
gives its centroids. A text gets the language of the centroid with the highest cosine; one that is farther from it than
nearly all of that centroid's own texts were is flagged as rejected.

Bound: at most about twice ``per_language`` distinct texts a language fit the centroids, each weighted by the rows it
stands for; floors are over distinct texts. Document frequencies cover all learning rows. A language with any text of
three bytes, a letter among them, has a centroid.
Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learnt.
Equal cosines go to the language that sorts first. Repeated rows are learnt from each, by weight. Extra columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, slices, text_bytes, written

UNKNOWN = "und"
DIMS = 4096
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def counts(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed two- and three-byte runs, a row for each text; all bytes but letters read as one space."""
    data, off = text_bytes(texts)
    out = np.zeros((len(off) - 1, dims), np.float32)
    if len(data) < 3:
        return out
    upper = (data - np.uint8(65)) < 26
    data = data + upper * np.uint8(32)
    data = np.where(((data - np.uint8(97)) < 26) | (data >= 128), data, np.uint8(32)).astype(np.uint32)
    pair = data[:-1] * _A + data[1:] * _B
    three = pair[:-1] + data[2:] * _C
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for code, n in ((pair * _B, 2), (three * _A, 3)):
        inside = row[: len(code)] == row[n - 1 :]
        blank = (data[: len(code)] == 32) & (data[1 : len(code) + 1] == 32)
        use = inside & ~blank
        flat = row[: len(code)][use] * dims + (code[use] >> shift)
        out += np.bincount(flat, minlength=out.size).reshape(out.shape)
    return out


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    np.log1p(found, out=found)
    found *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", found, found))
    found /= np.where(norm > 0, norm, 1)[:, None]
    return found


def _frequencies(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for part in slices(batches, "text", 1_000_000, 512):
            total += (counts(part.column("text"), dims) > 0).sum(0)
            n += part.num_rows
        if n:
            bins = np.append(np.flatnonzero(total), dims)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(np.append(total, n)[bins], pa.int64())], names=["bin", "df"])

    return run


def _cluster(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start, rows counted by weight: unit centroids, and each row's own."""
    centre = weight @ x
    chosen = [int(np.argmax(x @ centre))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        for j in range(len(c)):
            if (own == j).any():
                m = weight[own == j] @ x[own == j]
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    own = np.argmax(x @ c.T, 1)
    return c, own


def _drawn(train: DataFrame, per_language: int) -> DataFrame:
    """``lang, text, weight``: distinct texts and the rows each stands for, at most about twice ``per_language`` a language.

    A text with more than its even share of the rows is always drawn and stands for its own rows. The others are drawn by
    hash at a rate over their distinct texts, the one with the smallest hash always, and stand for as many more.
    """
    # a text of three bytes, a letter among them, has a vector
    rows = train.where(F.col("text").rlike(r"[a-zA-Z]|[^\x00-\x7F]") & (F.octet_length("text") > 2)).select("lang", "text", F.xxhash64("text").alias("h"))
    seen = written(rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")), "texts")
    share = seen.groupBy("lang").agg((F.sum("n") / per_language).alias("share"))
    seen = seen.join(F.broadcast(share), "lang").withColumn("large", F.col("n") > F.col("share"))
    rate = seen.where(~F.col("large")).groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count(F.lit(1))).alias("rate"), F.min("h").alias("least"))
    seen = seen.join(F.broadcast(rate), "lang", "left")
    seen = seen.where(F.col("large") | (F.pmod("h", F.lit(1_000_003)) < F.col("rate") * 1_000_003) | (F.col("h") == F.col("least")))
    chosen = seen.select("lang", "h", F.when(F.col("large"), F.col("n")).otherwise(F.col("n") / F.col("rate")).cast("double").alias("weight"))
    # bounded by the number of languages; copies of a text are one row before they leave a task
    return rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h", "weight").agg(F.min("text").alias("text"))


def fit(train: DataFrame, per_language: int = 1500, clusters: int = 4, dims: int = DIMS, reject_quantile: float = 0.001) -> pd.DataFrame:
    """Centroids learnt from ``lang, text``: ``lang, cluster, floor, centroid, idf`` (the last the same in each row).

    The result has ``clusters`` rows of ``dims`` numbers a language, whatever the number of texts.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    found = train.select("text").mapInArrow(_frequencies(dims), "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).toPandas()
    if not len(found):
        return pd.DataFrame({"lang": [], "cluster": [], "floor": [], "centroid": []})
    df = np.zeros(dims + 1)
    df[found["bin"]] = found["df"]
    idf = (np.log((df[dims] + 1) / (df[:dims] + 1)) + 1).astype(np.float32)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        x = np.concatenate([weighted(counts(p.column("text"), dims), idf) for p in slices(iter(table.select(["text"]).to_batches()), "text", 1_000_000, 512)])
        some = x.any(1)
        x, weight = x[some], table["weight"].to_numpy()[some].astype(np.float32)
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "cluster": pa.array([], pa.int32()), "floor": pa.array([], pa.float64()), "centroid": pa.array([], pa.list_(pa.float32()))})
        c, own = _cluster(x, weight / weight.sum(), clusters)
        kept = [j for j in range(len(c)) if (own == j).any()]
        floor = [float(np.quantile(x[own == j] @ c[j], reject_quantile)) for j in kept]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(kept), pa.string()), "cluster": pa.array(range(len(kept)), pa.int32()), "floor": pa.array(floor, pa.float64()), "centroid": pa.array([c[j].tolist() for j in kept], pa.list_(pa.float32()))})

    model = _drawn(train, per_language).groupBy("lang").applyInArrow(one, "lang string, cluster int, floor double, centroid array<float>").toPandas()
    model = model.sort_values(["lang", "cluster"]).reset_index(drop=True)
    model.attrs["idf"] = idf
    return model


def predict(docs: DataFrame, model: pd.DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected`` of every row."""
    spark = docs.sparkSession
    langs = model["lang"].tolist()
    # `clusters` rows of `dims` floats a language: bounded by the number of languages
    shared = spark.sparkContext.broadcast((np.stack(model["centroid"].to_list()).astype(np.float32) if langs else np.zeros((0, dims), np.float32), model["floor"].to_numpy(float), model.attrs.get("idf")))
    source = docs.select(*keep, clean_text(text_col).alias("_text"), clean_text(text_col).rlike(r"\p{L}").alias("_letter"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, floors, idf = shared.value
        for part in slices(batches, "_text", 1_000_000, 512):
            letter = np.array(part.column("_letter").to_pylist(), bool)
            n = part.num_rows
            pred, score, away = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            if langs and letter.any():
                cos = weighted(counts(part.column("_text"), dims), idf) @ centroids.T
                best = cos.argmax(1)
                high = cos[np.arange(n), best]
                pred = [langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                score = np.where(letter, np.clip(high, 0, 1), 0).astype(float)
                away = ~letter | (high < floors[best])
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(away, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)

