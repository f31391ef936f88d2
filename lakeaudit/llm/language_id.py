"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of a whole lower-cased text are hashed to ``SIZE`` features; document
frequencies come from all learnable documents, the weights from a bounded sample of them
(``SAMPLE_PER_LANG`` documents a language) by FTRL with elastic-net penalties. A temperature fitted
on sampled documents that weren't trained on calibrates the probability of the predicted language.

Null text and text without a letter: ``und`` with score 0. No learnable document at all: every text is
``und``. Equal probabilities: the first language by name. A null id is neither held out nor learned
from. Repeated rows are separate documents. Only id, text and lang are read, lang only to learn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .linear import ftrl, sample_key, softmax, temperature
from .linear import KEYS

SIZE = 1 << 16
SAMPLE_PER_LANG = 1_500
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a text and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not codes.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.zeros(SIZE, np.int64)
    for n in (1, 2, 3):
        if codes.size < n:
            break
        h = codes[: codes.size - n + 1] * FACTORS[0] + np.uint32(n)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * FACTORS[k] + codes[k : codes.size - n + 1 + k]
        h = (h ^ (h >> np.uint32(16))) * FACTORS[1]
        counts += np.bincount((h >> np.uint32(16)).astype(np.int64), minlength=SIZE)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of the rows each feature occurs; the result's size doesn't depend on the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[features(text.as_py())[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])

    sums = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE, np.int64)
    out[sums["feature"].to_numpy()] = sums["n"].to_numpy()
    return out


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        at, counts = features(text)
        p = softmax(weighted(at, counts, self.idf) @ self.weights[at] / self.heat)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows with text, lang and an id that isn't held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    if not langs:
        return LanguageModel([], np.zeros(SIZE), np.zeros((SIZE, 0)), 1.0)
    df = document_frequencies(rows)
    idf = np.log((1 + sum(per_lang.values())) / (1 + df)) + 1
    below = F.lit(0)
    for lang, n in per_lang.items():
        share = min(1.0, SAMPLE_PER_LANG / n)
        below = F.when(F.col("lang") == lang, int(share * KEYS) + (share == 1.0)).otherwise(below)
    chosen = rows.where(sample_key("id", "text") < below).select("lang", "text", sample_key("text", "id").alias("part"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["lang", "part", "at", "n"])

        return each

    sample = map_rows(chosen, make, "lang string, part long, at array<long>, n array<long>").limit(2 * SAMPLE_PER_LANG * len(langs)).toPandas()
    sample = sample.sort_values(["part", "lang"], kind="stable")
    x = [(np.asarray(at, np.int64), weighted(np.asarray(at, np.int64), np.asarray(n, np.int64), idf)) for at, n in zip(sample["at"], sample["n"])]
    y = sample["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy(np.int64)
    fitted = sample["part"].to_numpy() % 5 != 0
    weights = ftrl([r for r, f in zip(x, fitted) if f], np.eye(len(langs))[y[fitted]], SIZE, alpha=1.0, l1=0.02, l2=0.1)
    logits = np.array([r[1] @ weights[r[0]] for r, f in zip(x, fitted) if not f]).reshape(-1, len(langs))
    return LanguageModel(langs, idf, weights, temperature(logits, y[~fitted]))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score. The model has a fixed size; no shuffle."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sent.value.predict(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
