"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; runs of one, two and three characters are hashed to 4096 features. Document frequencies count
every labelled document. The weights are trained on a bounded sample, `PER_LANGUAGE` different texts of each language
(those of the smallest hashes, so neither order nor copies decide), of the `LANGUAGES` values of lang with most texts,
ties by name; a rarer value is not learnt. Follow-the-regularised-leader takes one document at a time, by a fixed order,
with elastic-net penalties (L1 makes the weights sparse, L2 keeps them small). A fifth of the sample does not train; on
it the temperature that the scores are divided by is chosen, so that the score of a prediction is close to its accuracy.

Prediction and document frequencies are single passes over the whole texts without shuffles; a task holds a table of a
fixed size. Text that is null or has no letter is `und` with score 1. Without any labelled document everything is `und`
with score 0 (for text with letters). Repeated rows are each predicted. Other columns of the input are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import arrow_map, release, table

FEATURES, PER_LANGUAGE, LANGUAGES, EPOCHS = 4096, 600, 500, 4
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    """How often each hashed run of one to three characters is in a text; runs of white space count as one blank."""
    points = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(FEATURES, np.float32)
    run = np.zeros(len(points) + 1, np.uint32)
    for n in range(3):
        run = run[: len(points) - n] * np.uint32(0x01000193) ^ points[n:] * np.uint32(0x9E3779B1)
        if len(run):
            out += np.bincount((run ^ run >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(20), minlength=FEATURES)
        if n == 2:
            break
        run = run * np.uint32(n + 3) + np.uint32(1)
    return out


class Model:
    """Weights by language; picklable and of a fixed size."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def vector(self, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf
        return np.append(x / max(float(np.sqrt((x * x).sum())), 1e-12), 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not LETTER.search(text):
            return UNKNOWN, 1.0
        if not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.vector(counts(text)) @ self.weights / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def follow_leader(x: np.ndarray, y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """FTRL-proximal for the multinomial logistic loss; weights with a small accumulated gradient stay zero (L1)."""
    z, n = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))
    order = np.random.default_rng(7)
    weights = np.zeros_like(z)
    for _ in range(EPOCHS):
        for i in order.permutation(len(x)):
            on = np.flatnonzero(x[i])
            zi, ni = z[on], n[on]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = softmax(x[i, on] @ w)
            p[y[i]] -= 1
            g = x[i, on][:, None] * p[None, :]
            z[on] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[on] = ni + g * g
    shown = np.abs(z) > l1
    weights[shown] = (-(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))[shown]
    return weights


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """Temperature of the least negative log likelihood."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature is, and the number of documents; a row of fixed size comes from each task."""

    def of(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total += counts(text.as_py()) > 0
                n += 1
            del batch
            release()
        yield pa.RecordBatch.from_arrays([pa.array([*range(FEATURES), FEATURES], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in texts.mapInArrow(of, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out[:FEATURES], int(out[FEATURES])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, most: int = LANGUAGES) -> Model:
    """Learns from columns (text, lang), both not null."""
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    keyed = labelled.withColumn("key", F.xxhash64("text"))
    different = keyed.select("lang", "key").distinct()
    of_lang = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    languages = sorted(of_lang)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    frequency, n = document_frequencies(labelled.select("text"))
    idf = np.log((1 + n) / (1 + frequency)) + 1
    # per_language different texts of `most` languages at most, found by hashes alone; then one copy of each. Hashes under
    # a bound that leaves about four times as many are ranked, so a language's rows gather nowhere
    bounds = [(lang, -(2**63) + min(2**64 - 1, 2**64 * 4 * per_language // of_lang[lang])) for lang in languages]
    under = different.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, top long")), "lang").where("key <= top")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    sample = under.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "key")
    chosen = keyed.join(F.broadcast(sample), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def features(batch):
        n = [counts(t) for t in batch.column(0).to_pylist()]
        on = [np.flatnonzero(x) for x in n]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([o.astype(np.uint16).tobytes() for o in on]), pa.array([x[o].tobytes() for x, o in zip(n, on, strict=True)])], names=["lang", "key", "at", "n"])

    rows = arrow_map(chosen.select("text", "lang", "key"), features, "lang string, key long, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["key"], r["lang"]))
    model = Model(languages, idf, np.zeros((FEATURES + 1, len(languages))), 1.0)
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        full = np.zeros(FEATURES, np.float32)
        full[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.float32)
        x[i] = model.vector(full)
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[r["lang"]] for r in rows], np.int64)
    aside = np.arange(len(rows)) % 5 == 4
    if len(rows):
        model.weights = follow_leader(x[~aside], y[~aside], len(languages))
        if aside.any():
            model.temperature = calibrate(x[aside] @ model.weights, y[aside])
    return model


def predictions(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, lang_pred, score), one per document."""
    source = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    at = source.columns.index(text_col)

    def of(batch):
        found = [model.predict(t.as_py()) for t in batch.column(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return arrow_map(source, of, f"{kinds}lang_pred string, score double")


def held_out() -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = predictions(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
