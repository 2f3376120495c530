"""Training-corpus pipeline: five stages over `documents`, each one of the operators in pointloom.llm.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
Results of a stage are written as Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, table
from pointloom.llm.decontaminate import contamination
from pointloom.llm.langid import UNKNOWN, held_out, predictions, train
from pointloom.llm.packing import pack
from pointloom.llm.simhash import drop_near_duplicates
from pointloom.llm.substrings import cut, repeated_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.35
TOKEN_CACHE = 100_000  # entries; the workers here have four other stages behind them


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects text without letters and text in which no language stands out; fills in lang.

    Where no row is there to learn from (lang null throughout, or on held-out ids alone), all text with letters stays.
    """
    model = train(docs.where(~held_out()))
    found = predictions(docs, model, keep=COLUMNS)
    if not model.languages:  # text without letters is `und` with score 1, other text with score 0
        return found.where("score = 0").select(*COLUMNS)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies (five words, similarity 0.8)."""
    return drop_near_duplicates(docs.select(*COLUMNS), words=5, at_least=0.8)


def whole_characters(raw: bytes, spans: list[dict]) -> list[dict]:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for s in spans:
        a, b = s["start"], s["end"]
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append({"start": a, "end": b})
    return out


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what repeats 50 bytes or more of a document with a smaller id; a document that nothing is left of goes."""
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]

    def shorten(batch):
        texts, same = [], []
        for text, found in zip(batch.column(1), batch.column(len(rest) + 2), strict=True):
            raw = text.as_py()
            spans = whole_characters(raw, found.as_py())
            texts.append(cut(raw, spans).decode("utf-8", "replace"))
            same.append(not spans)
        kept = pa.array([unchanged or bool(t.strip()) for t, unchanged in zip(texts, same, strict=True)], pa.bool_())
        out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2 : len(rest) + 2], pa.array(same, pa.bool_())], names=["doc_id", "text", *rest, "same"])
        return out.filter(kept)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    cut_down = repeated_spans(docs, 50, keep=tuple(rest), then=shorten, then_schema=f"doc_id long, text string, {kinds}, same boolean")
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut_down.withColumn("n_chars", F.when(F.col("same"), F.col("n_chars")).otherwise(length)).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or a shorter item whole, also of one without id."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the remaining documents in sequences of 4096 tokens."""
    return pack(docs, 4096, 1, kept=TOKEN_CACHE)


STAGES = [
    ("language identification", language),
    ("simhash near-duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Fingerprints, trained models and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, str(i))
    return docs
