"""Scoring against class tables, remapping and prompt ensembles. Class tables are small: dozens of rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import sums, with_unit

CLASS_LIMIT = 10_000


def small(table: DataFrame, what: str, most: int = CLASS_LIMIT) -> DataFrame:
    """The table itself, if it has `most` rows at most, so that it may be broadcast; raises where it has more."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return table


def argmax_class(rows: DataFrame, classes: DataFrame, keys: Sequence[str], vector: str = "z", cls: str = "cls") -> DataFrame:
    """(keys, pred, sim): the class with the highest dot product, ties to the lowest.

    The class table (its size is checked) goes to the tasks as a matrix, and each Arrow batch of rows is one product with
    it: no join per class, no window, no vector taken apart in an expression. A null vector scores as zero.
    """
    found = small(classes, "classes").select(F.col(cls).alias("c"), F.col("emb").cast("array<double>").alias("e")).collect()
    known: dict[bytes, int] = {}  # equal vectors are one column, named by the lowest class
    for r in sorted(found, key=lambda r: r["c"]):
        known.setdefault(np.array(r["e"], np.float64).tobytes(), r["c"])
    ids = np.array(list(known.values()))
    matrix = np.stack([np.frombuffer(v, np.float64) for v in known]).T if known else np.zeros((0, 0))
    source = rows.select(*keys, F.col(vector).cast("array<double>").alias("__v"))
    n = len(keys)

    def score(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, len(matrix)))
            there = batch.column(n).is_valid().to_numpy(zero_copy_only=False)
            x[there] = pc.list_flatten(batch.column(n)).to_numpy(zero_copy_only=False).reshape(-1, len(matrix))
            s = x @ matrix
            best = s.argmax(1) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ids[best]).cast(pred), pa.array(s[np.arange(len(s)), best])], names=[*keys, "pred", "sim"])

    kind = classes.schema[cls].dataType
    pred = pa.int32() if kind.simpleString() == "int" else pa.int64()
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    got = source.mapInArrow(score, f"{kinds}, pred {'int' if pred == pa.int32() else 'bigint'}, sim double")
    return got if len(ids) else got.limit(0)


def remap(pred: DataFrame, table: DataFrame, idx: str = "idx", cls: str = "cls") -> DataFrame:
    """Detail predictions to evaluation classes; the table has a row a detail class."""
    return pred.join(F.broadcast(small(table, "detail classes").select(F.col(idx).alias("pred"), F.col(cls).alias("__cls"))), "pred").drop("pred").withColumnRenamed("__cls", "pred")


def prompt_ensemble(prompts: DataFrame, dim: int, keys: Sequence[str] = ("cls",)) -> DataFrame:
    """Unit mean of the unit vectors of all templates of a class."""
    unit = with_unit(prompts, "emb")
    return with_unit(unit.groupBy(*keys).agg(sums("emb", dim).alias("emb")), "emb")


def fill_template(names: DataFrame, templates: DataFrame) -> DataFrame:
    """Every template with every name put for {}; both tables are small."""
    return names.join(F.broadcast(small(templates, "templates"))).withColumn("prompt", F.replace("template", F.lit("{}"), F.col("name")))


def legend(rows: DataFrame, cls: str = "gt", k: int = 12, ignore: int = 255) -> DataFrame:
    """The k most frequent classes."""
    return rows.where(F.col(cls) != ignore).groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls").limit(k)


def rich_scenes(rows: DataFrame, least: int = 9, most: int = 3, n_classes: str = "n_classes") -> DataFrame:
    """Scenes of `least` classes or more; all of them where fewer than `most` have so many."""
    enough = rows.where(F.col(n_classes) >= least)
    few = enough.agg((F.count("*") < most).alias("__few"))  # one row
    return rows.join(F.broadcast(few)).where(F.col("__few") | (F.col(n_classes) >= least)).drop("__few")


def pick_by_rank(rows: DataFrame, gain: str, keys: Sequence[str]) -> DataFrame:
    """Rows at a sixth, the middle and an eighth before the end of the order by gain; rows are scenes."""
    w = Window.orderBy(gain, *keys)
    ranked = rows.withColumn("__at", F.row_number().over(w) - 1).join(F.broadcast(rows.agg(F.count("*").alias("__n"))))
    n = F.col("__n")
    places = [F.floor(n / 6), F.floor(n / 2), n - 1 - F.floor(n / 8)]
    return ranked.withColumn("pick", F.array_position(F.array(*[p.cast("int") for p in places]), F.col("__at").cast("int"))).where("pick > 0").drop("__at", "__n")
