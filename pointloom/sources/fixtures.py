"""Point clouds, class tables and shapes derived from the driver's tables, as DataFrames of the engine's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.vectors import sums, with_unit

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (fid, feat) of double vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), F.col("embedding").cast("array<double>").alias("feat"))


def vec_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small cloud with real vectors: (scene, pid, seg, gt, x, y, z, nx, ny, nz, r, g, b, valid, feat)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("feat"))
    e = F.col("feat")
    length = F.greatest(F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5]), F.lit(1e-12))
    return v.select(
        (F.col("vec_id") % 4).alias("scene"), F.col("vec_id").alias("pid"), (F.col("vec_id") % 50).alias("seg"), F.col("label").alias("gt"),
        e[0].alias("x"), e[1].alias("y"), e[2].alias("z"), (e[3] / length).alias("nx"), (e[4] / length).alias("ny"), (e[5] / length).alias("nz"),
        ((e[6] + 1) / 2).alias("r"), ((e[7] + 1) / 2).alias("g"), ((e[8] + 1) / 2).alias("b"), (F.col("vec_id") % 20 != 7).alias("valid"), "feat",
    )


def big_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large cloud: (scene, pid, seg, gt, x, y, z, valid, partkey); pid is arithmetic, so nothing is sorted or shuffled."""
    pid = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 262144 + F.col("l_partkey")) * 4096 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("scene"), pid.cast("long").alias("pid"), F.col("l_suppkey").alias("seg"),
        F.when(F.col("l_linestatus") == "F", 255).otherwise(F.col("l_partkey") % 10).cast("int").alias("gt"),
        (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 105000).alias("y"), (F.col("l_discount") * 10).alias("z"),
        (F.col("l_returnflag") != "N").alias("valid"), F.col("l_partkey").alias("partkey"),
    )


def big_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large cloud with a vector for each point."""
    f = features(spark, sf_dir)
    n = f.agg(F.count("*").alias("n"))
    keyed = big_points(spark, sf_dir).join(F.broadcast(n), how="left").withColumn("fid", F.pmod("partkey", "n")).drop("n")  # one row
    return keyed.join(f, "fid").drop("fid")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text table: (cls, emb), unit mean vector of each label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cls"), F.col("embedding").cast("array<double>").alias("v"))
    return with_unit(v.groupBy("cls").agg(sums("v", DIM).alias("emb")), "emb")


def detail_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail vocabulary: (idx, cls, emb), many to one onto labels."""
    v = table(spark, sf_dir, "embeddings").select((F.col("label") * 4 + F.col("vec_id") % 4).cast("int").alias("idx"), F.col("label").alias("cls"), F.col("embedding").cast("array<double>").alias("v"))
    return with_unit(v.groupBy("idx", "cls").agg(sums("v", DIM).alias("emb")), "emb")
