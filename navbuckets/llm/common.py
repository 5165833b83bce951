"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from navbuckets.session import materialize

__all__ = ["table", "crc_mod", "extended", "materialize", "components"]


def extended(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` with further columns (``schema.add`` would change ``df``'s own)."""
    return StructType([*df.schema.fields, *[StructField(n, DataType.fromDDL(k)) for n, k in kinds.items()]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(column: str, m: int):
    """crc32 of the column as text, modulo ``m`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, component)``, the smallest id reachable.

    Min-label exchange with pointer jumping: every round takes the smallest label among a
    node's neighbours, then replaces each label by its own label, so path lengths at least
    halve. A node of any degree is one aggregated row; each round is written to the shared
    checkpoint folder, so a lost executor repeats one round at most. Empty edges give no rows.
    """
    both = materialize(edges.select("a", "b").where("a <> b")
                       .union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                         .select("id", F.least("id", "m").alias("component")))
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m")))
        step = (labels.join(near, "id").select("id", F.col("component").alias("old"),
                                               F.least("component", "m").alias("mid")))
        up = labels.select(F.col("id").alias("mid"), F.col("component").alias("up"))
        new = materialize(step.join(up, "mid", "left").select(
            "id", "old", F.least("mid", F.coalesce("up", "mid")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
