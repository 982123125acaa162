"""Tables, manifests and run registries.

Writes are atomic per table (the engine's committer); a manifest is written
after its table and names it, so a reader that goes by manifests never sees half
a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_run(df: DataFrame, root: str, method: str, feature_set: str, run_id: str, tag: str, partition: Sequence[str] = ()) -> DataFrame:
    """Table and manifest of one run; refuses to overwrite, checks the row count."""
    spark = df.sparkSession
    at = f"{root}/{method}/{feature_set}/{run_id}"
    w = df.write.mode("error")
    (w.partitionBy(*partition) if partition else w).parquet(f"{at}/table")
    n = spark.read.parquet(f"{at}/table").count()
    m = spark.createDataFrame([(method, feature_set, run_id, tag, n, at)], "method string, feature_set string, run_id string, tag string, n_rows long, path string")
    m.coalesce(1).write.mode("error").json(f"{at}/manifest")
    return m


def registry(spark: SparkSession, root: str) -> DataFrame:
    """All manifests under the root."""
    return spark.read.schema("method string, feature_set string, run_id string, tag string, n_rows long, path string").json(f"{root}/*/*/*/manifest")


def newest(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """Newest run of each track under the current tag."""
    r = registry(spark, root).filter(F.col("tag") == tag)
    return r.groupBy("method", "feature_set").agg(F.max_by(F.struct("run_id", "n_rows", "path"), "run_id").alias("b")).select("method", "feature_set", "b.*")


def read_run(spark: SparkSession, root: str, method: str, feature_set: str, run_id: str, tag: str) -> DataFrame:
    """A run's table; a run of another tag is refused, not silently used."""
    m = registry(spark, root).filter((F.col("method") == method) & (F.col("feature_set") == feature_set) & (F.col("run_id") == run_id)).first()  # one manifest
    if m is None:
        raise FileNotFoundError(f"no run {method}/{feature_set}/{run_id}")
    if m["tag"] != tag:
        raise ValueError(f"run {run_id} was made for {m['tag']}, not {tag}")
    return spark.read.parquet(f"{m['path']}/table")


def trials_by_condition(df: DataFrame, path: str) -> None:
    """One folder of tab-separated trials per patient and condition."""
    df.write.mode("error").partitionBy("patient", "condition_name").option("sep", "\t").option("header", "true").csv(path)
