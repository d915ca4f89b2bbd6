"""The run catalog: report view, top-k, summaries, comparison, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corrgrid.sources.derived import read


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration runs: status, images, creation time and the metrics' row, if any."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("insufficient_matches")
    r = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("image_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    li = read(spark, sf_dir, "lineitem")
    m = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("num_matches"), F.max("l_extendedprice").alias("best"))
    return r.join(m, "run_id", "left").withColumn("quality_score", F.col("best") / 1050.0)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their image and sensor, metrics left-joined."""
    images = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_name").alias("file_path"), F.col("c_nationkey").alias("sensor_id"))
    sensors = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sensor_id"), F.col("n_name").alias("sensor"))
    return runs(spark, sf_dir).join(images, "image_id").join(sensors, "sensor_id").select("run_id", "file_path", "sensor", "status", "num_matches", F.round("quality_score", 4).alias("quality_score"))


def top_runs(r: DataFrame, least: int = 4, n: int = 10) -> DataFrame:
    ok = r.where((F.col("status") == "success") & (F.col("num_matches") >= least))
    return ok.orderBy(F.desc("quality_score"), "run_id").limit(n).select("run_id", "num_matches", F.round("quality_score", 4).alias("quality_score"))


def summary(r: DataFrame) -> DataFrame:
    good = F.col("status") == "success"
    return r.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(good, F.col("quality_score"))), 4).alias("mean_quality"))


def latest(r: DataFrame, key: str, n: int) -> DataFrame:
    """The n latest runs of each image, ties to the smaller run id."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), "run_id")
    return r.select(key, "run_id", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def best_by_sensor(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The n best successful runs of each sensor by quality, ties to the smaller run id."""
    ok = report(spark, sf_dir).select("sensor", "run_id", "status").where("status = 'success'")
    scored = ok.join(runs(spark, sf_dir).select("run_id", F.col("quality_score").alias("q")), "run_id").where("q is not null")
    w = Window.partitionBy("sensor").orderBy(F.desc("q"), "run_id")
    return scored.select("sensor", "run_id", F.row_number().over(w).alias("place")).where(F.col("place") <= n)


def winner(a: Column, b: Column, more_is_better: bool) -> Column:
    """a or b by one metric, ties to a; NULL where either is missing."""
    return F.when(a >= b if more_is_better else a <= b, "a").when(a < b if more_is_better else a > b, "b")


def compare_next(r: DataFrame, key: str, metrics: dict[str, tuple[str, bool]]) -> DataFrame:
    """Each run (a) beside the next one of its image (b), with the winner per metric."""
    w = Window.partitionBy(key).orderBy("run_id")
    cols = {c for c, _ in metrics.values()}
    both = r.select(F.col("run_id").alias("a"), F.lead("run_id").over(w).alias("b"), *cols, *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return both.where("b is not null").select("a", "b", *[winner(F.col(c), F.col(f"next_{c}"), more).alias(f"{name}_winner") for name, (c, more) in metrics.items()])


def pair_with(images: DataFrame, key: str, references: Sequence[int]) -> DataFrame:
    """Every image with each of a few given references, itself excepted: one run per row."""
    named = F.explode(F.array(*[F.lit(x).cast("long") for x in references])).alias("reference_id")
    return images.select(key, named).where(F.col(key) != F.col("reference_id"))


def merge(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Upsert: of the rows with one key the latest stays, the new one on ties, and of equal ones that with the greatest content."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(stamp), F.desc("_new"), F.desc(F.to_json(F.struct(*old.columns))))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def full_report(r: DataFrame, images: DataFrame, sensors: DataFrame, metrics: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs (run_id, source_id, reference_id, status) with both images (image_id, path, sensor_id), both sensors
    (sensor_id, sensor), and, where there are any, metrics and configs (run_id, ...)."""

    def side(name: str) -> DataFrame:
        named = images.join(sensors, "sensor_id")
        return named.select(F.col("image_id").alias(f"{name}_id"), F.col("path").alias(f"{name}_path"), F.col("sensor").alias(f"{name}_sensor"))

    return r.join(side("source"), "source_id").join(side("reference"), "reference_id").join(metrics, "run_id", "left").join(configs, "run_id", "left")


def best_by_pair(report: DataFrame, n: int) -> DataFrame:
    """The n best runs of each pair of sensors by quality, ties to the smaller run id."""
    w = Window.partitionBy("source_sensor", "reference_sensor").orderBy(F.desc("quality_score"), "run_id")
    return report.where("quality_score is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def first_completed(r: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The n earliest successful runs of each key."""
    w = Window.partitionBy(key).orderBy("created_at", "run_id")
    return r.where("status = 'success'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def log_run(runs: DataFrame, metrics: DataFrame, matches: DataFrame, root: str, token: str | None = None) -> int:
    """Append runs with their metrics and matches to the catalog as one commit; see sources.snapshots."""
    from corrgrid.sources.snapshots import Catalog

    return Catalog(runs.sparkSession, root).append({"runs": runs, "metrics": metrics, "matches": matches}, token=token)


def list_datasets(uploads: DataFrame, samples: DataFrame) -> DataFrame:
    """Both listings as one; columns that one lacks are null there, origin says where a row is from."""
    return uploads.withColumn("origin", F.lit("upload")).unionByName(samples.withColumn("origin", F.lit("sample")), allowMissingColumns=True)


def fetch(listing: DataFrame, key: str) -> DataFrame:
    """One row per key: uploads before samples; of one origin the row with the least content."""
    w = Window.partitionBy(key).orderBy(F.desc("origin"), F.to_json(F.struct(*[c for c in listing.columns if c != key])))
    return listing.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
