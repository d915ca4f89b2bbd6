"""Registration of many image pairs in one call: neighbours, ratio test, look-up, robust fit, a status row per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrgrid.operators.knn import ratio_test, two_nearest_by_pair
from corrgrid.operators.robust import robust_fit
from corrgrid.staging import staged

#: Weights of the quality score's parts by default.
WEIGHTS = {"inlier_ratio": 0.5, "precision": 0.5}


def match_pairs(pairs: DataFrame, features: DataFrame, *, ratio: float = 0.8, both_ways: bool = False) -> DataFrame:
    """pair_id, k, x0, y0, x1, y1: matches of pairs (pair_id, source_id, reference_id) from features (image_id, kp_id, x, y, v).

    A source feature matches its nearest reference feature if it is clearly nearer than the second
    (a reference image with one feature matches nothing); both_ways also asks that the match be the
    nearest in return. Features without a vector take no part.
    """
    usable = features.where("v is not null and x is not null and y is not null")
    side = lambda name: pairs.select("pair_id", F.col(name).alias("image_id")).join(usable, "image_id").select(F.col("pair_id").cast("long").alias("pair_id"), F.col("kp_id").cast("long").alias("id"), "x", "y", "v")
    left, right = staged(side("source_id")), staged(side("reference_id"))
    good = ratio_test(two_nearest_by_pair(left.drop("x", "y"), right.drop("x", "y")), ratio)
    if both_ways:
        back = two_nearest_by_pair(right.drop("x", "y"), left.drop("x", "y")).select("pair_id", F.col("id").alias("nn"), F.col("nn").alias("id"))
        good = good.join(back, ["pair_id", "id", "nn"], "left_semi")
    at = lambda df, key, i: df.select("pair_id", F.col("id").alias(key), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    return good.join(at(left, "id", 0), ["pair_id", "id"]).join(at(right, "nn", 1), ["pair_id", "nn"]).select("pair_id", F.col("id").alias("k"), "x0", "y0", "x1", "y1")


def register_pairs(pairs: DataFrame, features: DataFrame, *, model: str = "homography", ratio: float = 0.8, both_ways: bool = False, threshold: float = 3.0, least: int = 12, canvas: tuple[float, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per pair: pair_id, source_id, reference_id, n_matches, inliers, inlier_ratio, rmse, h, quality, status.

    status: success; insufficient_matches; error (no transform, or one that the canvas refuses);
    no_features (an image of the pair has none). No pair fails the job. quality, for successes, is 100
    times the weighted mean of the inlier ratio and of 1 - rmse / threshold. Unknown weights are refused.
    """
    used = WEIGHTS if weights is None else weights
    if set(used) - set(WEIGHTS) or not sum(used.values()) > 0:
        raise ValueError(f"weights are of {sorted(WEIGHTS)}")
    found = staged(match_pairs(pairs, features, ratio=ratio, both_ways=both_ways))
    fit = robust_fit(found, model, key=("k",), threshold=threshold, least=least, canvas=canvas)
    present = features.where("v is not null").select("image_id").distinct()
    out = pairs.join(fit, "pair_id", "left")
    for side in ("source", "reference"):
        out = out.join(present.select(F.col("image_id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_there")), f"{side}_id", "left")
    status = F.when(F.col("source_there").isNull() | F.col("reference_there").isNull(), "no_features").otherwise(F.coalesce("status", F.lit("insufficient_matches")))
    n, inliers = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("inliers", F.lit(0)).cast("long")
    share = inliers / F.greatest(n, F.lit(1))
    parts = {"inlier_ratio": share, "precision": 1 - F.least(F.col("rmse") / threshold, F.lit(1.0))}
    quality = 100 * sum((F.lit(w) * parts[name] for name, w in used.items()), F.lit(0.0)) / sum(used.values())
    return out.select("pair_id", "source_id", "reference_id", n.alias("n_matches"), inliers.alias("inliers"), share.alias("inlier_ratio"), "rmse", F.when(status == "success", F.col("h")).alias("h"), F.when(status == "success", quality).alias("quality"), status.alias("status"))
