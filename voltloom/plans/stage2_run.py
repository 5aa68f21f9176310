"""The second stage as one run: from counts of clusters by place, with predictors, to a fitted model and what documents it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voltloom.operators import stage2
from voltloom.sources import files


def run(wide: DataFrame, clusters: list[int], folder: str, least: int = 50, wanted: int | None = None, reuse: bool = False, **values) -> stage2.Fit:
    """Fits the multinomial logit of wide's clusters on its predictors and writes to `folder`:

    regression_data and coefficients (Parquet), stage2_manifest.json (statistics, sizes of each step and `values`),
    predictors_used.txt, predictors_without_values.txt and predictors_dependent.txt. With reuse set, the predictors are those
    that an earlier run left there. Raises if no predictor or no place is left.
    """
    spark = wide.sparkSession
    numeric = [c for c, kind in wide.dtypes if kind in ("double", "float", "int", "bigint", "boolean") and c not in stage2.NOT_PREDICTORS and not c.startswith("cluster_")]
    own = stage2.enough(wide, least).persist()
    try:
        found = stage2.predictors(own)
        names = files.listed(folder) if reuse else None
        whole = stage2.complete_cases(own, found if names is None else names)
        names, dependent = stage2.independent(whole, found) if names is None else (names, [])
        sizes = {"places_total": wide.count(), "places_with_enough": own.count(), "places_complete": whole.count()}
        if not names or not sizes["places_complete"]:
            raise ValueError(f"nothing to fit: predictors {names}, {sizes}")
        base = stage2.baseline(whole, clusters, wanted)
        fit = stage2.multinomial(whole, names, clusters, base)
        files.write_parquet(whole, f"{folder}/regression_data", mode="overwrite")
        files.write_parquet(stage2.coefficients(fit, spark), f"{folder}/coefficients", mode="overwrite")
    finally:
        own.unpersist()
    lists = {"predictors_used": names, "predictors_without_values": [c for c in numeric if c not in found], "predictors_dependent": dependent}
    files.run_manifest(folder, "stage2_manifest", lists, baseline_cluster=base, least_observations=least, **sizes, statistics=fit.statistics(), **values)
    return fit
