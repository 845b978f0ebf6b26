"""Mergeable sketches: kept for each part of a dataset, merged when asked.

A part (a partition, a day) is summarised once, in a few kilobytes, by the distinct sketches HLL and
theta and the quantile sketch KLL. A question over any set of parts merges their rows; the
data isn't read again. Theta sketches also answer how many keys parts share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of HLL and of the kept hashes of theta, and the size of KLL.
HLL_BITS, THETA_BITS, KLL_SIZE = 14, 14, 1024
#: Three standard errors of each: 1.04 / sqrt(2**14), 1 / sqrt(2**14), and KLL's rank error at 99 %.
HLL_ERROR, THETA_ERROR, KLL_ERROR = 3 * 1.04 / 128, 3 / 128, 0.004


def build(df: DataFrame, parts: list[str], key: str, number: str) -> DataFrame:
    """One row a part: n, and sketches of the distinct keys and of a number's distribution."""
    return df.groupBy(*parts).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(key), F.lit(HLL_BITS)).alias("hll"),
        F.theta_sketch_agg(F.col(key), F.lit(THETA_BITS)).alias("theta"),
        F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(KLL_SIZE)).alias("kll"),
    )


def merge(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sketches of all parts of a group, as if it had been read in one."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("hll").alias("hll"),
        F.theta_union_agg(F.col("theta"), F.lit(THETA_BITS)).alias("theta"),
        F.kll_merge_agg_double("kll").alias("kll"),
    )


def estimates(merged: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Numbers of distinct keys by both sketches, and quantiles."""
    q = [F.kll_sketch_get_quantile_double(F.col("kll"), F.lit(x)).alias(f"p{round(100 * x)}") for x in quantiles]
    return merged.select(*(c for c in merged.columns if c not in ("hll", "theta", "kll")), F.hll_sketch_estimate("hll").alias("distinct_hll"), F.theta_sketch_estimate("theta").alias("distinct_theta"), *q)


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Estimated keys in both, in the first alone, and in either, of two theta sketches."""
    est: Callable[[Column], Column] = F.theta_sketch_estimate
    return {"both": est(F.theta_intersection(a, b)), "first": est(F.theta_difference(a, b)), "either": est(F.theta_union(a, b, F.lit(THETA_BITS)))}
