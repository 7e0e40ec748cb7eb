"""One ranking from several scores in unlike units.

Method: within a request every score becomes an empirical percentile with
averaged ties, the percentile is mapped through the inverse normal
distribution, and nodes are ordered by the weighted mean of these normal
scores. Range, unit and outliers of a score cannot matter, since only its
order enters.

Rules: rows of one (request, node) count once, with the best value of each
score among them, so identical rows change nothing; a score that is absent,
null or NaN stands behind all present ones (such nodes tie); equal means are
ordered by the smaller node; rows without request or node are left out; a
null or non-positive ``top_n`` selects nothing. Extra columns are ignored and
an empty table gives an empty result.

Scale: a request may hold a third of all rows. Ranks come from a histogram
(one row per distinct value) and a distributed running total, never from a
window over a whole request; the leading rows are selected salt by salt first.
Values that many rows of a request share (such as an absent score) reach these
rows by broadcast, and so do the few facts of each request, while their number is
below BROADCAST_ROWS.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.durable import materialize, running_total

# Coefficients of P. J. Acklam's rational approximation of the inverse normal distribution.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425

#: Slices of a request that are cut to their leading rows before they meet.
SALTS = 64
#: Tables of at most so many rows (under 100 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
#: A value that so many rows of one request share is looked up apart from the others.
HOT = 50_000


def _sent(df: DataFrame) -> DataFrame:
    """`df`, broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1."""
    q = p - 0.5
    r = q * q
    centre = _poly(CENTRE_TOP, r) * q / (_poly(CENTRE_BOTTOM, r) * r + 1.0)
    outer = F.sqrt(F.log(F.least(p, 1.0 - p)) * -2.0)
    tail = _poly(TAIL_TOP, outer) / (_poly(TAIL_BOTTOM, outer) * outer + 1.0)
    return F.when(p < TAIL, tail).when(p > 1.0 - TAIL, -tail).otherwise(centre)


def normal_scores(hits: DataFrame, request: str, node: str, scores: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> DataFrame:
    """``(request, node, fused)``: the weighted mean of the normal scores of every node of every request.

    `scores` maps a name to a column in which larger is better.
    """
    names = list(scores)
    share = {n: float((weights or {}).get(n, 1.0)) for n in names}
    total = sum(share.values())
    value = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    nodes = (
        hits.where(F.col(request).isNotNull() & F.col(node).isNotNull())
        .select(F.col(request).alias("_request"), F.col(node).alias("_node"), *[value(c).alias(f"_s{i}") for i, c in enumerate(scores.values())])
        .groupBy("_request", "_node")
        .agg(*[F.max(f"_s{i}").alias(f"_s{i}") for i in range(len(names))])
    )
    nodes = materialize(nodes)
    each = F.array(
        *[
            F.struct(
                F.lit(i).alias("_signal"),
                F.col(f"_s{i}").isNotNull().alias("_present"),
                F.coalesce(F.col(f"_s{i}"), F.lit(0.0)).alias("_value"),
                F.lit(share[n] / total).alias("_weight"),
            )
            for i, n in enumerate(names)
        ]
    )
    long = nodes.select("_request", "_node", F.inline(each))
    key = ["_request", "_signal"]
    histogram = long.groupBy(*key, "_present", "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(histogram, key, ["_present", "_value"], "_n", "_upto")
    size = _sent(materialize(nodes.groupBy("_request").agg(F.count(F.lit(1)).alias("_size"))))
    percentile = (F.col("_upto") - F.col("_n") / 2.0) / F.col("_size")
    mapped = materialize(ranked.join(size, "_request").select(*key, "_present", "_value", "_n", inverse_normal(percentile).alias("_z")))
    shared = mapped.where(F.col("_n") > HOT)
    if few := shared.limit(BROADCAST_ROWS + 1).count():
        if few > BROADCAST_ROWS:
            shared = shared.orderBy(F.col("_n").desc()).limit(BROADCAST_ROWS)
        shared = materialize(shared.drop("_n"))
        shown = long.join(F.broadcast(shared.withColumnRenamed("_z", "_hot")), [*key, "_present", "_value"], "left")
        rest = mapped.join(F.broadcast(shared.drop("_z")), [*key, "_present", "_value"], "left_anti").drop("_n")
        scored = (
            shown.where("_hot IS NOT NULL").withColumnRenamed("_hot", "_z")
            .unionByName(shown.where("_hot IS NULL").drop("_hot").join(rest, [*key, "_present", "_value"]))
        )
    else:
        scored = long.join(mapped.drop("_n"), [*key, "_present", "_value"])
    fused = (
        scored.groupBy("_request", "_node")
        .agg(F.sum(F.col("_weight") * F.col("_z")).alias("_fused"))
    )
    # Twelve decimals hide the order in which the sum was taken, so that true ties stay ties.
    return fused.select(F.col("_request").alias(request), F.col("_node").alias(node), F.round("_fused", 12).alias("fused"))


def leading(fused: DataFrame, requests: DataFrame, request: str, node: str, top: str) -> DataFrame:
    """``(request, node, fused, position)``: the first `top` nodes of each request (position counts from 1)."""
    wanted = _sent(materialize(requests.where(F.col(request).isNotNull()).groupBy(request).agg(F.max(top).alias("_top"))))
    best = [F.col("fused").desc(), F.col(node)]
    salted = fused.join(wanted, request).withColumn("_salt", F.pmod(F.xxhash64(F.col(node)), F.lit(SALTS)))
    some = salted.withColumn("_at", F.row_number().over(Window.partitionBy(request, "_salt").orderBy(*best))).where("_at <= _top")
    return (
        some.withColumn("position", F.row_number().over(Window.partitionBy(request).orderBy(*best)))
        .where("position <= _top")
        .select(request, node, "fused", "position")
    )
