"""Reference distributions of retraining noise and what exceeds them.

All statistics are exact, and none gathers a group: values at given ranks are found
by counting, first over coarse buckets of the value, then over the different values
of the bucket that holds the rank.  Medians without one row follow from the three
values around the middle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..runtime import same, staged

MAD_FACTOR = 1.4826

#: Coarse buckets per factor e of the value, and the value below which all is one bucket.
BUCKETS_PER_E = 128
LEAST_VALUE = 1e-6

Ranks = Callable[[Column], list[Column]]


def _bucket(v: Column) -> Column:
    """A number that never falls as v grows; about 1 / BUCKETS_PER_E of the value wide."""
    size = F.floor(F.log1p(F.abs(v) / LEAST_VALUE) * BUCKETS_PER_E)
    return F.when(v < 0, -size - 1).otherwise(size).cast("int")


def at_ranks(df: DataFrame, groups: Sequence[str], value: str, ranks: Ranks) -> DataFrame:
    """(groups, n, at): the values at the given ranks (from 1) of each group's values in order.

    ``ranks`` makes the ranks from n; ranks outside of 1..n give null.  Null values do
    not count; null group keys form groups.  df is read twice.
    """
    d = df.select(F.struct(*groups).alias("_g") if groups else F.struct(F.lit(0).alias("all")).alias("_g"), F.col(value).alias("_v")).filter("_v is not null").withColumn("_b", _bucket(F.col("_v")))
    counts = d.groupBy("_g", "_b").agg(F.count("*").alias("c"))
    # A row per bucket of a group, however many values it has.
    w = Window.partitionBy("_g")
    counts = counts.withColumn("n", F.sum("c").over(w)).withColumn("cum", F.sum("c").over(w.orderBy("_b")))
    wanted = counts.select("_g", "_b", "n", "c", "cum", F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("i", "r"))
    wanted = staged(wanted.filter((F.col("r") <= F.col("cum")) & (F.col("r") > F.col("cum") - F.col("c"))).select("_g", "_b", "n", "i", (F.col("r") - F.col("cum") + F.col("c")).alias("r")), "ranks")
    held = d.join(wanted.select("_g", "_b").distinct(), ["_g", "_b"], "left_semi").groupBy("_g", "_b", "_v").agg(F.count("*").alias("c"))
    held = held.withColumn("cum", F.sum("c").over(Window.partitionBy("_g", "_b").orderBy("_v")))
    hit = held.join(wanted, ["_g", "_b"]).filter((F.col("r") <= F.col("cum")) & (F.col("r") > F.col("cum") - F.col("c")))
    out = hit.groupBy("_g", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", "_v"))).alias("m"))
    wide = len(ranks(F.lit(1)))
    return out.select(*([f"_g.{g}" for g in groups]), "n", F.array(*[F.col("m")[i] for i in range(wide)]).alias("at"))


def quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(groups, n, q): exact quantiles, linear between neighbouring ranks."""

    def ranks(n: Column) -> list[Column]:
        return [f(F.lit(p) * (n - 1)) + 1 for p in shares for f in (F.floor, F.ceil)]

    def between(i: int, p: float) -> Column:
        low, high, at = F.col("at")[2 * i], F.col("at")[2 * i + 1], F.lit(p) * (F.col("n") - 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    d = at_ranks(df, groups, value, ranks)
    return d.select(*groups, "n", F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("q"))


def group_statistics(df: DataFrame, groups: Sequence[str], value: str, minimum: int = 5, mad_floor: float = 1e-9) -> DataFrame:
    """(groups, n, median, mad, robust_scale, reason): reason is null where the reference can be used."""
    d = df.select(*groups, x.finite(value).alias("_v")).filter("_v is not null")
    m = staged(quantiles(d, groups, "_v", [0.5]).select(*groups, "n", F.col("q")[0].alias("median")), "medians")
    # A row per group on the other side: AQE broadcasts it while it is small.
    dev = d.alias("a").join(m.alias("b"), F.expr(same("a", "b", groups))).select(*[F.col(f"a.{g}") for g in groups], F.abs(F.col("_v") - F.col("median")).alias("_dev"))
    mad = quantiles(dev, groups, "_dev", [0.5]).select(*groups, F.col("q")[0].alias("mad"))
    s = m.alias("a").join(mad.alias("b"), F.expr(same("a", "b", groups))).select("a.*", "mad")
    return s.withColumn("robust_scale", MAD_FACTOR * F.col("mad")).withColumn("reason", F.when(F.col("n") < minimum, "INSUFFICIENT").when(F.col("mad") < mad_floor, "ZERO_MAD"))


def entity_medians(df: DataFrame, keys: Sequence[str], value: str, hot: int = 50_000) -> DataFrame:
    """(keys, value, observations): the median of the finite observations of each key.

    Keys with up to ``hot`` observations are reduced at once, the few above it by ranks.
    """
    d = df.select(*keys, x.finite(value).alias("_v")).filter("_v is not null")
    sizes = staged(d.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot), "hot")
    if sizes.isEmpty():
        return d.groupBy(*keys).agg(F.median("_v").alias("value"), F.count("*").alias("observations"))
    on = F.expr(same("a", "b", keys))
    cold = d.alias("a").join(sizes.alias("b"), on, "left_anti").groupBy(*keys).agg(F.median("_v").alias("value"), F.count("*").alias("observations"))
    warm = quantiles(d.alias("a").join(sizes.alias("b"), on, "left_semi"), keys, "_v", [0.5])
    return cold.unionByName(warm.select(*keys, F.col("q")[0].alias("value"), F.col("n").alias("observations")))


def _middle(n: Column) -> list[Column]:
    """Three ranks around the middle: what is left of a group without one row has its median among their values."""
    low = F.when(n % 2 == 0, n / 2).otherwise((n - 1) / 2).cast("long")
    return [low, low + 1, low + 2]


def _without(v: Column, n: Column, at: Column) -> Column:
    """The median of a group without one row of the value v, from the values at the ranks of :func:`_middle`.

    Of equal values it does not matter which one goes.
    """
    low, mid, high = at[0], at[1], at[2]
    single = F.when(v > low, low).otherwise(mid)
    double = F.when(low.isNotNull() & (v <= low), (mid + high) / 2).when(v <= mid, (low + high) / 2).otherwise((low + mid) / 2)
    return F.when(n < 2, F.lit(None).cast("double")).when(n % 2 == 0, single).otherwise(double)


def leave_target_out(entities: DataFrame, groups: Sequence[str], key: str = "entity_id", value: str = "value") -> DataFrame:
    """entities with reference_n, reference_median and reference_mad of the others in their group.

    Medians without one row take at most three values a group, so the deviations are
    counted once for each of them: nothing is sorted as a whole, nothing joined to itself.
    """
    g = list(groups)
    m = staged(at_ranks(entities, g, value, _middle), "middles")
    d = entities.alias("a").join(m.alias("b"), F.expr(same("a", "b", g)), "left")
    d = d.select("a.*", (F.coalesce("n", F.lit(1)) - 1).alias("reference_n"), _without(F.col(f"a.{value}"), F.col("n"), F.col("at")).alias("reference_median"))
    d = staged(d, "left_out")
    centres = staged(d.select(*g, F.col("reference_median").alias("_m")).filter("_m is not null").distinct(), "centres")
    dev = entities.alias("a").join(centres.alias("b"), F.expr(same("a", "b", g))).select(*[F.col(f"a.{c}") for c in g], "_m", F.abs(F.col(f"a.{value}") - F.col("_m")).alias("_dev"))
    w = at_ranks(dev, [*g, "_m"], "_dev", _middle)
    on = F.expr(same("a", "b", g) + " and a.reference_median = b._m")
    own = F.abs(F.col(f"a.{value}") - F.col("a.reference_median"))
    return d.alias("a").join(w.alias("b"), on, "left").select("a.*", _without(own, F.col("b.n"), F.col("b.at")).alias("reference_mad"))


def calibrate(df: DataFrame, delta: str, minimum: int = 5, mad_floor: float = 1e-9, eps: float = 1e-4) -> DataFrame:
    """df with signed_excess, sed_plus and status; epsilon never rescues a reference without spread."""
    status = F.when(F.col(delta).isNull(), "NO_DISPLACEMENT").when(F.col("reference_n") < minimum, "INSUFFICIENT").when(F.col("reference_mad") < mad_floor, "ZERO_MAD").otherwise("OK")
    excess = F.col(delta) - F.col("reference_median")
    d = df.withColumn("status", status).withColumn("signed_excess", excess)
    return d.withColumn("sed_plus", F.when(F.col("status") == "OK", F.greatest(F.lit(0.0), excess) / (MAD_FACTOR * F.col("reference_mad") + eps)))


def drift_summary(scores: DataFrame, groups: Sequence[str], value: str = "sed_plus") -> DataFrame:
    """(groups, n, available, share2, q25, median, q75, p95, max) per group, per leading groups and in all; what is summed over is null."""
    v = F.col(value)
    # Every level of the roll-up is a copy of the row with the later groups set to null.
    level = F.explode(F.sequence(F.lit(0), F.lit(len(groups))))
    d = scores.select(*groups, value, level.alias("_level"))
    d = d.select("_level", *[F.when(F.col("_level") > i, F.col(c)).alias(c) for i, c in enumerate(groups)], value)
    keys = ["_level", *groups]
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count(v).alias("available"), F.avg((v >= 2).cast("double")).alias("share2"), F.max(v).alias("max"))
    q = quantiles(d, keys, value, (0.25, 0.5, 0.75, 0.95)).select(*keys, "q")
    j = s.alias("a").join(q.alias("b"), F.expr(same("a", "b", keys)), "left")
    return j.select(*[f"a.{c}" for c in (*groups, "n", "available", "share2")], *[F.col("b.q")[i].alias(n) for i, n in enumerate(("q25", "median", "q75", "p95"))], "a.max")


def merged_buckets(counts: list[tuple[int, int]], support: int, rule: str = "crossfit") -> list[tuple[int, ...]]:
    """Neighbouring buckets joined until each has support.

    counts: (bucket, n) in order.  Rules: ``crossfit`` (n - 1 < support, the smallest
    first), ``observations`` (0 < n < support, the first first), ``entities`` (empty
    ones dropped, n < support, the smallest first).  A sparse bucket joins its larger
    neighbour, the left one on ties.
    """
    groups = [([b], n) for b, n in counts if n > 0 or rule != "entities"]
    sparse = {"crossfit": lambda n: n - 1 < support, "observations": lambda n: 0 < n < support, "entities": lambda n: n < support}[rule]
    while len(groups) > 1:
        at = [i for i, (_, n) in enumerate(groups) if sparse(n)]
        if not at:
            break
        i = at[0] if rule == "observations" else min(at, key=lambda j: groups[j][1])
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(groups)]
        j = max(near, key=lambda j: (groups[j][1], -j))
        a, b = sorted((i, j))
        groups[a : b + 1] = [(groups[a][0] + groups[b][0], groups[a][1] + groups[b][1])]
    return [tuple(b) for b, _ in groups]


def merge_buckets(counts: DataFrame, group: str, support: int, rule: str = "crossfit") -> DataFrame:
    """(group, bucket, merged): counts(group, bucket, n) has a few rows a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["bucket"], pdf["n"]))
        out = {b: "+".join(map(str, g)) for g in merged_buckets(rows, support, rule) for b in g}
        return pd.DataFrame({group: pdf[group].iloc[0], "bucket": list(out), "merged": list(out.values())})

    return counts.groupBy(group).applyInPandas(run, f"{group} string, bucket int, merged string")
