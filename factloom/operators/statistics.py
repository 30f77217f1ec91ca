"""Panel statistics: two-way fixed effects, clustered errors, wild bootstrap, plateau rules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import staged

WEBB = np.array([s * math.sqrt(v) for s in (-1, 1) for v in (1.5, 1.0, 0.5)])


def informative(panel: DataFrame, unit: str, least: int = 2) -> DataFrame:
    """Rows of units that have at least two rows."""
    return panel.withColumn("_n", F.count("*").over(Window.partitionBy(unit))).filter(F.col("_n") >= least).drop("_n")


def demean_balanced(panel: DataFrame, unit: str, time: str, columns: list[str]) -> DataFrame:
    """panel with <column>_tilde: less the means of unit and time, plus the grand mean (exact for balanced panels).

    The means are aggregates joined back, so no window over the whole panel is needed.
    """
    u = panel.groupBy(unit).agg(*[F.avg(c).alias(f"_u_{c}") for c in columns])
    t = panel.groupBy(time).agg(*[F.avg(c).alias(f"_t_{c}") for c in columns])
    g = panel.agg(*[F.avg(c).alias(f"_g_{c}") for c in columns])
    d = panel.join(u, unit).join(t, time).join(F.broadcast(g))
    return d.select(*panel.columns, *[(F.col(c) - F.col(f"_u_{c}") - F.col(f"_t_{c}") + F.col(f"_g_{c}")).alias(f"{c}_tilde") for c in columns])


def demean_iterated(panel: DataFrame, unit: str, time: str, columns: list[str], tolerance: float = 1e-9, limit: int = 500) -> DataFrame:
    """The same for unbalanced panels by alternating projections in the JVM; each round is written once.

    Rounds go on until no mean of a unit that is still there exceeds ``tolerance``
    times the column's spread; without that after ``limit`` rounds it is an error.
    """
    d = staged(panel.select("*", *[F.col(c).cast("double").alias(f"{c}_tilde") for c in columns]), "demeaned")
    spread = d.agg(*[F.coalesce(F.stddev_pop(f"{c}_tilde"), F.lit(0.0)).alias(c) for c in columns]).first()
    for done in range(limit):
        left = d.groupBy(unit).agg(*[F.abs(F.avg(f"{c}_tilde")).alias(c) for c in columns]).agg(*[F.max(c).alias(c) for c in columns]).first()
        # The times are even after each round, so the units alone tell.
        if done and all((left[c] or 0.0) <= tolerance * max(spread[c], 1e-300) for c in columns):
            return d
        for by in (unit, time):
            m = d.groupBy(by).agg(*[F.avg(f"{c}_tilde").alias(f"_m_{c}") for c in columns])
            d = d.join(m, by).select(*panel.columns, *[(F.col(f"{c}_tilde") - F.col(f"_m_{c}")).alias(f"{c}_tilde") for c in columns])
        d = staged(d, "demeaned")
    raise ArithmeticError("the panel's means did not converge")


def fit_fixed_effects(demeaned: DataFrame, y: str, x: str, cluster: str, regressors: int = 1) -> DataFrame:
    """(n, clusters, beta, se, t_stat): one regressor, errors clustered and adjusted by G/(G-1) (N-1)/(N-K).

    K counts the regressors that were fitted, those partialled out before included.
    """
    a, b = F.col(f"{x}_tilde"), F.col(f"{y}_tilde")
    sums = demeaned.groupBy(cluster).agg(F.sum(a * b).alias("xy"), F.sum(a * a).alias("xx"), F.count("*").alias("n"))
    total = sums.agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), F.try_divide(F.sum("xy"), F.sum("xx")).alias("beta"), F.sum("xx").alias("xx_all"))
    # A cluster's score is sum x (y - beta x); only a row per cluster is needed.
    s = sums.select("xy", "xx").join(F.broadcast(total)).withColumn("score", F.col("xy") - F.col("beta") * F.col("xx"))
    out = s.groupBy("n", "clusters", "beta", "xx_all").agg(F.sum(F.col("score") * F.col("score")).alias("meat"))
    adjust = F.try_divide(F.col("clusters") * (F.col("n") - 1), (F.col("clusters") - 1) * (F.col("n") - regressors))
    out = out.withColumn("se", F.try_divide(F.sqrt(adjust * F.col("meat")), F.col("xx_all")))
    return out.select("n", "clusters", "beta", "se", F.try_divide(F.col("beta"), F.col("se")).alias("t_stat"))


def partial_out(demeaned: DataFrame, columns: list[str], control: str) -> DataFrame:
    """demeaned with the part of each column's residual that the control explains taken away: fits on it equal those with the control."""
    c, raw = F.col(f"{control}_tilde"), F.col(control)
    # A control that unit and time explain but for rounding takes nothing away.
    varies = F.sum(c * c) > 1e-12 * F.sum(raw * raw)
    slopes = demeaned.agg(*[F.when(varies, F.try_divide(F.sum(F.col(f"{k}_tilde") * c), F.sum(c * c))).alias(f"_s_{k}") for k in columns])
    d = demeaned.join(F.broadcast(slopes))
    return d.select(*[k for k in demeaned.columns if k not in {f"{k}_tilde" for k in columns}], *[(F.col(f"{k}_tilde") - F.coalesce(F.col(f"_s_{k}"), F.lit(0.0)) * c).alias(f"{k}_tilde") for k in columns])


def wild_bootstrap(demeaned: DataFrame, y: str, x: str, cluster: str, draws: int = 999, seed: int = 101) -> DataFrame:
    """(clusters, draws, p): restricted wild cluster bootstrap-t with six-point weights.

    A draw needs each cluster's sums of x*y and x*x only, so the rows are reduced to
    one per cluster before anything is gathered; p = (exceeding + 1) / (draws + 1).
    """
    a, b = F.col(f"{x}_tilde"), F.col(f"{y}_tilde")
    sums = demeaned.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.sum(a * b).alias("xy"), F.sum(a * a).alias("xx"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        xy, xx = pdf["xy"].to_numpy(), pdf["xx"].to_numpy()
        all_xx = xx.sum()

        def t(v: np.ndarray) -> np.ndarray:
            beta = (v * xy).sum(axis=-1) / all_xx
            score = v * xy - beta[..., None] * xx
            se = np.sqrt(len(xx) / (len(xx) - 1) * (score**2).sum(axis=-1)) / all_xx
            return np.where(se > 1e-12, np.abs(beta) / np.maximum(se, 1e-12), 0.0)

        base = t(np.ones((1, len(xx))))[0]
        v = np.random.default_rng(seed).choice(WEBB, size=(draws, len(xx)))
        return pd.DataFrame({"clusters": [len(xx)], "draws": [draws], "p": [(int((t(v) >= base).sum()) + 1) / (draws + 1)]})

    return sums.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "clusters int, draws int, p double")


def estimate(panel: DataFrame, label: str, unit: str, time: str, y: str, x: str, control: str | None = None, draws: int = 999) -> DataFrame:
    """(label, status, n, clusters, beta, se, t_stat, p, mde80) of one fit, in one row.

    Rows without exposure, outcome or control are dropped, then units with one row.
    NO_DATA, FEW_CLUSTERS (under 2) and NO_VARIATION (of the exposure, once unit, time
    and control are taken out) give no estimate.  mde80 is 2.8 standard errors.
    """
    columns = [y, x, *([control] if control else [])]
    p = informative(panel.select(unit, time, *columns).dropna(subset=columns), unit)
    d = staged(demean_iterated(p, unit, time, columns), "estimate")
    if control:
        d = staged(partial_out(d, [y, x], control), "estimate")
    a = F.col(f"{x}_tilde")
    size = d.agg(F.count("*").alias("n"), F.countDistinct(time).alias("clusters"), F.sum(a * a).alias("left"), F.sum(F.col(x) * F.col(x)).alias("all")).first()
    status = "NO_DATA" if not size["n"] else "FEW_CLUSTERS" if size["clusters"] < 2 else "NO_VARIATION" if size["left"] <= 1e-12 * max(size["all"], 1e-300) else "OK"
    head = d.sparkSession.range(1).select(F.lit(label).alias("label"), F.lit(status).alias("status"))
    if status != "OK":
        none = [F.lit(None).cast("double").alias(c) for c in ("beta", "se", "t_stat", "p", "mde80")]
        return head.select("*", F.lit(size["n"]).cast("long").alias("n"), F.lit(size["clusters"]).cast("long").alias("clusters"), *none)
    fit = fit_fixed_effects(d, y, x, time, 1 + bool(control))
    p_of = wild_bootstrap(d, y, x, time, draws).select("p")
    # One row each.
    return head.join(F.broadcast(fit)).join(F.broadcast(p_of)).select("label", "status", "n", "clusters", "beta", "se", "t_stat", "p", (2.8 * F.col("se")).alias("mde80"))


def testability(jobs: DataFrame, primary: str, least_rows: int = 100, least_clusters: int = 5) -> DataFrame:
    """(status, rows, clusters): TESTABLE where the primary fit has an estimate on enough rows and clusters."""
    one = jobs.filter(F.col("label") == primary).agg(F.max("n").alias("rows"), F.max("clusters").alias("clusters"), F.coalesce(F.bool_or(F.col("status") == "OK"), F.lit(False)).alias("ok"))
    good = F.col("ok") & (F.col("rows") >= least_rows) & (F.col("clusters") >= least_clusters)
    return one.select(F.when(good, "TESTABLE").otherwise("NOT_TESTABLE").alias("status"), "rows", "clusters")


def _poisson_cuts() -> np.ndarray:
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap_interval(df: DataFrame, group: str, value: str, key: str, draws: int = 200, level: float = 0.95) -> DataFrame:
    """(group, mean, low, high): percentile interval of the mean by Poisson resampling with hashed counts.

    A row's count in draw k is a Poisson(1) number made from a hash of its key and the
    draw, so the result does not depend on partitions; rows with one key are drawn
    together.  A batch is reduced to two sums per group and draw before anything is
    shuffled.
    """
    cuts = _poisson_cuts()
    step = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        offsets = (np.arange(1, draws + 1, dtype=np.uint64) * step)[None, :]
        for b in batches:
            codes = b.column(0).dictionary_encode()
            names, at = codes.dictionary.to_pylist(), codes.indices.fill_null(len(codes.dictionary)).to_numpy()
            names = [*names, None]
            v, ids = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(v), 4096):
                x = ids[lo : lo + 4096, None] + offsets
                # Mixing of the sum's bits: every draw of a row has its own number.
                x ^= x >> np.uint64(30)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(27)
                x *= np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
                w = np.searchsorted(cuts, (x >> np.uint64(11)) * (1.0 / (1 << 53)), side="right")
                part, y = at[lo : lo + 4096], v[lo : lo + 4096]
                for g in np.unique(part):
                    own = part == g
                    both = held.setdefault(names[g], np.zeros((2, draws)))
                    both[0] += w[own].sum(axis=0)
                    both[1] += y[own] @ w[own]
        n = len(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g in held for _ in range(draws)], pa.string()), pa.array(np.tile(np.arange(draws, dtype=np.int32), n)), pa.array(np.concatenate([b[0] for b in held.values()]) if n else []), pa.array(np.concatenate([b[1] for b in held.values()]) if n else [])],
            schema=pa.schema([("g", pa.string()), ("k", pa.int32()), ("w", pa.float64()), ("s", pa.float64())]),
        )

    d = df.filter(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(key).alias("id"))
    mean = d.groupBy("g").agg(F.avg("v").alias("mean"))
    per = d.mapInArrow(run, "g string, k int, w double, s double").groupBy("g", "k").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    a = (1 - level) / 2
    # A row per draw: the number of draws bounds a group.
    q = per.groupBy("g").agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return mean.alias("a").join(q.alias("b"), F.expr("a.g <=> b.g")).select(F.col("a.g").alias(group), "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _blocks(losses: DataFrame, group: str, epoch: str, loss: str, block: int) -> DataFrame:
    """Per group: means and spreads of the last two blocks of epochs, the first loss, and whether the losses suffice.

    A group is one training run, so its number of epochs bounds the window.
    """
    w = Window.partitionBy(group)
    at = F.row_number().over(w.orderBy(F.desc(epoch))) - 1
    d = losses.withColumn("_b", F.floor(at / block)).withColumn("_first", F.min_by(loss, epoch).over(w))
    m = lambda f, k: f(F.when(F.col("_b") == k, F.col(loss)))
    finite = F.coalesce(~F.isnan(loss) & (F.abs(F.col(loss)) < float("inf")), F.lit(False))
    return d.groupBy(group).agg(
        m(F.avg, 0).alias("last"), m(F.avg, 1).alias("before"), m(F.var_samp, 0).alias("v0"), m(F.var_samp, 1).alias("v1"), F.max("_first").alias("first"), ((F.count("*") >= 2 * block) & F.bool_and(finite)).alias("enough")
    )


def plateau(losses: DataFrame, group: str, epoch: str, loss: str, block: int = 10, relative: float = 0.01, absolute: float = 0.002, reduction: float = 0.75) -> DataFrame:
    """(group, last, before, converged) by the means of the last two blocks of epochs.

    They differ by at most a share or an absolute amount, and the loss has fallen by
    at least ``reduction``; runs that are too short or not finite have not converged.
    """
    s = _blocks(losses, group, epoch, loss, block)
    flat = F.abs(F.col("last") - F.col("before")) <= F.greatest(relative * F.col("before"), F.lit(absolute))
    fallen = F.col("last") <= (1 - reduction) * F.col("first")
    return s.select(group, "last", "before", F.coalesce(F.col("enough") & flat & fallen, F.lit(False)).alias("converged"))


def noise_aware_plateau(losses: DataFrame, group: str, epoch: str, loss: str, block: int = 20, z: float = 2.0, most: float = 0.5) -> DataFrame:
    """(group, gap, error, converged): the difference of the last two blocks against its standard error, and a loss of at most ``most`` of the first."""
    s = _blocks(losses, group, epoch, loss, block).withColumn("gap", F.col("last") - F.col("before")).withColumn("error", F.sqrt((F.col("v0") + F.col("v1")) / block))
    good = F.col("enough") & (F.abs("gap") <= z * F.col("error")) & (F.col("last") <= most * F.col("first"))
    return s.select(group, "gap", "error", F.coalesce(good, F.lit(False)).alias("converged"))
