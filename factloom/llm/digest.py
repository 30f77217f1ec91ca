"""Percentiles of very large numeric columns by merging centroid digests (problem 6).

A digest clusters sorted values into centroids whose weight follows a scale
function of the quantile: small at both ends, at most a share of about
pi / (2 * compression) in the middle.  Every input batch gives one digest per
group, digests merge by clustering their centroids again (first under a salt, so
a hot group is merged in many tasks, then per group), and digests of separate
portions or days combine in the same way.

A second pass over the rows counts how many lie below and up to each estimate,
which certifies its error of rank.  Stated bound: |rank - q*n| <= RANK_BOUND*n
+ 1; the certified error of every estimate is in the result, and groups with an
error above the bound are digested again, finer, until they keep it.

Defined results: null, NaN and infinite values do not count; null group keys
form groups; groups without a finite value have no row; every delivered row
counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import same, staged

COMPRESSION = 400
RANK_BOUND = 0.01
QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
SALTS = 32


def cluster(means: np.ndarray, weights: np.ndarray, compression: int = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted (mean, weight): neighbours join while the scale function grows by less than 1."""
    total = weights.sum()
    if len(means) <= compression // 2:
        return means, weights
    end = np.cumsum(weights)
    # k(q) = compression / (2 pi) * asin(2q - 1); a centroid may span one unit of k.
    k = compression / (2 * np.pi) * np.arcsin(np.clip(2 * (end - weights / 2) / total - 1, -1, 1))
    cell = np.floor(k - k[0]).astype(np.int64)
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    w = np.add.reduceat(weights, starts)
    m = np.add.reduceat(means * weights, starts) / w
    # Rounding must not take a mean out of its own cell.
    last = np.append(starts[1:], len(means)) - 1
    return np.clip(m, means[starts], means[last]), w


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """Between the centres of neighbouring centroids the value is linear in rank."""
    total = weights.sum()
    centre = np.cumsum(weights) - weights / 2
    x = np.concatenate([[0.0], centre, [total]])
    y = np.concatenate([[low], means, [high]])
    return float(np.interp(q * total, x, y))


_FIELDS = "low double, high double, n long, means array<double>, weights array<long>"


def _row(values: np.ndarray, weights: np.ndarray, low: float, high: float, compression: int) -> dict:
    order = np.argsort(values, kind="stable")
    m, w = cluster(values[order], weights[order], compression)
    return {"low": low, "high": high, "n": int(w.sum()), "means": m.tolist(), "weights": w.astype(np.int64).tolist()}


def partial_digests(df: DataFrame, group: Column, value: str, compression: int = COMPRESSION) -> DataFrame:
    """(g, digest) of the values of each input batch, g being a string key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for g, parts in held.items():
                v = np.concatenate(parts)
                rows.append({"g": g} | _row(v, np.ones(len(v)), float(v.min()), float(v.max()), compression))
            return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

        for b in batches:
            codes = b.column(0).dictionary_encode()
            names, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            v = b.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
            for i, j in zip(cuts, np.append(cuts[1:], len(order))):
                held.setdefault(names[at[order[i]]], []).append(v[order[i:j]])
            size += len(v)
            if size >= 1_000_000:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return df.filter(finite).select(group.alias("g"), F.col(value).cast("double").alias("v")).mapInArrow(run, f"g string, {_FIELDS}")


_ARROW = pa.schema([("g", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64()), ("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.int64()))])


def merge_digests(digests: DataFrame, compression: int = COMPRESSION, salts: int = SALTS) -> DataFrame:
    """(g, digest): the digests of each g as one; any number of portions may be united before."""

    def merge(t: pa.Table) -> pa.Table:
        means = t.column("means").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        weights = t.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        row = _row(means, weights, min(t.column("low").to_pylist()), max(t.column("high").to_pylist()), compression)
        return pa.Table.from_pylist([{"g": t.column("g")[0].as_py()} | row], schema=_ARROW)

    out = f"g string, {_FIELDS}"
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("means", "n"), F.lit(salts)))
    first = salted.groupBy("g", "salt").applyInArrow(merge, out)
    return first.groupBy("g").applyInArrow(merge, out)


def estimates(digests: DataFrame, quantiles: list[float] = QUANTILES) -> DataFrame:
    """(g, n, est): est has the estimate of each quantile, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"g": r["g"], "n": r["n"], "est": [quantile(np.array(r["means"]), np.array(r["weights"], float), r["low"], r["high"], q) for q in quantiles]} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("g", pa.string()), ("n", pa.int64()), ("est", pa.list_(pa.float64()))]))

    return digests.mapInArrow(run, "g string, n long, est array<double>")


def group_key(*columns: str) -> Column:
    """One string for several keys; nulls differ from every text."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))


#: How much finer a group is digested again, and up to which compression.
FINER, FINEST = 8, COMPRESSION * 8**4


def percentiles(df: DataFrame, groups: list[str], value: str, quantiles: list[float] = QUANTILES, digests: DataFrame | None = None, broadcast_groups: int = 20_000, compression: int = COMPRESSION, bound: float = RANK_BOUND) -> DataFrame:
    """(groups, n, q, estimate, rank_error): rank_error is certified, as a share of n, and within the bound."""
    done = []
    while True:
        made = staged(_certified(df, groups, value, quantiles, digests, broadcast_groups, compression), "certified")
        over = F.max(F.col("rank_error") * F.col("n") > F.lit(bound) * F.col("n") + 1)
        bad = staged(made.groupBy(*groups).agg(over.alias("over")).filter("over").select(*groups), "over")
        if bad.isEmpty():
            return reduce(DataFrame.unionByName, [*done, made])
        if compression >= FINEST:
            raise ArithmeticError(f"estimates of {value} exceed the bound on their ranks")
        on = F.expr(same("a", "b", groups))
        done.append(made.alias("a").join(bad.alias("b"), on, "left_anti"))
        df, digests, compression = df.alias("a").join(bad.alias("b"), on, "left_semi"), None, compression * FINER


def _certified(df: DataFrame, groups: list[str], value: str, quantiles: list[float], digests: DataFrame | None, broadcast_groups: int, compression: int) -> DataFrame:
    g = group_key(*groups)
    digests = staged(digests if digests is not None else merge_digests(partial_digests(df, g, value, compression), compression), "digests")
    est = staged(estimates(digests, quantiles), "estimates")
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    # Own names are marked, as the groups may have any.
    rows = df.filter(finite).select(*groups, g.alias("__g"), F.col(value).cast("double").alias("__v"))
    # A row per group: broadcast while their number is small, else a join that AQE may split.
    side = est.select(F.col("g").alias("__g"), F.col("est").alias("__est"))
    side = F.broadcast(side) if est.count() <= broadcast_groups else side
    hit = rows.join(side, "__g")
    v, e = F.col("__v"), F.col("__est")
    counts = [F.sum((v < e[i]).cast("long")).alias(f"__lt{i}") for i in range(len(quantiles))] + [F.sum((v <= e[i]).cast("long")).alias(f"__le{i}") for i in range(len(quantiles))]
    sums = hit.groupBy("__g", *groups).agg(F.count("*").alias("__n"), F.first("__est").alias("__est"), *counts)
    per = []
    for i, q in enumerate(quantiles):
        n = F.col("__n")
        err = F.greatest(F.col(f"__lt{i}") - F.lit(q) * n, F.lit(q) * n - F.col(f"__le{i}"), F.lit(0.0)) / n
        per.append(F.struct(F.lit(q).alias("q"), e[i].alias("estimate"), err.alias("rank_error")))
    return sums.select(*groups, F.col("__n").alias("n"), F.explode(F.array(*per)).alias("__e")).select(*groups, "n", "__e.*")
