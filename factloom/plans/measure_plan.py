"""Reference noise, drift, ranking, panel statistics and embedding geometry, with their SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import geometry, graph, nullmodel, ranking
from ..operators import statistics as stats
from ..runtime import load, same, staged
from ..sources.bindings import edges

GROUP = ["transition_id", "bucket_id"]
SNAPSHOTS = [f"T{i:02d}" for i in range(1, 11)]
PAIRS = list(zip(SNAPSHOTS, SNAPSHOTS[1:]))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _noise(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "saved_null_observations_v1")


def null_bucket_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(nullmodel.group_statistics(_noise(spark, d), GROUP, "noise_displacement"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return nullmodel.entity_medians(_noise(spark, d).filter("entity_id is not null"), [*GROUP, "entity_id"], "noise_displacement")


def null_entity_medians(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_entities(spark, d))


def _references(spark: SparkSession, d: str) -> DataFrame:
    e = staged(_entities(spark, d).select(*GROUP, "entity_id", "value"), "medians")
    return nullmodel.leave_target_out(e, GROUP)


def null_leave_target_out(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_references(spark, d))


def _drift(spark: SparkSession, d: str) -> DataFrame:
    """The largest observation of an entity, as its displacement, against the noise of the others in its bucket."""
    top = _noise(spark, d).withColumn("v", x.finite("noise_displacement")).filter("entity_id is not null").groupBy(*GROUP, "entity_id").agg(F.max("v").alias("delta"))
    r = _references(spark, d)
    j = top.alias("t").join(r.alias("r"), F.expr("t.transition_id <=> r.transition_id and t.bucket_id <=> r.bucket_id and t.entity_id = r.entity_id"), "left")
    s = j.select("t.transition_id", "t.bucket_id", "t.entity_id", "delta", F.coalesce("reference_n", F.lit(0)).alias("reference_n"), "reference_median", "reference_mad")
    return nullmodel.calibrate(s, "delta", mad_floor=1e-6)


def drift_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_drift(spark, d), 9).withColumn("sed_plus", F.round("sed_plus", 4))


def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _drift(spark, d).withColumn("transition_id", F.coalesce("transition_id", F.lit("?"))).withColumn("bucket_id", F.coalesce("bucket_id", F.lit("?")))
    return _rounded(nullmodel.drift_summary(s, GROUP), 4)


def bucket_merges(spark: SparkSession, d: str) -> DataFrame:
    """Degree buckets of each transition joined until each has 400 entities, by three rules."""
    n = _noise(spark, d).filter("transition_id is not null and entity_id is not null").withColumn("bucket", F.when(F.col("pretransition_degree") < 3, 0).when(F.col("pretransition_degree") < 6, 1).otherwise(2))
    c = staged(n.groupBy("transition_id", "bucket").agg(F.countDistinct("entity_id").alias("n")), "counts")
    parts = [nullmodel.merge_buckets(c, "transition_id", 60, r).withColumn("rule", F.lit(r)) for r in ("crossfit", "observations", "entities")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def noise_seed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per transition and pair of seeds: observations, how many are finite, their median and range."""
    keys = ["transition_id", "source_seed", "target_seed"]
    n = _noise(spark, d).select(*keys, x.finite("noise_displacement").alias("v"))
    s = n.groupBy(*keys).agg(F.count("*").alias("n"), F.count("v").alias("usable"), (F.max("v") - F.min("v")).alias("spread"))
    q = nullmodel.quantiles(n, keys, "v", [0.5]).select(*keys, F.col("q")[0].alias("median"))
    return _rounded(s.alias("a").join(q.alias("b"), F.expr(same("a", "b", keys)), "left").select("a.*", "median"))


# Ranking over the embeddings: a stated set of queries against all rows ----------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").filter("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "vec")
    return ranking.score_queries(q, v.select(F.col("vec_id").alias("candidate"), "vec"))


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gold: the next vector of the query's label; the label's other vectors are true answers too."""
    v = _vectors(spark, d).select("vec_id", "label")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label")
    same = q.join(v.select(F.col("vec_id").alias("candidate"), "label"), "label").filter("candidate <> query")
    gold = same.filter("candidate > query").groupBy("query").agg(F.min("candidate").alias("gold"))
    own = q.select("query", F.col("query").alias("candidate"))
    return gold, same.select("query", "candidate").unionByName(own)


def _ranks(spark: SparkSession, d: str, filtered: bool) -> DataFrame:
    v = _vectors(spark, d)
    gold, true = _gold(spark, d)
    q = gold.join(v.select(F.col("vec_id").alias("query"), "vec"), "query")
    return ranking.filtered_ranks(q, v.select(F.col("vec_id").alias("candidate"), "vec"), true if filtered else None)


def rank_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d, True).select("query", "gold", "rank", F.round("reciprocal", 9).alias("reciprocal"))


def rank_raw(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d, False).select("query", "gold", "rank", F.round("reciprocal", 9).alias("reciprocal"))


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = _ranks(spark, d, True).join(_vectors(spark, d).select(F.col("vec_id").alias("query"), "label"), "query").withColumn("half", F.col("query") % 100 < 50)
    return _rounded(ranking.metrics(r, ["label", "half"]))


def _held_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges with fold, those held out, vectors trained without them)."""
    folds = staged(graph.covered_folds(edges(spark, d), 5), "folds")
    held = folds.filter("fold = 0")
    return folds, held, staged(geometry.train(folds.filter("fold <> 0")), "vectors")


def rank_triples(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of each held-out triple by vectors trained without it, other known ends left out: the mean reciprocal of both sides per seed, and its median over seeds."""
    folds, held, v = _held_out(spark, d)
    r = ranking.triple_ranks(v, held, folds)
    per = r.groupBy("snapshot_id", "seed", "h", "r", "t").agg(F.avg("reciprocal").alias("reciprocal"), F.max(F.when(F.col("side") == "tail", F.col("rank"))).alias("tail_rank"), F.max(F.when(F.col("side") == "head", F.col("rank"))).alias("head_rank"))
    return per.groupBy("snapshot_id", "h", "r", "t").agg(F.median("reciprocal").alias("reciprocal"), F.median("tail_rank").alias("tail_rank"), F.median("head_rank").alias("head_rank"), F.count("*").alias("seeds"))


def model_against_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Per snapshot: mean reciprocal rank of held-out tails by trained vectors, by frequency in training, and of a random order."""
    folds, held, v = _held_out(spark, d)
    model = ranking.triple_ranks(v, held, folds, ["tail"]).groupBy("snapshot_id").agg(F.avg("reciprocal").alias("model_mrr"), F.count("*").alias("queries"))
    base = graph.frequency_ranks(folds.filter("fold <> 0").drop("fold"), held.drop("fold"), ["snapshot_id"]).groupBy("snapshot_id").agg(F.avg(1 / F.col("rank")).alias("frequency_mrr"))
    n = v.filter("kind = 'entity'").select("snapshot_id", "id").distinct().groupBy("snapshot_id").agg(F.count("*").alias("n")).select("snapshot_id", x.random_mrr("n").alias("random_mrr"))
    return model.join(base, "snapshot_id").join(n, "snapshot_id")


def _panel_paths(e: DataFrame) -> DataFrame:
    """The capped two-hop paths between entities of degree three and more."""
    eligible = graph.degrees(e).filter("degree >= 3").select("snapshot_id", "entity")
    return staged(graph.cap_per_head(graph.simple_paths(e, 2, eligible), 3), "paths")


def rank_paths(spark: SparkSession, d: str) -> DataFrame:
    """The end of each two-hop path of the capped panel, other ends of its relation sequence left out; the medians over seeds."""
    e = staged(edges(spark, d), "edges")
    r = ranking.path_ranks(_trained(spark, d, False), _panel_paths(e), e, geometry.SEEDS)
    return r.groupBy("snapshot_id", F.array_join("path", ">").alias("path")).agg(F.median("reciprocal").alias("reciprocal"), F.median("rank").alias("rank"), F.count("*").alias("seeds"))


def panel_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank of the panel per snapshot in two universes of candidates, and their contrast over the paths that both can rank."""
    e = staged(edges(spark, d), "edges")
    first = e.filter(F.col("snapshot_id") == PAIRS[0][0]).select(F.explode(F.array("h", "t")).alias("id"))
    r = ranking.path_ranks(_trained(spark, d, False), _panel_paths(e), e, geometry.SEEDS, first)
    # The median leaves out the paths that a universe can't rank, as nulls.
    able = lambda name: F.median(F.when(F.col(f"rank{name}") < float("inf"), F.col(f"reciprocal{name}")))
    j = r.groupBy("snapshot_id", F.array_join("path", ">").alias("path")).agg(able("").alias("open_world"), able("_within").alias("seen_at_first")).filter("open_world is not null")
    return j.groupBy("snapshot_id").agg(F.avg("open_world").alias("open_world"), F.avg("seen_at_first").alias("seen_at_first"), F.avg(F.col("seen_at_first") - F.col("open_world")).alias("contrast"), F.count("*").alias("paths"))


def rank_top3(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d).filter("candidate <> query")
    return ranking.top_k(s, 3).select("query", "candidate", "position", F.round("score", 6).alias("score"))


def vector_products(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the mean vector of its label."""
    v = _vectors(spark, d)
    m = v.select("label", F.posexplode("vec").alias("i", "c")).groupBy("label", "i").agg(F.avg("c").alias("c"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("mean"))
    j = v.join(m, "label")
    return _rounded(j.select("vec_id", x.norm("vec").alias("norm"), x.dot("vec", "mean").alias("dot"), x.distance("vec", "mean").alias("distance"), x.cosine("vec", "mean").alias("cosine"), x.norm(x.normalise("vec")).alias("unit")), 5)


# Panels --------------------------------------------------------------------------------------------


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Events by user and day; y the mean value, x the number."""
    e = load(spark, d, "events").select(F.col("user_id").alias("unit"), F.to_date("ts").alias("time"), "value")
    return e.groupBy("unit", "time").agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("x"))


def _weeks(spark: SparkSession, d: str) -> DataFrame:
    """Events by user and week: the users with all four weeks are a balanced panel."""
    e = load(spark, d, "events").select(F.col("user_id").alias("unit"), F.floor((F.dayofmonth("ts") - 1) / 7).alias("time"), "value").filter("time < 4")
    p = e.groupBy("unit", "time").agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("x"))
    full = p.groupBy("unit").agg(F.count("*").alias("n")).filter("n = 4").select("unit")
    return p.join(full, "unit", "left_semi")


def panel_demeaned(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.demean_balanced(_weeks(spark, d), "unit", "time", ["y", "x"]), 6)


def panel_fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    p = stats.demean_balanced(_weeks(spark, d), "unit", "time", ["y", "x"])
    return _rounded(stats.fit_fixed_effects(p, "y", "x", "time"), 6)


def panel_unbalanced(spark: SparkSession, d: str) -> DataFrame:
    p = stats.demean_iterated(stats.informative(_panel(spark, d), "unit"), "unit", "time", ["y", "x"])
    return _rounded(stats.fit_fixed_effects(p, "y", "x", "time"), 6)


def panel_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = stats.demean_iterated(stats.informative(_panel(spark, d), "unit"), "unit", "time", ["y", "x"])
    return stats.wild_bootstrap(p, "y", "x", "time")


def panel_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of the primary fit, with a control, of a falsified exposure, and without each of the first times."""
    p = staged(_panel(spark, d).withColumn("size", F.log1p("x")).withColumn("z", (F.pmod(F.xxhash64("unit", "time"), F.lit(1000)) / 1000.0)), "panel")
    jobs = [stats.estimate(p, "primary", "unit", "time", "y", "x"), stats.estimate(p, "control", "unit", "time", "y", "x", "z"), stats.estimate(p, "falsified", "unit", "time", "y", "z")]
    for r in p.select("time").distinct().orderBy("time").limit(3).collect():
        jobs.append(stats.estimate(p.filter(F.col("time") != r["time"]), f"without_{r['time']}", "unit", "time", "y", "x"))
    return reduce(DataFrame.unionByName, jobs)


def panel_informative(spark: SparkSession, d: str) -> DataFrame:
    return stats.informative(_panel(spark, d), "unit").groupBy("unit").agg(F.count("*").alias("rows"))


def mean_intervals(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_interval(load(spark, d, "events"), "event_type", "value", "event_id")


def _losses(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value by type and hour of the month, as a stand-in for a loss by epoch."""
    e = load(spark, d, "events").select("event_type", ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).alias("epoch"), "value")
    return e.groupBy("event_type", "epoch").agg(F.avg("value").alias("loss"))


def loss_plateau(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.plateau(_losses(spark, d), "event_type", "epoch", "loss", 50), 6)


def loss_noise_plateau(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.noise_aware_plateau(_losses(spark, d), "event_type", "epoch", "loss", 50), 6)


# Geometry ------------------------------------------------------------------------------------------


def _trained(spark: SparkSession, d: str, kept: bool = True) -> DataFrame:
    """Trained vectors; not kept for those that read them once."""
    v = geometry.train(edges(spark, d))
    return staged(v, "vectors") if kept else v


def transe_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, norms and loss of the trained vectors of each snapshot and seed; converged by the noise-aware plateau of its losses."""
    v = _trained(spark, d)
    l = v.filter("kind = 'loss'").withColumn("fit", F.struct("snapshot_id", "seed")).select("fit", F.posexplode("vec").alias("epoch", "loss"))
    c = stats.noise_aware_plateau(l, "fit", "epoch", "loss").select("fit.snapshot_id", "fit.seed", "converged")
    n = v.filter("kind <> 'loss'").groupBy("snapshot_id", "seed", "kind").agg(F.count("*").alias("n"), F.avg(x.norm("vec")).alias("mean_norm"), F.max("loss").alias("loss"), F.min(x.all_finite("vec").cast("int")).alias("all_finite"))
    return n.join(c, ["snapshot_id", "seed"])


def _side_by_side(spark: SparkSession, d: str, listed: Sequence[tuple]) -> DataFrame:
    return staged(geometry.side_by_side(_trained(spark, d, False), listed), "wide")


def embedding_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The rotation of every comparison: how orthogonal it is, what it spans, and the mean distance of what it carries over."""
    listed = geometry.comparisons(PAIRS)
    wide = _side_by_side(spark, d, listed)
    fits = geometry.fitted(wide, listed)
    r = geometry.distances_side_by_side(wide, fits, listed).groupBy(*geometry.COMPARISON).agg(F.avg("distance").alias("residual"), F.count("*").alias("entities"))
    return fits.select(*geometry.COMPARISON, "orthogonality_error", "rank").join(r, geometry.COMPARISON)


def embedding_displacement(spark: SparkSession, d: str) -> DataFrame:
    listed = [c for c in geometry.comparisons(PAIRS) if c[1] == "drift"]
    return geometry.displacement_side_by_side(_side_by_side(spark, d, listed), listed)


def _observed(spark: SparkSession, d: str, roles: Sequence[str] = ("null", "drift")) -> DataFrame:
    listed = [c for c in geometry.comparisons(PAIRS) if c[1] in roles]
    wide = _side_by_side(spark, d, listed)
    return staged(geometry.distances_side_by_side(wide, geometry.fitted(wide, listed), listed), "observations")


def _degree_buckets(spark: SparkSession, d: str) -> DataFrame:
    """(a, id, bucket_id): the degree bucket of each entity in the snapshot a."""
    return graph.degrees(edges(spark, d)).select(F.col("snapshot_id").alias("a"), F.col("entity").alias("id"), x.degree_bucket("degree").alias("bucket_id"))


def embedding_drift(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's displacement over a transition against the noise of retraining: six null observations an entity, three of drift.

    The reference of an entity is made of the medians of the others of its degree
    bucket; seed_range is how far the three displacements lie apart.
    """
    o = _observed(spark, d)
    null = nullmodel.entity_medians(o.filter("role = 'null'"), ["transition_id", "id"], "distance")
    at = null.withColumn("a", F.split("transition_id", "->")[0]).join(_degree_buckets(spark, d), ["a", "id"])
    ref = nullmodel.leave_target_out(staged(at.select("transition_id", "bucket_id", "id", "value"), "null"), ["transition_id", "bucket_id"], key="id")
    # Three rows an entity.
    drift = o.filter("role = 'drift'").groupBy("transition_id", "id").agg(F.median("distance").alias("delta"), (F.max("distance") - F.min("distance")).alias("seed_range"))
    return nullmodel.calibrate(ref.join(drift, ["transition_id", "id"], "left"), "delta")


def embedding_noise_floor(spark: SparkSession, d: str) -> DataFrame:
    """Median distance of the same entity between seeds, per transition and degree bucket, beside that of two random directions (1)."""
    o = _observed(spark, d, ["null"]).withColumn("a", F.split("transition_id", "->")[0]).join(_degree_buckets(spark, d), ["a", "id"])
    q = nullmodel.quantiles(staged(o.select("transition_id", "bucket_id", "distance"), "bucketed"), ["transition_id", "bucket_id"], "distance", [0.5])
    return q.select("transition_id", "bucket_id", "n", F.col("q")[0].alias("noise"), F.lit(1.0).alias("random"))


QUERIES = {
    f.__name__: f
    for f in (
        null_bucket_statistics, null_entity_medians, null_leave_target_out, drift_scores, drift_summary, bucket_merges, noise_seed_pairs, rank_filtered, rank_raw, rank_metrics, rank_triples, model_against_baseline, rank_paths, panel_mrr, rank_top3, vector_products,
        panel_demeaned, panel_fixed_effects, panel_unbalanced, panel_bootstrap, panel_jobs, panel_informative, mean_intervals, loss_plateau, loss_noise_plateau, transe_vectors, embedding_alignment, embedding_displacement, embedding_drift, embedding_noise_floor,
    )
}

_FIN = "n AS (SELECT *, CASE WHEN isfinite(noise_displacement) THEN noise_displacement END AS v FROM saved_null_observations_v1)"
_MED = f"{_FIN}, m AS (SELECT transition_id, bucket_id, entity_id, median(v) AS value, count(*) AS observations FROM n WHERE v IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL)"
_LTO = f"""{_MED}, p AS (SELECT a.transition_id, a.bucket_id, a.entity_id, a.value, b.value AS other FROM m a LEFT JOIN m b ON a.transition_id IS NOT DISTINCT FROM b.transition_id AND a.bucket_id IS NOT DISTINCT FROM b.bucket_id AND a.entity_id <> b.entity_id),
c AS (SELECT transition_id, bucket_id, entity_id, value, count(other) AS reference_n, median(other) AS reference_median FROM p GROUP BY ALL),
l AS (SELECT c.*, (SELECT median(abs(p.other - c.reference_median)) FROM p WHERE p.transition_id IS NOT DISTINCT FROM c.transition_id AND p.bucket_id IS NOT DISTINCT FROM c.bucket_id AND p.entity_id = c.entity_id) AS reference_mad FROM c)"""
_DRIFT = f"""{_LTO}, t AS (SELECT transition_id, bucket_id, entity_id, max(v) AS delta FROM n WHERE entity_id IS NOT NULL GROUP BY ALL),
j AS (SELECT t.*, coalesce(reference_n, 0) AS reference_n, reference_median, reference_mad FROM t LEFT JOIN l ON t.transition_id IS NOT DISTINCT FROM l.transition_id AND t.bucket_id IS NOT DISTINCT FROM l.bucket_id AND t.entity_id = l.entity_id),
s AS (SELECT *, CASE WHEN delta IS NULL THEN 'NO_DISPLACEMENT' WHEN reference_n < 5 THEN 'INSUFFICIENT' WHEN reference_mad < 1e-6 THEN 'ZERO_MAD' ELSE 'OK' END AS status, delta - reference_median AS signed_excess FROM j),
z AS (SELECT transition_id, bucket_id, entity_id, round(delta, 9) AS delta, reference_n, round(reference_median, 9) AS reference_median, round(reference_mad, 9) AS reference_mad, status, round(signed_excess, 9) + 0.0 AS signed_excess, round(CASE WHEN status = 'OK' THEN greatest(0, signed_excess) / (1.4826 * reference_mad + 1e-4) END, 4) AS sed_plus FROM s)"""
_SCORED = """q AS (SELECT vec_id AS query, embedding AS a, label FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL), v AS (SELECT vec_id AS candidate, embedding AS b, label FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT query, candidate, q.label AS ql, v.label AS vl, -sqrt(list_sum([pow(CAST(p[1] AS double) - CAST(p[2] AS double), 2) for p in list_zip(a, b)])) AS score FROM q, v),
g AS (SELECT query, min(candidate) AS gold FROM s WHERE ql = vl AND candidate > query GROUP BY 1), gs AS (SELECT g.*, score AS gold_score FROM g JOIN s ON s.query = g.query AND s.candidate = g.gold)"""


def _rank_sql(keep: str) -> str:
    return f"r AS (SELECT gs.query, gold, 1 + count(*) FILTER (score > gold_score) + (count(*) FILTER (score = gold_score) - 1) / 2 AS rank FROM gs JOIN s ON s.query = gs.query WHERE {keep} GROUP BY ALL)"


_FILTERED = _rank_sql("candidate = gold OR (candidate <> s.query AND ql <> vl)")
_WEEKS = """e AS (SELECT user_id AS unit, CAST((day(ts) - 1) // 7 AS bigint) AS time, value FROM events WHERE day(ts) <= 28), pp AS (SELECT unit, time, avg(value) AS y, CAST(count(*) AS double) AS x FROM e GROUP BY ALL), p AS (SELECT * FROM pp WHERE unit IN (SELECT unit FROM pp GROUP BY 1 HAVING count(*) = 4)),
d AS (SELECT *, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY time) + avg(y) OVER () AS yt, x - avg(x) OVER (PARTITION BY unit) - avg(x) OVER (PARTITION BY time) + avg(x) OVER () AS xt FROM p)"""
_FIT = """b AS (SELECT count(*) AS n, count(DISTINCT time) AS g, sum(xt * yt) / sum(xt * xt) AS beta, sum(xt * xt) AS xx FROM {d}), c AS (SELECT time, sum(xt * (yt - beta * xt)) AS score FROM {d}, b GROUP BY 1),
f AS (SELECT n, g AS clusters, beta, sqrt(g / (g - 1) * (n - 1) / (n - 1) * (SELECT sum(score * score) FROM c)) / xx AS se FROM b) SELECT n, clusters, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS t_stat FROM f"""
_STEP = "u{i} AS (SELECT unit, time, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x FROM t{p}), t{i} AS (SELECT unit, time, y - avg(y) OVER (PARTITION BY time) AS y, x - avg(x) OVER (PARTITION BY time) AS x FROM u{i})"
_ROUNDS = ", ".join(_STEP.format(i=i, p=i - 1) for i in range(1, 41))
_DAYS = f"pp AS (SELECT user_id AS unit, CAST(ts AS date) AS time, avg(value) AS y, CAST(count(*) AS double) AS x FROM events GROUP BY ALL), t0 AS (SELECT * FROM pp WHERE unit IN (SELECT unit FROM pp GROUP BY 1 HAVING count(*) >= 2)), {_ROUNDS}, d AS (SELECT unit, time, y AS yt, x AS xt FROM t40)"
_LOSS = """l AS (SELECT event_type, (day(ts) - 1) * 24 + hour(ts) AS epoch, avg(value) AS loss FROM events GROUP BY ALL), k AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY epoch DESC) - 1) // 50 AS b FROM l),
s AS (SELECT event_type, avg(loss) FILTER (b = 0) AS last, avg(loss) FILTER (b = 1) AS before, var_samp(loss) FILTER (b = 0) AS v0, var_samp(loss) FILTER (b = 1) AS v1, arg_min(loss, epoch) AS first, count(*) >= 100 AND bool_and(coalesce(isfinite(loss), false)) AS enough FROM k GROUP BY 1)"""

# rank_triples, model_against_baseline, rank_paths, panel_mrr, bucket_merges, panel_bootstrap, panel_jobs, mean_intervals, transe_vectors, embedding_alignment, embedding_displacement,
# embedding_drift and embedding_noise_floor have none: sequential, seeded or iterative numerics are compared with plain versions in the tests.
SQL = {
    "null_bucket_statistics": f"""WITH {_FIN}, a AS (SELECT transition_id, bucket_id, count(*) AS n, median(v) AS median FROM n WHERE v IS NOT NULL GROUP BY ALL),
b AS (SELECT a.transition_id, a.bucket_id, a.n, median, median(abs(v - median)) AS mad FROM a JOIN n ON a.transition_id IS NOT DISTINCT FROM n.transition_id AND a.bucket_id IS NOT DISTINCT FROM n.bucket_id WHERE v IS NOT NULL GROUP BY ALL)
SELECT transition_id, bucket_id, n, round(median, 9) AS median, round(mad, 9) AS mad, round(1.4826 * mad, 9) AS robust_scale, CASE WHEN n < 5 THEN 'INSUFFICIENT' WHEN mad < 1e-9 THEN 'ZERO_MAD' END AS reason FROM b""",
    "null_entity_medians": f"WITH {_MED} SELECT * REPLACE (round(value, 9) AS value) FROM m",
    "null_leave_target_out": f"WITH {_LTO} SELECT transition_id, bucket_id, entity_id, round(value, 9) AS value, reference_n, round(reference_median, 9) AS reference_median, round(reference_mad, 9) AS reference_mad FROM l",
    "drift_scores": f"WITH {_DRIFT} SELECT * FROM z",
    "drift_summary": f"""WITH {_DRIFT}, y AS (SELECT coalesce(transition_id, '?') AS transition_id, coalesce(bucket_id, '?') AS bucket_id, CASE WHEN status = 'OK' THEN greatest(0, signed_excess) / (1.4826 * reference_mad + 1e-4) END AS sed_plus FROM s)
SELECT transition_id, bucket_id, count(*) AS n, count(sed_plus) AS available, round(avg((sed_plus >= 2)::int), 4) AS share2, round(quantile_cont(sed_plus, 0.25), 4) AS q25, round(quantile_cont(sed_plus, 0.5), 4) AS median, round(quantile_cont(sed_plus, 0.75), 4) AS q75, round(quantile_cont(sed_plus, 0.95), 4) AS p95, round(max(sed_plus), 4) AS max FROM y GROUP BY ROLLUP (transition_id, bucket_id)""",
    "noise_seed_pairs": f"WITH {_FIN} SELECT transition_id, source_seed, target_seed, count(*) AS n, count(v) AS usable, round(median(v), 9) AS median, round(max(v) - min(v), 9) AS spread FROM n GROUP BY ALL",
    "rank_filtered": f"WITH {_SCORED}, {_FILTERED} SELECT query, gold, rank, round(1 / rank, 9) AS reciprocal FROM r",
    "rank_raw": f"WITH {_SCORED}, {_rank_sql('true')} SELECT query, gold, rank, round(1 / rank, 9) AS reciprocal FROM r",
    "rank_metrics": f"WITH {_SCORED}, {_FILTERED}, k AS (SELECT r.*, q.label, r.query % 100 < 50 AS half FROM r JOIN q ON q.query = r.query) SELECT label, half, count(*) AS n, round(avg(1 / rank), 9) AS mrr, round(median(rank), 9) AS median_rank, round(avg((rank <= 1)::int), 9) AS hits1, round(avg((rank <= 3)::int), 9) AS hits3, round(avg((rank <= 10)::int), 9) AS hits10 FROM k GROUP BY GROUPING SETS ((label), (half), ())",
    "rank_top3": f"WITH {_SCORED} SELECT query, candidate, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS int) AS position, round(score, 6) AS score FROM s WHERE candidate <> query QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) <= 3",
    "vector_products": """WITH v AS (SELECT vec_id, label, [CAST(c AS double) for c in embedding] AS a FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT label, i, avg(a[i]) AS c FROM v, range(1, 65) t(i) GROUP BY ALL), k AS (SELECT label, list(c ORDER BY i) AS b FROM m GROUP BY 1),
j AS (SELECT vec_id, sqrt(list_sum([c * c for c in a])) AS na, sqrt(list_sum([c * c for c in b])) AS nb, list_sum([p[1] * p[2] for p in list_zip(a, b)]) AS ab, sqrt(list_sum([pow(p[1] - p[2], 2) for p in list_zip(a, b)])) AS dist FROM v JOIN k USING (label))
SELECT vec_id, round(na, 5) AS norm, round(ab, 5) AS dot, round(dist, 5) AS distance, round(ab / (na * nb), 5) AS cosine, CAST(1 AS double) AS unit FROM j""",
    "panel_demeaned": f"WITH {_WEEKS} SELECT unit, time, round(y, 6) AS y, round(x, 6) AS x, round(yt, 6) AS y_tilde, round(xt, 6) AS x_tilde FROM d",
    "panel_fixed_effects": f"WITH {_WEEKS}, {_FIT.format(d='d')}",
    "panel_unbalanced": f"WITH {_DAYS}, {_FIT.format(d='d')}",
    "panel_informative": "WITH p AS (SELECT user_id AS unit, CAST(ts AS date) AS time FROM events GROUP BY ALL) SELECT unit, count(*) AS rows FROM p GROUP BY 1 HAVING count(*) >= 2",
    "loss_plateau": f"WITH {_LOSS} SELECT event_type, round(last, 6) AS last, round(before, 6) AS before, coalesce(enough AND abs(last - before) <= greatest(0.01 * before, 0.002) AND last <= 0.25 * first, false) AS converged FROM s",
    "loss_noise_plateau": f"WITH {_LOSS} SELECT event_type, round(last - before, 6) AS gap, round(sqrt((v0 + v1) / 50), 6) AS error, coalesce(enough AND abs(last - before) <= 2 * sqrt((v0 + v1) / 50) AND last <= 0.5 * first, false) AS converged FROM s",
}
