"""Graph queries over the ten snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..operators import graph as op
from ..sources.bindings import EDGES_SQL, edges

CAP = 3


def _eligible(e: DataFrame, low: int = 3) -> DataFrame:
    return op.degrees(e).filter(F.col("degree") >= low).select("snapshot_id", "entity")


def _paths(spark: SparkSession, d: str, hops: int) -> DataFrame:
    e = edges(spark, d)
    return op.simple_paths(e, hops, _eligible(e))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return op.degrees(edges(spark, d)).withColumn("bucket", x.degree_bucket("degree"))


def graph_profile(spark: SparkSession, d: str) -> DataFrame:
    return op.profile(edges(spark, d)).withColumn("share_low", F.round("share_low", 9))


def graph_relations(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("snapshot_id", "r").agg(F.count("*").alias("edges"), F.countDistinct("h").alias("heads"), F.countDistinct("t").alias("tails"))


def graph_entity_index(spark: SparkSession, d: str) -> DataFrame:
    return op.entity_index(edges(spark, d))


def graph_relation_index(spark: SparkSession, d: str) -> DataFrame:
    return op.relation_index(edges(spark, d))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the weakly connected components per snapshot."""
    c = op.components(edges(spark, d))
    return c.groupBy("snapshot_id", "root").agg(F.count("*").alias("size"))


def graph_persistent_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each snapshot that the one before it has too; snapshot_id is the later one."""
    return op.persistent_entities(edges(spark, d))


def graph_persistent_triples(spark: SparkSession, d: str) -> DataFrame:
    return op.persistent_triples(edges(spark, d))


def graph_new_triples(spark: SparkSession, d: str) -> DataFrame:
    return op.new_per_snapshot(edges(spark, d), ["h", "r", "t"])


def paths_2hop(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d, 2).withColumn("path", F.array_join("path", ">"))


def paths_3hop_counts(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d, 3).groupBy("snapshot_id").agg(F.count("*").alias("paths"), F.countDistinct(F.col("path")[0]).alias("heads"))


def paths_capped(spark: SparkSession, d: str) -> DataFrame:
    return op.cap_per_head(_paths(spark, d, 2), CAP).withColumn("path", F.array_join("path", ">"))


def paths_new(spark: SparkSession, d: str) -> DataFrame:
    """Paths by the first snapshot that has them."""
    return op.new_per_snapshot(_paths(spark, d, 2).withColumn("p", F.array_join("path", ">")), ["p"])


def path_support(spark: SparkSession, d: str) -> DataFrame:
    p = op.cap_per_head(_paths(spark, d, 2), CAP)
    return p.select("snapshot_id", F.array_join("path", ">").alias("path"), F.array_join(x.path_entities("path"), ",").alias("entities"), F.array_join(x.path_relations("path"), ",").alias("relations"))


def path_answers(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    q = op.cap_per_head(op.simple_paths(e, 2, _eligible(e)), CAP).select("snapshot_id", F.col("path")[0].alias("head"), x.path_relations("path").alias("relations"))
    return op.path_answers(e, q).withColumn("relations", F.array_join("relations", ","))


def path_questions(spark: SparkSession, d: str) -> DataFrame:
    q = op.cap_per_head(_paths(spark, d, 2), CAP).select("snapshot_id", F.col("path")[0].alias("head"), x.path_relations("path").alias("relations")).distinct()
    return q.select("snapshot_id", "head", op.question("head", "relations").alias("question"))


def qa_panel(spark: SparkSession, d: str) -> DataFrame:
    """1-hop and 2-hop queries over the triples of all snapshots; the end differs from the head."""
    p = op.persistent_triples(edges(spark, d))
    one = p.select(F.col("h").alias("head"), F.col("r").alias("relations"), F.col("t").alias("gold"))
    a, b = p.alias("a"), p.alias("b")
    two = a.join(b, F.expr("a.t = b.h and a.h <> b.t")).select(F.col("a.h").alias("head"), F.concat_ws(",", "a.r", "b.r").alias("relations"), F.col("b.t").alias("gold"))
    return one.unionByName(two).distinct()


def anchors_split(spark: SparkSession, d: str) -> DataFrame:
    return op.hash_split(op.degrees(edges(spark, d)).select("snapshot_id", "entity"), 0.6, "kge_anchor_split_v1")


def anchors_folds(spark: SparkSession, d: str) -> DataFrame:
    k = op.degrees(edges(spark, d)).withColumn("bucket", x.degree_bucket("degree"))
    return op.stratified_folds(k, "bucket", "v33", 5).select("snapshot_id", "entity", "fold")


def anchors_fixed(spark: SparkSession, d: str) -> DataFrame:
    k = op.degrees(edges(spark, d)).select("snapshot_id", "entity", F.least("degree", F.lit(8)).alias("stratum"))
    return op.stratified_sample(k, 30, 20, "fixed-v1")


def anchors_percent(spark: SparkSession, d: str) -> DataFrame:
    """A 60/40 split by the hash of each entity alone."""
    k = op.degrees(edges(spark, d)).select("snapshot_id", "entity")
    return k.withColumn("role", F.when(x.salted_number(8, F.lit("anchor"), "snapshot_id", "entity") % 100 < 60, "fit").otherwise("holdout"))


def relation_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first three edges of each relation by hash."""
    e = edges(spark, d).withColumn("k", x.joined_hash(F.lit("diag"), "snapshot_id", "h", "r", "t"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("snapshot_id", "r").orderBy("k"))).filter("n <= 3").select("snapshot_id", "h", "r", "t", "n")


def corruption_probability(spark: SparkSession, d: str) -> DataFrame:
    return op.corruption_probability(edges(spark, d)).select("snapshot_id", "r", *[F.round(c, 9).alias(c) for c in ("tph", "hpt", "p_head")])


def covered_folds(spark: SparkSession, d: str) -> DataFrame:
    return op.covered_folds(edges(spark, d), 5)


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, d).withColumn("held", x.salted_number(8, F.lit("split"), "h", "r", "t") % 5 == 0)
    return e.filter("not held").drop("held"), e.filter("held").drop("held")


def split_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return op.split_diagnostics(*_split(spark, d), ["snapshot_id"])


def _baseline(r: DataFrame, *group: str) -> DataFrame:
    return r.groupBy(*group).agg(F.round(F.avg(1 / F.col("rank")), 9).alias("mrr"), F.round(F.avg((F.col("rank") <= 10).cast("double")), 9).alias("hits10"), F.count("*").alias("n"))


def frequency_baseline(spark: SparkSession, d: str) -> DataFrame:
    """MRR and hits of ranking tails by their frequency, per snapshot and relation and over all of a snapshot, each split and ranked by its own edges."""
    r = op.frequency_ranks(*_split(spark, d), ["snapshot_id"])
    return _baseline(r, "snapshot_id", "r").unionByName(_baseline(r, "snapshot_id").withColumn("r", F.lit("ALL")))


def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Expected reciprocal rank of a random order of each snapshot's entities."""
    n = op.entity_index(edges(spark, d)).groupBy("snapshot_id").agg(F.count("*").alias("entities"))
    return n.select("snapshot_id", "entities", F.round(x.random_mrr("entities"), 9).alias("mrr"))


def paths_capped_counts(spark: SparkSession, d: str) -> DataFrame:
    """Paths per snapshot, and how many remain if a head keeps at most three."""
    heads = _paths(spark, d, 2).groupBy("snapshot_id", F.col("path")[0].alias("head")).agg(F.count("*").alias("n"))
    return heads.groupBy("snapshot_id").agg(F.sum("n").alias("paths"), F.sum(F.least("n", F.lit(CAP))).alias("capped"))


def entity_picks(spark: SparkSession, d: str) -> DataFrame:
    """The first 5 % of each snapshot's entities of degree 3 and more in hash order, at least one."""
    return op.hash_share(_eligible(edges(spark, d)), 0.05, "inject")


def path_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Median and largest degree change to the next snapshot over the entities of a path; null unless all have one."""
    e = edges(spark, d)
    deg = op.degrees(e)
    follow = F.expr("concat('T', lpad(cast(substring(snapshot_id, 2) as int) - 1, 2, '0'))")
    change = deg.alias("a").join(deg.select(follow.alias("snapshot_id"), "entity", F.col("degree").alias("later")).alias("b"), ["snapshot_id", "entity"]).select("snapshot_id", "entity", F.abs(F.col("later") - F.col("degree")).cast("double").alias("x"))
    p = op.cap_per_head(op.simple_paths(e, 2, _eligible(e)), CAP).select("snapshot_id", F.array_join("path", ">").alias("path"), F.explode(x.path_entities("path")).alias("entity"))
    j = p.join(change, ["snapshot_id", "entity"], "left").groupBy("snapshot_id", "path").agg(F.median("x").alias("m"), F.max("x").alias("top"), F.count_if(F.col("x").isNull()).alias("open"))
    return j.select("snapshot_id", "path", F.when(F.col("open") == 0, F.col("m")).alias("median_change"), F.when(F.col("open") == 0, F.col("top")).alias("max_change"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_degrees, graph_profile, graph_relations, graph_entity_index, graph_relation_index, graph_components, graph_persistent_entities, graph_persistent_triples, graph_new_triples, paths_2hop, paths_3hop_counts,
        paths_capped, paths_new, path_support, path_answers, path_questions, qa_panel, anchors_split, anchors_folds, anchors_fixed, anchors_percent, relation_sample, corruption_probability, covered_folds,
        split_diagnostics, frequency_baseline, random_baseline, paths_capped_counts, entity_picks, path_exposure,
    )
}

_DEG = f"{EDGES_SQL}, deg AS (SELECT snapshot_id, entity, count(*) AS degree FROM (SELECT snapshot_id, unnest([h, t]) AS entity FROM e) GROUP BY ALL)"
_ELIG = f"{_DEG}, el AS (SELECT snapshot_id, entity FROM deg WHERE degree >= 3), st AS (SELECT e.* FROM e JOIN el a ON a.snapshot_id = e.snapshot_id AND a.entity = h JOIN el b ON b.snapshot_id = e.snapshot_id AND b.entity = t)"
_FREE = "NOT EXISTS (SELECT 1 FROM e x WHERE x.snapshot_id = {p}.snapshot_id AND x.h = {a} AND x.t = {b}) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.snapshot_id = {p}.snapshot_id AND x.h = {b} AND x.t = {a})"
_P2 = f"{_ELIG}, p2 AS (SELECT a.snapshot_id, a.h AS x, a.r AS r1, a.t AS y, b.r AS r2, b.t AS z FROM st a JOIN st b ON a.snapshot_id = b.snapshot_id AND a.t = b.h WHERE a.h <> a.t AND b.t <> a.h AND b.t <> a.t AND {_FREE.format(p='a', a='a.h', b='b.t')}), q2 AS (SELECT *, concat_ws('>', x, r1, y, r2, z) AS path FROM p2)"
_CAPPED = "k2 AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, x ORDER BY sha256('n1-cap|' || x || '|' || concat_ws('|', x, r1, y, r2, z)), x, r1, y, r2, z) AS n FROM q2)"
_LR = "SELECT snapshot_id, stratum, n, {t} * n // sum(n) OVER w AS q, ({t} * n) % sum(n) OVER w AS rest FROM {s} WINDOW w AS (PARTITION BY snapshot_id)"


def _largest(source: str, target: int, name: str) -> str:
    return f"{name}_a AS ({_LR.format(t=target, s=source)}), {name} AS (SELECT snapshot_id, stratum, CAST(q + CASE WHEN row_number() OVER (PARTITION BY snapshot_id ORDER BY rest DESC, stratum) <= {target} - sum(q) OVER (PARTITION BY snapshot_id) THEN 1 ELSE 0 END AS bigint) AS n FROM {name}_a)"


_SPLITS = f"{EDGES_SQL}, s AS (SELECT *, CAST('0x' || substr(sha256('split|' || h || '|' || r || '|' || t), 1, 8) AS bigint) % 5 = 0 AS held FROM e), tr AS (SELECT * FROM s WHERE NOT held), he AS (SELECT * FROM s WHERE held)"

# graph_components and covered_folds have none: a closure and a sequential choice are compared with plain searches in the tests.
SQL = {
    "graph_degrees": f"WITH {_DEG} SELECT *, CASE WHEN degree < 3 THEN 'low' WHEN degree < 6 THEN 'medium' ELSE 'high' END AS bucket FROM deg",
    "graph_profile": f"""WITH {_DEG}, a AS (SELECT snapshot_id, count(*) AS edges, count(DISTINCT r) AS relations, count(*) FILTER (h = t) AS self_loops FROM e GROUP BY 1),
b AS (SELECT snapshot_id, count(*) AS entities, max(degree) AS max_degree, list_sort(list(degree))[count(*) // 2 + 1] AS upper_median_degree, round(avg((degree <= 2)::int), 9) AS share_low FROM deg GROUP BY 1) SELECT * FROM a JOIN b USING (snapshot_id)""",
    "graph_relations": f"WITH {EDGES_SQL} SELECT snapshot_id, r, count(*) AS edges, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails FROM e GROUP BY ALL",
    "graph_entity_index": f"WITH {_DEG} SELECT snapshot_id, entity, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY entity) - 1 AS int) AS idx FROM deg",
    "graph_relation_index": f"WITH {EDGES_SQL}, k AS (SELECT DISTINCT snapshot_id, r FROM e) SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY r) - 1 AS int) AS idx FROM k",
    "graph_persistent_entities": f"WITH {_DEG}, i AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS before FROM (SELECT DISTINCT snapshot_id FROM e)) SELECT deg.snapshot_id, entity FROM deg JOIN i USING (snapshot_id) SEMI JOIN deg x ON x.snapshot_id = i.before AND x.entity = deg.entity",
    "graph_persistent_triples": f"WITH {EDGES_SQL} SELECT h, r, t FROM e GROUP BY ALL HAVING count(DISTINCT snapshot_id) = (SELECT count(DISTINCT snapshot_id) FROM e)",
    "graph_new_triples": f"WITH {EDGES_SQL}, k AS (SELECT min(snapshot_id) AS snapshot_id FROM e GROUP BY h, r, t) SELECT snapshot_id, count(*) AS n FROM k GROUP BY 1",
    "paths_2hop": f"WITH {_P2} SELECT snapshot_id, path FROM q2",
    "paths_3hop_counts": f"WITH {_ELIG}, p3 AS (SELECT a.snapshot_id, a.h FROM st a JOIN st b ON a.snapshot_id = b.snapshot_id AND a.t = b.h JOIN st c ON b.snapshot_id = c.snapshot_id AND b.t = c.h WHERE a.h <> a.t AND b.t NOT IN (a.h, a.t) AND c.t NOT IN (a.h, a.t, b.t) AND {_FREE.format(p='a', a='a.h', b='c.t')}) SELECT snapshot_id, count(*) AS paths, count(DISTINCT h) AS heads FROM p3 GROUP BY 1",
    "paths_capped": f"WITH {_P2}, {_CAPPED} SELECT snapshot_id, path FROM k2 WHERE n <= {CAP}",
    "paths_new": f"WITH {_P2}, m AS (SELECT min(snapshot_id) AS snapshot_id FROM q2 GROUP BY path) SELECT snapshot_id, count(*) AS n FROM m GROUP BY 1",
    "path_support": f"WITH {_P2}, {_CAPPED} SELECT snapshot_id, path, concat_ws(',', x, y, z) AS entities, concat_ws(',', r1, r2) AS relations FROM k2 WHERE n <= {CAP}",
    "path_answers": f"WITH {_P2}, {_CAPPED}, q AS (SELECT DISTINCT snapshot_id, x, r1, r2 FROM k2 WHERE n <= {CAP}) SELECT DISTINCT q.snapshot_id, x AS head, r1 || ',' || r2 AS relations, b.t AS answer FROM q JOIN e a ON a.snapshot_id = q.snapshot_id AND a.h = x AND a.r = r1 JOIN e b ON b.snapshot_id = q.snapshot_id AND b.h = a.t AND b.r = r2",
    "path_questions": f"WITH {_P2}, {_CAPPED} SELECT DISTINCT snapshot_id, x AS head, 'Starting at ' || x || ', which entity is reached by \"' || replace(r1, '_', ' ') || '\" and then \"' || replace(r2, '_', ' ') || '\"?' AS question FROM k2 WHERE n <= {CAP}",
    "qa_panel": f"WITH {EDGES_SQL}, p AS (SELECT h, r, t FROM e GROUP BY ALL HAVING count(DISTINCT snapshot_id) = (SELECT count(DISTINCT snapshot_id) FROM e)) SELECT h AS head, r AS relations, t AS gold FROM p UNION SELECT a.h, a.r || ',' || b.r, b.t FROM p a JOIN p b ON a.t = b.h AND a.h <> b.t",
    "anchors_split": f"WITH {_DEG} SELECT snapshot_id, entity, CASE WHEN row_number() OVER (PARTITION BY snapshot_id ORDER BY sha256('kge_anchor_split_v1:' || entity), entity) <= greatest(1, least(count(*) OVER (PARTITION BY snapshot_id) - 1, round_even(0.6 * count(*) OVER (PARTITION BY snapshot_id), 0))) THEN 'fit' ELSE 'holdout' END AS role FROM deg",
    "anchors_folds": f"WITH {_DEG} SELECT snapshot_id, entity, CAST((row_number() OVER (PARTITION BY snapshot_id, CASE WHEN degree < 3 THEN 0 WHEN degree < 6 THEN 1 ELSE 2 END ORDER BY sha256('s5-fold|v33|' || entity), entity) - 1) % 5 AS int) AS fold FROM deg",
    "anchors_fixed": f"""WITH {_DEG}, k AS (SELECT snapshot_id, entity, least(degree, 8) AS stratum FROM deg), c AS (SELECT snapshot_id, stratum, count(*) AS n FROM k GROUP BY ALL), {_largest('c', 50, 'l1')}, {_largest('l1', 30, 'l2')},
rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, stratum ORDER BY sha256('fixed-v1:degree:' || stratum || ':' || entity), entity) AS rn FROM k)
SELECT rk.snapshot_id, entity, rk.stratum, CASE WHEN rn <= l2.n THEN 'fit' ELSE 'holdout' END AS role FROM rk JOIN l1 USING (snapshot_id, stratum) JOIN l2 USING (snapshot_id, stratum) WHERE rn <= l1.n""",
    "anchors_percent": f"WITH {_DEG} SELECT snapshot_id, entity, CASE WHEN CAST('0x' || substr(sha256('anchor|' || snapshot_id || '|' || entity), 1, 8) AS bigint) % 100 < 60 THEN 'fit' ELSE 'holdout' END AS role FROM deg",
    "relation_sample": f"WITH {EDGES_SQL}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_id, r ORDER BY sha256('diag|' || snapshot_id || '|' || h || '|' || r || '|' || t)) AS int) AS n FROM e) SELECT * FROM k WHERE n <= 3",
    "corruption_probability": f"WITH {EDGES_SQL}, k AS (SELECT snapshot_id, r, count(*) / count(DISTINCT h) AS a, count(*) / count(DISTINCT t) AS b FROM e GROUP BY ALL) SELECT snapshot_id, r, round(a, 9) AS tph, round(b, 9) AS hpt, round(a / (a + b), 9) AS p_head FROM k",
    "paths_capped_counts": f"WITH {_P2}, k AS (SELECT snapshot_id, x, count(*) AS n FROM q2 GROUP BY ALL) SELECT snapshot_id, CAST(sum(n) AS bigint) AS paths, CAST(sum(least(n, {CAP})) AS bigint) AS capped FROM k GROUP BY 1",
    "entity_picks": f"WITH {_ELIG} SELECT snapshot_id, entity FROM el QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY sha256('inject|' || entity), entity) <= greatest(1, ceil(0.05 * count(*) OVER (PARTITION BY snapshot_id)))",
    "path_exposure": f"""WITH {_P2}, {_CAPPED}, c AS (SELECT a.snapshot_id, a.entity, CAST(abs(b.degree - a.degree) AS double) AS v FROM deg a JOIN deg b ON a.entity = b.entity AND CAST(substr(b.snapshot_id, 2) AS int) = CAST(substr(a.snapshot_id, 2) AS int) + 1),
p AS (SELECT snapshot_id, path, unnest([x, y, z]) AS entity FROM k2 WHERE n <= {CAP}), j AS (SELECT p.snapshot_id, path, median(v) AS m, max(v) AS top, count(*) FILTER (v IS NULL) AS open FROM p LEFT JOIN c ON p.snapshot_id = c.snapshot_id AND p.entity = c.entity GROUP BY ALL)
SELECT snapshot_id, path, CASE WHEN open = 0 THEN m END AS median_change, CASE WHEN open = 0 THEN top END AS max_change FROM j""",
    "split_diagnostics": f"""WITH {_SPLITS}, te AS (SELECT DISTINCT snapshot_id, unnest([h, t]) AS entity FROM tr), hx AS (SELECT DISTINCT snapshot_id, unnest([h, t]) AS entity FROM he)
SELECT s.snapshot_id, count(*) FILTER (held) AS held, (SELECT count(*) FROM (SELECT entity FROM hx WHERE hx.snapshot_id = s.snapshot_id EXCEPT SELECT entity FROM te WHERE te.snapshot_id = s.snapshot_id)) AS unseen_entities,
(SELECT count(*) FROM (SELECT r FROM he WHERE he.snapshot_id = s.snapshot_id EXCEPT SELECT r FROM tr WHERE tr.snapshot_id = s.snapshot_id)) AS unseen_relations,
count(*) FILTER (held AND EXISTS (SELECT 1 FROM tr WHERE tr.snapshot_id = s.snapshot_id AND least(tr.h, tr.t) = least(s.h, s.t) AND greatest(tr.h, tr.t) = greatest(s.h, s.t))) AS seen_pairs FROM s GROUP BY 1""",
    "frequency_baseline": f"""WITH {_SPLITS}, f AS (SELECT snapshot_id, r, t, count(*) AS c FROM tr GROUP BY ALL), k AS (SELECT snapshot_id, r, t, rank() OVER (PARTITION BY snapshot_id, r ORDER BY c DESC) + (count(*) OVER (PARTITION BY snapshot_id, r, c) - 1) / 2 AS rank FROM f), n AS (SELECT snapshot_id, r, count(*) AS tails FROM f GROUP BY ALL),
j AS (SELECT he.snapshot_id, he.r, coalesce(k.rank, coalesce(tails, 0) + 1.0) AS rank FROM he LEFT JOIN k ON he.snapshot_id = k.snapshot_id AND he.r = k.r AND he.t = k.t LEFT JOIN n ON he.snapshot_id = n.snapshot_id AND he.r = n.r)
SELECT snapshot_id, r, round(avg(1 / rank), 9) AS mrr, round(avg((rank <= 10)::int), 9) AS hits10, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT snapshot_id, 'ALL', round(avg(1 / rank), 9), round(avg((rank <= 10)::int), 9), count(*) FROM j GROUP BY ALL""",
    "random_baseline": f"WITH {_DEG}, n AS (SELECT snapshot_id, count(*) AS entities FROM deg GROUP BY 1) SELECT snapshot_id, entities, round((SELECT sum(1.0 / k) FROM range(1, entities + 1) t(k)) / entities, 9) AS mrr FROM n",
}
