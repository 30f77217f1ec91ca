"""Graph operators over edges (h, r, t): degrees, components, paths, samples, splits.

Group columns such as snapshot_id come first in every signature, so that all
snapshots are handled in one job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ranked, staged
from .snapshots import snapshot_sequence


def degrees(edges: DataFrame, group: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """(group, entity, degree): both ends count, a self-loop twice."""
    return edges.select(*group, F.explode(F.array("h", "t")).alias("entity")).groupBy(*group, "entity").agg(F.count("*").alias("degree"))


def entity_index(edges: DataFrame, group: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """(group, entity, idx): 0, 1, ... in the order of the ids."""
    e = edges.select(*group, F.explode(F.array("h", "t")).alias("entity")).distinct()
    return ranked(e, list(group), ["entity"], "_r").select(*group, "entity", (F.col("_r") - 1).cast("int").alias("idx"))


def relation_index(edges: DataFrame, group: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    e = edges.select(*group, "r").distinct()
    return e.withColumn("idx", F.row_number().over(Window.partitionBy(*group).orderBy("r")) - 1)


def components(edges: DataFrame, group: str = "snapshot_id") -> DataFrame:
    """(group, entity, root): the least entity of each weakly connected component.

    Labels take the least label around them and then that label's own label; every
    round is written to the shared folder, so lost executors cost one round at most.
    """
    both = staged(edges.select(group, F.col("h").alias("a"), F.col("t").alias("b")).unionByName(edges.select(group, F.col("t").alias("a"), F.col("h").alias("b"))).distinct(), "links")
    labels = staged(both.select(group, F.col("a").alias("entity")).distinct().withColumn("root", F.col("entity")), "labels")
    # A label only ever falls, so the rounds end, and they end when nothing changes.
    while True:
        near = both.join(labels.withColumnRenamed("entity", "b"), [group, "b"]).groupBy(group, F.col("a").alias("entity")).agg(F.min("root").alias("near"))
        low = labels.join(near, [group, "entity"]).select(group, "entity", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(group, F.col("entity").alias("root"), F.col("root").alias("up"))
        new = staged(low.join(up, [group, "root"], "left").select(group, "entity", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        labels = new.select(group, "entity", "root")
        if not new.filter("root <> old").limit(1).count():
            return labels


def profile(edges: DataFrame) -> DataFrame:
    """Per snapshot: edges, entities, relations, self-loops, degree max, upper median and share of degrees up to 2."""
    d = degrees(edges)
    # The upper median is the value at the middle of the counts per degree, not of sorted rows.
    per = d.groupBy("snapshot_id", "degree").agg(F.count("*").alias("c"))
    w = Window.partitionBy("snapshot_id").orderBy("degree")
    at = per.withColumn("cum", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("snapshot_id")))
    s = at.groupBy("snapshot_id").agg(
        F.max("n").alias("entities"),
        F.max("degree").alias("max_degree"),
        F.min(F.when(F.col("cum") > F.floor(F.col("n") / 2), F.col("degree"))).alias("upper_median_degree"),
        (F.sum(F.when(F.col("degree") <= 2, F.col("c")).otherwise(0)) / F.sum("c")).alias("share_low"),
    )
    e = edges.groupBy("snapshot_id").agg(F.count("*").alias("edges"), F.countDistinct("r").alias("relations"), F.sum((F.col("h") == F.col("t")).cast("long")).alias("self_loops"))
    return e.join(s, "snapshot_id")


def persistent_entities(edges: DataFrame) -> DataFrame:
    """(snapshot_id, entity): entities of a snapshot that the one before it has too."""
    e = edges.select("snapshot_id", F.explode(F.array("h", "t")).alias("entity")).distinct()
    pairs = snapshot_sequence(edges, "snapshot_id").filter("following is not null")
    moved = e.join(pairs.withColumnRenamed("snapshot", "snapshot_id"), "snapshot_id").select(F.col("following").alias("snapshot_id"), "entity")
    return e.join(moved, ["snapshot_id", "entity"], "left_semi")


def persistent_triples(edges: DataFrame) -> DataFrame:
    """Triples of all snapshots."""
    n = edges.agg(F.countDistinct("snapshot_id").alias("n"))
    c = edges.groupBy("h", "r", "t").agg(F.countDistinct("snapshot_id").alias("c"))
    return c.join(F.broadcast(n), F.col("c") == F.col("n")).select("h", "r", "t")


def simple_paths(edges: DataFrame, hops: int, eligible: DataFrame | None = None, shortcuts: bool = False) -> DataFrame:
    """(snapshot_id, path) of directed paths without repeated entity over eligible entities.

    path alternates entity and relation.  Unless ``shortcuts``, paths whose ends an
    edge joins in either direction are left out.
    """
    e = edges.select("snapshot_id", "h", "r", "t").distinct()
    step = e
    if eligible is not None:
        k = eligible.select("snapshot_id", "entity").distinct()
        step = step.join(k.withColumnRenamed("entity", "h"), ["snapshot_id", "h"], "left_semi").join(k.withColumnRenamed("entity", "t"), ["snapshot_id", "t"], "left_semi")
    step = step.select("snapshot_id", F.col("h").alias("end"), F.col("r").alias("_r"), F.col("t").alias("_t"))
    p = step.filter("end <> _t").select("snapshot_id", F.array("end", "_r", "_t").alias("path"), F.col("_t").alias("end"))
    for _ in range(hops - 1):
        p = p.join(step, ["snapshot_id", "end"]).filter(~F.exists(F.filter("path", lambda v, i: i % 2 == 0), lambda v: v == F.col("_t"))).select("snapshot_id", F.concat("path", F.array("_r", "_t")).alias("path"), F.col("_t").alias("end"))
    p = p.select("snapshot_id", "path", F.col("path")[0].alias("_h"), "end")
    if not shortcuts:
        ends = e.select("snapshot_id", F.col("h").alias("_h"), F.col("t").alias("end"))
        ends = ends.unionByName(ends.select("snapshot_id", F.col("end").alias("_h"), F.col("_h").alias("end"))).distinct()
        p = p.join(ends, ["snapshot_id", "_h", "end"], "left_anti")
    return p.select("snapshot_id", "path")


def cap_per_head(paths: DataFrame, cap: int, salt: str = "n1-cap") -> DataFrame:
    """At most cap paths per snapshot and head, in salted hash order."""
    key = F.sha2(F.concat_ws("|", F.lit(salt), F.col("path")[0], F.array_join("path", "|")), 256)
    d = paths.withColumn("_k", key).withColumn("_h", F.col("path")[0])
    # A hot head is cut to cap rows inside of salts before its own ranking.
    first = Window.partitionBy("snapshot_id", "_h", F.substring("_k", 1, 1)).orderBy("_k", "path")
    d = d.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= cap)
    w = Window.partitionBy("snapshot_id", "_h").orderBy("_k", "path")
    return d.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).select("snapshot_id", "path")


def path_answers(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(snapshot_id, head, relations, answer): all ends of the relation sequence from head, revisits allowed.

    queries: snapshot_id, head, relations (array).
    """
    q = queries.select("snapshot_id", "head", "relations").distinct()
    at = q.withColumn("answer", F.col("head")).withColumn("_i", F.lit(0))
    done = None
    for i in range(3):
        if i:
            ended = at.filter(F.size("relations") == i).select("snapshot_id", "head", "relations", "answer")
            done = ended if done is None else done.unionByName(ended)
        at = at.filter(F.size("relations") > i).withColumn("_r", F.col("relations")[i])
        e = edges.select("snapshot_id", F.col("h").alias("answer"), F.col("r").alias("_r"), F.col("t").alias("_t"))
        at = at.join(e, ["snapshot_id", "answer", "_r"]).select("snapshot_id", "head", "relations", F.col("_t").alias("answer")).distinct()
    return done.unionByName(at.select("snapshot_id", "head", "relations", "answer")).distinct()


def new_per_snapshot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(snapshot_id, n): keys that occur in no earlier snapshot, by the first that has them."""
    return rows.groupBy(*keys).agg(F.min("snapshot_id").alias("snapshot_id")).groupBy("snapshot_id").agg(F.count("*").alias("n"))


def _sizes(entities: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entities.groupBy(*keys).agg(F.count("*").alias("_n"))


def hash_split(entities: DataFrame, ratio: float, salt: str, group: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """entities with role: the first round-half-even(n*ratio), at least 1 and not all, by hash are ``fit``."""
    d = entities.withColumn("_k", F.sha2(F.concat(F.lit(salt + ":"), "entity"), 256))
    d = ranked(d, list(group), ["_k", "entity"], "_r").join(_sizes(entities, group), list(group))
    fit = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(ratio), 0)))
    return d.withColumn("role", F.when(F.col("_r") <= fit, "fit").otherwise("holdout")).select(*entities.columns, "role")


def hash_share(entities: DataFrame, share: float, salt: str, group: Sequence[str] = ("snapshot_id",), least: int = 1) -> DataFrame:
    """The first ceil(n*share) entities of each group in hash order, at least ``least``."""
    d = entities.withColumn("_k", F.sha2(F.concat_ws("|", F.lit(salt), "entity"), 256))
    d = ranked(d, list(group), ["_k", "entity"], "_r").join(_sizes(entities, group), list(group))
    return d.filter(F.col("_r") <= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("_n")))).select(*entities.columns)


def stratified_folds(entities: DataFrame, stratum: str, salt: str, k: int, group: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """entities with fold: rank by hash inside the stratum, modulo k."""
    d = entities.withColumn("_k", F.sha2(F.concat_ws("|", F.lit("s5-fold"), F.lit(salt), F.col("entity")), 256))
    return ranked(d, [*group, stratum], ["_k", "entity"], "_r").withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).select(*entities.columns, "fold")


def largest_remainder(counts: DataFrame, target: int, group: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """counts(group, stratum, n) with quota: shares of target in proportion, remainders to the largest, ties to the lesser stratum."""
    w = Window.partitionBy(*group)
    d = counts.withColumn("_t", F.sum("n").over(w)).withColumn("quota", F.floor(F.lit(target) * F.col("n") / F.col("_t")).cast("long"))
    d = d.withColumn("_rest", (F.lit(target) * F.col("n")) % F.col("_t")).withColumn("_left", F.lit(target) - F.sum("quota").over(w))
    d = d.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_rest"), "stratum")))
    return d.withColumn("quota", F.col("quota") + (F.col("_r") <= F.col("_left")).cast("long")).drop("_t", "_rest", "_left", "_r")


def stratified_sample(entities: DataFrame, fit: int, holdout: int, salt: str, group: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """(group, entity, stratum, role): a sample of fixed size, spread over the strata in proportion, by hash order."""
    counts = entities.groupBy(*group, "stratum").agg(F.count("*").alias("n"))
    quota = largest_remainder(counts, fit + holdout, group)
    q = quota.join(largest_remainder(quota.select(*group, "stratum", F.col("quota").alias("n")), fit, group).select(*group, "stratum", F.col("quota").alias("fit_quota")), [*group, "stratum"])
    key = F.sha2(F.concat(F.lit(salt + ":degree:"), F.col("stratum").cast("string"), F.lit(":"), "entity"), 256)
    r = ranked(entities.withColumn("_k", key), [*group, "stratum"], ["_k", "entity"], "_r")
    return r.join(q, [*group, "stratum"]).filter("_r <= quota").select(*group, "entity", "stratum", F.when(F.col("_r") <= F.col("fit_quota"), "fit").otherwise("holdout").alias("role"))


def corruption_probability(edges: DataFrame) -> DataFrame:
    """(snapshot_id, r, tph, hpt, p_head): tails per head and heads per tail of each relation."""
    d = edges.groupBy("snapshot_id", "r").agg(F.countDistinct("h", "t").alias("n"), F.countDistinct("h").alias("hs"), F.countDistinct("t").alias("ts"))
    tph, hpt = F.col("n") / F.col("hs"), F.col("n") / F.col("ts")
    return d.select("snapshot_id", "r", tph.alias("tph"), hpt.alias("hpt"), (tph / (tph + hpt)).alias("p_head"))


def covered_folds(edges: DataFrame, k: int, salt: str = "s3-valfold-v1") -> DataFrame:
    """(snapshot_id, h, r, t, fold): validation folds that leave every entity and relation a training edge; -1 stays in training.

    A triple is a candidate of the fold that its hash names, modulo k, unless it is a
    self-loop.  In the order of the hashes a candidate is taken if, without it and
    those taken before, its ends and its relation keep an edge.  An end that has an
    edge outside of the fold's candidates never decides, so only candidates whose
    ends or relation lie in the fold alone are looked at one after another; the
    others are settled by counts.
    """
    key = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), "snapshot_id", "h", "r", "t"), 256), 1, 12), 16, 10).cast("long")
    e = edges.select("snapshot_id", "h", "r", "t", key.alias("_key")).withColumn("_fold", (F.col("_key") % k).cast("int"))
    e = staged(e, "keyed")
    # How often an entity or relation occurs: at all, and among the candidates of a fold.
    what = F.array(F.struct(F.lit("e").alias("kind"), F.col("h").alias("id")), F.struct(F.lit("e").alias("kind"), F.col("t").alias("id")), F.struct(F.lit("r").alias("kind"), F.col("r").alias("id")))
    uses = e.select("snapshot_id", "_fold", (F.col("h") != F.col("t")).alias("_can"), F.explode(what).alias("w")).select("snapshot_id", "_fold", "_can", "w.*")
    per = uses.groupBy("snapshot_id", "_fold", "kind", "id").agg(F.count("*").alias("n"), F.count_if("_can").alias("own"))
    total = per.groupBy("snapshot_id", "kind", "id").agg(F.sum("n").alias("total"))
    tight = per.filter("own > 0").join(total, ["snapshot_id", "kind", "id"]).filter("own >= total").select("snapshot_id", "_fold", "kind", "id", "total")
    tight = staged(tight, "tight")
    c = e.filter("h <> t")
    for side, kind in (("h", "e"), ("t", "e"), ("r", "r")):
        own = tight.filter(F.col("kind") == kind).select("snapshot_id", "_fold", F.col("id").alias(side), F.col("total").alias(f"_{side}"))
        c = c.join(own, ["snapshot_id", "_fold", side], "left")
    bound = F.col("_h").isNotNull() | F.col("_t").isNotNull() | F.col("_r").isNotNull()
    # What has one edge in all is never taken.
    hopeless = (F.col("_h") < 2) | (F.col("_t") < 2) | (F.col("_r") < 2)
    c = staged(c.withColumn("_bound", bound).withColumn("_never", F.coalesce(hopeless, F.lit(False))), "candidates")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "h", "r", "t"])
        taken: Counter = Counter()
        out = []
        for row in pdf.itertuples(index=False):
            needs = [(("r" if i == 2 else "e", x), n) for i, (x, n) in enumerate(zip(row[:3], row[3:6])) if not pd.isna(n)]
            ok = all(n - taken[what] >= 2 for what, n in needs)
            if ok:
                taken.update(what for what, _ in needs)
            out.append(row.fold if ok else -1)
        return pdf[["snapshot_id", "h", "r", "t"]].assign(fold=out)

    slow = c.filter("_bound and not _never").select("h", "t", "r", F.col("_h").alias("nh"), F.col("_t").alias("nt"), F.col("_r").alias("nr"), "snapshot_id", F.col("_fold").alias("fold"), "_key")
    decided = slow.groupBy("snapshot_id", "fold").applyInPandas(run, "snapshot_id string, h string, r string, t string, fold int")
    none = e.filter("h = t").select("snapshot_id", "h", "r", "t").unionByName(c.filter("_never").select("snapshot_id", "h", "r", "t")).withColumn("fold", F.lit(-1))
    return decided.unionByName(c.filter("not _bound").select("snapshot_id", "h", "r", "t", F.col("_fold").alias("fold"))).unionByName(none)


def split_diagnostics(train: DataFrame, held: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, held, unseen_entities, unseen_relations, seen_pairs): what held-out edges have that training lacks, in one row a group; without group in one row."""
    one = lambda d: d.withColumn("_one", F.lit(1))
    g = ["_one", *group]
    every = one(train.select(*group).unionByName(held.select(*group)).distinct() if group else train.sparkSession.range(1).select())
    train, held = one(train), one(held)
    te = train.select(*g, F.explode(F.array("h", "t")).alias("e")).distinct()
    he = held.select(*g, F.explode(F.array("h", "t")).alias("e")).distinct()
    pair = F.array_sort(F.array("h", "t"))
    n = held.groupBy(*g).agg(F.count("*").alias("held"))
    a = he.join(te, [*g, "e"], "left_anti").groupBy(*g).agg(F.count("*").alias("unseen_entities"))
    b = held.select(*g, "r").distinct().join(train.select(*g, "r").distinct(), [*g, "r"], "left_anti").groupBy(*g).agg(F.count("*").alias("unseen_relations"))
    c = held.withColumn("p", pair).join(train.select(*g, pair.alias("p")).distinct(), [*g, "p"], "left_semi").groupBy(*g).agg(F.count("*").alias("seen_pairs"))
    counts = ("held", "unseen_entities", "unseen_relations", "seen_pairs")
    return every.join(n, g, "left").join(a, g, "left").join(b, g, "left").join(c, g, "left").select(*group, *[F.coalesce(k, F.lit(0)).alias(k) for k in counts])


def frequency_ranks(train: DataFrame, held: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, h, r, t, rank): mid-rank of each held tail among the tails that training has for its relation, by frequency; unseen tails come after all."""
    g = [*group, "r"]
    f = train.groupBy(*g, "t").agg(F.count("*").alias("c"))
    # Ranks by frequency class: how many tails of the relation are more or equally frequent.
    k = f.groupBy(*g, "c").agg(F.count("*").alias("peers"))
    w = Window.partitionBy(*g).orderBy(F.desc("c"))
    k = k.withColumn("better", F.sum("peers").over(w) - F.col("peers"))
    rank = f.join(k, [*g, "c"]).select(*g, "t", (1 + F.col("better") + (F.col("peers") - 1) / 2).alias("rank"))
    n = f.groupBy(*g).agg(F.count("*").alias("tails"))
    return held.join(rank, [*g, "t"], "left").join(n, g, "left").select(*group, "h", "r", "t", F.coalesce("rank", F.coalesce("tails", F.lit(0)) + 1.0).alias("rank"))


def question(head: str, relations: str) -> Column:
    """The text of a 1-hop or 2-hop question."""
    words = F.transform(F.col(relations), lambda r: F.replace(r, F.lit("_"), F.lit(" ")))
    one = F.format_string("Which entity does %s relate to by \"%s\"?", F.col(head), words[0])
    two = F.format_string("Starting at %s, which entity is reached by \"%s\" and then \"%s\"?", F.col(head), words[0], words[1])
    return F.when(F.size(relations) == 1, one).when(F.size(relations) == 2, two)

