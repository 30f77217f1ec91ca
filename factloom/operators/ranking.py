"""Ranking of candidates with filtered answers and mid-ranks.

A stated set of queries meets all candidates of its group in cells: blocks of
queries against blocks of candidates, both of bounded size.  A cell gives two counts
a query, of better and of equal candidates, so no score is ever shuffled.  Other true
answers do not compete: they are few, are scored by themselves, and their counts are
taken off.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..runtime import BROADCAST_LIMIT, staged, tasks_for

#: Queries and candidates of a cell.
BLOCK = 2000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Along the last axis; a pair of vectors has the same value wherever it stands."""
    d = a - b
    return np.sqrt((d * d).sum(axis=-1))


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearer(v: np.ndarray, limit: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``other`` lie nearer to each row of v than its limit, and how many exactly as far, by :func:`_distances`.

    Squared distances less the squared limit come from one product of matrices, in
    single precision where its range allows.  They settle all pairs but those within
    that product's rounding of the limit, which are measured directly.
    """
    better, same = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    if not len(v) or not len(other):
        return better, same
    lengths, others, limits = (v * v).sum(axis=1), (other * other).sum(axis=1), limit * limit
    quick = np.isfinite(lengths).all() and np.isfinite(others).all() and np.isfinite(limits).all()
    step = max(1, 4_000_000 // (len(other) if quick else max(1, other.size)))
    if quick:
        single = 1e-20 < max(lengths.max(), others.max(), limits.max()) < 1e30
        kind = np.float32 if single else np.float64
        to_all = np.vstack([-2 * other.T, np.ones(len(other)), others]).astype(kind)
        # Rounding of a sum of so many products, several times over.
        slacks = (8 * (v.shape[1] + 6) * float(np.finfo(kind).eps) * (lengths + others.max() + limits)).astype(kind)
    for i in range(0, len(v), step):
        a, most = v[i : i + step], limit[i : i + step, None]
        if not quick:
            d = _distances(a[:, None, :], other[None])
            better[i : i + step], same[i : i + step] = (d < most).sum(axis=1), (d == most).sum(axis=1)
            continue
        slack = slacks[i : i + step, None]
        over = np.column_stack([a, lengths[i : i + step] - limits[i : i + step], np.ones(len(a))]).astype(kind) @ to_all
        sure, near = over < -slack, over <= slack
        better[i : i + step] = np.count_nonzero(sure, axis=1)
        near ^= sure
        q, c = np.divmod(np.flatnonzero(near), len(other))
        for k in range(0, len(q), 50_000):
            at, to = q[k : k + 50_000], c[k : k + 50_000]
            d, far = _distances(a[at], other[to]), most[at, 0]
            better[i : i + step] += np.bincount(at[d < far], minlength=len(a))
            same[i : i + step] += np.bincount(at[d == far], minlength=len(a))
    return better, same


def filtered_ranks(queries: DataFrame, candidates: DataFrame, filtered: DataFrame | None = None, group: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """(group, query, gold, rank, reciprocal): 1 + better + ties/2 of the gold answer by the distance from the query's vector.

    queries: group, query (unique), vec, gold; candidates: group, candidate, vec, one
    row each; filtered: query and a candidate that is a true answer too.  A gold answer
    that is no candidate has rank infinity and reciprocal 0; so has a query without one.
    """
    g, kinds, names = list(group), dict(queries.dtypes), dict(candidates.dtypes)
    c = candidates.select(*g, "candidate", "vec")
    own = c.select(*g, F.col("candidate").alias("gold"), F.col("vec").alias("gold_vec"))
    q = staged(queries.select(*g, "query", "vec", "gold").join(own, [*g, "gold"], "left"), "queries")
    ready = q.filter("gold_vec is not null")
    most = lambda d: (d.groupBy(*g).agg(F.count("*").alias("n")) if g else d.agg(F.count("*").alias("n"))).agg(F.max("n")).first()[0] or 0
    qs, cs = tasks_for(most(ready), block, 1), tasks_for(most(c), block, 1)
    spread = lambda k, n: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ready.select(*g, "query", "vec", "gold_vec").withColumn("_q", spread("query", qs)).withColumn("_c", every(cs))
    right = c.withColumn("_c", spread("candidate", cs)).withColumn("_q", every(qs))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        better, same = np.zeros(a.num_rows, np.int64), np.zeros(a.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            v, w, other = _vectors(a.column("vec")), _vectors(a.column("gold_vec")), _vectors(b.column("vec"))
            better, same = nearer(v, _distances(v, w), other)
        return pa.table({"query": a.column("query"), "better": better, "same": same})

    by = [*g, "_q", "_c"]
    counts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(count, f"query {kinds['query']}, better long, same long")
    if filtered is not None:
        # The gold answer itself competes, whether it is listed or not.
        f = filtered.select("query", "candidate").distinct().join(ready.select(*g, "query", "vec", "gold_vec", "gold"), "query").filter("candidate <> gold").join(c.withColumnRenamed("vec", "other"), [*g, "candidate"])

        def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v, w, o = (_vectors(b.column(n)) for n in ("vec", "gold_vec", "other"))
                    d, limit = _distances(v, o), _distances(v, w)
                    yield pa.RecordBatch.from_arrays([b.column("query"), pa.array(-(d < limit).astype(np.int64)), pa.array(-(d == limit).astype(np.int64))], names=["query", "better", "same"])

        counts = counts.unionByName(f.select("query", "vec", "gold_vec", "other").mapInArrow(less, f"query {kinds['query']}, better long, same long"))
    total = counts.groupBy("query").agg(F.sum("better").alias("better"), F.sum("same").alias("same"))
    rank = 1 + F.col("better") + (F.col("same") - 1) / 2
    r = q.select(*g, "query", F.col("gold").cast(names["candidate"]).alias("gold")).join(total, "query", "left")
    return r.select(*g, "query", "gold", F.coalesce(rank, F.lit(float("inf"))).alias("rank"), F.coalesce(1 / rank, F.lit(0.0)).alias("reciprocal"))


def score_queries(queries: DataFrame, candidates: DataFrame, block: int = 256) -> DataFrame:
    """(query, candidate, score): minus the distance of each query's vector to each candidate's.

    queries: query, vec; candidates: candidate, vec.  Blocks of queries are broadcast
    while they are under the size limit, and joined by replication beyond it.
    """
    n = queries.count()
    width = len(queries.select("vec").first()["vec"]) if n else 1
    blocks = max(1, -(-n // block))
    q = queries.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(blocks))).groupBy("_b").agg(F.collect_list(F.struct("query", "vec")).alias("qs"))
    c = candidates.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    small = n * (width * 8 + 64) < BROADCAST_LIMIT
    d = c.join(F.broadcast(q) if small else q, "_b")
    d = d.select("candidate", F.col("vec").alias("_v"), F.explode("qs").alias("q"))
    return d.select(F.col("q.query").alias("query"), "candidate", (-x.distance("q.vec", "_v")).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(query, candidate, score, position): the best k per query, ties by candidate."""
    order = [F.desc("score"), "candidate"]
    # A query's candidates are cut to k inside of salts before the final ranking.
    first = scores.withColumn("_s", F.pmod(F.xxhash64("candidate"), F.lit(16)))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("query", "_s").orderBy(*order))).filter(F.col("_n") <= k)
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("position") <= k).select("query", "candidate", "score", "position")


def triple_queries(triples: DataFrame, vectors: DataFrame) -> DataFrame:
    """(snapshot_id, seed, query, vec, gold, side, h, r, t) for each triple, both sides and every seed.

    The tail is looked for at h + r, the head at t - r.  vectors: snapshot_id, seed,
    kind (entity, relation), id, vec.  Triples without all three vectors have no query.
    """
    e, r = (vectors.filter(F.col("kind") == k).select("snapshot_id", "seed", F.col("id"), "vec") for k in ("entity", "relation"))
    named = lambda d, i, v: d.select("snapshot_id", "seed", F.col("id").alias(i), F.col("vec").alias(v))
    d = triples.select("snapshot_id", "h", "r", "t").distinct().join(named(r, "r", "vr"), ["snapshot_id", "r"])
    d = d.join(named(e, "h", "vh"), ["snapshot_id", "seed", "h"]).join(named(e, "t", "vt"), ["snapshot_id", "seed", "t"])
    sides = F.array(F.struct(F.lit("tail").alias("side"), x.add("vh", "vr").alias("vec"), F.col("t").alias("gold")), F.struct(F.lit("head").alias("side"), x.subtract("vt", "vr").alias("vec"), F.col("h").alias("gold")))
    d = d.select("snapshot_id", "seed", "h", "r", "t", F.explode(sides).alias("s")).select("snapshot_id", "seed", "h", "r", "t", "s.*")
    return d.withColumn("query", F.sha2(F.to_json(F.array("snapshot_id", F.col("seed").cast("string"), "side", "h", "r", "t")), 256))


def true_answers(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query, candidate): the ends that known triples give to a query of :func:`triple_queries`, its own included."""
    k = known.select("snapshot_id", "h", "r", "t").distinct()
    tails = queries.filter("side = 'tail'").select("query", "snapshot_id", "h", "r").join(k, ["snapshot_id", "h", "r"]).select("query", F.col("t").alias("candidate"))
    heads = queries.filter("side = 'head'").select("query", "snapshot_id", "r", "t").join(k, ["snapshot_id", "r", "t"]).select("query", F.col("h").alias("candidate"))
    return tails.unionByName(heads)


def triple_ranks(vectors: DataFrame, asked: DataFrame, known: DataFrame, sides: Sequence[str] = ("tail", "head")) -> DataFrame:
    """(snapshot_id, seed, side, h, r, t, rank, reciprocal): the filtered ranks of :func:`triple_queries` of ``asked``, other ends that ``known`` triples give left out.

    One run (snapshot and seed) is one group and one task, as in its training: its
    vectors come once and queries are made from ids inside of it, so no query's vector
    and no known answer is shuffled.
    """
    # One row a run, the largest first.
    runs = vectors.filter("snapshot_id is not null").groupBy("snapshot_id", "seed").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "snapshot_id", "seed").collect()
    numbers = F.broadcast(vectors.sparkSession.createDataFrame([(r["snapshot_id"], r["seed"], i) for i, r in enumerate(runs)], "snapshot_id string, seed int, run int"))
    triples = lambda d, kind: d.select("snapshot_id", F.lit(kind).alias("kind"), "h", "r", "t", F.lit(None).cast("array<double>").alias("vec")).join(numbers, "snapshot_id")
    v = vectors.filter("kind in ('entity', 'relation')").select("snapshot_id", "seed", "kind", F.col("id").alias("h"), F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("t"), "vec").join(numbers, ["snapshot_id", "seed"])
    d = v.unionByName(triples(asked, "asked")).unionByName(triples(known, "known"))
    d = d.repartitionById(max(1, len(runs)), F.col("run"))

    def run(t: pa.Table) -> pa.Table:
        of = lambda k: t.filter(pc.equal(t.column("kind"), k))
        ids, vec = zip(*((p.column("h").combine_chunks(), p.column("vec").combine_chunks()) for p in (of("entity"), of("relation"))))
        e, r = map(_vectors, vec)

        def coded(k: str) -> np.ndarray:
            """The different triples whose three vectors are there, by the vectors' rows."""
            p = of(k)
            x = np.stack([pc.fill_null(pc.index_in(p.column(c), ids[c == "r"]), -1).to_numpy() for c in "hrt"], axis=1).astype(np.int64).reshape(-1, 3)
            return np.unique(x[(x >= 0).all(axis=1)], axis=0)

        q, k, parts = coded("asked"), coded("known"), []
        for side in sides:
            # The end that is kept, the one looked for, and where it is looked for.
            kept, sought, sign = (0, 2, 1) if side == "tail" else (2, 0, -1)
            at = e[q[:, kept]] + sign * r[q[:, 1]] if len(q) else np.zeros((0, 1))
            limit = _distances(at, e[q[:, sought]]) if len(q) else np.zeros(0)
            better, same = nearer(at, limit, e)
            # Other known ends don't compete.
            code = k[:, kept] * len(r) + k[:, 1]
            order = np.argsort(code, kind="stable")
            asks = q[:, kept] * len(r) + q[:, 1]
            first = np.searchsorted(code[order], asks)
            number = np.searchsorted(code[order], asks, "right") - first
            for i, j in _stretches(number, 50_000):
                own = np.repeat(np.arange(i, j), number[i:j])
                place = np.arange(len(own)) - np.repeat(np.cumsum(number[i:j]) - number[i:j], number[i:j]) + first[own]
                other = k[order[place], sought]
                own, other = own[other != q[own, sought]], other[other != q[own, sought]]
                d = _distances(at[own], e[other])
                better -= np.bincount(own[d < limit[own]], minlength=len(q))
                same -= np.bincount(own[d == limit[own]], minlength=len(q))
            rank = 1 + better + (same - 1) / 2
            names = [pc.take(ids[c == 1], pa.array(q[:, c])) for c in range(3)]
            first_of = lambda c: pa.repeat(t.column(c)[0], len(q))
            parts.append(pa.table({"snapshot_id": first_of("snapshot_id"), "seed": first_of("seed"), "side": pa.array([side] * len(q), pa.string()), "h": names[0], "r": names[1], "t": names[2], "rank": rank, "reciprocal": 1 / rank}))
        return pa.concat_tables(parts)

    return d.groupBy("run").applyInArrow(run, "snapshot_id string, seed int, side string, h string, r string, t string, rank double, reciprocal double")


def _stretches(number: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring queries whose numbers add up to ``most`` at most, or one query."""
    total, i = np.cumsum(number), 0
    while i < len(number):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _ends(code: np.ndarray, ends: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the ask, end): all ends whose code is asked for. code: sorted, with its ends."""
    first = np.searchsorted(code, asks)
    number = np.searchsorted(code, asks, "right") - first
    own = np.repeat(np.arange(len(asks)), number)
    return own, ends[np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number) + first[own]]


def path_queries(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """(snapshot_id, seed, query, vec, gold, path) of each path (alternating entity and relation) and seed: its end is looked for at head plus all relations."""
    e, r = (vectors.filter(F.col("kind") == k).select("snapshot_id", "seed", "id", "vec") for k in ("entity", "relation"))
    d = paths.select("snapshot_id", "path", F.col("path")[0].alias("id"), F.element_at("path", -1).alias("gold"), F.posexplode(x.path_relations("path")).alias("i", "rel"))
    d = d.join(r.select("snapshot_id", "seed", F.col("id").alias("rel"), F.col("vec").alias("vr")), ["snapshot_id", "rel"])
    # A path has as many rows as relations: two or three.
    sums = d.groupBy("snapshot_id", "seed", "path", "id", "gold").agg(F.array_sort(F.collect_list(F.struct("i", "vr"))).alias("steps"))
    sums = sums.filter(F.size("steps") == F.size(x.path_relations("path"))).join(e.withColumnRenamed("vec", "vh"), ["snapshot_id", "seed", "id"])
    vec = F.aggregate("steps", F.col("vh"), lambda a, s: F.zip_with(a, s["vr"], lambda p, q: p + q))
    return sums.select("snapshot_id", "seed", F.sha2(F.to_json(F.array("snapshot_id", F.col("seed").cast("string"), F.array_join("path", "|"))), 256).alias("query"), vec.alias("vec"), "gold", "path")


def path_ranks(vectors: DataFrame, paths: DataFrame, known: DataFrame, seeds: Sequence[int], within: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, seed, path, rank, reciprocal): the filtered ranks of :func:`path_queries` under each of ``seeds`` among all entities of the run, other ends that ``known`` triples give to a path's head and relations (revisits allowed) left out.

    paths: snapshot_id, path, each once; they are read twice, vectors once.  A path
    whose end has no vector has rank infinity and reciprocal 0.  within (id) adds
    rank_within and reciprocal_within: those among its entities only.

    One run (snapshot and seed) is one group and one task, as in its training: vectors
    come once, and as they come from it; queries and answers are made from ids inside
    of it, so no query's vector and no answer is shuffled.
    """
    spark, paths = vectors.sparkSession, paths.filter("snapshot_id is not null")
    # One row a snapshot, the largest first.
    sizes = [r["snapshot_id"] for r in paths.groupBy("snapshot_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "snapshot_id").collect()]
    runs = [(s, seed, i * len(seeds) + k) for i, s in enumerate(sizes) for k, seed in enumerate(seeds)]
    numbers = F.broadcast(spark.createDataFrame(runs, "snapshot_id string, seed int, run int"))
    columns = {"h": "string", "r": "string", "t": "string", "path": "array<string>", "vec": "array<double>"}

    def rows(d: DataFrame, kind: str | None, by: Sequence[str], **named: str) -> DataFrame:
        kind_of = F.lit(kind) if kind else F.col("kind")
        d = d.join(numbers, list(by)) if by else d.crossJoin(numbers)
        return d.select("run", "snapshot_id", "seed", kind_of.alias("kind"), *[(F.col(named[c]) if c in named else F.lit(None).cast(k)).alias(c) for c, k in columns.items()])

    d = rows(vectors.filter("kind in ('entity', 'relation')"), None, ["snapshot_id", "seed"], h="id", vec="vec")
    d = d.unionByName(rows(known, "known", ["snapshot_id"], h="h", r="r", t="t")).unionByName(rows(paths, "path", ["snapshot_id"], path="path"))
    if within is not None:
        d = d.unionByName(rows(within.select("id").distinct(), "within", [], h="id"))
    d = d.repartitionById(max(1, len(runs)), F.col("run"))
    kinds = "snapshot_id string, seed int, path array<string>, rank double, reciprocal double"
    if within is None:
        return d.groupBy("run").applyInArrow(lambda t: _run_of_paths(t).select(["snapshot_id", "seed", "path", "rank", "reciprocal"]), kinds)
    return d.groupBy("run").applyInArrow(_run_of_paths, f"{kinds}, rank_within double, reciprocal_within double")


def _run_of_paths(t: pa.Table) -> pa.Table:
    of = lambda k: t.filter(pc.equal(t.column("kind"), k))
    column = lambda p, c: p.column(c).combine_chunks()
    entities, relations, known, asked = map(of, ("entity", "relation", "known", "path"))
    ids, names, paths = column(entities, "h"), column(relations, "h"), column(asked, "path")
    parts = [(paths.slice(0, 0), np.zeros((0, 2)))]
    if len(ids) and len(names):
        e, r = _vectors(entities.column("vec")), _vectors(relations.column("vec"))
        # Entities with a vector come first, by its row; a path may pass through others.
        nodes = pc.unique(pa.concat_arrays([ids, column(known, "h"), column(known, "t")]))
        number = lambda a, b: pc.fill_null(pc.index_in(a, b), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        h, k, to = number(column(known, "h"), nodes), number(column(known, "r"), names), number(column(known, "t"), nodes)
        code = h * len(r) + k
        order = np.argsort(code, kind="stable")
        order = order[k[order] >= 0]
        code, to = code[order], to[order]
        inside = pc.is_in(ids, column(of("within"), "h")).to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(paths).to_numpy(zero_copy_only=False)
        for n in np.unique(lengths[lengths >= 3]).astype(int):
            some = paths.filter(pa.array(lengths == n))
            flat, at = some.flatten(), np.arange(len(some) * n).reshape(-1, n)
            of_path = lambda i, b: number(flat.take(pa.array(at[:, i].ravel())), b).reshape(len(at), -1)  # noqa: E731, B023
            head, gold, steps = of_path(slice(0, 1), ids)[:, 0], of_path(slice(n - 1, n), ids)[:, 0], of_path(slice(1, n, 2), names)
            there = (head >= 0) & (steps >= 0).all(axis=1)
            rank = np.full((len(some), 2), np.inf)
            ready = np.flatnonzero(there & (gold >= 0))
            rank[ready] = _ranks_of_paths(e, r, head[ready], steps[ready], gold[ready], inside, code, to, len(nodes))
            parts.append((some.filter(pa.array(there)), rank[there]))
    rank, rank_within = np.concatenate([k for _, k in parts]).T
    first_of = lambda c: pa.repeat(t.column(c)[0], len(rank))
    return pa.table({"snapshot_id": first_of("snapshot_id"), "seed": first_of("seed"), "path": pa.concat_arrays([p for p, _ in parts]), "rank": rank, "reciprocal": 1 / rank, "rank_within": rank_within, "reciprocal_within": 1 / rank_within})


def _ranks_of_paths(e: np.ndarray, r: np.ndarray, head: np.ndarray, steps: np.ndarray, gold: np.ndarray, inside: np.ndarray, code: np.ndarray, to: np.ndarray, nodes: int) -> np.ndarray:
    """Ranks of gold ends among all entities and among those inside. steps: relations of each path; code, to: known triples by head and relation."""
    at = e[head]
    for i in range(steps.shape[1]):
        at = at + r[steps[:, i]]
    limit = _distances(at, e[gold])
    # An entity is met once, whether it is inside or not.
    (better, same), (more, as_far) = (np.stack(nearer(at, limit, e[w])) for w in (inside, ~inside))
    counts = np.stack([[better + more, same + as_far], [better, same]])
    # Other known ends don't compete; so many paths at once that their ends stay few.
    for i in range(0, len(head), 256):
        some = slice(i, i + 256)
        own, now = np.arange(len(head))[some], head[some]
        for k in range(steps.shape[1]):
            step, ends = _ends(code, to, now * len(r) + steps[own, k])
            own, now = np.divmod(np.unique(own[step] * nodes + ends), nodes)
        others = (now < len(e)) & (now != gold[own])
        own, now = own[others], now[others]
        for j in range(0, len(own), 50_000):
            o, c = own[j : j + 50_000], now[j : j + 50_000]
            d = _distances(at[o], e[c])
            for among, w in zip(counts, (np.ones(len(c), bool), inside[c])):
                among[0, some] -= np.bincount(o[(d < limit[o]) & w] - i, minlength=len(head[some]))
                among[1, some] -= np.bincount(o[(d == limit[o]) & w] - i, minlength=len(head[some]))
    ranks = (1 + counts[:, 0] + (counts[:, 1] - 1) / 2).T
    ranks[~inside[gold], 1] = np.inf
    return ranks


def metrics(ranks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mrr, median_rank, hits1, hits3, hits10) of each column of ``by`` alone and of all: one pass by grouping sets."""
    hits = [F.avg((F.col("rank") <= k).cast("double")).alias(f"hits{k}") for k in (1, 3, 10)]
    sets = [[F.col(c)] for c in by] + [[]]
    return ranks.groupingSets(sets, *by).agg(F.count("*").alias("n"), F.avg("reciprocal").alias("mrr"), F.median("rank").alias("median_rank"), *hits)
