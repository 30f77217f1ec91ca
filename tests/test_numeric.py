"""Numeric and graph operators against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import expressions as x
from factloom.operators import geometry, graph, nullmodel, ranking, statistics
from factloom.plans import graph_plan, measure_plan
from factloom.runtime import staged


def plainly_merged(counts, sparse, first, drop_empty):
    """Joins one sparse bucket a time with its heavier neighbour until none is left."""
    parts = [((b,), n) for b, n in counts if n or not drop_empty]
    while len(parts) > 1 and (poor := [i for i, (_, n) in enumerate(parts) if sparse(n)]):
        i = poor[0] if first else min(poor, key=lambda j: (parts[j][1], j))
        weights = {j: parts[j][1] for j in (i - 1, i + 1) if 0 <= j < len(parts)}
        j = next(j for j in sorted(weights) if weights[j] == max(weights.values()))
        lo, hi = sorted((i, j))
        parts = parts[:lo] + [(parts[lo][0] + parts[hi][0], parts[lo][1] + parts[hi][1])] + parts[hi + 1 :]
    return [b for b, _ in parts]


@pytest.mark.parametrize("rule", ["crossfit", "observations", "entities"])
def test_bucket_merges(rule):
    rng = np.random.default_rng(11)
    support = 17
    sparse = {"crossfit": lambda n: n <= support, "observations": lambda n: 0 < n < support, "entities": lambda n: n < support}[rule]
    for _ in range(300):
        counts = [(int(b), int(n)) for b, n in enumerate(rng.choice([0, 3, 9, 16, 17, 18, 40, 80], rng.integers(1, 7)))]
        assert nullmodel.merged_buckets(counts, support, rule) == plainly_merged(counts, sparse, rule == "observations", rule == "entities")


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 300), ("d", 301), (None, 40)) for v in rng.choice([-3.5, -1e-9, 0.0, 2.0, *rng.normal(size=50)], n)] + [("e", None)]
    got = {r["g"]: (r["n"], r["q"]) for r in nullmodel.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, (n, q) in got.items():
        own = [v for h, v in rows if h == g]
        assert n == len(own) and np.allclose(q, np.quantile(own, [0.0, 0.25, 0.5, 0.9, 1.0]), rtol=0, atol=1e-12)


def test_leave_target_out(spark):
    rng = np.random.default_rng(1)
    rows = [(g, f"e{i:03d}", float(v)) for g, n in (("a", 1), ("b", 2), ("c", 7), ("d", 8), ("f", 60), ("g", 61), (None, 5)) for i, v in enumerate(rng.integers(0, 6, n))]
    df = spark.createDataFrame(rows, "g string, entity_id string, value double")
    got = {(r["g"], r["entity_id"]): (r["reference_median"], r["reference_mad"]) for r in nullmodel.leave_target_out(df, ["g"]).collect()}
    for g, e, _ in rows:
        rest = np.array([v for h, f, v in rows if h == g and f != e])
        want = (None, None) if not len(rest) else (np.median(rest), np.median(np.abs(rest - np.median(rest))))
        assert got[g, e] == want


def test_components(spark, data):
    got = {(r["snapshot_id"], r["root"]): r["size"] for r in graph_plan.graph_components(spark, data).collect()}
    edges = graph_plan.edges(spark, data).collect()
    near = {}
    for r in edges:
        near.setdefault((r["snapshot_id"], r["h"]), set()).add(r["t"])
        near.setdefault((r["snapshot_id"], r["t"]), set()).add(r["h"])
    want, seen = {}, set()
    for s, e in sorted(near):
        if (s, e) in seen:
            continue
        todo, part = [e], {e}
        while todo:
            for n in near[s, todo.pop()] - part:
                part.add(n)
                todo.append(n)
        seen |= {(s, n) for n in part}
        want[s, min(part)] = len(part)
    assert got == want


def test_covered_folds(spark):
    """Against a plain pass over each fold's candidates in the order of their hashes."""
    import hashlib
    import random

    rnd = random.Random(9)
    rows = sorted({("S", f"e{rnd.randrange(25)}", rnd.choice("pq"), f"e{rnd.randrange(25)}") for _ in range(60)} | {("S", "only", "z", "e1"), ("S", "e1", "z", "e2"), ("S", "e3", "p", "e3"), ("T", "a", "p", "b")})
    number = lambda t: int(hashlib.sha256("|".join(("s3-valfold-v1", *t)).encode()).hexdigest()[:12], 16)
    want = {t: -1 for t in rows}
    for s in "ST":
        for f in range(3):
            left = [t for t in rows if t[0] == s]
            for t in sorted((t for t in left if number(t) % 3 == f), key=number):
                rest = [u for u in left if u != t]
                ends = {e for u in rest for e in (u[1], u[3])}
                if t[1] != t[3] and t[1] in ends and t[3] in ends and any(u[2] == t[2] for u in rest):
                    left, want[t] = rest, f
    df = spark.createDataFrame(rows, "snapshot_id string, h string, r string, t string")
    assert {tuple(r)[:4]: r["fold"] for r in graph.covered_folds(df, 3).collect()} == want
    assert graph.covered_folds(df.limit(0), 3).count() == 0


def test_simple_paths(spark):
    df = spark.createDataFrame([("s", "a", "r", "b"), ("s", "b", "q", "c"), ("s", "b", "p", "c"), ("s", "c", "r", "a"), ("s", "c", "r", "d"), ("s", "d", "r", "d")], "snapshot_id string, h string, r string, t string")
    got = {">".join(r["path"]) for r in graph.simple_paths(df, 2).collect()}
    assert got == {"b>q>c>r>d", "b>p>c>r>d"}
    assert graph.simple_paths(df.limit(0), 3).count() == 0


VECTORS = "transition_id string, role string, source_snapshot string, source_seed int, target_snapshot string, target_seed int, id string, va array<double>, vb array<double>"


def compared(spark, sets):
    rows = [(n, "drift", "A", 13, "B", 13, f"i{i:03d}", [float(v) for v in a], [float(v) for v in b]) for n, (va, vb) in sets.items() for i, (a, b) in enumerate(zip(va, vb))]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def test_rotations_undo_a_motion(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(50, 5))
    turn = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    flat = np.zeros((9, 5))
    flat[:, :2] = rng.normal(size=(9, 2))
    rows = compared(spark, {"moved": (a, a @ turn - 2), "flat": (flat, flat), "one": (a[:1], a[1:2])})
    fits = {r["transition_id"]: r for r in geometry.rotations(geometry.cross_sums(rows, geometry.COMPARISON, "va", "vb"), geometry.COMPARISON).collect()}
    assert np.allclose(fits["moved"]["q"], turn) and fits["moved"]["rank"] == 5 and fits["moved"]["orthogonality_error"] < 1e-9
    assert np.allclose(fits["flat"]["q"], np.eye(5)) and fits["flat"]["rank"] == 2
    assert np.allclose(fits["one"]["q"], np.eye(5)) and fits["one"]["rank"] == 0
    far = {(r["transition_id"], r["id"]): r["distance"] for r in geometry.observations(rows).collect()}
    assert len(far) == 60 and all(abs(far["moved", f"i{i:03d}"]) < 1e-9 for i in range(50))
    # A single row lies at its own mean: no direction, no distance.
    assert far["one", "i000"] is None
    assert geometry.observations(rows.limit(0)).count() == 0


def test_displacement_leaves_the_fold_out(spark):
    """Against fits of all rows but the fold's, made row by row."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(80, 4))
    b = a @ np.linalg.qr(rng.normal(size=(4, 4)))[0] + 0.05 * rng.normal(size=(80, 4))
    rows = compared(spark, {"t": (a, b)})
    got = {r["id"]: r["distance"] for r in geometry.displacement(rows, k=3).collect()}
    fold = {r["id"]: r["f"] for r in rows.selectExpr("id", "pmod(xxhash64('v33', id), 3) f").collect()}
    for f in range(3):
        own = [i for i in range(80) if fold[f"i{i:03d}"] == f]
        rest = [i for i in range(80) if fold[f"i{i:03d}"] != f]
        left, right = a[rest] - a[rest].mean(0), b[rest] - b[rest].mean(0)
        u, _, v = np.linalg.svd(left.T @ right)
        for i in own:
            p, q = (a[i] - a[rest].mean(0)) @ u @ v, b[i] - b[rest].mean(0)
            assert abs(got[f"i{i:03d}"] - (1 - p @ q / np.linalg.norm(p) / np.linalg.norm(q))) < 1e-9
    # Five rows span less than the four directions that a fit may.
    assert all(r["distance"] is None for r in geometry.displacement(compared(spark, {"t": (np.ones((6, 4)), np.ones((6, 4)))}), k=3).collect())


def test_comparisons():
    c = geometry.comparisons([("A", "B")])
    assert len(c) == len(set(c)) == 9 and sum(x[1] == "drift" for x in c) == 3 and ("A->B", "null", "B", 37, "B", 101) in c


def test_compared_vectors(spark):
    """Entities of both ends alone, within one end too, and each vector shuffled once whatever the number of comparisons."""
    has = {"A": "abc", "B": "bcd", "C": "ce"}
    rows = [(s, seed, "entity", e, [float(ord(e)), float(seed), float(ord(s))]) for s in has for seed in geometry.SEEDS for e in has[s] if (s, seed, e) != ("B", 37, "b")]
    v = spark.createDataFrame([*rows, ("A", 13, "relation", "b", [0.0] * 3), (None, 13, "entity", "b", [0.0] * 3)], "snapshot_id string, seed int, kind string, id string, vec array<double>")
    listed = geometry.comparisons([("A", "B"), ("B", "C")])
    held = {(r[0], r[1], r[3]): r[4] for r in rows}
    want = [(*c, e, held[c[2], c[3], e], held[c[4], c[5], e]) for c in listed for e in "abcde" if all(e in has[s] for s in c[0].split("->")) and (c[2], c[3], e) in held and (c[4], c[5], e) in held]
    d = geometry.compared_vectors(v, listed)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, d.collect())) == sorted(want)


def _near(rows):
    return sorted((tuple("?" if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows))


def test_side_by_side_equals_compared(spark):
    """The same rotations, distances and displacements as from rows a comparison; an entity of one end, a missing vector, another seed, rows without length."""
    rng = np.random.default_rng(12)
    rows = [(s, seed, "entity", f"e{i}", rng.normal(size=4).tolist()) for s in "ABC" for seed in (*geometry.SEEDS, 7) for i in range(60) if (s, seed, i) != ("B", 37, 3) and (s, i) != ("C", 5) and ((s, i) != ("A", 9) or seed == 7)]
    v = spark.createDataFrame([*rows, ("A", 13, "relation", "e1", [0.0] * 4), (None, 13, "entity", "e1", [0.0] * 4), ("Z", 13, "entity", "z", [0.0] * 4)], "snapshot_id string, seed int, kind string, id string, vec array<double>").repartition(3)
    listed = geometry.comparisons([("A", "B"), ("B", "C"), ("C", "D")])
    long, wide = geometry.compared_vectors(v, listed), geometry.side_by_side(v, listed)
    fits = geometry.fitted(wide, listed)
    columns = [*geometry.COMPARISON, "rank", "n"]
    assert _near(fits.select(*columns).collect()) == _near(geometry.rotations(geometry.cross_sums(long, geometry.COMPARISON, "va", "vb"), geometry.COMPARISON).select(*columns).collect())
    got = geometry.distances_side_by_side(wide, fits, listed)
    assert _near(got.collect()) == _near(geometry.observations(long).collect()) and got.count() > 900
    assert _near(geometry.displacement_side_by_side(wide, listed, 3).collect()) == _near(geometry.displacement(long, 3).collect())
    assert geometry.distances_side_by_side(wide.limit(0), geometry.fitted(wide.limit(0), listed), listed).count() == 0


@pytest.mark.parametrize("name", ["embedding_alignment", "embedding_displacement", "embedding_noise_floor"])
def test_a_vector_is_not_written_once_a_comparison(spark, data, trained, monkeypatch, name):
    monkeypatch.setattr(measure_plan, "_trained", lambda *_: trained)
    monkeypatch.setattr(geometry, "compared_vectors", lambda *_: pytest.fail("a row for each comparison"))
    measure_plan.QUERIES[name](spark, data)


@pytest.mark.parametrize("optimiser,rate", [("sgd", 0.02), ("adam", 0.02)])
def test_training_lowers_the_loss(optimiser, rate):
    rows = [(f"n{i}", k, f"n{(i + step) % 30}") for k, step in (("near", 2), ("far", 11)) for i in range(30)]
    *_, losses = geometry.train_translation(rows, 16, 200, 13, rate=rate, margin=1.0, optimiser=optimiser)
    assert np.mean(losses[-10:]) < 0.5 * losses[0]


def plain_training(rows, dimension, epochs, seed, margin=2.0, rate=0.01, batch=128):
    """Triple by triple over gradients that are added up per batch, from the same draws."""
    rng = np.random.default_rng(seed)
    ents, rels = sorted({e for h, _, t in rows for e in (h, t)}), sorted({r for _, r, _ in rows})
    known = sorted(set(rows))
    x = np.array([(ents.index(h), rels.index(r), ents.index(t)) for h, r, t in known])
    n, m = len(ents), len(rels)
    share = np.array([(p := len(own) / len({h for h, _ in own})) / (p + len(own) / len({t for _, t in own})) for k in range(m) for own in [[(h, t) for h, r, t in x.tolist() if r == k]]])
    true = np.array(sorted((h * m + r) * n + t for h, r, t in x.tolist()))
    ev, rv = rng.uniform(-6 / dimension**0.5, 6 / dimension**0.5, (n, dimension)), rng.uniform(-6 / dimension**0.5, 6 / dimension**0.5, (m, dimension))
    rv /= np.linalg.norm(rv, axis=1, keepdims=True)
    losses = []
    for _ in range(epochs):
        ev /= np.linalg.norm(ev, axis=1, keepdims=True)
        order, total = x[rng.permutation(len(x))], 0.0
        head, put, usable = geometry.replacements(order, true, share, n, rng)
        for lo in range(0, len(x), batch):
            de, dr = np.zeros_like(ev), np.zeros_like(rv)
            for i in range(lo, min(lo + batch, len(x))):
                h, r, t = order[i]
                nh, nt = (put[i], t) if head[i] else (h, put[i])
                good, bad = ev[h] + rv[r] - ev[t], ev[nh] + rv[r] - ev[nt]
                loss = margin + np.linalg.norm(good) - np.linalg.norm(bad)
                if not usable[i] or loss <= 0:
                    continue
                total += loss
                good, bad = good / np.linalg.norm(good), bad / np.linalg.norm(bad)
                for d, k, v in ((de, h, good), (de, t, -good), (de, nh, -bad), (de, nt, bad), (dr, r, good - bad)):
                    d[k] += v
            ev, rv = ev - rate * de, rv - rate * dr
        losses.append(total / len(x))
    return ents, ev, rels, rv, losses


@pytest.mark.parametrize("relations", [3, 90])
def test_training_equals_triple_by_triple(relations):
    rng = np.random.default_rng(2)
    rows = [("a", "r0", "a"), *{(f"e{h}", f"r{r}", f"e{t}") for h, r, t in zip(rng.integers(0, 40, 300), rng.integers(0, relations, 300), rng.integers(0, 9, 300))}]
    got, want = geometry.train_translation(rows, 8, 6, 13), plain_training(rows, 8, 6, 13)
    assert got[0] == want[0] and got[2] == want[2]
    assert all(np.allclose(got[i], want[i], rtol=0, atol=1e-9) for i in (1, 3, 4))


def test_replacements():
    """Never a true triple, heads as often as the relation's share, and nothing usable where every replacement is true."""
    x = np.array([(h, 0, t) for h in range(20) for t in range(20) if (h * 7 + t) % 3] + [(h, 1, 0) for h in range(20)])
    share, rng = np.array([0.3, 1.0]), np.random.default_rng(3)
    true = np.sort((x[:, 0] * 2 + x[:, 1]) * 20 + x[:, 2])
    known, heads = {tuple(v) for v in x.tolist()}, 0
    for _ in range(40):
        head, put, usable = geometry.replacements(x, true, share, 20, rng)
        for (h, r, t), a, p, ok in zip(x.tolist(), head, put.tolist(), usable):
            assert ok == (r == 0) and (not ok or ((p, r, t) if a else (h, r, p)) not in known)
        heads += head[x[:, 1] == 0].sum()
    assert abs(heads / 40 / (x[:, 1] == 0).sum() - 0.3) < 0.02


def test_rows_named_repeatedly_get_all_their_changes():
    rng = np.random.default_rng(4)
    rows, at, change = rng.normal(size=(50, 5)), rng.integers(0, 12, 90), rng.normal(size=(90, 5))
    want = rows.copy()
    np.add.at(want, at, change)
    geometry.add_rows(rows, at, rows[at], change, np.full(50, 7))
    assert np.allclose(rows, want, rtol=0, atol=1e-12)


def test_each_run_is_a_task_of_its_own(spark):
    """Two runs in one task take twice as long as the others."""
    d = spark.createDataFrame([(s, f"{s}{i}", "r", f"{s}{i + 1}") for s in "ABCDEFGHIJ" for i in range(3)], "snapshot_id string, h string, r string, t string")
    v = geometry.train(d, dimension=4, epochs=1).select("snapshot_id", "seed", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(v) == len({r["p"] for r in v}) == 30


def test_steps_cost_no_more_than_their_rows():
    """A step over many vectors costs as much as one over few, and far less than adding up each number by itself."""
    rng = np.random.default_rng(5)
    rows = [(f"h{h}", f"r{r}", f"t{t}") for h, r, t in zip(rng.integers(0, 1500, 2500), rng.integers(0, 9, 2500), rng.integers(0, 900, 2500))]
    least = lambda f: min(f() for _ in range(3))

    def timed(f):
        began = time.perf_counter()
        f()
        return time.perf_counter() - began

    x, change = np.zeros((2400, 64)), np.ones((512, 64))
    plain = least(lambda: timed(lambda: [np.add.at(x, rng.integers(0, 2400, 512), change) for _ in range(100)])) / 100
    steps = 8 * -(-len(set(rows)) // 128)
    one = least(lambda: timed(lambda: geometry.train_translation(rows, 64, 1, 13)))
    assert (least(lambda: timed(lambda: geometry.train_translation(rows, 64, 9, 13))) - one) / steps < plain


def plain_fit(rows, names):
    """Least squares with a column per unit and time, and errors clustered by time."""
    units, times = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    dummies = np.array([[float(r[0] == u) for u in units] + [float(r[1] == t) for t in times] for r in rows])
    hat = dummies @ np.linalg.pinv(dummies)
    clean = {n: v - hat @ v for n, v in zip(names, np.array([r[2:] for r in rows], float).T)}
    y, xs = clean["y"], np.array([clean[n] for n in names if n != "y"]).T
    beta = np.linalg.lstsq(xs, y, rcond=None)[0]
    inverse, e = np.linalg.inv(xs.T @ xs), y - xs @ beta
    g, n, k = len(times), len(rows), xs.shape[1]
    meat = sum(np.outer(s, s) for t in times for s in [xs[[r[1] == t for r in rows]].T @ e[[r[1] == t for r in rows]]])
    cov = g / (g - 1) * (n - 1) / (n - k) * inverse @ meat @ inverse
    return beta[0], cov[0, 0] ** 0.5


def test_fixed_effects_equal_least_squares(spark):
    rng = np.random.default_rng(6)
    rows = [(u, t, float(u * 0.3 - t + 0.7 * a + 0.2 * c + rng.normal()), float(a), float(c)) for u in range(14) for t in range(6) for a, c in [rng.normal(size=2)] if rng.random() < 0.8]
    p = statistics.demean_iterated(spark.createDataFrame(rows, "unit int, time int, y double, x double, c double"), "unit", "time", ["y", "x", "c"])
    fit = statistics.fit_fixed_effects(p, "y", "x", "time").first()
    assert np.allclose((fit["beta"], fit["se"]), plain_fit([r[:4] for r in rows], ["y", "x"])) and fit["clusters"] == 6
    both = statistics.fit_fixed_effects(statistics.partial_out(p, ["y", "x"], "c"), "y", "x", "time", regressors=2).first()
    assert np.allclose((both["beta"], both["se"]), plain_fit(rows, ["y", "x", "c"]))
    assert 0 < statistics.wild_bootstrap(p, "y", "x", "time", 99).first()["p"] <= 1


def test_estimates(spark):
    rng = np.random.default_rng(5)
    rows = [(u, t, float(0.5 * a + u + rng.normal() * 0.1), float(a), 1.0, None if u == 0 else 2.0) for u in range(12) for t in range(4) for a in [rng.normal()]]
    p = spark.createDataFrame(rows, "u int, t int, y double, x double, flat double, c double")
    ok = statistics.estimate(p, "main", "u", "t", "y", "x", draws=99)
    r = ok.first()
    assert (r["status"], r["n"], r["clusters"]) == ("OK", 48, 4) and abs(r["beta"] - 0.5) < 0.1 and abs(r["mde80"] - 2.8 * r["se"]) < 1e-12
    assert statistics.estimate(p, "c", "u", "t", "y", "x", "c", draws=9).first()["n"] == 44
    assert statistics.estimate(p, "flat", "u", "t", "y", "flat").first()["status"] == "NO_VARIATION"
    assert statistics.estimate(p.limit(0), "none", "u", "t", "y", "x").first()["status"] == "NO_DATA"
    assert statistics.testability(ok, "main", 40, 4).first()["status"] == "TESTABLE" and statistics.testability(ok, "other").first()["status"] == "NOT_TESTABLE"


def test_selection_of_configurations(spark):
    from factloom.operators import audit

    rows = [("a", "s1", 0.4), ("a", "s1", 0.6), ("a", "s2", 0.3), ("b", "s1", 0.5), ("b", "s2", 0.298), ("c", "s1", 0.1), ("c", "s2", 0.1), ("d", "s1", 0.4), ("d", "s2", 0.4)]
    got = {r["k"]: r["best"] for r in audit.tied_best(spark.createDataFrame(rows, "k string, s string, v double"), "k", "s", "v").collect()}
    assert got == {"a": True, "b": False, "d": False}
    noise = spark.createDataFrame([("g", e, v) for e, v in ((100, 0.5), (200, 0.3), (300, 0.29), (400, 0.31))], "g string, e int, v double")
    assert {r["e"]: r["stable"] for r in audit.stability_plateau(noise, "g", "e", "v", 0.02).collect()} == {100: False, 200: True, 300: True, 400: None}


def test_plateaus(spark):
    from math import nan

    runs = {"flat": [8.0] + [1.0] * 40, "high": [2.0] + [1.9] * 40, "short": [8.0, 1.0], "nan": [8.0] + [1.0] * 39 + [nan], "falling": [50.0 - i for i in range(41)]}
    df = spark.createDataFrame([(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)], "run string, epoch int, loss double")
    assert {r["run"]: r["converged"] for r in statistics.plateau(df, "run", "epoch", "loss").collect()} == {"flat": True, "high": False, "short": False, "nan": False, "falling": False}
    assert {r["run"]: r["converged"] for r in statistics.noise_aware_plateau(df, "run", "epoch", "loss").collect()} == {"flat": True, "high": False, "short": False, "nan": False, "falling": False}


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, concat('g', id % 3)) g", "cast(id % 7 as double) v")
    a, b = ({r["g"]: tuple(r)[1:] for r in statistics.bootstrap_interval(d, "g", "v", "id").collect()} for d in (df, df.repartition(7)))
    assert a.keys() == b.keys() == {None, "g1", "g2"} and all(np.allclose(a[g], b[g]) for g in a)
    assert all(low < mean < high and high - low < 0.5 for mean, low, high in a.values())


@pytest.mark.parametrize("block", [3, 2000])
def test_filtered_ranks(spark, block):
    """Against a plain count of what is nearer; ties, a missing gold answer and several groups."""
    rng = np.random.default_rng(7)
    cand = {g: {f"c{i}": rng.integers(0, 3, 2).astype(float) for i in range(n)} for g, n in (("a", 9), ("b", 4))}
    asked = [(g, f"{g}{i}", rng.integers(0, 3, 2).astype(float), f"c{i}") for g in cand for i in range(5)]
    other = {(q, f"c{i}") for _, q, _, _ in asked for i in rng.choice(9, 3)}
    queries = spark.createDataFrame([(g, q, v.tolist(), c) for g, q, v, c in asked], "g string, query string, vec array<double>, gold string")
    candidates = spark.createDataFrame([(g, c, v.tolist()) for g, d in cand.items() for c, v in d.items()], "g string, candidate string, vec array<double>")
    true = spark.createDataFrame([*other, *list(other)[:2]], "query string, candidate string")
    for f in (true, None):
        got = {r["query"]: (r["rank"], r["reciprocal"]) for r in ranking.filtered_ranks(queries, candidates, f, ["g"], block).collect()}
        for g, q, v, gold in asked:
            if gold not in cand[g]:
                assert got[q] == (float("inf"), 0.0)
                continue
            far = {c: float(((v - w) ** 2).sum()) for c, w in cand[g].items() if c == gold or f is None or (q, c) not in other}
            rank = 1 + sum(d < far[gold] for d in far.values()) + (sum(d == far[gold] for d in far.values()) - 1) / 2
            assert got[q] == (rank, 1 / rank)
    assert ranking.filtered_ranks(queries.limit(0), candidates, None, ["g"]).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e6, 1e200])
def test_nearer_equals_direct_distances(scale):
    """Ties, rows a rounding apart, and values whose squares are not finite."""
    rng = np.random.default_rng(8)
    other = rng.integers(0, 3, (300, 6)).astype(float) + 7
    other[::3] *= 1 + np.finfo(float).eps
    other[5] += rng.normal(size=6) * 1e-16
    v, gold = np.concatenate([other[:20], rng.integers(0, 3, (60, 6)) + 7.0]) * scale, other[rng.integers(0, 300, 80)] * scale
    other = other * scale
    with np.errstate(all="ignore"):
        d, limit = ranking._distances(v[:, None], other[None]), ranking._distances(v, gold)
        better, same = ranking.nearer(v, limit, other)
    assert (better == (d < limit[:, None]).sum(axis=1)).all() and (same == (d == limit[:, None]).sum(axis=1)).all()


def test_nearer_takes_less_time_than_direct_distances():
    rng = np.random.default_rng(9)
    v, other, times = rng.normal(size=(400, 64)), rng.normal(size=(2000, 64)), []
    limit = ranking._distances(v, other[:400])
    for f in (lambda: ranking.nearer(v, limit, other), lambda: [(ranking._distances(v[i : i + 31, None], other[None]) < limit[i : i + 31, None]).sum() for i in range(0, 400, 31)]):
        f()
        began = time.perf_counter()
        f()
        times.append(time.perf_counter() - began)
    assert times[0] < 0.5 * times[1]


def test_panel_trains_once(spark, data, trained, monkeypatch):
    """Both universes of candidates have the vectors of one training."""
    calls = []
    monkeypatch.setattr(measure_plan, "_trained", lambda *a: calls.append(a) or trained)
    measure_plan.panel_mrr(spark, data)
    assert len(calls) == 1


def test_triple_and_path_queries(spark):
    vectors = [("S", 1, "entity", "a", [0.0, 0.0]), ("S", 1, "entity", "b", [1.0, 0.0]), ("S", 1, "entity", "c", [1.0, 1.0]), ("S", 1, "relation", "r", [1.0, 0.0]), ("S", 1, "relation", "s", [0.0, 1.0])]
    v = spark.createDataFrame(vectors, "snapshot_id string, seed int, kind string, id string, vec array<double>")
    t = spark.createDataFrame([("S", "a", "r", "b"), ("S", "a", "r", "c"), ("S", "x", "r", "b")], "snapshot_id string, h string, r string, t string")
    q = ranking.triple_queries(t, v)
    assert {(r["side"], r["h"], r["t"], tuple(r["vec"]), r["gold"]) for r in q.collect()} == {("tail", "a", "b", (1.0, 0.0), "b"), ("head", "a", "b", (0.0, 0.0), "a"), ("tail", "a", "c", (1.0, 0.0), "c"), ("head", "a", "c", (0.0, 1.0), "a")}
    true = ranking.true_answers(q, t).join(q.select("query", "side", "t"), "query").collect()
    assert {(r["side"], r["t"], r["candidate"]) for r in true} == {("tail", "b", "b"), ("tail", "b", "c"), ("tail", "c", "b"), ("tail", "c", "c"), ("head", "b", "a"), ("head", "b", "x"), ("head", "c", "a")}
    p = spark.createDataFrame([("S", ["a", "r", "b", "s", "c"]), ("S", ["a", "r", "b", "none", "c"])], "snapshot_id string, path array<string>")
    got = ranking.path_queries(p, v).collect()
    assert [(tuple(r["vec"]), r["gold"]) for r in got] == [((1.0, 1.0), "c")]


def test_triple_ranks_make_queries_inside_of_runs(spark):
    """Equal to queries that meet all candidates; ties, repeats, self-loops, ends without vectors, a run without questions; nothing but one exchange by run."""
    rng = np.random.default_rng(6)
    ids = [f"e{i}" for i in range(12)]
    vectors = [(s, seed, kind, i, rng.integers(-1, 2, 3).astype(float).tolist()) for s in "AB" for seed in (1, 2) for kind, names in (("entity", ids), ("relation", ["r", "s"]), ("loss", ["epochs"])) for i in names]
    v = spark.createDataFrame([*vectors, ("C", 1, "entity", "e0", [0.0] * 3), ("C", 1, "relation", "r", [0.0] * 3)], "snapshot_id string, seed int, kind string, id string, vec array<double>")
    known = [(s, ids[a], r, ids[b]) for s in "AB" for a, r, b in zip(rng.integers(0, 5, 40), rng.choice(["r", "s"], 40), rng.integers(0, 12, 40))]
    asked = [*known[::3], known[0], ("A", "e0", "r", "none"), ("A", "e0", "none", "e1"), ("D", "e0", "r", "e1")]
    triples = "snapshot_id string, h string, r string, t string"
    asked, known = spark.createDataFrame(asked, triples), spark.createDataFrame([*known, ("A", "e0", "r", "none")], triples)
    d = ranking.triple_ranks(v, asked, known)
    got = {tuple(r) for r in d.collect()}
    q = ranking.triple_queries(asked, v)
    c = v.filter("kind = 'entity'").select("snapshot_id", "seed", F.col("id").alias("candidate"), "vec")
    want = ranking.filtered_ranks(q, c, ranking.true_answers(q, known), ["snapshot_id", "seed"]).select("query", "rank", "reciprocal").join(q, "query")
    assert got == {(r["snapshot_id"], r["seed"], r["side"], r["h"], r["r"], r["t"], r["rank"], r["reciprocal"]) for r in want.collect()} and len(got) > 50
    assert {r for r in got if r[2] == "tail"} == {tuple(r) for r in ranking.triple_ranks(v, asked, known, ["tail"]).collect()}
    # The only exchange is that by run.
    assert "Exchange hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
    assert ranking.triple_ranks(v, asked.limit(0), known).count() == ranking.triple_ranks(v.limit(0), asked, known).count() == 0


def made_paths(spark):
    """(vectors, paths, known triples) of a few runs: ties, revisits, several ends, ends, middles and relations without vectors, paths of two and three hops, a snapshot without vectors."""
    rng = np.random.default_rng(12)
    ids = [f"e{i}" for i in range(10)]
    vectors = [(s, seed, kind, i, rng.integers(-1, 2, 3).astype(float).tolist()) for s in "AB" for seed in (1, 2) for kind, names in (("entity", ids), ("relation", ["r", "s"]), ("loss", ["epochs"])) for i in names]
    known = {(s, f"e{a}", r, f"e{b}") for s in "ABC" for a, r, b in zip(rng.integers(0, 12, 50), rng.choice(["r", "s", "none"], 50), rng.integers(0, 12, 50))}
    v = spark.createDataFrame(vectors, "snapshot_id string, seed int, kind string, id string, vec array<double>")
    k = spark.createDataFrame(sorted(known), "snapshot_id string, h string, r string, t string")
    return v, staged(graph.simple_paths(k, 2).unionByName(graph.simple_paths(k, 3)), "paths"), k


def test_path_ranks_make_queries_inside_of_runs(spark):
    """Equal to queries that meet all candidates; nothing but one exchange by run."""
    v, paths, known = made_paths(spark)
    d = ranking.path_ranks(v, paths, known, (1, 2))
    got = [(r["snapshot_id"], r["seed"], tuple(r["path"]), r["rank"], r["reciprocal"]) for r in d.collect()]
    q = ranking.path_queries(paths, v)
    asked = q.select("query", "snapshot_id", F.col("path")[0].alias("head"), x.path_relations("path").alias("relations"))
    true = asked.join(graph.path_answers(known, asked), ["snapshot_id", "head", "relations"]).select("query", F.col("answer").alias("candidate"))
    c = v.filter("kind = 'entity'").select("snapshot_id", "seed", F.col("id").alias("candidate"), "vec")
    want = ranking.filtered_ranks(q, c, true, ["snapshot_id", "seed"]).select("query", "rank", "reciprocal").join(q, "query")
    assert sorted(got) == sorted((r["snapshot_id"], r["seed"], tuple(r["path"]), r["rank"], r["reciprocal"]) for r in want.collect())
    assert {len(p) for _, _, p, _, _ in got} == {5, 7} and {k == float("inf") for *_, k, _ in got} == {True, False} and any(k % 1 for *_, k, _ in got)
    # The only exchange is that by run.
    assert "Exchange hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
    assert ranking.path_ranks(v, paths.limit(0), known, (1, 2)).count() == ranking.path_ranks(v.limit(0), paths, known, (1, 2)).count() == 0
    assert ranking.path_ranks(v, paths, known.limit(0), (1, 2)).count() == len(got)


def test_path_ranks_within(spark):
    """Both universes at once: equal to one after the other, infinite where the end is outside."""
    v, paths, known = made_paths(spark)
    within = spark.createDataFrame([(f"e{i}",) for i in (0, 2, 2, 3, 5, 8, 11)], "id string")
    both = ranking.path_ranks(v, paths, known, (1, 2), within)
    key = ["snapshot_id", "seed", "path"]
    rows = lambda d: sorted((r[0], r[1], tuple(r[2]), r[3], r[4]) for r in d.collect())
    assert rows(both.select(*key, "rank", "reciprocal")) == rows(ranking.path_ranks(v, paths, known, (1, 2)))
    q = ranking.path_queries(paths, v)
    asked = q.select("query", "snapshot_id", F.col("path")[0].alias("head"), x.path_relations("path").alias("relations"))
    true = asked.join(graph.path_answers(known, asked), ["snapshot_id", "head", "relations"]).select("query", F.col("answer").alias("candidate"))
    c = v.filter("kind = 'entity'").join(within, "id", "left_semi").select("snapshot_id", "seed", F.col("id").alias("candidate"), "vec")
    want = ranking.filtered_ranks(q, c, true, ["snapshot_id", "seed"]).select("query", "rank", "reciprocal").join(q, "query")
    assert rows(both.select(*key, "rank_within", "reciprocal_within")) == rows(want.select(*key, "rank", "reciprocal"))
    assert {r["rank_within"] == float("inf") for r in both.collect()} == {True, False}


@pytest.mark.parametrize("name", ["rank_paths", "panel_mrr"])
def test_paths_are_ranked_inside_of_runs(spark, data, trained, monkeypatch, name):
    """No vector is staged, and queries don't meet blocks of candidates."""
    names, plain = [], staged
    monkeypatch.setattr(measure_plan, "staged", lambda d, n: names.append((n, dict(d.dtypes))) or plain(d, n))
    monkeypatch.setattr(measure_plan, "_trained", lambda *_: trained)
    monkeypatch.setattr(ranking, "filtered_ranks", None)
    assert measure_plan.QUERIES[name](spark, data).count() > 0
    assert names and not any("vec" in columns for _, columns in names)


@pytest.mark.parametrize("name,sides", [("rank_triples", None), ("model_against_baseline", ["tail"])])
def test_held_out_triples_are_ranked_inside_of_runs(spark, data, trained, monkeypatch, name, sides):
    calls, plain = [], ranking.triple_ranks
    monkeypatch.setattr(measure_plan, "_held_out", lambda *_: ((f := graph.covered_folds(graph_plan.edges(spark, data), 5)), f.filter("fold = 0"), trained))
    monkeypatch.setattr(ranking, "triple_ranks", lambda *a: calls.append(a[3:]) or plain(*a))
    measure_plan.QUERIES[name](spark, data)
    assert calls == [(sides,) if sides else ()]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [[0.0, 1.0], [1.0, 0.0]]), ([0.0, 0.0], [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]])], "a array<double>, b array<double>, q array<array<double>>")
    r = df.select(x.dot("a", "b").alias("d"), x.norm("a").alias("n"), x.cosine("a", "b").alias("c"), x.cosine_distance("a", "b").alias("cd"), x.times_matrix("a", "q").alias("m"), x.normalise("a").alias("u")).collect()
    assert (r[0]["d"], r[0]["n"], round(r[0]["c"], 9), round(r[0]["cd"], 9), r[0]["m"], r[0]["u"]) == (24.0, 5.0, 0.96, 0.04, [4.0, 3.0], [0.6, 0.8])
    assert r[1]["c"] == 0.0 and r[1]["cd"] is None and r[1]["u"] == [0.0, 0.0]


@pytest.fixture(scope="module")
def trained(spark, data):
    """Few epochs for the tests that only look at what comes out of the plans."""
    from factloom.runtime import staged

    return staged(geometry.train(graph_plan.edges(spark, data), dimension=16, epochs=20), "trained")


@pytest.mark.parametrize("name", ["bucket_merges", "mean_intervals", "panel_bootstrap", "embedding_alignment", "embedding_displacement", "embedding_drift", "embedding_noise_floor", "rank_paths", "panel_mrr", "rank_triples", "model_against_baseline"])
def test_runs(spark, data, trained, monkeypatch, name):
    monkeypatch.setattr(measure_plan, "_trained", lambda *_: trained)
    monkeypatch.setattr(measure_plan, "_held_out", lambda *_: ((f := graph.covered_folds(graph_plan.edges(spark, data), 5)), f.filter("fold = 0"), trained))
    assert measure_plan.QUERIES[name](spark, data).count() > 0
