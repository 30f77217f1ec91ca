"""As-of snapshots against a plain pass over the facts, and their edge cases."""

import random
from datetime import datetime

import pytest

from factloom.operators import asof_snapshot as op
from factloom.operators import audit

FACTS = "version string, logical string, subject string, relation string, object string, observed long, accepted long, valid_from long, valid_to long, supersedes string, retraction boolean, claims array<string>"
DAY = 86_400_000_000


def day(n):
    return op.micros(datetime(2025, 1, 1)) + n * DAY


def fact(version, observed=0, supersedes=None, retraction=False, logical="f", valid_from=0, valid_to=None, accepted=None, subject="a", obj="b", claims=("c",)):
    at = lambda n: None if n is None else day(n)
    return (version, logical, subject, "r", obj, at(observed), at(observed if accepted is None else accepted), at(valid_from), at(valid_to), supersedes, retraction, list(claims))


def plain(facts, cutoff):
    """The reason of each fact at a cutoff, one fact after another."""
    def clock(f):
        _, _, _, _, _, seen, accepted, start, end, _, _, _ = f
        if seen is None or seen > cutoff:
            return op.REASONS[0]
        if accepted is not None and accepted > cutoff:
            return op.REASONS[1]
        if start is not None and start > cutoff:
            return op.REASONS[2]
        return op.REASONS[3] if end is not None and end <= cutoff else None

    clocks = {f[0]: clock(f) for f in facts}
    valid = {f[0]: f for f in facts if clocks[f[0]] is None}
    out = {}
    for f in facts:
        reason = clocks[f[0]]
        if reason is None:
            children = [g[0] for g in valid.values() if g[9] == f[0] and g[1] == f[1]]
            rivals = [g[0] for g in valid.values() if f[9] is not None and g[9] == f[9] and g[1] == f[1]]
            tombs = [g for g in facts if g[10] and g[9] == f[0] and clocks[g[0]] in (None, op.REASONS[3])]
            if children or (f[9] in valid and valid[f[9]][1] == f[1] and f[0] != max(rivals)):
                reason = op.REASONS[4]
            elif f[10]:
                reason = op.REASONS[5]
            elif tombs:
                reason = op.REASONS[6]
        out[f[0]] = reason
    return out


def test_status_equals_a_plain_pass(spark):
    rnd = random.Random(12)
    facts = []
    for i in range(80):
        start = rnd.choice([None, rnd.randrange(12)])
        facts.append(fact(f"v{i:02d}", rnd.choice([None, *range(12)]), rnd.choice([None, None, f"v{rnd.randrange(80):02d}", "gone"]), rnd.random() < 0.15, f"f{rnd.randrange(12)}", start, rnd.choice([None, None, rnd.randrange(4, 14)]), rnd.choice([None, rnd.randrange(14)])))
    cutoffs = [(f"S{n}", datetime(2025, 1, 1 + n)) for n in (2, 5, 9, 13)]
    got = {(r["snapshot"], r["version"]): r["reason"] for r in op.snapshot_status(spark.createDataFrame(facts, FACTS), cutoffs).collect()}
    assert got == {(n, v): reason for n, c in cutoffs for v, reason in plain(facts, op.micros(c)).items()}
    assert len(set(got.values())) == 8


def test_mappings_apply_as_known_at_the_cutoff(spark):
    """A later alias changes later snapshots alone; a decision of the future never counts."""
    f = spark.createDataFrame([fact("1", subject="Old Name"), fact("2", logical="g", subject="new name", claims=())], FACTS)
    m = spark.createDataFrame([("m1", "OLD NAME", "E1", "2025-01-03T00:00:00Z", None), ("m2", "old name", "E2", "2025-01-06T00:00:00Z", "m1"), ("m3", "New Name", "E2", "2025-01-02T00:00:00Z", None), ("m4", "b", None, "2025-01-01T00:00:00Z", None), ("m5", None, "E9", "2025-01-01T00:00:00Z", None)], "entity_mapping_id string, mention string, canonical_entity_id string, mapping_available_at string, supersedes_mapping_id string")
    cut = [(f"S{n}", datetime(2025, 1, n)) for n in (1, 4, 7)]
    a = op.resolve_ends(op.snapshot_status(f, cut), m)
    assert {(r["snapshot"], r["version"]): (r["subject"], r["object"]) for r in a.collect()} == {("S1", "1"): ("Old Name", "b"), ("S1", "2"): ("new name", "b"), ("S4", "1"): ("E1", "b"), ("S4", "2"): ("E2", "b"), ("S7", "1"): ("E2", "b"), ("S7", "2"): ("E2", "b")}
    e = {(r["snapshot"], r["subject"]): r["support"] for r in op.snapshot_edges(a).collect()}
    assert e == {("S1", "Old Name"): 1, ("S1", "new name"): 1, ("S4", "E1"): 1, ("S4", "E2"): 1, ("S7", "E2"): 2}
    assert op.resolve_ends(op.snapshot_status(f, cut), m.limit(0)).count() == 6 and op.snapshot_status(f.limit(0), cut).count() == 0


def test_a_strict_clock_is_required(spark):
    f = spark.createDataFrame([fact("1"), ("2", "f", "a", "r", "b", day(0), None, None, None, None, False, [])], FACTS)
    cut = [("S", datetime(2025, 1, 5))]
    assert {r["reason"] for r in op.snapshot_status(f, cut).collect()} == {None}
    with pytest.raises(Exception, match="no acceptance of version 2"):
        op.snapshot_status(f, cut, strict=True).collect()


def test_support_is_exact(spark):
    good = "0" * 64
    f = spark.createDataFrame([fact("1", claims=("c1", "c1", "c2")), fact("2", logical="g", claims=())], FACTS)
    p = spark.createDataFrame([("p1", "c1", "m", "s", "r", good), ("p1", "c1", "m", "s", "r", good), ("p2", "c1", "m", " ", "r", good), ("p3", "c1", "m", "s", "r", "zz"), (None, "c1", "m", "s", "r", good)], "provenance_id string, claim_id string, membership_id string, source_version_id string, retrieval_id string, raw_blob_sha256 string")
    a = op.snapshot_status(f, [("S", datetime(2025, 1, 5))])
    got = sorted((r["fact_version_id"], r["claim_id"] or "", r["provenance_id"] or "", r["problem"] or "") for r in op.edge_support(a, p).collect())
    assert got == [("1", "c1", "p1", ""), ("1", "c1", "p2", "INCOMPLETE"), ("1", "c1", "p3", "BAD_HASH"), ("1", "c2", "", "MISSING_PROVENANCE"), ("2", "", "", "MISSING_PROVENANCE")]


def test_audits(spark):
    u = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "k string")
    d = spark.createDataFrame([("a",), ("c",), ("c",), ("x",), (None,)], "k string")
    assert {r["side"]: r["n"] for r in audit.conservation(u, d, "k").collect()} == {"UNDECIDED": 1, "UNKNOWN": 1, "REPEATED": 1}
    assert {r["side"]: r["n"] for r in audit.conservation(u.limit(0), d.limit(0), "k").collect()} == {"UNDECIDED": 0, "UNKNOWN": 0, "REPEATED": 0}
    p = audit.parity_by(spark.createDataFrame([("s", "a"), ("s", "a"), (None, "b")], "g string, k string"), spark.createDataFrame([("s", "b"), (None, "b"), ("t", None)], "g string, k string"), "g", "k")
    assert {tuple(r) for r in p.collect()} == {("s", "LEFT_ONLY", 1), ("s", "RIGHT_ONLY", 1), (None, "BOTH", 1), ("t", "RIGHT_ONLY", 1)}
    g = spark.createDataFrame([("1", 1, None), ("2", 2, "x"), ("3", 3, "x")], "k string, a int, b string")
    q = spark.createDataFrame([("1", 1, None), ("2", 9, "x"), ("4", 3, "x")], "k string, a int, b string")
    got = {r["metric"]: (r["numerator"], r["denominator"]) for r in audit.quality_by_kind(g, q, ["k"], {"span": ["a", "b"], "kind": ["b"]}).collect()}
    assert got == {"relation_precision": (2, 3), "relation_recall": (2, 3), "span_accuracy": (3, 6), "kind_accuracy": (2, 3)}
