"""Edge cases and plain comparisons of the operators of the core."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.operators import asof, history, orphans, snapshots, timestamps
from factloom.plans import general
from tests import brute

ZONES = "source_id string, zone_name string, date_order string, std_abbrev string, dst_abbrev string"
TIMES = "id string, value string, src string, basis string, arrived timestamp_ntz"


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([("b", "Europe/Berlin", "dmy", "CET", "CEST"), ("n", "America/New_York", "mdy", "EST", "EDT"), ("bad", "Nowhere/None", "dmy", None, None)], ZONES)


def instants(spark, zones, rows):
    from datetime import datetime

    df = spark.createDataFrame([(i, v, s, b, datetime(2025, 1, 1, 0, 0, k)) for k, (i, v, s, b) in enumerate(rows)], TIMES)
    return {r["id"]: r["us"] for r in timestamps.normalise_timestamps(df, "id", "value", "src", "basis", "arrived", zones).collect()}


def us(y, mo, d, h=0, mi=0, s=0):
    from datetime import datetime, timezone

    return int(datetime(y, mo, d, h, mi, s, tzinfo=timezone.utc).timestamp()) * 1_000_000


def test_timestamp_notations(spark, zones):
    w = timestamps.ARCHIVE_BASIS
    cases = [
        ("gap", "2025-03-30T02:30:00", "b", None, us(2025, 3, 30, 1, 30)),
        ("twice", "26.10.2025 02:30:00", "b", None, us(2025, 10, 26, 0, 30)),
        ("mdy", "3/4/2025 1:05 PM", "n", None, us(2025, 3, 4, 18, 5)),
        ("noon", "3/4/2025 12:05 AM", "n", None, us(2025, 3, 4, 5, 5)),
        ("abbr", "2025-11-02 01:30:00 EST", "n", None, us(2025, 11, 2, 6, 30)),
        ("region", "2025-06-01T12:00:00[Asia/Tokyo]", None, None, us(2025, 6, 1, 3)),
        ("day", "2025-06-01", "b", None, us(2025, 5, 31, 22)),
        ("archive", "20250601120000", "unlisted", w, us(2025, 6, 1, 12)),
        ("nano", "2025-06-01T12:00:00.123456789Z", None, None, us(2025, 6, 1, 12) + 123456),
        ("epoch", "1748779200", None, None, us(2025, 6, 1, 12)),
        ("milli", " 1748779200123\n", None, None, us(2025, 6, 1, 12) + 123000),
        ("gmt", "12:00 01/06/2025 (GMT+5:30)", "b", None, us(2025, 6, 1, 6, 30)),
        ("rfc", "Sun, 01 Jun 2025 12:00:00 +0200", None, None, us(2025, 6, 1, 10)),
        ("month", "Jun 1, 2025 1:00 PM", "n", None, us(2025, 6, 1, 17)),
        ("unlisted", "2025-06-01T12:00:00", "unlisted", None, None),
        ("badzone", "2025-06-01T12:00:00", "bad", None, None),
        ("none", "2025-02-30T00:00:00Z", None, None, None),
        ("hour", "2025-02-03T25:00:00Z", None, None, None),
        ("words", "vừa xong", "b", None, None),
        ("empty", "", "b", w, None),
        ("null", None, None, None, None),
        ("zero", "0000-00-00 00:00:00", "b", None, None),
        ("order", "31/11/2025 09:30", "n", None, None),
        ("declared", "13/02/2025 09:30", "n", None, None),
        ("either", "2/3/2025 09:30", "n", None, us(2025, 2, 3, 14, 30)),
    ]
    got = instants(spark, zones, [c[:4] for c in cases])
    assert got == {c[0]: c[4] for c in cases}


def test_order_of_an_unlisted_source_follows_its_records(spark, zones):
    w = timestamps.ARCHIVE_BASIS
    dmy = [("a", "13/02/2025 10:00", "x", w), ("b", "03/04/2025 10:00", "x", w), ("c", "25/04/2025 10:00", "x", w)]
    mdy = [("d", "02/13/2025 10:00", "y", w), ("e", "03/04/2025 10:00", "y", w), ("f", "03/25/2025 10:00", "y", w)]
    got = instants(spark, zones, dmy + mdy)
    assert got["b"] == us(2025, 4, 3, 10) and got["e"] == us(2025, 3, 4, 10)


def plain_cost(rows, path):
    """The cost of a path of readings over (readings, declared) in order; infinite where it takes an invalid one."""
    cost = 0.0
    for i, ((us, declared), s) in enumerate(zip(rows, path)):
        if us[s] is None:
            return float("inf")
        cost += timestamps.AGAINST_COST * ((declared is not None and s % 2 != declared) + (s >= 2))
        if i:
            cost += timestamps.SWITCH_COST * (path[i - 1] % 2 != s % 2) + timestamps.BACKWARD_COST * (us[s] < rows[i - 1][0][path[i - 1]])
    return cost


@pytest.mark.parametrize("part_rows", [1, 3, 1000])
@pytest.mark.parametrize("block", [1, 2, 128])
def test_the_cheapest_path_is_taken(spark, monkeypatch, part_rows, block):
    """However the chain is cut, its cost is the least of all paths'."""
    import itertools
    import random

    rnd = random.Random(part_rows)
    data, want = [], {}
    for src in ("s", "t", None):
        rows = []
        for i in range(7):
            us = [rnd.choice([None, rnd.randrange(9), rnd.randrange(9)]) for _ in range(4)]
            us = us if any(u is not None for u in us) else [5, 5, None, None]
            rows.append((us, rnd.choice([None, None, 0, 1])))
            data.append((f"{src}{i}", src, i * 10, *rows[-1]))
        want[src] = min(plain_cost(rows, p) for p in itertools.product(range(4), repeat=7))
    df = spark.createDataFrame(data, "id string, src string, at long, readings array<long>, declared int")
    monkeypatch.setattr(timestamps._Part.__init__, "__defaults__", (block,))
    got = {r["id"]: r["us"] for r in timestamps.choose_readings(df, "id", "src", "at", part_rows).collect()}
    assert len(got) == len(data)
    for src, least in want.items():
        own = [r for r in data if r[1] == src]
        fits = (p for p in itertools.product(*[[s for s in range(4) if r[3][s] == got[r[0]] and r[3][s] is not None] for r in own]))
        assert min(plain_cost([(r[3], r[4]) for r in own], p) for p in fits) == least


def test_a_source_of_one_arrival_time_is_spread(spark):
    """Many records of one source without arrival time: parts stay bounded."""
    n = 3000
    df = spark.range(n).selectExpr("id", "'s' src", "cast(0 as bigint) at", "array(id, id + 5, null, null) readings", "cast(null as int) declared")
    assert df.repartitionByRange(10, "src", "at", "id", "readings").selectExpr("spark_partition_id() p").groupBy("p").count().agg({"count": "max"}).first()[0] < n / 4
    assert timestamps.choose_readings(df, "id", "src", "at", part_rows=300).selectExpr("count(distinct id) n", "count_if(us = id) d").first() == (n, n)


def test_readings(spark, zones):
    """Every valid way is there before one is chosen."""
    df = spark.createDataFrame([(v, z, o) for v, z, o in [("03/04/2025 10:00", "UTC", None), ("13/04/2025 10:00", "UTC", None), ("13/04/2025 10:00", "UTC", "mdy"), ("2025-10-26 02:30", "Europe/Berlin", None), ("202501020304", "UTC", None), ("2025-04-06 01:45", "Australia/Lord_Howe", None), ("x", "UTC", None)]], "v string, z string, o string")
    none = F.lit(None).cast("string")
    got = {(r["v"], r["o"]): r["readings"] for r in timestamps.interpretations(df.withColumn("n", none), "v", "z", "o", "n", "n", F.lit(False)).collect()}
    assert got["03/04/2025 10:00", None] == [us(2025, 4, 3, 10), us(2025, 3, 4, 10), None, None]
    assert got["13/04/2025 10:00", None] == [us(2025, 4, 13, 10), None, None, None]
    assert got["13/04/2025 10:00", "mdy"] == [None] * 4 == got["x", None]
    assert got["2025-10-26 02:30", None] == [us(2025, 10, 26, 0, 30)] * 2 + [us(2025, 10, 26, 1, 30)] * 2
    assert got["202501020304", None] == [us(2025, 1, 2, 3, 4)] * 2 + [202501020304000] * 2
    assert got["2025-04-06 01:45", None] == [us(2025, 4, 5, 14, 45)] * 2 + [us(2025, 4, 5, 15, 15)] * 2


def test_a_source_without_open_values(spark, zones):
    assert instants(spark, zones, [("a", "4/30/2025 2:37 PM", "n", None), ("b", "30/4/2025 14:37", "b", None)]) == {"a": us(2025, 4, 30, 18, 37), "b": us(2025, 4, 30, 12, 37)}


def test_abbreviations_follow_the_year(spark):
    z = spark.createDataFrame([("m", "Europe/Moscow", "dmy", "MSK", "MSD")], ZONES)
    got = instants(spark, z, [("then", "2012-07-01 12:00:00 MSK", "m", None), ("now", "2025-07-01 12:00:00 MSK", "m", None)])
    assert got == {"then": us(2012, 7, 1, 8), "now": us(2025, 7, 1, 9)}


def test_p4_and_p7_equal_plain_python(spark, data):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    zones = {r[0]: dict(zip(("zone_name", "date_order", "std_abbrev", "dst_abbrev"), r[1:])) for r in c.execute(f"SELECT source_id, zone_name, date_order, std_abbrev, dst_abbrev FROM '{data}/publisher_zones.parquet'").fetchall()}
    want = set()
    for t, cols in (("document_times", "document_time_id, observed_at, source_id, basis"), ("fact_versions", "fact_version_id, evidence_observed_at, source_id, evidence_time_basis")):
        for k, v, s, b in c.execute(f"SELECT {cols} FROM '{data}/{t}.parquet'").fetchall():
            if (u := brute.instant(v, s, b, zones)) is not None:
                want.add((t, k, u))
    assert {tuple(r) for r in general.p4_found(spark, data).collect()} == want
    at = {k: u for t, k, u in want if t == "fact_versions"}
    events = [(k, e, m, at.get(k)) for k, s, o in c.execute(f"SELECT fact_version_id, subject_id, object_id FROM '{data}/fact_versions.parquet'").fetchall() for e, m in (("subject", s), ("object", o))]
    decisions = [(a, b, int(u), s) for a, b, u, s in c.execute(f"SELECT entity_mapping_id, mention, epoch_us(mapping_available_at::timestamptz), supersedes_mapping_id FROM '{data}/entity_mapping_versions.parquet'").fetchall()]
    assert {tuple(r) for r in general.p7_found(spark, data).collect()} == brute.known(events, decisions)


VERSIONS = "fact_version_id string, logical_fact_id string, valid_from string, valid_to string, supersedes_version_id string, revision_type string, extra int"


def test_history_edges(spark):
    rows = [
        ("a", "f", None, None, None, "assertion", 1),
        ("a", "f", None, None, None, "assertion", 2),
        ("b", "f", "2025-01-01T00:00:00Z", None, "a", "correction", 1),
        ("c", "f", "2025-02-01T07:00:00+07:00", "2025-03-01T00:00:00Z", None, "update", 1),
        ("d", "f", "2025-02-10T00:00:00Z", None, "c", "retraction", 1),
        ("e", None, "2025-01-01T00:00:00Z", None, None, "assertion", 1),
        (None, "f", "2025-01-05T00:00:00Z", None, None, "assertion", 1),
        ("g", "h", "2025-05-01T00:00:00Z", None, None, "assertion", 1),
        ("r1", "t", "2025-01-01T00:00:00Z", None, None, "assertion", 1),
        ("r2", "t", "2025-02-01T00:00:00Z", None, None, "retraction", 1),
        ("r3", "t", "2025-03-01T00:00:00Z", None, None, "retraction", 1),
        ("r4", "t", "2025-04-01T00:00:00Z", "2025-06-01T00:00:00Z", None, "assertion", 1),
        ("r0", "t", "2025-04-01T00:00:00Z", None, None, "assertion", 1),
        ("i", "h", "2025-04-01T00:00:00Z", None, "g", "correction", 1),
    ]
    got = {(r["fact_version_id"], r["period_start"], r["period_end"]) for r in history.version_history(spark.createDataFrame(rows, VERSIONS)).collect()}
    assert got == {("a", "", "2025-01-01T00:00:00Z"), ("b", "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z"), ("c", "2025-02-01T00:00:00Z", "2025-02-10T00:00:00Z"), ("e", "2025-01-01T00:00:00Z", ""), ("i", "2025-04-01T00:00:00Z", ""), ("r1", "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z"), ("r4", "2025-04-01T00:00:00Z", "2025-06-01T00:00:00Z")}
    assert history.version_history(spark.createDataFrame([], VERSIONS)).count() == 0


def test_validity_chunks_do_not_matter(spark):
    df = spark.range(1, 200).select(F.lit("k").alias("k"), F.col("id").alias("n"), (F.col("id") * 3).alias("s"))
    want = [(i, i * 3 + 3 if i < 199 else None) for i in range(1, 200)]
    for chunk in (2, 7, 1000):
        assert sorted((r["n"], r["period_end"]) for r in history.validity(df, "k", "n", "s", chunk).collect()) == want


def test_orphans_edges(spark):
    from datetime import datetime as t

    child = spark.createDataFrame([("1", "p", t(2025, 1, 2), 0), ("1", "p", t(2025, 1, 1), 0), ("2", " ", t(2025, 1, 1), 0), ("3", None, t(2025, 1, 1), 0), ("4", "q", t(2025, 1, 1), 0), ("5", "P", t(2025, 1, 1), 0), ("6", "r", t(2025, 1, 3), 0), (None, "zz", t(2025, 1, 1), 0)], "id string, ref string, ingested_at_real timestamp_ntz, key int")
    parent = spark.createDataFrame([("p", t(2025, 1, 1), "x"), ("q", t(2025, 1, 5), "x"), ("r", t(2025, 1, 1), "x"), (None, t(2025, 1, 1), "x")], "key string, ingested_at_real timestamp_ntz, record_id string")
    gone = spark.createDataFrame([("r",), ("r",), ("unknown",)], "record_id string")
    got = {(r["record_id"], r["reason"]) for r in orphans.find_orphans(child, "id", "ref", parent, "key", gone).collect()}
    assert got == {("4", "late"), ("5", "missing"), ("6", "deleted")}
    assert orphans.find_orphans(child.limit(0), "id", "ref", parent, "key").count() == 0
    assert {r["record_id"] for r in orphans.find_orphans(child, "id", "ref", parent.limit(0), "key").collect()} == {"1", "4", "5", "6"}


def test_snapshot_changes_edges(spark):
    rows = [("T1", "a", "r", "x"), ("T1", "a", "r", "x"), ("T2", "a", "r", "x"), ("T2", "a", "r", "y"), ("T1", None, "r", "x"), ("T2", None, "r", None), ("T3", "b", "r", None), (None, "z", "r", "x"), ("T2", "c", "r", None), ("T3", "c", "r", None)]
    df = spark.createDataFrame(rows, "s string, k string, r string, o string").withColumn("f", F.lit(1)).withColumn("at", F.lit(2))
    got = {tuple(r) for r in snapshots.snapshot_changes(df, "s", ["k", "r"], ["o"]).drop("changed_fields").collect()}
    assert got == {("T2", "a", "r", "changed"), ("T2", None, "r", "changed"), ("T2", "c", "r", "added"), ("T3", "a", "r", "removed"), ("T3", None, "r", "removed"), ("T3", "b", "r", "added")}
    assert snapshots.snapshot_changes(df.limit(0), "s", ["k", "r"], ["o"]).count() == 0


def test_snapshot_changes_over_many_snapshots(spark):
    """More snapshots than a word has bits, against plain sets."""
    import random

    rnd = random.Random(3)
    rows = sorted({(f"S{s:03d}", rnd.choice("abc"), rnd.choice("xyz"), rnd.choice("uv")) for s in range(150) for _ in range(2)})
    held = {}
    for s, k, x, y in rows:
        held.setdefault(s, {}).setdefault(k, (set(), set()))
        held[s][k][0].add(x), held[s][k][1].add(y)
    want, ids = set(), sorted(held)
    for a, b in zip(ids, ids[1:]):
        for k in held[a].keys() | held[b].keys():
            was, now = held[a].get(k), held[b].get(k)
            if was != now:
                fields = None if was is None or now is None else tuple(f for f, p, q in zip("xy", was, now) if p != q)
                want.add((b, k, "added" if was is None else "removed" if now is None else "changed", fields))
    got = snapshots.snapshot_changes(spark.createDataFrame(rows, "s string, k string, x string, y string"), "s", ["k"], ["x", "y"]).collect()
    assert {(r["snapshot_id"], r["k"], r["change_kind"], r["changed_fields"] and tuple(r["changed_fields"])) for r in got} == want


def test_change_classes_make_the_history(spark):
    rows = [("k", 1, "a", False), ("k", 2, "a", False), ("k", 3, "b", False), ("k", 4, None, True), ("k", 5, None, True), ("k", 6, "b", False), (None, 1, None, False)]
    got = {(r["k"], r["n"]): r["change"] for r in history.difference_consecutive(spark.createDataFrame(rows, "k string, n int, v string, gone boolean"), ["k"], "n", ["v"], absent="gone").collect()}
    assert got == {("k", 1): "inserted", ("k", 2): "unchanged", ("k", 3): "changed", ("k", 4): "deleted", ("k", 5): "unchanged", ("k", 6): "inserted", ("k", 7): "deleted", (None, 1): "inserted", (None, 2): "deleted"}


def test_as_known_edges(spark):
    m = spark.createDataFrame([("1", "Ab", "2025-01-01T00:00:00Z", None), ("1", "Ab", "2025-01-01T07:00:00+07:00", None), ("2", "aB", "2025-02-01T00:00:00Z", "1"), ("3", None, "2025-01-01T00:00:00Z", None), ("4", "c", "unknown", None)], "i string, mention string, av string, sup string")
    p = asof.decision_periods(m, "i", "mention", "av", "sup")
    e = spark.createDataFrame([("x", "AB", us(2025, 1, 1)), ("y", "ab", us(2025, 2, 1) - 1), ("z", "ab", us(2025, 2, 1)), ("late", "ab", us(2200, 1, 1)), ("early", "ab", us(1990, 1, 1)), ("n", None, us(2025, 1, 1)), ("m", "ab", None)], "e string, mention string, at long")
    assert {(r["e"], r["id"]) for r in asof.join_as_known(e, "mention", "at", p).collect()} == {("x", "1"), ("y", "1"), ("z", "2"), ("late", "2")}


def test_lineage_roots(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "a")]
    got = {r["k"]: (r["root"], r["depth"]) for r in history.lineage_roots(spark.createDataFrame(rows, "k string, p string"), "k", "p").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0), "x": (None, None), "y": (None, None), "z": (None, None), "s": (None, None)}
    assert history.lineage_roots(spark.createDataFrame([], "k string, p string"), "k", "p").count() == 0


def test_history_of_full_snapshots(spark):
    rows = [("T1", "a", 1), ("T2", "a", 1), ("T3", "a", 2), ("T1", "b", 1), ("T3", "b", 1), ("T2", None, None), (None, "q", 1)]
    got = {tuple(r) for r in history.snapshot_history(spark.createDataFrame(rows, "s string, k string, v int"), ["k"], "s", ["v"]).select("k", "v", "valid_from", "valid_to").collect()}
    assert got == {("a", 1, "T1", "T3"), ("a", 2, "T3", None), ("b", 1, "T1", "T2"), ("b", 1, "T3", None), (None, None, "T2", "T3")}
