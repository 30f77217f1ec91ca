"""Queries p1, p3, p4, p5 and p7 over the domain tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import mappings_as_known
from ..operators.history import snapshot_history, version_history
from ..operators.orphans import REFERENCES, count_orphans, orphans_of
from ..operators.snapshots import snapshot_changes
from ..operators.timestamps import normalise_timestamps
from ..runtime import load
from ..sources.bindings import version_instants

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return version_history(load(spark, d, "fact_versions"))


def p1_edge_history(spark: SparkSession, d: str) -> DataFrame:
    """The history of full snapshots: each edge with the snapshots between which it stood."""
    edges = load(spark, d, "snapshot_edges").withColumn("present", F.lit(1))
    return snapshot_history(edges, ["subject_id", "relation_id", "object_id"], "snapshot_id", ["present"]).drop("present")


def _reference_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: load(spark, d, t) for t in {x for r in REFERENCES for x in (r.child, r.parent)}}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans_of(_reference_tables(spark, d), deletions=load(spark, d, "record_deletions")).select("child_table", "ref_field", "record_id")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_orphans(_reference_tables(spark, d), deletions=load(spark, d, "record_deletions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    times = normalise_timestamps(load(spark, d, "document_times"), "document_time_id", "observed_at", "source_id", "basis", "ingested_at_real", load(spark, d, "publisher_zones"))
    both = times.select(F.lit("document_times").alias("rec_table"), F.col("document_time_id").alias("record_id"), F.col("us").alias("instant_us"))
    facts = version_instants(spark, d).select(F.lit("fact_versions").alias("rec_table"), F.col("fact_version_id").alias("record_id"), F.col("us").alias("instant_us"))
    return both.unionByName(facts).filter("record_id is not null and instant_us is not null").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_changes(spark, d).drop("changed_fields")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(load(spark, d, "snapshot_edges"), "snapshot_id", ["subject_id", "relation_id"], ["object_id"]).withColumn("changed_fields", F.array_join("changed_fields", ","))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mappings_as_known(load(spark, d, "fact_versions"), version_instants(spark, d).distinct(), load(spark, d, "entity_mapping_versions"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_edge_history, p3_found, p3_counts, p4_found, p5_found, p5_changes, p7_found)}

_V = """
v AS (SELECT fact_version_id, min(logical_fact_id) AS logical_fact_id, min(supersedes_version_id) AS sup, min(revision_type) AS rt,
             coalesce(min(CAST(valid_from AS timestamptz)), '-infinity'::timestamptz) AS s, min(CAST(valid_to AS timestamptz)) AS e
      FROM fact_versions GROUP BY 1),
kept AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.sup = v.fact_version_id AND w.fact_version_id <> v.fact_version_id AND w.logical_fact_id = v.logical_fact_id AND w.s <= v.s)),
n AS (SELECT *, lead(s) OVER (PARTITION BY logical_fact_id ORDER BY s, fact_version_id) AS nxt FROM kept)"""

_ORPHANS = " UNION ALL ".join(
    f"""SELECT '{r.child}' AS child_table, '{r.field}' AS ref_field, c.record_id, c.at AS seen_at,
       (x.key IS NULL OR x.key IN (SELECT record_id FROM record_deletions WHERE table_name = '{r.parent}' AND record_id IS NOT NULL) OR x.at > c.at) AND c.ref IS NOT NULL AND trim(c.ref) <> '' AS orphan
FROM (SELECT {r.record} AS record_id, arg_min({r.field}, ingested_at_real) AS ref, min(ingested_at_real) AS at FROM {r.child} GROUP BY 1) c
LEFT JOIN (SELECT {r.key} AS key, min(CAST(ingested_at_real AS timestamptz) AT TIME ZONE 'UTC') AS at FROM {r.parent} GROUP BY 1) x ON x.key = c.ref"""
    for r in REFERENCES
)

_CHANGES = """
WITH d AS (SELECT DISTINCT snapshot_id, subject_id, relation_id, object_id FROM snapshot_edges WHERE snapshot_id IS NOT NULL),
g AS (SELECT snapshot_id, subject_id, relation_id, list_sort(list(object_id)) AS objects FROM d GROUP BY ALL),
ids AS (SELECT snapshot_id, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS nxt FROM (SELECT DISTINCT snapshot_id FROM g)),
a AS (SELECT nxt AS snapshot_id, subject_id, relation_id, objects FROM g JOIN ids USING (snapshot_id) WHERE nxt IS NOT NULL),
b AS (SELECT * FROM g WHERE snapshot_id <> (SELECT min(snapshot_id) FROM ids)),
j AS (SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(a.relation_id, b.relation_id) AS relation_id, a.objects AS x, b.objects AS y
      FROM a FULL JOIN b ON a.snapshot_id = b.snapshot_id AND a.subject_id = b.subject_id AND a.relation_id = b.relation_id)
SELECT snapshot_id, subject_id, relation_id, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS change_kind"""

# In the tables every numeric date belongs to a publisher with a declared order, so that its reading is known here without a path.
_BASES = "['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%dt%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%d %b %Y %H:%M:%S', '%b %d, %Y %I:%M %p']"
_ORDERED = {o: "[" + ", ".join(f"'{f.replace('D', d)}'" for d in ds for f in ("D %H:%M", "D %H:%M:%S", "D, %H:%M", "D %I:%M %p", "%H:%M D")) + "]" for o, ds in (("mdy", ("%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y")), ("dmy", ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y")))}
_INSTANTS = rf"""z AS (SELECT source_id, zone_name, date_order, std_abbrev, dst_abbrev, epoch(TIMESTAMP '2025-01-15') - epoch(timezone(zone_name, TIMESTAMP '2025-01-15')) AS o1, epoch(TIMESTAMP '2025-07-15') - epoch(timezone(zone_name, TIMESTAMP '2025-07-15')) AS o7 FROM publisher_zones),
raw AS (SELECT 'document_times' AS rec_table, document_time_id AS record_id, observed_at AS v, source_id, basis FROM document_times UNION ALL SELECT 'fact_versions', fact_version_id, evidence_observed_at, source_id, evidence_time_basis FROM fact_versions),
a AS (SELECT rec_table, record_id, basis, z.*, regexp_replace(v, '^\s+|\s+$', '', 'g') AS s FROM raw LEFT JOIN z ON raw.source_id = z.source_id WHERE v IS NOT NULL),
b AS (SELECT *, contains(s, '[') AS bracket, regexp_replace(regexp_replace(s, '\[[^\]]+\]$', ''), '^[^\d,]+, ', '') AS s2 FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(s2, '\(GMT[+-]') THEN regexp_extract(s2, '\(GMT([+-]\d+(?::\d+)?)\)$', 1) WHEN regexp_matches(s2, ':\d\d(?:[.,]\d+)?\s*[+-]\d\d(?::?\d\d)?$') THEN regexp_extract(s2, '([+-]\d\d(?::?\d\d)?)$', 1) WHEN regexp_matches(s2, '\d[zZ]$') THEN '+0' END AS num, regexp_extract(s2, ' ([A-Z]{{3,5}})$', 1) AS abbr,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(s2, '\s*\(GMT[^)]*\)$', ''), '(:\d\d(?:[.,]\d+)?)\s*[+-]\d\d(?::?\d\d)?$', '\1'), '(\d)[zZ]$', '\1'), ' [A-Z]{{3,5}}$', '') AS s3 FROM b),
e AS (SELECT *, CAST(coalesce(rpad(nullif(substr(regexp_extract(s3, ':\d\d[.,](\d+)$', 1), 1, 6), ''), 6, '0'), '0') AS bigint) AS frac, regexp_replace(s3, '(:\d\d)[.,]\d+$', '\1') AS s4,
  CASE WHEN num IS NOT NULL THEN (CASE WHEN num LIKE '-%' THEN -60 ELSE 60 END) * (60 * CAST(regexp_extract(num, '^[+-](\d\d?)', 1) AS int) + coalesce(TRY_CAST(nullif(regexp_extract(num, '^[+-]\d\d?:?(\d\d)$', 1), '') AS int), 0)) WHEN abbr = std_abbrev THEN least(o1, o7) WHEN abbr = dst_abbrev THEN greatest(o1, o7) END AS off FROM c),
f AS (SELECT *, CASE WHEN regexp_full_match(s4, '\d{{14}}') THEN try_strptime(s4, '%Y%m%d%H%M%S') WHEN date_order = 'mdy' THEN coalesce(try_strptime(s4, {_BASES}), try_strptime(s4, {_ORDERED["mdy"]})) ELSE coalesce(try_strptime(s4, {_BASES}), try_strptime(s4, {_ORDERED["dmy"]})) END AS ts FROM e),
g AS (SELECT *, timezone(zone_name, ts) AS u FROM f),
inst AS (SELECT rec_table, record_id, CASE WHEN regexp_full_match(s, '\d{{10}}|\d{{13}}|\d{{16}}') THEN CAST(s AS bigint) * CAST(pow(10, 16 - length(s)) AS bigint) WHEN num IS NOT NULL OR abbr <> '' THEN epoch_us(ts) + frac - CAST(off AS bigint) * 1000000 WHEN bracket THEN NULL
  WHEN basis = 'wayback_archive_datetime' THEN epoch_us(ts) + frac WHEN timezone(zone_name, u - INTERVAL 1 HOUR) = ts THEN epoch_us(u) - 3600000000 + frac ELSE epoch_us(u) + frac END AS us FROM g)"""

SQL: dict[str, str] = {
    "p4_found": f"WITH {_INSTANTS} SELECT DISTINCT rec_table, record_id, us AS instant_us FROM inst WHERE us IS NOT NULL AND record_id IS NOT NULL",
    "p7_found": f"""WITH {_INSTANTS}, m AS (SELECT entity_mapping_id AS id, lower(mention) AS k, min(epoch_us(CAST(mapping_available_at AS timestamptz))) AS av, min(supersedes_mapping_id) AS sup FROM entity_mapping_versions WHERE mention IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT DISTINCT fact_version_id, unnest(['subject', 'object']) AS endpoint, lower(unnest([subject_id, object_id])) AS k, us FROM fact_versions JOIN inst ON rec_table = 'fact_versions' AND record_id = fact_version_id WHERE us IS NOT NULL),
h AS (SELECT fact_version_id, endpoint, us, id, av FROM ev JOIN m ON ev.k = m.k AND av <= us WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.k = m.k AND o.sup = m.id AND o.id <> m.id AND o.av <= us))
SELECT DISTINCT fact_version_id, endpoint, arg_min(id, {{'a': -av, 'b': id}}) AS entity_mapping_id FROM h GROUP BY fact_version_id, endpoint, us""",
    "p1_found": f"""WITH {_V}
SELECT logical_fact_id, fact_version_id,
  CASE WHEN s = '-infinity'::timestamptz THEN '' ELSE strftime(s AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS period_start,
  coalesce(strftime(least(e, nxt) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '') AS period_end
FROM n WHERE rt <> 'retraction' AND (least(e, nxt) IS NULL OR least(e, nxt) > s)""",
    "p1_edge_history": """
WITH d AS (SELECT DISTINCT snapshot_id, subject_id, relation_id, object_id FROM snapshot_edges WHERE snapshot_id IS NOT NULL),
ids AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS n, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS nxt FROM (SELECT DISTINCT snapshot_id FROM d)),
r AS (SELECT d.*, n, nxt, n - row_number() OVER (PARTITION BY subject_id, relation_id, object_id ORDER BY n) AS island FROM d JOIN ids USING (snapshot_id))
SELECT subject_id, relation_id, object_id, min(snapshot_id) AS valid_from, nullif(arg_max(coalesce(nxt, ''), n), '') AS valid_to FROM r GROUP BY subject_id, relation_id, object_id, island""",
    "p3_found": f"SELECT child_table, ref_field, record_id FROM ({_ORPHANS}) WHERE orphan",
    "p3_counts": f"SELECT child_table, ref_field, strftime(seen_at, '%Y-%m') AS period, count(*) AS records, CAST(sum(orphan::int) AS bigint) AS orphans FROM ({_ORPHANS}) GROUP BY 1, 2, 3",
    "p5_found": f"{_CHANGES} FROM j WHERE x IS DISTINCT FROM y",
    "p5_changes": f"{_CHANGES}, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 'object_id' END AS changed_fields FROM j WHERE x IS DISTINCT FROM y",
}
